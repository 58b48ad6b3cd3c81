"""Every query of the catalogue against its SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from tidelog.oracle import ORACLE
from tidelog.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(frame):
    cols = sorted(frame.columns)
    text = frame[cols].astype(object).where(frame[cols].notna(), None).map(lambda v: str(int(v)) if isinstance(v, float) and v == int(v) else str(v))
    return cols, sorted(map(tuple, text.values.tolist()))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    assert plain(QUERIES[name](spark, SF).toPandas()) == plain(duck.execute(ORACLE[name]).fetchdf())


def test_every_query_is_registered():
    assert set(QUERIES) <= set(entry.queries())
    assert set(ORACLE) <= set(QUERIES)


def test_anchor_pruning_changes_nothing(spark):
    from tidelog.operators.temporal import VersionLog
    from tidelog.queries import T
    from tidelog.views import vlog

    log = VersionLog(vlog(spark, SF))
    assert sorted(log.state_at(T).select("path", "state").collect()) == sorted(log.state_at(T, prune=False).select("path", "state").collect())
