"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where the
    session has none, a folder of its own is set, which only a local master may
    use."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(found)
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidelog-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again: cuts the
    lineage, outlives lost executors, is removed when the session's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}-{label}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def addressed(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of each row and ``_row``, which no other row has and which is the same
    whenever the rows are read again: a row's file and place in it, where ``docs`` is a scan
    of files without more than a selection; anything else is written first."""
    node = docs._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    if node.nodeName().startswith("LogicalRelation"):
        place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
        return docs.select(*columns, place.alias("_row"))
    place = F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("at"))
    return staged(docs.select(*columns, place.alias("_row")), "rows")


def ascii_lower(col: Column) -> Column:
    """A-Z lower-cased and nothing else. ``lower`` does just that to a text that
    is ASCII throughout, at a multiple of the speed of ``translate``."""
    return F.when(F.length(col) == F.octet_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, UPPER.lower()))


def carrying(docs: DataFrame, carry: tuple[str, ...]) -> tuple[list[Column], list[Column]]:
    """Columns that pass through an operator: as they go in, under names of their own, and as they come out."""
    return [F.col(c).alias(f"_carried{i}") for i, c in enumerate(carry)], [F.col(f"_carried{i}").alias(c) for i, c in enumerate(carry)]


#: What empties the caches of each operator in a worker process.
_emptied: dict[str, Callable[[], None]] = {}


def alone(owner: str, empty: Callable[[], None]) -> None:
    """Called where an operator begins to work in a worker, which is used again for others: only
    one operator at a time remembers words there, so that what is remembered doesn't add up."""
    others = [empty_other for name, empty_other in _emptied.items() if name != owner]
    if others:
        import gc

        import pyarrow

        for empty_other in others:
            empty_other()
        gc.collect()
        pyarrow.default_memory_pool().release_unused()
    _emptied.clear()
    _emptied[owner] = empty
