"""Streams against the same over a batch."""

from datetime import datetime, timedelta

import duckdb
from pyspark.sql import functions as F

from tidelog.model import CREATE, DELETE, MODIFY
from tidelog.oracle import ORACLE
from tidelog.queries import QUERIES
from tidelog.session import PLAIN, STORE
from tidelog.streaming import capture, lifecycle

NOON = datetime(2024, 1, 1, 12)


def drained(spark, stream, tmp_path, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"cp-{name}")).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def with_sql(spark, tmp_path, query, table, rows, schema):
    """What a query of the catalogue and its SQL make of a table, in a session with Spark's default state store."""
    (tmp_path / "sf").mkdir(exist_ok=True)
    at = str(tmp_path / "sf" / f"{table}.parquet")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(at)
    own = spark.conf.get(STORE)
    spark.conf.set(STORE, PLAIN)
    try:
        got = QUERIES[query](spark, str(tmp_path / "sf"))
        assert spark.conf.get(STORE) == PLAIN
    finally:
        spark.conf.set(STORE, own)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{at}/*.parquet'")
    want = con.execute(ORACLE[query])
    names = [d[0] for d in want.description]
    return sorted(tuple(r[n] for n in names) for r in got.collect()), sorted(want.fetchall())


def test_captured_without_a_setting_for_the_state(spark, tmp_path):
    rows = [(1, 0, "user", "one"), (1, 1, "user", "one and two"), (1, 2, "user", "one and two"), (2, 0, "user", ""), (2, 1, "user", "x"), (3, 0, "user", None)]
    got, want = with_sql(spark, tmp_path, "stream_captured", "conversations", rows, "conv_id bigint, turn bigint, role string, text string")
    assert got == want and len(got) == 5


def test_debounced_ties_and_gaps_that_the_watermark_has_not_passed(spark, tmp_path):
    """Of two events of one second the first closes, whatever order they come in; a session that a gap
    ends stays open until the watermark passes it."""
    at = lambda hours, ms=0: NOON + timedelta(hours=hours, milliseconds=ms)
    events = [(9, at(0, 900), 1, "view"), (8, at(0, 950), 1, "purchase"), (7, at(0, 100), 2, "view"), (6, at(0, 900), 2, "error"), (10, at(20), 3, "view"), (11, at(27), 3, "error"), (12, at(27, 5000), 4, "view")]
    rows = [(i, t, u, k, 1.0, "{}") for i, t, u, k in events]
    got, want = with_sql(spark, tmp_path, "stream_debounced", "events", rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string")
    assert got == want and len(got) == 3


def test_debounced_keeps_sessions_that_a_late_event_joins(spark, tmp_path):
    """Two sessions of one batch, joined by an event of the next one; times don't depend on the time zone."""
    schema, own = "path string, ts timestamp, kind string", spark.conf.get("spark.sql.session.timeZone")
    ms = lambda n: NOON + timedelta(milliseconds=n)
    for rows in ([("a", ms(0), "modify"), ("a", ms(300), "modify")], [("a", ms(150), "modify")], [("z", ms(3_600_000), "modify")]):
        write(spark.createDataFrame(rows, schema), tmp_path / "in")
    base = int(spark.createDataFrame([(NOON,)], "t timestamp").select(F.unix_millis("t")).first()[0])
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        got = drained(spark, capture.debounced(stream, 200), tmp_path, "joined")
    finally:
        spark.conf.set("spark.sql.session.timeZone", own)
    assert [(r["path"], r["first_ms"] - base, r["last_ms"] - base, r["n"], r["event_type"]) for r in got] == [("a", 0, 300, 3, MODIFY)]


def test_a_drained_stream_is_in_files(spark):
    """Not in the driver's memory, whatever the number of sessions."""
    assert QUERIES["stream_sessions"](spark, "/root/testdata/sf0.001").inputFiles()


def write(df, path):
    df.coalesce(1).write.mode("append").parquet(str(path))


def test_debounce_with_early_close(spark, tmp_path):
    """Gaps, a closing event, and deletions that end a session or are overridden."""
    events = [("a", 0, "modify"), ("a", 150, "modify"), ("a", 350, "modify"), ("a", 551, "modify"), ("b", 0, "modify"), ("b", 100, "close"), ("b", 150, "create"), ("c", 0, "create"), ("c", 10, "delete"), ("c", 20, "moved_to")]
    schema = "path string, ts timestamp, kind string"
    write(spark.createDataFrame([(p, NOON + timedelta(milliseconds=t), k) for p, t, k in events], schema), tmp_path / "in")
    write(spark.createDataFrame([("z", NOON + timedelta(hours=1), "modify")], schema), tmp_path / "in")
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    base = int(spark.sql(f"SELECT unix_millis(timestamp'{NOON}')").first()[0])
    rows = [(r["path"], r["first_ms"] - base, r["last_ms"] - base, r["n"], r["event_type"]) for r in drained(spark, capture.debounced(read()), tmp_path, "sessions")]
    want = [("a", 0, 350, 3, MODIFY), ("a", 551, 551, 1, MODIFY), ("b", 0, 100, 2, MODIFY), ("b", 150, 150, 1, MODIFY), ("c", 0, 10, 2, DELETE), ("c", 20, 20, 1, MODIFY)]
    assert sorted(r for r in rows if r[0] != "z") == want
    batch = spark.createDataFrame([(p, t * 1000, i, k) for i, (p, t, k) in enumerate(events)], "path string, ts_us long, seq int, kind string")
    same = capture.islands(batch, 200_000, F.col("kind").isin(*capture.CLOSES)).collect()
    assert sorted((r["path"], r["first_us"] // 1000, r["last_us"] // 1000, r["n"]) for r in same) == [w[:4] for w in want]


def test_sessions_of_a_stream(spark, tmp_path):
    schema = "path string, ts timestamp"
    write(spark.createDataFrame([("a", NOON), ("a", NOON + timedelta(milliseconds=150)), ("a", NOON + timedelta(seconds=5))], schema), tmp_path / "in")
    write(spark.createDataFrame([("z", NOON + timedelta(hours=1))], schema), tmp_path / "in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("ts", "1 second")
    got = drained(spark, capture.sessions(stream), tmp_path, "windows")
    assert sorted(r["n"] for r in got if r["path"] == "a") == [1, 2]


def test_capture_from_an_initial_state(spark, tmp_path):
    """A file with history is anchored anew when it changes; one without shows its first content, too."""
    schema = "path string, ts_ns bigint, content binary"
    write(spark.createDataFrame([("old", 5, b"x"), ("old", 6, b"changed"), ("base", 5, b"now"), ("same", 5, b"s"), ("new", 5, b"n")], schema), tmp_path / "in")
    initial = spark.createDataFrame([("old", b"x", True), ("base", b"was", False), ("same", b"s", False)], "path string, content binary, has_history boolean")
    rows = drained(spark, capture.captured(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 1, initial), tmp_path, "captured_from")
    got = sorted((r["path"], r["ts_ns"], r["event_type"], r["reason"]) for r in rows)
    assert got == [("base", 1, CREATE, "original"), ("base", 5, got[1][2], got[1][3]), ("new", 5, CREATE, "new"), ("old", 6, CREATE, "reanchored")] and got[1][3] in ("changed", "rewritten")


def test_capture_of_many_rows_of_one_path(spark, tmp_path):
    """More rows than come in one piece, last ones first."""
    schema, n = "path string, ts_ns bigint, content binary", 25_000
    rows = spark.range(n).select(F.lit("a").alias("path"), (F.lit(n) - F.col("id")).alias("ts_ns"), F.when((F.lit(n) - F.col("id")) % 2 == 0, F.lit(b"even")).otherwise(F.lit(b"odd")).alias("content"))
    write(rows, tmp_path / "in")
    got = drained(spark, capture.captured(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), tmp_path, "captured_many")
    assert len(got) == n and sorted(r["ts_ns"] for r in got) == list(range(1, n + 1)) and sum(r["event_type"] == CREATE for r in got) == 1


def test_running_totals(spark, tmp_path):
    schema = "repo string, delta_size bigint"
    write(spark.createDataFrame([("a", 1), ("a", 2), ("b", 5)], schema), tmp_path / "in")
    got = drained(spark, capture.running_totals(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), tmp_path, "totals", "complete")
    assert sorted(map(tuple, got)) == [("a", 2, 3), ("b", 1, 5)]


def test_enriched_and_settled(spark):
    events = spark.createDataFrame([("a", 1), ("gone", 2)], "path string, ts_ns bigint")
    contents = spark.createDataFrame([("a", b"x")], "path string, content binary")
    assert {(r["path"], r["content"] and bytes(r["content"])) for r in capture.enriched(events, contents).collect()} == {("a", b"x"), ("gone", None)}
    reads = spark.createDataFrame([("a", 1, 5, 5, 7, 7), ("b", 2, 5, 6, 7, 7), ("c", 3, 5, 5, 7, 8)], "path string, ts_ns bigint, size bigint, size_after bigint, mtime bigint, mtime_after bigint")
    still, again = capture.settled(reads)
    assert [r["path"] for r in still.collect()] == ["a"] and sorted(map(tuple, again.collect())) == [("b", 2, MODIFY), ("c", 3, MODIFY)]


def test_repos_start_stop_and_recover(spark, tmp_path):
    schema, seen = "path string, digest string", []
    for name in ("one", "two"):
        write(spark.createDataFrame([("a", "1"), ("b", "2")], schema), tmp_path / name)
    repos = lifecycle.Repos(spark, str(tmp_path / "cps"))
    current = lambda: spark.createDataFrame([("a", "1"), ("b", "0"), ("c", "3")], schema)
    sink = lifecycle.reconciling(current, lambda found: seen.append(sorted(map(tuple, found.collect()))))
    source = lambda name: lambda: spark.readStream.schema(schema).parquet(str(tmp_path / name))
    for name in ("one", "two"):
        repos.start(name, source(name), sink, processingTime="100 milliseconds").processAllAvailable()
    assert seen == [[("b", MODIFY), ("c", DELETE)]] * 2 and sorted(repos.running()) == ["one", "two"]
    repos.stop("one")
    assert [(n, on) for n, on, _ in repos.progress()] == [("one", False), ("two", True)]
    write(spark.createDataFrame([("a", "1"), ("b", "0"), ("c", "3")], schema), tmp_path / "one")
    assert repos.recover() == ["one"]
    repos.running()["one"].processAllAvailable()
    assert seen[-1] == [] and len(seen) == 3  # what was read before isn't read again
    for name in ("one", "two"):
        repos.remove(name)
    assert not repos.running() and repos.progress() == []
    assert lifecycle.ticks(spark).isStreaming
