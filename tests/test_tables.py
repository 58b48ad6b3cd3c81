"""Side tables, exports, sealed logs and keys, over files."""

import pytest
from pyspark.sql import functions as F

from tidelog.functions import codec
from tidelog.model import CREATE, DELETE, MODIFY
from tidelog.operators import blocks, joins
from tidelog.operators.temporal import VersionLog
from tidelog.sources import segments, tables

LOG = "repo string, path string, ts_ns bigint, seq bigint, event_type int, file_size bigint, payload binary"


def test_tags_append_and_last_one_wins(spark, tmp_path):
    at = str(tmp_path / "tags")
    for name, ts in (("v1", 5), ("v2", 6), ("v1", 9), ("odd\tname", 7)):
        tables.append_tag(spark, at, name, ts)
    got = tables.read_tags(spark, at)
    assert sorted((r["name"], r["ts_ns"]) for r in got.collect()) == [("odd name", 7), ("v1", 5), ("v1", 9), ("v2", 6)]
    assert {r["name"]: r["ts_ns"] for r in joins.latest_tags(got).collect()}["v1"] == 9


def test_annotations(spark, tmp_path):
    at = str(tmp_path / "notes")
    tables.append_annotations(spark.createDataFrame([(1, "a", "first\ttab\nline"), (2, "b", "x")], "ts_ns bigint, path string, summary string"), at)
    tables.append_annotations(spark.createDataFrame([(1, "a", "later")], "ts_ns bigint, path string, summary string"), at)
    notes = tables.read_annotations(spark, at)
    assert notes.count() == 3
    log = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "ts_ns bigint, path string")
    assert {r["path"]: r["summary"] for r in joins.annotated(log, notes).collect()} == {"a": "first tab line", "b": "x", "c": None}


def test_patterns_persist(spark, tmp_path):
    at = str(tmp_path / "excludes")
    rows = lambda *p: spark.createDataFrame([(x,) for x in p], "pattern string")
    tables.write_patterns(rows("build", "*.log", "build"), at)
    tables.write_patterns(tables.add_patterns(tables.read_patterns(spark, at), rows("# no", "x/")), at)
    tables.write_patterns(tables.remove_patterns(tables.read_patterns(spark, at), rows("*.log")), at)
    assert sorted(r["pattern"] for r in tables.read_patterns(spark, at).collect()) == ["build", "x/"]


def test_repos_baseline_status(spark, tmp_path):
    repos = [("/a", None), ("/b", "only.txt")]
    tables.write_repos(spark.createDataFrame(repos, "root string, file_filter string"), str(tmp_path / "repos"))
    assert sorted(map(tuple, tables.read_repos(spark, str(tmp_path / "repos")).collect())) == repos
    at = str(tmp_path / "baseline")
    tables.write_baseline(spark.createDataFrame([("a.txt",), ("sub/b",)], "path string"), at)
    assert sorted(r["path"] for r in tables.read_baseline(spark, at).collect()) == ["a.txt", "sub/b"]
    with pytest.raises(Exception, match="exist"):
        tables.write_baseline(spark.createDataFrame([("c",)], "path string"), at)
    status = [("/a", 3, 100, 2, 0)]
    for _ in range(2):
        tables.write_status(spark.createDataFrame(status, "root string, deltas bigint, bytes bigint, files bigint, lost bigint"), str(tmp_path / "status"))
    assert list(map(tuple, tables.read_status(spark, str(tmp_path / "status")).collect())) == status


def test_walk_restore_and_exports(spark, tmp_path):
    state = spark.createDataFrame([("r", "a.txt", b"one\ntwo\n"), ("r", "sub/b c", b""), ("r", "x/build/o", b"q"), ("r", "n.o", b"q")], "repo string, path string, content binary")
    tables.restore(state, str(tmp_path / "out"))
    found = {r["path"]: (r["size"], bytes(r["content"])) for r in tables.walk(spark, str(tmp_path / "out"), ["build"]).collect()}
    assert found == {"a.txt": (8, b"one\ntwo\n"), "sub/b c": (0, b"")}
    versions = spark.createDataFrame([("a/b", 100, 1, b"v1"), ("a_b", 100, 1, b"w1"), ("a/b", 200, 2, None)], "path string, ts_ns bigint, seq bigint, content binary")
    tables.export_versions(versions, str(tmp_path / "dump"))
    assert sorted(p.read_bytes() for p in (tmp_path / "dump" / "files").rglob("v*")) == [b"v1", b"w1"]
    tables.export_diffs(spark.createDataFrame([("a", 5, 2, "x\ny\n", "x\nz\n")], "path string, ts_ns bigint, seq bigint, old string, new string"), str(tmp_path / "dump"))
    (diff,) = (tmp_path / "dump" / "diffs").rglob("*.diff")
    assert diff.name == "v000002_5.diff" and diff.read_text().splitlines()[3:] == [" x", "-y", "+z"]
    log = VersionLog(spark.createDataFrame([("r", "p", 100, 1, CREATE, 3, 3), ("r", "p", 200, 2, DELETE, 0, 0)], "repo string, path string, ts_ns bigint, seq bigint, event_type int, delta_size bigint, file_size bigint"))
    tables.write_manifest(log.manifest(), str(tmp_path / "manifest"))
    back = spark.read.option("sep", "\t").option("header", "true").csv(str(tmp_path / "manifest"))
    assert back.columns == ["path", "ts_ns", "seq", "event", "size", "version_file"] and {r["event"] for r in back.collect()} == {"CREATE", "DELETE"}


def test_prune_keeps_what_is_excluded(spark):
    rows = [("r", p, 100, i, CREATE, 1, 1) for i, p in enumerate(("old", "new", "new.log", "new.o", "build/x"))]
    log = VersionLog(spark.createDataFrame(rows, "repo string, path string, ts_ns bigint, seq bigint, event_type int, delta_size bigint, file_size bigint"))
    assert [r["path"] for r in log.to_prune(spark.createDataFrame([("r", "old")], "repo string, path string"), ["*.log", "build"]).collect()] == ["new"]


def test_bad_segments_are_counted(spark, tmp_path):
    spark.dataSource.register(segments.SegmentSource)
    rows = [(f"p{i}", 100 + i, CREATE, 3, b"abc") for i in range(5)]
    spark.createDataFrame(rows, "path string, ts_ns bigint, event_type int, file_size bigint, payload binary").coalesce(1).write.format("segments").option("path", str(tmp_path)).mode("append").save()
    (good,) = tmp_path.glob("*.ttd")
    (tmp_path / f"{10**18:020d}.ttd").write_bytes(good.read_bytes()[:-2])
    (tmp_path / f"{10**18 + 1:020d}.ttd").write_bytes(b"not a segment at all")
    (tmp_path / f"{10**18 + 2:020d}.ttd").write_bytes(b"x")
    got = {(r["fault"], r["n_records"], r["torn_bytes"]) for r in segments.segment_report(spark, str(tmp_path)).collect()}
    assert got == {(None, 5, 0), (None, 4, 28), ("magic", 0, 0), ("short", 0, 0)}
    read = segments.read_segments(spark, str(tmp_path))
    assert read.count() == 9 and [r["seq"] for r in read.orderBy("seq").collect()] == [*range(5), *(1 << 26 | i for i in range(4))]


def test_sealed_log(spark, tmp_path):
    rows = [("r", "p", 1, 1, CREATE, 3, b"abc"), ("r", "p", 2, 2, MODIFY, 4, b"delta"), ("r", "q", 1, 3, DELETE, 0, b"")]
    log = spark.createDataFrame(rows, LOG)
    key = codec.key_from("pw", b"0123456789abcdef", 1000)
    shut = segments.sealed(log, key)
    assert [r["delta_size"] for r in shut.orderBy("seq").collect()] == [31, 33, 0]
    spark.dataSource.register(segments.SegmentSource)
    shut.select("path", "ts_ns", "event_type", "file_size", "payload").coalesce(1).sortWithinPartitions("seq").write.format("segments").option("path", str(tmp_path)).mode("append").save()
    back = segments.read_segments(spark, str(tmp_path), "r", key)
    assert sorted((r["path"], r["ts_ns"], r["delta_size"], bytes(r["payload"])) for r in back.collect()) == [("p", 1, 3, b"abc"), ("p", 2, 5, b"delta"), ("q", 1, 0, b"")]
    for changed in (segments.opened(shut, b"k" * 32), segments.opened(shut.withColumn("path", F.concat("path", F.lit("x"))), key), segments.opened(shut.withColumn("file_size", F.col("file_size") + 1), key)):
        with pytest.raises(Exception, match="(?i)aes|decrypt|tag"):
            changed.collect()


def test_keys(spark):
    meta, key = codec.new_meta("secret", 10_000)
    assert len(meta) == codec.META_BYTES and codec.meta_fault(meta) is None and codec.unlock(meta, "secret") == key
    with pytest.raises(ValueError, match="password"):
        codec.unlock(meta, "other")
    assert codec.meta_fault(meta[:-1]) == "size" and codec.meta_fault(b"X" + meta[1:]) == "magic" and codec.meta_fault(meta[:9] + bytes(4) + meta[13:]) == "iterations"
    own = codec.seal_bytes(spark, b"r" * 32, key, b"repo.key")
    assert codec.open_bytes(spark, own, key, b"repo.key") == b"r" * 32 and own != codec.seal_bytes(spark, b"r" * 32, key, b"repo.key")


def test_equal_blocks_seal_alike(spark):
    files = spark.createDataFrame([("a", b"x" * 100 + b"y" * 100), ("b", b"x" * 100)], "path string, content binary")
    found = blocks.split(files, 100, digest=lambda c: F.unhex(F.sha2(c, 256)))
    key = codec.block_key(F.col("hash"), b"k" * 32)
    shut = found.withColumn("key", key).withColumn("data", codec.sealed_block(F.col("data"), F.col("key")))
    assert shut.select("data").distinct().count() == 2
    assert {bytes(r["x"]) for r in shut.select(codec.opened_block(F.col("data"), F.col("key")).alias("x")).collect()} == {b"x" * 100, b"y" * 100}
