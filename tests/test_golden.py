"""Small cases with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tidelog.functions import codec, format, paths, text, timeexpr
from tidelog.model import CREATE, CREATE_DEDUP, DELETE, MODIFY
from tidelog.operators import replay
from tidelog.operators.temporal import VersionLog
from tidelog.sources.segments import SegmentSource, read_segments
from tidelog.streaming import capture

SCHEMA = "repo string, path string, ts_ns bigint, seq bigint, event_type int, delta_size bigint, file_size bigint"


def one(spark, expr, *values, types=None):
    df = spark.createDataFrame([values], types or ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(expr(*(F.col(c) for c in df.columns)).alias("x")).first()["x"]


@pytest.fixture(scope="module")
def chain(spark):
    rows = [(100, CREATE, 3, 3), (200, MODIFY, 9, 6), (300, DELETE, 0, 0), (400, CREATE, 0, 0), (500, MODIFY, 7, 2)]
    return VersionLog(spark.createDataFrame([("r", "a.txt", t, i + 1, k, d, s) for i, (t, k, d, s) in enumerate(rows)], SCHEMA))


def test_versions_by_time_and_revision(chain):
    seqs = lambda df: [r["seq"] for r in df.collect()]
    assert seqs(chain.as_of(250)) == [2] and seqs(chain.as_of(300)) == [] and seqs(chain.as_of(99)) == [] and seqs(chain.as_of(400)) == [4]
    assert seqs(chain.undo_last()) == [4] and seqs(chain.nth(1)) == [1] and seqs(chain.nth(-1)) == [5] and seqs(chain.nth(99)) == [5] and seqs(chain.nth(-99)) == [] and seqs(chain.nth(0)) == []


def test_extlog(chain):
    rows = sorted(chain.extlog().collect(), key=lambda r: r["rev"])
    assert [r["size_change"] for r in rows] == [None, 3, None, 0, 2]
    assert [r["elapsed_ns"] for r in rows] == [None, 100, 100, 100, 100]
    assert [r["ratio_bp"] for r in rows] == [10000, 15000, 0, 0, 35000]
    assert [r["rev"] for r in chain.where(since=400).extlog().collect()] == [1, 2]


@pytest.mark.parametrize(("events", "collapsed", "left"), [("C" + "M" * 15, 1, 2), ("C" + "M" * 14, 0, 15), ("C" + "M" * 20 + "DC" + "MMM", 1, 7), ("5" + "M" * 15, 0, 16), ("C" + "M" * 8 + "DC" + "M" * 8, 0, 19)])
def test_compaction(spark, events, collapsed, left):
    kinds = {"C": CREATE, "M": MODIFY, "D": DELETE, "5": CREATE_DEDUP}
    log = VersionLog(spark.createDataFrame([("r", "p", 100 * i, i, kinds[e], 1, 50) for i, e in enumerate(events)], SCHEMA))
    assert log.compaction().count() == collapsed and log.compacted().count() == left


def test_changed_range(spark):
    for old, new, first, last in [("a\nb\nc\n", "a\nX\nc\n", 2, 2), ("a\nb\nc\n", "a\nb\nc\nd\n", 4, 4), ("", "a\nb\n", 1, 2), ("a\nb\n", "a\nb", 1, 1)]:
        assert tuple(one(spark, text.changed_range, old, new)) == (first, last)


def test_tags(spark):
    said = "int quantum_flux = 42; GALACTIC_ROUTER buffer buffer ab x1234567 xkcdmwp ñandu"
    assert one(spark, lambda c: text.top_tags(text.tokens(c)), said) == "#andu #galactic_router #quantum_flux"


def test_formats(spark):
    for n, want in [(0, "0 B"), (1023, "1023 B"), (1024, "1.0 KiB"), (1 << 20, "1.0 MiB"), (1 << 30, "1.00 GiB")]:
        assert one(spark, format.nbytes, n, types="n bigint") == want
    for s, want in [(59, "59s"), (60, "1m 0s"), (3600, "1h 0m 0s"), (90061, "1d 1h 1m 1s")]:
        assert one(spark, format.duration, s * timeexpr.NS, types="n bigint") == want


def test_sizes_halfway_round_as_in_c(spark):
    """To the even digit; what rounds up to a whole carries; no size gives none."""
    want = {1280: "1.2 KiB", 1792: "1.8 KiB", 806144: "787.2 KiB", (1 << 20) - 1: "1024.0 KiB", 5 << 18: "1.2 MiB", 9 << 27: "1.12 GiB", 11 << 27: "1.38 GiB", (1 << 31) - 1: "2.00 GiB", (1 << 63) - 1: "8589934592.00 GiB", -3: "-3 B", None: None}
    rows = spark.createDataFrame([(n,) for n in want], "n bigint")
    assert {r["n"]: r["size"] for r in rows.select("n", format.nbytes(F.col("n")).alias("size")).collect()} == want


def test_time_expressions():
    now = 1_000_000 * timeexpr.NS
    for expr, s in [("10 minutes ago", 999_400), ("-2 hours", 992_800), ("1 week", 395_200), ("999 weeks", 0), ("", 1_000_000), (None, 1_000_000)]:
        assert timeexpr.parse_time(expr, now) == s * timeexpr.NS
    assert timeexpr.parse_time("5 months", now) is None and timeexpr.parse_time("banana", now) is None
    assert timeexpr.resolve("tag:v1", now, {"v1": 5}).until == 5 and timeexpr.resolve("@7", now).until == 7 * timeexpr.NS and timeexpr.resolve("-3", now).revision == -3
    with pytest.raises(ValueError, match="neither"):
        timeexpr.resolve("banana", now)


def test_exclusions(spark):
    hit = lambda path, p: one(spark, lambda c: paths.excluded_by(c, p), path)
    assert [hit(p, "build") for p in ("build", "build/x", "a/build/x", "builder/x")] == [True, True, True, False]
    assert hit("a/b.log", "*.log") and hit(".log", "*.log")
    assert one(spark, paths.excluded_builtin, "a.o") and not one(spark, paths.excluded_builtin, ".o") and one(spark, paths.excluded_builtin, "x/.git/y")


def test_islands_with_closing_events(spark):
    rows = [("p", t * 1000, i, k) for i, (t, k) in enumerate([(0, "m"), (150, "m"), (350, "m"), (551, "m")])]
    df = spark.createDataFrame(rows, "path string, ts_us bigint, seq int, kind string")
    assert sorted(r["n"] for r in capture.islands(df, 200_000).collect()) == [1, 3]
    assert sorted(r["n"] for r in capture.islands(df.withColumn("kind", F.when(F.col("seq") == 1, "close").otherwise("m")), 200_000, F.col("kind") == "close").collect()) == [1, 1, 2]


def test_state_machine():
    kinds = lambda state, content: [m[1] for m in capture.step(state, content, 9, 1)[1]]
    assert kinds(None, b"x") == [CREATE]
    assert kinds((b"x", False, True), b"x") == [] and kinds((b"x", False, True), b"y") == [CREATE, MODIFY] and kinds((b"x", False, True), None) == []
    assert kinds((b"x", True, False), b"y") == [MODIFY] and kinds((b"x", True, False), b"") == [CREATE] and kinds((b"x", True, False), None) == [DELETE]
    assert kinds((b"x", False, False), b"x") == [] and kinds((b"x", False, False), b"y") == [CREATE]


def test_delta_round_trip():
    for old, new in [(b"", b""), (b"abc", b""), (b"", b"abc"), (b"abcdefghijkl" * 9, b"abcdefXhijkl" * 9), (b"x" * 3000, b"y" + b"x" * 2999)]:
        assert codec.delta_decode_bytes(old, codec.delta_encode_bytes(old, new)) == new


def test_segments_round_trip(spark, tmp_path):
    spark.dataSource.register(SegmentSource)
    rows = [(f"p{i % 3}", 100 + i, CREATE, 3, b"abc") for i in range(20)]
    spark.createDataFrame(rows, "path string, ts_ns bigint, event_type int, file_size bigint, payload binary").coalesce(1).write.format("segments").option("path", str(tmp_path)).option("most", "200").mode("append").save()
    (tmp_path / f"{10**18:020d}.ttd").write_bytes(b"not a segment")
    for got in (spark.read.format("segments").option("path", str(tmp_path)).load(), read_segments(spark, str(tmp_path))):
        assert sorted((r["path"], r["ts_ns"], r["event_type"], r["file_size"], bytes(r["payload"])) for r in got.collect()) == sorted(rows)
    assert len(list(tmp_path.glob("*.ttd"))) > 2


def test_replay_names_the_first_fault(spark):
    rows = [("r", "p", 1, 1, CREATE, 2, b"ab"), ("r", "p", 2, 2, MODIFY, 9, codec.delta_encode_bytes(b"ab", b"abc")), ("r", "p", 3, 3, CREATE, 1, b"x"), ("r", "q", 1, 4, MODIFY, 1, b"")]
    log = spark.createDataFrame(rows, "repo string, path string, ts_ns bigint, seq bigint, event_type int, file_size bigint, payload binary")
    assert {r["seq"]: r["fault"] for r in replay.versions(log).collect()} == {1: None, 2: "size", 3: None, 4: "no base"}


def test_captured_stream_equals_batch(spark, tmp_path):
    rows = [("a", 1, b"x"), ("a", 2, b"y"), ("b", 1, b"q"), ("a", 3, None), ("b", 2, b"q")]
    df = spark.createDataFrame(rows, "path string, ts_ns bigint, content binary")
    df.write.parquet(str(tmp_path / "in"))
    stream = capture.captured(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("captured").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("captured").collect())) == sorted(map(tuple, capture.captured_batch(df).collect()))


def test_described_changes(spark):
    long = "y words\n" * 3000
    pairs = [("a\nb\nc\n", "a\nquantum_flux x\nc\n"), ("", "orange window here\n"), ("gone window remain", ""), ("a\x00b", "binary window"), ("same\n", "same\n"), ("x\n" * 3000, long)]
    rows = text.described(spark.createDataFrame(pairs, "old string, new string")).collect()
    got = {r["old"]: (tuple(r["range"]), r["lines"], r["tags"]) for r in rows}
    assert got["a\nb\nc\n"] == ((2, 2), "quantum_flux x", "#quantum_flux") and got[""] == ((1, 1), "orange window here", "#here #orange #window")
    assert got["gone window remain"][2] == "#gone #remain #window" and got["a\x00b"][2] == "" and got["same\n"] == ((1, 1), "same", "#same")
    assert got["x\n" * 3000] == ((1, 3000), "\n".join(["y words"] * (8192 // 8)), "#words")
    for r in rows:
        assert tuple(one(spark, text.changed_range, r["old"], r["new"])) == tuple(r["range"]) and one(spark, text.changed_lines, r["old"], r["new"]) == r["lines"]


def test_delta_of_large_contents():
    import random

    rng = random.Random(1)
    old = bytes(rng.randrange(256) for _ in range(100_000))
    new = bytearray(old)
    new[1_000] ^= 1
    new[90_000] ^= 1
    assert len(codec.delta_encode_bytes(old, bytes(new))) < 100
    for b, most in ((old[50_000:] + b"new" + old[:50_000], 100), (old[:70_000] * 2, 100), (b"x" + old + b"y", 100), (old[::-1], 101_000)):
        delta = codec.delta_encode_bytes(old, b)
        assert len(delta) < most and codec.delta_decode_bytes(old, delta) == b
    for _ in range(300):
        a = bytes(rng.choice(b"ab") if rng.random() < 0.5 else rng.randrange(256) for _ in range(rng.randrange(300)))
        b = bytearray(a)
        for _ in range(rng.randrange(5)):
            i = rng.randrange(len(b) + 1)
            b[i : i + rng.randrange(40)] = rng.choice([b"", a[:50], bytes(rng.randrange(256) for _ in range(20))])
        assert codec.delta_decode_bytes(a, codec.delta_encode_bytes(a, bytes(b))) == bytes(b)


def test_dedup_records(spark):
    """Contents as blocks, replayed; a lost or damaged block is a fault of its path."""
    from tidelog.operators import blocks

    big = bytes(range(256)) * 5
    rows = [("r", "p", 1, 1, CREATE, len(big), big), ("r", "p", 2, 2, MODIFY, len(big) + 1, codec.delta_encode_bytes(big, big + b"z")), ("r", "q", 1, 3, CREATE, 3, b"abc"), ("r", "s", 1, 4, CREATE, len(big) + 7, big + b"another"), ("r", "t", 1, 5, DELETE, 0, b"")]
    log = spark.createDataFrame(rows, "repo string, path string, ts_ns bigint, seq bigint, event_type int, file_size bigint, payload binary")
    made, refs, pool = blocks.deduplicated(log, 1000, 256)
    kinds = {r["seq"]: (r["event_type"], len(r["payload"])) for r in made.collect()}
    assert kinds == {1: (CREATE_DEDUP, 5 * 32), 2: (MODIFY, kinds[2][1]), 3: (CREATE, 3), 4: (CREATE_DEDUP, 6 * 32), 5: (DELETE, 0)} and pool.count() == 2
    assert sorted(map(tuple, refs.collect())) == sorted(map(tuple, blocks.references(made).collect()))
    whole = {r["seq"]: (r["content"] and bytes(r["content"]), r["fault"]) for r in replay.versions(made, pool).collect()}
    assert whole == {1: (big, None), 2: (big + b"z", None), 3: (b"abc", None), 4: (big + b"another", None), 5: (None, None)}
    for broken in (pool.where("size < 256"), pool.withColumn("data", F.when(F.col("size") == 256, F.lit(b"x")).otherwise(F.col("data"))), pool.limit(0)):
        assert {r["seq"]: r["fault"] for r in replay.versions(made, broken).collect()} == {1: "block", 2: None, 3: None, 4: "block", 5: None}
    assert {r["seq"]: r["fault"] for r in replay.versions(made).collect()}[1] == "block"
    assert sorted(r["path"] for r in replay.content_as_of(made, 1, pool).collect()) == ["p", "q", "s"]
    assert {r["seq"] for r in replay.compacted(made, 0).collect()} == {1, 2, 3, 4, 5}


def test_compacted_payloads(spark):
    contents = [b"v%d\n" % i * 40 for i in range(20)]
    rows = [("r", "p", 1, 1, CREATE, len(contents[0]), contents[0])]
    rows += [("r", "p", i + 1, i + 1, MODIFY, len(b), codec.delta_encode_bytes(a, b)) for i, (a, b) in enumerate(zip(contents, contents[1:]), 1)]
    rows += [("r", "p", 50, 50, DELETE, 0, b""), ("r", "p", 51, 51, CREATE, 1, b"x")]
    rows += [("r", "bad", i, 100 + i, CREATE if i == 1 else MODIFY, 5, b"12345" if i == 1 else b"\xff" * 9) for i in range(1, 30)]
    log = spark.createDataFrame(rows, "repo string, path string, ts_ns bigint, seq bigint, event_type int, file_size bigint, payload binary")
    out = replay.compacted(log)
    assert sorted(r["seq"] for r in out.where("path = 'p'").collect()) == [1, 20, 50, 51] and out.where("path = 'bad'").count() == 29
    state = {r["seq"]: r["content"] and bytes(r["content"]) for r in replay.versions(out.where("path = 'p'")).collect()}
    assert state == {1: contents[0], 20: contents[19], 50: None, 51: b"x"}


def test_tags_of_many_words(spark):
    """Only the first 256 distinct words count."""
    words = [f"w{a}{b}{c}" for a in "aeiou" for b in "bcdfg" for c in "aeiouklmnpst"][:300]
    said = " ".join(words[:256] + words[256:] * 3 + words[5:6])
    assert one(spark, lambda c: text.top_tags(text.tokens(c)), said).split()[0] == f"#{words[5]}"
