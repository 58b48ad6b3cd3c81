"""The catalogue: each operator over the test tables. ``oracle`` has the SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import codec, format, paths, text, timeexpr
from .model import CREATE, EXTLOG_LABELS, LOG_LABELS, MODIFY, SINCE_LABELS, label
from .operators import blocks, joins, replay, temporal
from .operators.temporal import VersionLog
from .session import opened_by_python, scratch, started
from .sources import segments, tables
from .streaming import capture, lifecycle
from .views import nanoseconds, table, vchain, vfiles, vlog, vorders, vpaths

DAY = 86_400_000_000_000
#: 2024-01-15 and 2024-01-10, in nanoseconds.
T, SINCE, START = 1_705_276_800_000_000_000, 1_704_844_800_000_000_000, 1_704_067_200_000_000_000
#: Runs of the test tables are short.
ABOVE = 3
BLOCK = 512
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _log(spark: SparkSession, sf: str) -> VersionLog:
    return VersionLog(vlog(spark, sf))


def _baseline(spark: SparkSession, sf: str) -> DataFrame:
    return _log(spark, sf).where(until=START + DAY).paths()


def _points(spark: SparkSession) -> DataFrame:
    return spark.range(1, 31).select(F.concat(F.lit("d"), F.lpad(F.col("id").cast("string"), 2, "0")).alias("name"), (F.lit(START) + (F.col("id") - 1) * DAY).alias("ts_ns"))


@query
def extlog(spark, sf):
    return _log(spark, sf).extlog()


@query
def extlog_since(spark, sf):
    return _log(spark, sf).where(since=SINCE).extlog()


@query
def extlog_footer(spark, sf):
    return _log(spark, sf).footer()


@query
def log_sorted(spark, sf):
    return _log(spark, sf).log()


@query
def log_path(spark, sf):
    return VersionLog(vlog(spark, sf).where(F.col("path") == "u7")).log()


@query
def scope_prefix(spark, sf):
    d = vfiles(spark, sf)
    return d.where(paths.in_scope(F.col("path"), "src0/en")).select("path", F.octet_length("content").cast("bigint").alias("size"), paths.relative(F.col("path"), "src0").alias("rel"))


@query
def as_of_state(spark, sf):
    return _log(spark, sf).as_of(T).select("repo", "path", "ts_ns", "seq", "file_size")


@query
def as_of_tags(spark, sf):
    return _log(spark, sf).as_of_many(_points(spark))


@query
def undo_last_dir(spark, sf):
    return _log(spark, sf).undo_last().select("repo", "path", "seq", "file_size")


@query
def undo_skipped(spark, sf):
    return _log(spark, sf).where(since=T, until=T + DAY).undo_skipped()


@query
def undo_initial(spark, sf):
    return _log(spark, sf).undo_initial(_baseline(spark, sf)).select("repo", "path", "seq", "file_size")


@query
def prune_list(spark, sf):
    return _log(spark, sf).to_prune(_baseline(spark, sf), ["*7", "u12"])


@query
def last_two(spark, sf):
    return _log(spark, sf).last_two()


@query
def nth_revision(spark, sf):
    v = _log(spark, sf)
    out = [v.nth(n).select(F.lit(n).cast("bigint").alias("n"), "repo", "path", "seq") for n in (1, 5, -1, -3, 0, 1_000_000, -1_000_000)]
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]


@query
def scd2(spark, sf):
    in_us = lambda c: F.call_function("div", F.col(c), F.lit(1000).cast("bigint"))  # noqa: E731  exact as a double, too
    return _log(spark, sf).versions().select("repo", "path", "seq", in_us("valid_from").alias("valid_from_us"), in_us("valid_to").alias("valid_to_us"))


@query
def noop_suppressed(spark, sf):
    return _log(spark, sf).kinds_changed().select("repo", "path", "seq")


@query
def replay_sum(spark, sf):
    return _log(spark, sf).replayed()


@query
def anchor_pruned(spark, sf):
    return _log(spark, sf).state_at(T)


@query
def compact_plan(spark, sf):
    return _log(spark, sf).compaction(ABOVE)


@query
def compacted_log(spark, sf):
    return _log(spark, sf).compacted(ABOVE)


@query
def debounce_sessions(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("path"), F.col("ts").cast("timestamp").alias("ts"))
    s = capture.sessions(e, "6 hours")
    return s.select("path", "n", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"))


@query
def debounce_close(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("path"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), F.col("event_id").alias("seq"), "event_type")
    return capture.islands(e, 6 * 3_600_000_000, F.col("event_type") == "purchase")


@query
def stats(spark, sf):
    return _log(spark, sf).stats()


@query
def stats_rollup(spark, sf):
    return _log(spark, sf).status()


@query
def status_totals(spark, sf):
    return _log(spark, sf).totals()


def _blocks(spark, sf):
    return blocks.split(vfiles(spark, sf).select("path", "doc_id", "content"), BLOCK)


@query
def block_split(spark, sf):
    return _blocks(spark, sf).select("path", "pos", "size", "hash")


@query
def block_dedup(spark, sf):
    return blocks.dedup_ratio(_blocks(spark, sf))


@query
def block_new(spark, sf):
    b = _blocks(spark, sf)
    return blocks.new_blocks(b.where(F.col("doc_id") % 2 == 1), b.where(F.col("doc_id") % 2 == 0)).select("hash", "size")


@query
def block_gc(spark, sf):
    b = _blocks(spark, sf)
    pool = b.groupBy("hash").agg(F.max("size").alias("size"))
    return blocks.collectable(pool, b.where(~F.col("path").startswith("src0/")).select("hash"))


@query
def block_reassemble(spark, sf):
    """J2. The pool is a table of its own, so that the commonest block's references are split where they are many."""
    b, at = _blocks(spark, sf), scratch(spark, "pool")
    b.groupBy("hash").agg(F.first("data").alias("data")).write.parquet(at)
    whole = blocks.reassembled(b.drop("data"), spark.read.parquet(at), ["path"])
    return whole.select("path", F.sha2("content", 256).alias("sha256"), "missing")


@query
def verify_report(spark, sf):
    return _log(spark, sf).verify_report((F.col("event_type") == MODIFY) & (F.col("delta_size") > F.col("file_size")))


@query
def exclude_builtin(spark, sf):
    p = vpaths(spark, sf)
    return p.withColumn("path", F.concat("path", F.element_at(F.array(*map(F.lit, ("/x.o", "/.git/a", "/.o", "/a.bak", "/b~", "/c", "/#d#", "/node_modules", "/a.tt_tmp_1", "/d/.tt_tmp_x/e"))), (F.col("page_id") % 10 + 1).cast("int")))).where(~paths.excluded_builtin(F.col("path"))).select("page_id", "path")


@query
def exclude_user(spark, sf):
    return paths.without_excluded(vfiles(spark, sf).select("path"), ["de", "src1/*/1*", "*7", "src3/", "src2/fr"])


@query
def repo_fanout(spark, sf):
    roots = spark.createDataFrame([("src0", 1), ("src0/en", 2), ("src1", 3), ("src1/de", 4)], "root string, id int")
    return joins.fanned_out(vfiles(spark, sf).select("path"), roots).select("root", "path")


@query
def repo_nearest(spark, sf):
    roots = spark.createDataFrame([("src0",), ("src0/en",), ("src1",), ("src1/de",)], "root string")
    return joins.nearest_root(vfiles(spark, sf), roots)


@query
def repo_overlap(spark, sf):
    path = F.col("path")
    # the addresses, and some of the directories above them
    roots = vpaths(spark, sf).select(F.explode(F.array(path, F.when(F.col("page_id") % 3 == 0, paths.dirname(path)), F.when(F.col("page_id") % 7 == 0, F.substring_index(path, "/", 1)))).alias("root"))
    return joins.overlapping(roots.where(F.col("root").isNotNull() & (F.col("root") != "")).distinct())


@query
def tag_latest(spark, sf):
    e = table(spark, sf, "events")
    return joins.latest_tags(e.select(F.concat(F.lit("t"), (F.col("user_id") % 50).cast("string")).alias("name"), nanoseconds(F.col("ts")).alias("ts_ns"), F.col("event_id").alias("seq")))


@query
def annotation_join(spark, sf):
    log = vlog(spark, sf)
    notes = log.where(F.col("seq") % 3 == 0).select("ts_ns", "path", "seq", F.concat(F.lit("n"), F.col("seq").cast("string")).alias("summary"))
    again = notes.withColumn("seq", F.col("seq") + 1_000_000).withColumn("summary", F.lit("later"))
    return joins.annotated(log.select("ts_ns", "path", F.col("seq").alias("record")), notes.unionByName(again))


@query
def event_kind_map(spark, sf):
    """ST4 over raw kinds: events as what a watcher reports."""
    kinds = {"view": "modify", "click": "moved_to", "purchase": "moved_from", "signup": "create", "error": "delete"}
    kind = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv)), F.col("event_type")), F.lit("attrib"))
    e = table(spark, sf, "events").select(kind.alias("kind")).withColumn("event", label(capture.event_kind(F.col("kind"))))
    return e.groupBy("kind", "event").agg(F.count("*").alias("n"))


@query
def event_labels(spark, sf):
    """the three ways in which the commands name an event."""
    codes = vlog(spark, sf).select("seq", (F.col("seq") % 7).cast("int").alias("event_type"))
    return codes.select("seq", label(F.col("event_type"), only=LOG_LABELS).alias("log"), label(F.col("event_type"), only=SINCE_LABELS).alias("log_since"), label(F.col("event_type"), only=EXTLOG_LABELS).alias("extlog"))


@query
def line_counts(spark, sf):
    return vfiles(spark, sf).select("path", text.line_count(F.col("content")).cast("bigint").alias("n_lines"))


def _pairs(spark, sf):
    from pyspark.sql import Window

    old = F.coalesce(F.lag("content").over(Window.partitionBy("path").orderBy("rev")), F.lit(""))
    # revisions share what a turn before has said, so that ranges are of interest
    return vchain(spark, sf).withColumn("old", old).withColumn("new", F.concat("old", F.lit("\n"), "content"))


@query
def changed_range(spark, sf):
    r = text.changed_range(F.col("old"), F.col("content"))
    return _pairs(spark, sf).select("path", "rev", r["first"].cast("bigint").alias("first_line"), r["last"].cast("bigint").alias("last_line"))


@query
def summary(spark, sf):
    p = text.described(_pairs(spark, sf))
    return p.select("path", "rev", text.summary(F.col("old"), F.col("new"), F.col("tags"), F.col("range")).alias("summary"), text.create_summary(F.col("new"), F.col("tags")).alias("created"))


@query
def autotags(spark, sf):
    """The tags of what each revision has changed."""
    return text.described(_pairs(spark, sf), new="content").select("path", "rev", "tags")


@query
def is_binary(spark, sf):
    return vfiles(spark, sf).select("path", text.is_binary(F.col("content").cast("binary")).alias("is_binary"))


@query
def fmt_bytes(spark, sf):
    return vorders(spark, sf).select("seq", format.nbytes(F.col("file_size")).alias("size"))


@query
def fmt_duration(spark, sf):
    return vlog(spark, sf).select("seq", format.duration(F.col("ts_ns") - START).alias("age"), format.timestamp(F.col("ts_ns")).alias("at"))


@query
def sanitize(spark, sf):
    return vpaths(spark, sf).select("page_id", paths.sanitized(F.col("path")).alias("name"))


@query
def basename(spark, sf):
    p = F.col("path")
    return vpaths(spark, sf).select("page_id", paths.basename(p).alias("base"), paths.dirname(p).alias("dir"), paths.normalized_prefix(F.concat(F.lit("./"), p, F.lit("//"))).alias("prefix"))


@query
def time_expr(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.element_at(F.array(*map(F.lit, ("min", "hours ago", "days", "weeks ago", "months", "sec"))), (F.col("event_id") % 6 + 1).cast("int")).alias("unit"))
    expr = F.concat((F.col("event_id") % 500).cast("string"), F.lit(" "), "unit")
    return e.select("event_id", timeexpr.time_expr(expr, 1_000_000 * timeexpr.NS).alias("ts_ns"))


@query
def rel_path(spark, sf):
    return vfiles(spark, sf).select("path", paths.relative(F.col("path"), "src0/en").alias("rel"))


@query
def manifest(spark, sf):
    return _log(spark, sf).manifest()


@query
def line_diff(spark, sf):
    """Every revision against the one before."""
    p = _pairs(spark, sf)
    return joins.line_diff(p.select("path", "rev", F.col("old").alias("content")), p.select("path", "rev", "content"), ["path", "rev"])


@query
def header_codec(spark, sf):
    v = vlog(spark, sf)
    raw = codec.header(F.col("ts_ns"), F.col("event_type"), F.octet_length("path"), F.col("delta_size"), F.col("file_size"))
    return v.select("seq", raw.alias("raw")).select("seq", F.lower(F.hex("raw")).alias("header"), codec.from_little_endian(F.substring("raw", 1, 8)).cast("bigint").alias("ts_ns"))


@query
def log_distinct_paths(spark, sf):
    return _log(spark, sf).paths()


@query
def orders_revisions(spark, sf):
    """T10 over orders: a customer is a path, an order a revision."""
    o = vorders(spark, sf).withColumn("repo", F.lit("o")).withColumn("event_type", F.lit(MODIFY)).withColumn("delta_size", F.col("file_size"))
    return VersionLog(o).extlog().select("path", "seq", "rev", "size_change", "elapsed_ns")


@query
def monotonic_ts(spark, sf):
    o = vorders(spark, sf).withColumn("repo", F.lit("o"))
    return temporal.monotonic(o).select("path", "seq", "ts_ns")


@query
def rescan_diff(spark, sf):
    v = _log(spark, sf)
    was, now = (v.as_of(t).select("path", F.col("seq").alias("digest")) for t in (SINCE, T))
    return joins.rescanned(was, now)


@query
def history_flag(spark, sf):
    every = table(spark, sf, "customer").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("path"))
    walk = vlog(spark, sf).select("path").union(every).distinct()
    return joins.with_history(walk, vlog(spark, sf))


@query
def common_dir(spark, sf):
    dirs = vfiles(spark, sf).select(F.substring_index("path", "/", 1).alias("source"), F.substring_index("path", "/", 2).alias("dir")).distinct()
    return dirs.groupBy("source").agg(F.collect_set(F.concat("dir", F.lit("/x"))).alias("files")).select("source", paths.common_directory(F.col("files")).alias("dir"))


# Digests, deltas, encryption and state machines.


@query
def blake2b_blocks(spark, sf):
    return vchain(spark, sf).select("path", "rev", F.lower(F.hex(codec.blake2b(F.col("content").cast("binary")))).alias("digest"))


@query
def delta_round_trip(spark, sf):
    p = _pairs(spark, sf).select("path", "rev", F.col("old").cast("binary").alias("old"), F.col("new").cast("binary").alias("new"))
    p = p.withColumn("delta", codec.delta_encode("old", "new"))
    return p.select("path", "rev", F.length("new").alias("file_size"), (F.length("delta") <= F.length("new") + 16).alias("bounded"), (codec.delta_decode("old", "delta") == F.col("new")).alias("same"))


@query
def encrypted_round_trip(spark, sf):
    key = codec.key_from("test", b"0123456789abcdef", 1000)
    c = vchain(spark, sf).withColumn("raw", F.col("content").cast("binary"))
    sealed = codec.encrypt(F.col("raw"), key, F.col("path").cast("binary"))
    return c.select("path", "rev", "raw", sealed.alias("sealed")).select("path", "rev", (codec.decrypt(F.col("sealed"), key, F.col("path").cast("binary")) == F.col("raw")).alias("same"))


def _snapshots(spark, sf):
    return vchain(spark, sf).select("path", (F.col("rev") * 1000 + 1000).alias("ts_ns"), F.col("content").cast("binary").alias("content"))


@query
def capture_fsm(spark, sf):
    return capture.captured_batch(_snapshots(spark, sf)).select("path", "ts_ns", "event_type", "file_size", "reason")


def _bytes(spark, sf):
    """conversations as captured: a log with payloads."""
    return capture.captured_batch(_snapshots(spark, sf)).select(F.lit("c").alias("repo"), "path", "ts_ns", F.col("ts_ns").alias("seq"), "event_type", F.length("payload").cast("bigint").alias("delta_size"), "file_size", "payload")


@query
def replay_bytes(spark, sf):
    return replay.versions(_bytes(spark, sf)).select("path", "ts_ns", F.sha2("content", 256).alias("sha256"), "fault")


@query
def content_as_of(spark, sf):
    """T1, T2 by content."""
    return replay.content_as_of(_bytes(spark, sf), 3500).select("path", F.sha2("content", 256).alias("sha256"), "fault")


@query
def restore_counts(spark, sf):
    """A8."""
    # some paths have lost their first record, some begin later
    lost = F.when(F.col("path").endswith("3"), F.col("ts_ns") > 1000).when(F.col("path").endswith("7"), F.col("ts_ns") > 3000).otherwise(F.lit(True))
    return replay.restored(_bytes(spark, sf).where(lost), 2500)


@query
def version_against_current(spark, sf):
    """What is there now against revision 1, line by line."""
    now = _snapshots(spark, sf).groupBy("path").agg(F.max_by("content", "ts_ns").alias("content"))
    p = replay.against_current(_bytes(spark, sf), now, 2500)
    return joins.line_diff(p.select("path", F.decode("old", "UTF-8").alias("content")), p.select("path", F.decode("new", "UTF-8").alias("content")), ["path"])


@query
def compacted_bytes(spark, sf):
    """T11 with payloads: the compacted log, replayed."""
    log = replay.compacted(_bytes(spark, sf), ABOVE)
    return replay.versions(log).select("path", "ts_ns", F.sha2("content", 256).alias("sha256"), "fault")


@query
def dedup_replay(spark, sf):
    """SK3, J2: contents from 256 bytes on as references to blocks, replayed from the pool."""
    log, refs, pool = blocks.deduplicated(_bytes(spark, sf), 256, 64)
    return replay.versions(log, pool).select("path", "ts_ns", "event_type", F.sha2("content", 256).alias("sha256"), "fault")


@query
def block_references(spark, sf):
    """The references of such a log, each with what is wrong with its block: none, but for those of a pool that lacks some."""
    log, _, pool = blocks.deduplicated(_bytes(spark, sf), 256, 64)
    found = blocks.verified(blocks.references(log), pool.where(~F.lower(F.hex("hash")).startswith("a")), digest=lambda c: F.unhex(F.sha2(c, 256)))
    return found.select("path", "ts_ns", "pos", F.lower(F.hex("hash")).alias("hash"), "fault")


@query
def resolve_targets(spark, sf):
    """Versions by expression, over the log."""
    v, out = _log(spark, sf), []
    tags = {"mid": T}
    for expr in ("now", "first", "prev", "3", "-2", "tag:mid", f"@{T // 1_000_000_000}", f"@{T}", "2024-01-15 00:00:00", "10 days ago"):
        target = timeexpr.resolve(expr, T + 10 * DAY, tags)
        out.append(v.resolve(target).select(F.lit(expr).alias("expr"), "repo", "path", "seq"))
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]


@query
def suppressed(spark, sf):
    """without records that repeat the kind and the size of the one before."""
    return VersionLog(vlog(spark, sf).withColumn("file_size", F.col("file_size") % 3)).changes().select("repo", "path", "seq")


@query
def changed_lines(spark, sf):
    """X19."""
    return _pairs(spark, sf).select("path", "rev", text.changed_lines(F.col("old"), F.col("content")).alias("lines"))


@query
def ratio_percent(spark, sf):
    """X13."""
    return vlog(spark, sf).select("seq", F.round(format.ratio(F.col("delta_size"), F.col("file_size")), 6).alias("percent"))


@query
def integers(spark, sf):
    """X6, X29."""
    e = table(spark, sf, "events").select("event_id", F.concat(F.element_at(F.array(*map(F.lit, ("", "-", "+", "a", " ", "1*", "0x", "[b]"))), (F.col("event_id") % 8 + 1).cast("int")), F.col("event_id").cast("string")).alias("arg"))
    return e.select("event_id", timeexpr.is_integer(F.col("arg")).alias("is_integer"), paths.is_unexpanded_glob(F.col("arg")).alias("is_glob"))


@query
def little_endian(spark, sf):
    """Bytes as digits and back."""
    raw = F.unhex(F.lower(F.hex(codec.little_endian(F.col("ts_ns"), 8))))
    return vlog(spark, sf).select("seq", codec.from_little_endian(raw).cast("bigint").alias("ts_ns"))


@query
def bridged_pairs(spark, sf):
    """Each version with the one before it, over deletions."""
    return _log(spark, sf).bridged().select("repo", "path", "seq", "previous_seq", "previous_size")


@query
def single_file_repos(spark, sf):
    """F9, ST10: events to the roots above them; a root with a file takes that file only."""
    roots = spark.createDataFrame([("src0", None), ("src0/en", "100"), ("src1", "en/1"), ("src2", "en/22"), ("src3", "en")], "root string, file_filter string")
    return joins.routed(vfiles(spark, sf).select("path"), roots).select("root", "path", "rel")


@query
def watched(spark, sf):
    """Events to what is watched, by descriptor."""
    watches = table(spark, sf, "customer").select(F.col("c_custkey").alias("wd"), F.concat(F.lit("d"), F.col("c_nationkey").cast("string")).alias("dir"))
    events = table(spark, sf, "events").select(F.col("user_id").alias("wd"), "event_id", F.concat(F.lit("f"), (F.col("event_id") % 10).cast("string")).alias("name"))
    return joins.with_watches(events, watches).select("event_id", "path")


@query
def annotated_extlog(spark, sf):
    """Extlog with its annotations, those of binary content hidden."""
    log = vlog(spark, sf)
    notes = log.where(F.col("seq") % 3 == 0).select("ts_ns", "path", "seq", F.concat(F.lit("note "), F.when(F.col("seq") % 2 == 0, "#ELF ").otherwise(""), F.col("seq").cast("string")).alias("summary"))
    return _log(spark, sf).extlog(notes).select("repo", "path", "seq", "rev", "summary")


@query
def ms_log(spark, sf):
    """SC13: the log as text, to the millisecond."""
    return vlog(spark, sf).select("seq", format.log_line(F.col("ts_ns"), F.col("event_type"), F.col("path"), F.col("file_size")).alias("line"))


@query
def captured_from_state(spark, sf):
    """ST7, SK5: capture that begins with what is known of a path: revision 0 is its content, for some with a history."""
    c = _snapshots(spark, sf)
    initial = c.where("ts_ns = 1000").select("path", "content", F.col("path").endswith("1").alias("has_history"))
    return capture.captured_batch(c.where("ts_ns > 1000"), 1, initial).select("path", "ts_ns", "event_type", "file_size", "reason")


# What is written and read again, in a folder that all executors share.


def _written(spark, sf, key: bytes | None = None):
    spark.dataSource.register(segments.SegmentSource)
    at = opened_by_python(scratch(spark, "segments"))
    rows = _snapshots(spark, sf).select(F.lit("c").alias("repo"), "path", "ts_ns", F.lit(CREATE).alias("event_type"), F.length("content").cast("bigint").alias("file_size"), F.col("content").alias("payload"))
    rows = segments.sealed(rows, key) if key else rows
    rows.select("path", "ts_ns", "event_type", "file_size", "payload").write.format("segments").option("path", at).option("most", 100_000).mode("append").save()
    return at


def _records(found):
    return found.select("path", "ts_ns", F.col("event_type").cast("int").alias("event_type"), "path_len", F.col("delta_size").cast("bigint").alias("delta_size"), "file_size", F.sha2("payload", 256).alias("sha256"))


@query
def segments_read(spark, sf):
    """SC1, SC3, SC5, SK1, SK2: segments as written, by Spark's own listing."""
    return _records(segments.read_segments(spark, "file:" + _written(spark, sf)))


@query
def segments_source(spark, sf):
    """SC1, O7, U1: the same by the data source; what a path's records are, in the store's order."""
    rows = spark.read.format("segments").option("path", _written(spark, sf)).load()
    return rows.groupBy("path").agg(F.count("*").alias("n"), F.count_distinct("seq").alias("n_seq"), F.sum("file_size").alias("bytes"))


@query
def segments_sealed(spark, sf):
    """SC4, C1, C2: encrypted segments, opened as they are read."""
    key = codec.key_from("test", b"0123456789abcdef", 1000)
    return _records(segments.read_segments(spark, "file:" + _written(spark, sf, key), "c", key))


@query
def segments_checked(spark, sf):
    """SC2: what a store holds and what is skipped, with a file in it that is no segment."""
    at = _written(spark, sf)
    tables.put_file(f"{at}/{10**18:020d}.ttd", b"no segment at all")
    found = segments.segment_report(spark, "file:" + at)
    return found.groupBy("fault").agg(F.sum("n_records").alias("n_records"), F.sum("torn_bytes").alias("torn_bytes"))


@query
def walked(spark, sf):
    """SC6, SC8, SC12, F10, F11, SK7: a restored tree, walked."""
    at = opened_by_python(scratch(spark, "tree"))
    tables.restore(vfiles(spark, sf).select("path", F.col("content").cast("binary").alias("content")), at)
    found = tables.walk(spark, "file://" + at, ["de", "*7"])
    return found.select("path", "size", F.sha2("content", 256).alias("sha256"))


@query
def exported_versions(spark, sf):
    """SK8, Q20: each version as a file, by its name."""
    at = opened_by_python(scratch(spark, "dump"))
    tables.export_versions(_bytes(spark, sf).where("event_type = 1").select("path", "ts_ns", "seq", F.col("payload").alias("content")), at)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load("file://" + at)
    return files.select(F.regexp_extract("path", "/files/([^/]+)-[0-9a-f]{8}/", 1).alias("path"), F.regexp_extract("path", "/(v[^/]+)$", 1).alias("version_file"), F.sha2("content", 256).alias("sha256"))


@query
def manifest_file(spark, sf):
    """SK8: the manifest as a file."""
    at = scratch(spark, "manifest")
    tables.write_manifest(_log(spark, sf).manifest(), at)
    back = spark.read.option("sep", "\t").option("header", "true").csv(at)
    return back.select("path", F.col("ts_ns").cast("bigint").alias("ts_ns"), F.col("seq").cast("bigint").alias("seq"), "event", F.col("size").cast("bigint").alias("size"), F.coalesce("version_file", F.lit("")).alias("version_file"))


@query
def tags_table(spark, sf):
    """SC11, SK10, T14: tags appended and read."""
    at = scratch(spark, "tags")
    for name, ts in (("v1", 5), ("v2", 6), ("v1", 9)):
        tables.append_tag(spark, at, name, ts)
    return tables.read_tags(spark, at).select("name", "ts_ns")


@query
def annotations_table(spark, sf):
    """SC11, SK9: annotations appended and read."""
    at = scratch(spark, "annotations")
    notes = vlog(spark, sf).select("ts_ns", "path", F.concat(F.lit("n\t"), F.col("seq").cast("string")).alias("summary"), "seq")
    for k in range(2):
        tables.append_annotations(notes.where(F.col("seq") % 2 == k), at)
    return tables.read_annotations(spark, at).select("ts_ns", "path", "summary")


@query
def patterns_table(spark, sf):
    """SC11, SK12, T16, U3, U4: exclusions written, added to and taken from."""
    at = scratch(spark, "patterns")
    own = table(spark, sf, "nation").select(F.lower("n_name").alias("pattern"))
    tables.write_patterns(own, at)
    tables.write_patterns(tables.add_patterns(tables.read_patterns(spark, at), own.select(F.concat(F.lit("*."), "pattern").alias("pattern"))), at)
    tables.write_patterns(tables.remove_patterns(tables.read_patterns(spark, at), own.where(F.col("pattern").contains("a"))), at)
    return tables.read_patterns(spark, at)


@query
def baseline_table(spark, sf):
    """SC8, SC11, SK12: the paths at first, written once and read."""
    at = scratch(spark, "baseline")
    tables.write_baseline(_baseline(spark, sf).select("path").distinct(), at)
    return tables.read_baseline(spark, at)


@query
def status_table(spark, sf):
    """SC11, SK11, ST14: a status snapshot of each repo."""
    at = scratch(spark, "status")
    now = _log(spark, sf).status().where("repo IS NOT NULL").select(F.col("repo").alias("root"), "deltas", "bytes", "files", F.lit(0).alias("lost"))
    lifecycle.publish(now, at)
    return tables.read_status(spark, at)


# Streams, run to the end of what is there.


def _drained(stream, mode: str = "append"):
    """What a stream has given. Rows that are appended go to files, not to the driver's memory."""
    spark = stream.sparkSession
    name, at = f"drained_{uuid.uuid4().hex}", scratch(spark, "drained")
    out = stream.writeStream.queryName(name).option("checkpointLocation", scratch(spark, "checkpoint")).outputMode(mode).trigger(availableNow=True)
    out = out.format("parquet").option("path", at) if mode == "append" else out.format("memory")
    started(spark, out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(at) if mode == "append" else spark.table(name)


def _event_stream(spark, sf):
    e = table(spark, sf, "events")
    return spark.readStream.schema(e.schema).parquet(f"{sf}/events.parquet*")


@query
def stream_totals(spark, sf):
    """SC9, A7: running totals of a stream."""
    e = _event_stream(spark, sf).select((F.col("user_id") % 4).cast("string").alias("repo"), F.get_json_object("props", "$.k").cast("bigint").alias("delta_size"))
    return _drained(capture.running_totals(e), "complete")


@query
def stream_sessions(spark, sf):
    """ST1: sessions of a stream, those that the watermark has passed."""
    e = _event_stream(spark, sf).select(F.col("user_id").alias("path"), F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", "1 hour")
    s = _drained(capture.sessions(e, "6 hours"))
    return s.select("path", "n", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"))


@query
def stream_debounced(spark, sf):
    """ST2, ST3: sessions with early close and the kind of their last event."""
    kind = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "purchase", "close").otherwise("modify")
    e = _event_stream(spark, sf).select(F.col("user_id").cast("string").alias("path"), F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts"), kind.alias("kind"), "event_id")
    return _drained(capture.debounced(e, 6 * 3_600_000, "1 hour", "event_id")).groupBy("path").agg(F.sum("n").alias("n"), F.min("first_ms").alias("first_ms"))


@query
def stream_captured(spark, sf):
    """SK4, ST6: the state machine over a stream."""
    c = table(spark, sf, "conversations")
    rows = spark.readStream.schema(c.schema).parquet(f"{sf}/conversations.parquet*").select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("path"), (F.col("turn") * 1000 + 1000).alias("ts_ns"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return _drained(capture.captured(rows)).select("path", "ts_ns", "event_type", "file_size", "reason")
