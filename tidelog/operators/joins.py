"""Joins between logs and their side tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import DELETE, MODIFY


def annotated(records: DataFrame, annotations: DataFrame) -> DataFrame:
    """Of several annotations of one (ts_ns, path), the first by ``seq``."""
    first = annotations.groupBy("ts_ns", "path").agg(F.min_by("summary", "seq").alias("summary"))
    return records.join(first, ["ts_ns", "path"], "left")


def latest_tags(tags: DataFrame) -> DataFrame:
    """The last of each name."""
    return tags.groupBy("name").agg(F.max_by("ts_ns", "seq").alias("ts_ns"))


def ancestors(path: F.Column) -> F.Column:
    """A path and all directories above it, as an array."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def fanned_out(events: DataFrame, roots: DataFrame, path: str = "path", root: str = "root") -> DataFrame:
    """An event for each root at or above its path. A prefix join turned into an
    equi-join on the path's ancestors, so that it may shuffle if roots are many."""
    above = events.withColumn(root, F.explode(F.array_distinct(ancestors(F.col(path)))))
    return above.join(roots, root)


def routed(events: DataFrame, roots: DataFrame) -> DataFrame:
    """F9, ST10: an event for each root above its path; a root with ``file_filter`` takes
    that path below it only. Adds ``rel``. For a batch or a stream of events."""
    below = F.expr("CASE WHEN path = root THEN '' ELSE substr(path, length(root) + 2) END")
    met = fanned_out(events, roots).withColumn("rel", below)
    return met.where(F.col("file_filter").isNull() | (F.col("file_filter") == F.col("rel")))


def with_watches(events: DataFrame, watches: DataFrame) -> DataFrame:
    """``events`` (wd, name, and more) with the path that the watch ``wd`` (dir) gives
    them; of no watch, none. Spark broadcasts the watches if they are small."""
    return events.join(watches, "wd").withColumn("path", F.concat_ws("/", "dir", "name"))


def nearest_root(paths: DataFrame, roots: DataFrame, path: str = "path", root: str = "root") -> DataFrame:
    """The deepest root of each path."""
    met = fanned_out(paths.select(path).distinct(), roots.select(root), path, root)
    return met.groupBy(path).agg(F.max_by(root, F.length(root)).alias(root))


def overlapping(roots: DataFrame, root: str = "root") -> DataFrame:
    """Pairs of which one lies under the other: (outer, inner)."""
    inner = roots.select(F.col(root).alias("inner"), F.explode(F.array_distinct(ancestors(F.col(root)))).alias("outer")).where(F.col("inner") != F.col("outer"))
    return inner.join(roots.select(F.col(root).alias("outer")), "outer").select("outer", "inner").distinct()


def rescanned(current: DataFrame, snapshot: DataFrame) -> DataFrame:
    """SC7, J13: what a snapshot (path, digest) says has changed since ``current`` (path,
    digest): (path, event_type)."""
    met = current.select("path", F.col("digest").alias("was")).join(snapshot.select("path", F.col("digest").alias("now")), "path", "full")
    gone = F.col("now").isNull()
    return met.where(gone | ~F.col("was").eqNullSafe(F.col("now"))).select("path", F.when(gone, DELETE).otherwise(MODIFY).alias("event_type"))


def with_history(walk: DataFrame, log: DataFrame) -> DataFrame:
    """Whether a path found by a walk has records."""
    seen = log.select("path").distinct().withColumn("has_history", F.lit(True))
    return walk.join(seen, "path", "left").withColumn("has_history", F.coalesce("has_history", F.lit(False)))


def line_diff(old: DataFrame, new: DataFrame, key: list[str], text: str = "content") -> DataFrame:
    """Lines (with their number of times) that only one side has: key, side, line."""
    from ..functions.text import lines

    a, b = (d.select(*key, F.explode(lines(F.col(text))).alias("line")) for d in (old, new))
    return a.exceptAll(b).withColumn("side", F.lit("-")).unionByName(b.exceptAll(a).withColumn("side", F.lit("+")))
