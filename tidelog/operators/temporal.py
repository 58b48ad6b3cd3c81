"""Queries over a version log: one row per change, totally ordered by (ts_ns, seq)
within (repo, path)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import in_scope, without_excluded
from ..functions.text import hides_binary
from ..functions.timeexpr import Target
from ..model import COMPACT_ABOVE, CREATE, CREATE_DEDUP, DELETE, EXTLOG_LABELS, MODIFY, label
from ..plans.anchor import pruned
from .joins import annotated

KEY = ("repo", "path")


def chain(*, descending: bool = False):
    order = [F.col("ts_ns"), F.col("seq")]
    return Window.partitionBy(*KEY).orderBy(*(c.desc() for c in order) if descending else order)


class VersionLog:
    """``df`` has repo, path, ts_ns, seq, event_type, delta_size, file_size; other
    columns pass through where rows do."""

    def __init__(self, df: DataFrame):
        self.df = df

    def where(self, scope: str | None = None, since: int | None = None, until: int | None = None) -> VersionLog:
        """F1-F4. Bounds are inclusive; they hold before any window, so revisions are
        counted from ``since`` on."""
        df = self.df
        if scope:
            df = df.where(in_scope(F.col("path"), scope))
        if since is not None:
            df = df.where(F.col("ts_ns") >= since)
        if until is not None:
            df = df.where(F.col("ts_ns") <= until)
        return VersionLog(df)

    # T9, T10
    def log(self) -> DataFrame:
        return self.df.select(*KEY, "ts_ns", "seq", label(F.col("event_type")).alias("event"), "delta_size", "file_size").orderBy("ts_ns", "seq")

    def extlog(self, annotations: DataFrame | None = None) -> DataFrame:
        """Revision, change of size, time since the revision before, and the delta's share of
        the size in basis points; with ``annotations`` (ts_ns, path, seq, summary), the first of
        each record, those of binary content hidden."""
        w = chain()
        gone = F.col("event_type") == DELETE
        change = F.col("file_size") - F.lag("file_size").over(w)
        share = F.when(F.col("file_size") > 0, F.expr("delta_size * 10000 div file_size")).otherwise(F.lit(0)).cast("bigint")
        out = self.df.select(
            *KEY, "ts_ns", "seq", label(F.col("event_type"), only=EXTLOG_LABELS).alias("event"), F.row_number().over(w).cast("bigint").alias("rev"), "delta_size", "file_size",
            F.when(~gone, change).alias("size_change"), (F.col("ts_ns") - F.lag("ts_ns").over(w)).alias("elapsed_ns"), share.alias("ratio_bp"),
        )
        return out if annotations is None else annotated(out, annotations).withColumn("summary", hides_binary(F.col("summary")))

    def footer(self) -> DataFrame:
        return self.df.agg(F.count("*").alias("n_records"), F.count_distinct(*KEY).alias("n_paths"))

    # T1, T2
    def last(self, until: int | None = None) -> DataFrame:
        """The last record of each path, deletions too: partial aggregation, no sort."""
        rows = self.where(until=until).df
        keep = [c for c in rows.columns if c not in KEY]
        return rows.groupBy(*KEY).agg(F.max_by(F.struct(*keep), F.struct("ts_ns", "seq")).alias("r")).select(*KEY, "r.*")

    def as_of(self, until: int | None = None) -> DataFrame:
        """Paths that exist at a time: their last record."""
        return self.last(until).where(F.col("event_type") != DELETE)

    def as_of_many(self, points: DataFrame, most: int = 10_000) -> DataFrame:
        """``points`` (name, ts_ns; at most ``most``, as they become part of the plan) against
        every path, in one pass over the log: a record meets the points that lie between it
        and the next one of its path."""
        found = points.select("name", F.col("ts_ns").cast("bigint").alias("at")).limit(most + 1).collect()
        if len(found) > most:
            raise ValueError(f"more than {most} points in time")
        every = F.array(*(F.struct(F.lit(r["name"]).alias("name"), F.lit(r["at"]).cast("bigint").alias("at")) for r in sorted(found, key=lambda r: r["at"])))
        rows = self.df.select(*KEY, "ts_ns", "seq", "event_type", "file_size", F.lead("ts_ns").over(chain()).alias("_to")).where(F.col("event_type") != DELETE)
        met = F.filter(every, lambda p: (p["at"] >= F.col("ts_ns")) & (F.col("_to").isNull() | (p["at"] < F.col("_to"))))
        return rows.select(*KEY, "seq", "file_size", F.explode(met).alias("p")).select("p.name", *KEY, "seq", "file_size") if found else rows.limit(0).select(F.lit("").alias("name"), *KEY, "seq", "file_size")

    # W4-W7, T3-T6
    def nth(self, n: int) -> DataFrame:
        """Revision n from 1, or from the end if negative; above the last it is the last, below the first there is none."""
        if n == 0:
            return self.df.limit(0)
        if n < 0:
            return self.df.withColumn("_r", F.row_number().over(chain(descending=True))).where(F.col("_r") == -n).drop("_r")
        w = Window.partitionBy(*KEY)
        ranked = self.df.withColumn("_r", F.row_number().over(chain())).withColumn("_n", F.count("*").over(w))
        return ranked.where(F.col("_r") == F.least(F.lit(n), F.col("_n"))).drop("_r", "_n")

    def resolve(self, target: Target) -> DataFrame:
        """The version of each path that a target names."""
        return self.nth(target.revision) if target.revision is not None else self.last(target.until)

    def undo_last(self) -> DataFrame:
        """The version before the last; paths with one record are skipped."""
        return self.nth(-2)

    def undo_skipped(self) -> DataFrame:
        return self.df.groupBy(*KEY).count().agg(F.count("*").alias("n_paths"), F.sum(F.when(F.col("count") < 2, 1).otherwise(0)).alias("n_skipped"), F.sum(F.when(F.col("count") >= 2, 1).otherwise(0)).alias("n_restored"))

    def undo_initial(self, baseline: DataFrame) -> DataFrame:
        """The first version of what the baseline holds."""
        return self.nth(1).join(baseline.select(*KEY), list(KEY), "left_semi")

    def to_prune(self, baseline: DataFrame, patterns: list[str] | None = None) -> DataFrame:
        """What exists now, wasn't there at first and isn't excluded."""
        return without_excluded(self.as_of().join(baseline.select(*KEY), list(KEY), "left_anti").select(*KEY), patterns or [])

    def last_two(self) -> DataFrame:
        ranked = self.df.withColumn("_r", F.row_number().over(chain(descending=True))).where(F.col("_r") <= 2)
        of = lambda n: F.max(F.when(F.col("_r") == n, F.col("ts_ns")))
        return ranked.groupBy(*KEY).agg(of(1).alias("last_ns"), of(2).alias("prev_ns"))

    # T8
    def versions(self) -> DataFrame:
        """Each version with the time in which it holds."""
        return self.df.select(*KEY, "seq", "event_type", "file_size", F.col("ts_ns").alias("valid_from"), F.lead("ts_ns").over(chain()).alias("valid_to"))

    def bridged(self) -> DataFrame:
        """Versions with content, each with the one before it, whatever deletions lie between."""
        w = chain()
        return self.df.where(F.col("event_type") != DELETE).withColumns({"previous_seq": F.lag("seq").over(w), "previous_size": F.lag("file_size").over(w)})

    def manifest(self) -> DataFrame:
        """Full versions numbered within their path, and deletions without a number."""
        alive = F.col("event_type") != DELETE
        numbered = self.df.withColumn("_v", F.sum(alive.cast("int")).over(chain().rowsBetween(Window.unboundedPreceding, 0)))
        kept = numbered.where(alive).select("path", "ts_ns", "seq", label(F.col("event_type")).alias("event"), F.col("file_size").alias("size"), F.concat(F.lit("v"), F.lpad(F.col("_v").cast("string"), 6, "0"), F.lit("_"), F.col("ts_ns").cast("string")).alias("version_file"))
        gone = self.df.where(~alive).select("path", "ts_ns", "seq", F.lit("DELETE").alias("event"), F.lit(0).cast("bigint").alias("size"), F.lit("").alias("version_file"))
        return kept.unionByName(gone)

    # F12, A12, W12
    def changes(self) -> DataFrame:
        """Without records that repeat the kind and size of the one before."""
        state = F.struct("event_type", "file_size")
        return self.df.withColumn("_p", F.lag(state).over(chain())).where(~F.coalesce(F.col("_p").eqNullSafe(state), F.lit(False))).drop("_p")

    def kinds_changed(self) -> DataFrame:
        return self.df.withColumn("_p", F.lag("event_type").over(chain())).where(~F.col("_p").eqNullSafe(F.col("event_type"))).drop("_p")

    def islands(self) -> DataFrame:
        """Runs of records that end with a deletion."""
        ended = F.sum((F.col("event_type") == DELETE).cast("int")).over(chain().rowsBetween(Window.unboundedPreceding, -1))
        return self.df.withColumn("island", F.coalesce(ended, F.lit(0)).cast("bigint"))

    def replayed(self) -> DataFrame:
        """The fold for algebraic payloads: the sum of deltas since the last full record."""
        since = F.sum(F.col("event_type").isin(CREATE, CREATE_DEDUP, DELETE).cast("int")).over(chain().rowsBetween(Window.unboundedPreceding, 0))
        w = Window.partitionBy(*KEY, "_since").orderBy("ts_ns", "seq").rowsBetween(Window.unboundedPreceding, 0)
        return self.df.withColumn("_since", since).select(*KEY, "seq", F.sum("delta_size").over(w).alias("state"))

    def state_at(self, until: int | None = None, prune: bool = True) -> DataFrame:
        """T2 for algebraic payloads, by the records from each path's anchor on."""
        rows = self.where(until=until).df
        if prune:
            rows = pruned(rows)
            return rows.groupBy(*KEY).agg(F.sum("delta_size").alias("state"), F.count("*").alias("n_folded"))
        return VersionLog(VersionLog(rows).replayed()).df.join(VersionLog(rows).last().select(*KEY, "seq"), [*KEY, "seq"]).select(*KEY, "state")

    # T11
    def runs(self, above: int = COMPACT_ABOVE) -> DataFrame:
        """The log with ``island`` and, for records of a run that collapses, ``n``,
        ``first_seq`` and ``last_seq`` (else null). Those are, in paths with more than
        ``above`` records, the runs of more than ``above`` records without their deletion
        that begin with a CREATE and hold no deduplicated content."""
        w = Window.partitionBy(*KEY)
        one = Window.partitionBy(*KEY, "island", "_alive")
        inside = one.orderBy("ts_ns", "seq")
        whole = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = self.islands().withColumns({"_n": F.count("*").over(w), "_alive": F.col("event_type") != DELETE})
        told = rows.withColumns({"n": F.count("*").over(one), "_dedup": F.max((F.col("event_type") == CREATE_DEDUP).cast("int")).over(one), "_kind": F.first("event_type").over(whole), "first_seq": F.first("seq").over(whole), "last_seq": F.last("seq").over(whole)})
        yes = F.col("_alive") & (F.col("_n") > above) & (F.col("n") > above) & (F.col("_kind") == CREATE) & (F.col("_dedup") == 0)
        return told.withColumns({c: F.when(yes, F.col(c)) for c in ("n", "first_seq", "last_seq")}).drop("_n", "_alive", "_dedup", "_kind")

    def compaction(self, above: int = COMPACT_ABOVE) -> DataFrame:
        """The runs that collapse: (repo, path, island, n, first_seq, last_seq)."""
        return self.runs(above).where(F.col("seq") == F.col("first_seq")).select(*KEY, "island", "n", "first_seq", "last_seq")

    def compacted(self, above: int = COMPACT_ABOVE) -> DataFrame:
        """The log with each collapsing run as its first record and one that stands for
        the rest, at the last one's time: a MODIFY with the run's deltas, or a CREATE of
        the content if that is smaller. Sizes only: ``replay.compacted`` has payloads."""
        one = Window.partitionBy(*KEY, "island", "n")
        rows = self.runs(above).withColumn("_sum", F.sum("delta_size").over(one) - F.first("delta_size").over(one.orderBy("ts_ns", "seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        last, smaller = (F.col("seq") == F.col("last_seq")) & F.col("n").isNotNull(), F.col("_sum") < F.col("file_size")
        kept = rows.where(F.col("n").isNull() | (F.col("seq") == F.col("first_seq")) | last)
        kind = F.when(last, F.when(smaller, MODIFY).otherwise(CREATE)).otherwise(F.col("event_type"))
        return kept.select(*KEY, "ts_ns", "seq", kind.alias("event_type"), F.when(last, F.least("_sum", "file_size")).otherwise(F.col("delta_size")).alias("delta_size"), "file_size")

    # T12, W11
    def verified(self, broken: Column, base_needed: bool = True) -> DataFrame:
        """Per record whether it is judged corrupt: ``broken`` holds, or it modifies what
        isn't there; after a path's first corrupt record none is judged."""
        w = chain()
        before = F.lag("event_type").over(w)
        homeless = (F.col("event_type") == MODIFY) & (before.isNull() | (before == DELETE)) if base_needed else F.lit(False)
        rows = self.df.withColumn("_bad", F.coalesce(broken, F.lit(False)) | homeless)
        earlier = F.coalesce(F.max(F.col("_bad").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
        return rows.withColumn("judged", ~earlier).withColumn("corrupt", F.col("_bad") & ~earlier).drop("_bad")

    def verify_report(self, broken: Column) -> DataFrame:
        """A5."""
        v = self.verified(broken)
        return v.agg(F.count("*").alias("n_records"), F.count_distinct(*KEY).alias("n_paths"), F.sum(F.col("corrupt").cast("int")).alias("n_corrupt"), F.count_distinct(F.when(F.col("corrupt"), F.concat_ws("/", *KEY))).alias("n_corrupt_paths"))

    # A1, A6, T15
    def stats(self) -> DataFrame:
        stored = F.sum(F.lit(25) + F.octet_length("path") + F.col("delta_size"))
        return self.df.agg(F.count("*").alias("n_records"), stored.alias("stored_bytes"), F.min(F.when(F.col("ts_ns") > 0, F.col("ts_ns"))).alias("first_ns"), F.max("ts_ns").alias("last_ns"))

    def status(self) -> DataFrame:
        """Per repo and in total (repo null)."""
        return self.df.rollup("repo").agg(F.count("*").alias("deltas"), F.sum("delta_size").alias("bytes"), F.count_distinct("path").alias("files"))

    def totals(self) -> DataFrame:
        is_ = lambda n: F.sum((F.col("event_type") == n).cast("int"))
        return self.df.groupBy("repo").agg(is_(CREATE).alias("creates"), is_(MODIFY).alias("modifies"), is_(DELETE).alias("deletes"), F.sum("delta_size").alias("bytes"))

    def paths(self) -> DataFrame:
        return self.df.select(*KEY).distinct()


def monotonic(rows: DataFrame, ts: str = "ts_ns", seq: str = "seq", by: tuple[str, ...] = KEY) -> DataFrame:
    """Timestamps made strictly increasing in arrival order: each at least one
    above the one before. max(now, last + 1) unrolls to a running maximum of
    (ts - position)."""
    w = Window.partitionBy(*by).orderBy(seq)
    at = F.row_number().over(w)
    return rows.withColumn("_at", at).withColumn(ts, F.max(F.col(ts) - F.col("_at")).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_at")).drop("_at")
