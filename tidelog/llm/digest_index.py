"""Exact deduplication against a persistent digest index.

The index is a table of (digest, keep_id), bucketed and sorted by digest. A batch
is reduced to one row per digest, within each task before anything is shuffled by it,
and that is written; it is anti-joined with the index (sort-merge, the index side is
read in its buckets without a shuffle) and what is new is appended.

Two sessions that append at once can both bring a digest; it is then in the index twice,
and the least of its ids counts. ``compact`` makes one sorted file of each bucket's again.

Defined cases: null text counts as empty; texts of any length are read whole; a null id
loses to any other, and is kept only where its whole group has none; rows that repeat an
id are one document and share its decision where their texts are equal; an empty batch
gives no rows and leaves the index as is; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, carrying, staged

BUCKETS = 64


class DigestIndex:
    """``name``: a table of the session's catalogue. ``location``: where its files
    are; by default the warehouse. With a location, a later session finds what an
    earlier one has appended."""

    def __init__(self, spark: SparkSession, name: str, location: str | None = None, buckets: int = BUCKETS):
        self.spark, self.name, self.location, self.buckets = spark, name, location, buckets
        where = f"LOCATION '{location}'" if location else ""
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS {where}"
        )

    def rows(self) -> DataFrame:
        """(digest, keep_id), each digest once: an aggregate within the buckets."""
        return self.spark.table(self.name).groupBy("digest").agg(F.min("keep_id").alias("keep_id"))

    def _write(self, rows: DataFrame, mode: str) -> None:
        out = rows.repartition(self.buckets, "digest").write.bucketBy(self.buckets, "digest").sortBy("digest").mode(mode)
        (out.option("path", self.location) if self.location else out).saveAsTable(self.name)
        self.spark.catalog.refreshTable(self.name)

    def compact(self) -> None:
        """One sorted file for each bucket. To be run while no other session uses the index;
        the rows also stand in the shared folder until the session ends."""
        self._write(staged(self.rows(), "index"), "overwrite")

    def drop(self) -> None:
        """The table and its files. What ``ingest`` has returned doesn't depend on them."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        if self.location:
            at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.location)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def ingest(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
        """Appends the batch's new texts. One row per row of ``docs``: the id,
        digest (binary), keep_id (the row that stays, of this batch or an earlier
        one), group_size (equal rows in this batch), kept, and the columns of ``carry``."""
        into, out_of = carrying(docs, carry)
        text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
        digests = staged(docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"), *into), "digests")
        # written, so that nothing is pushed below the aggregate: a digest that a third of the rows share is a row of each task
        groups = staged(digests.groupBy("digest").agg(F.max("id").alias("newest"), F.count("*").alias("group_size")), "groups")
        fresh = groups.join(self.rows().hint("merge"), "digest", "left_anti").select("digest", F.col("newest").alias("keep_id"))
        self._write(fresh, "append")
        decided = groups.join(self.rows().hint("merge"), "digest").select(F.col("digest").alias("of"), "keep_id", "group_size")
        # a written side has nothing between shuffle and sort, so that a skewed partition of the last join is split as it runs
        plain = staged(decided, "decided")
        return digests.join(plain.hint("merge"), F.col("digest") == F.col("of")).select(
            F.col("id").alias(id_col), "digest", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), *out_of
        )
