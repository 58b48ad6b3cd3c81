"""Mixing of sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies: the source's
target over its size. Documents stand in order of size within their source;
their expected copies are summed up along that order, one offset per source, drawn
from the seed, is added, and a document is emitted once for every integer that its
own interval crosses. Neighbours in that order are alike in size, so what is taken
stays near the target.

No window spans a source's rows: ranks come from counts by (source, size), counts
by (source, size, slice of the hashed id) and a row number within such a slice.

Defined cases: null text has size 0; a null source is a source of its own, ordered
last; a source of size 0 has target 0 and takes nothing; rows that repeat an id are
ranked one by one in an order that doesn't matter, as they are alike; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import carrying, staged

#: A document's size: its words.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: No source is repeated more often than this.
MOST = 3
#: Rows that one slice of equal sizes holds on average, at most.
SLICE_ROWS = 50_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sizes``: a row for each source (source, source_size). Adds weight and
    target: shares of the total by weight, held at ``most`` times a source's size;
    the excess goes to the others by weight, again and again until none is above.

    In closed form: by the time a water level rises, sources fill up in order of
    ``most * size / weight``. With the sources in that order, the level that the
    rest shares once the first j are full is (total - what they hold) / (weights of
    the rest); the first j at which the next one is not above its limit is right.
    """
    order = Window.orderBy("source")
    filling = Window.orderBy("ratio", "source")
    before, rest, every = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1).cast("double")
    limits = sizes.withColumn("weight", weight).withColumn("limit", F.col("source_size").cast("double") * most).withColumn("ratio", F.col("limit") / F.col("weight"))
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    levels = limits.withColumn("level", level)
    # levels fall from the first open source on, so the first is the largest
    final = F.max(F.when(F.col("ratio") >= F.col("level"), F.col("level"))).over(every)
    return levels.withColumn("final", final).select("source", "source_size", "weight", F.least("limit", F.col("weight") * F.col("final")).alias("target"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: the id, size, source_size, target, copies (how
    often the mix emits it), taken (copies times size), and the columns of ``carry``."""
    into, out_of = carrying(docs, carry)
    words = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    # a name that is never null and puts null last
    source = F.coalesce(F.concat(F.lit("a"), F.col(source_col)), F.lit("b"))
    sized = staged(docs.select(F.col(id_col).cast("long").alias("id"), source.alias("source"), words.alias("size"), *into), "sizes")
    slices = sized.count() // SLICE_ROWS + 1
    cut = sized.withColumn("slice", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(slices)))
    by_slice = staged(cut.groupBy("source", "size", "slice").agg(F.count("*").alias("n")), "slices")
    by_size = by_slice.groupBy("source", "size").agg(F.sum("n").alias("n"))
    sources = targets(by_size.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, most)
    earlier = lambda over: F.coalesce(F.sum("n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before_size = by_size.withColumn("before_size", earlier(Window.partitionBy("source").orderBy("size"))).drop("n")
    before_slice = by_slice.withColumn("before_slice", earlier(Window.partitionBy("source", "size").orderBy("slice"))).drop("n")
    starts = before_slice.join(before_size, ["source", "size"]).join(sources.drop("weight"), "source")
    key = ["source", "size", "slice"]
    placed = cut.withColumn("row", F.row_number().over(Window.partitionBy(*key).orderBy("id", *(c for c in cut.columns if c.startswith("_carried"))))).join(starts, key)
    rank = F.col("before_size") + F.col("before_slice") + F.col("row")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    copies = (F.floor(rank * each + offset) - F.floor((rank - 1) * each + offset)).cast("long")
    return placed.select(F.col("id").alias(id_col), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *out_of)
