"""SimHash near-duplicates: fingerprints of word shingles, linked within three bits.

Two fingerprints of 64 bits that differ in at most three have, of their two halves
of 32 bits, one that differs in at most one. So every distinct fingerprint is
indexed by each half with each one of its bits left out (64 variants), variants are
joined by equality, and what meets is verified. Each pair is taken at one variant
only: the lower half if that differs in at most one bit, else the upper one, with the
differing bit left out, or bit 0 if there is none.

A variant that more than ``CROWDED`` distinct fingerprints share isn't paired.
Its members are linked exactly, in linear work, by hubs: two fingerprints are
within three bits when some value is within one bit of the first and two of the
second; at each value within one bit of a member, all members within two bits are
linked to the least of the former.

Components are those of the links between distinct fingerprints (see ``components``).

Defined cases: null and empty texts, and those without a word, have fingerprint
zero and are linked like any other; equal fingerprints are one node, however many
rows share them; a null id takes no part in naming a component (which is null if
there is no other); rows that repeat an id each have their own text's component; texts
of any length are read whole; an empty table gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import signatures
from .common import UPPER, carrying, staged
from .components import components

BITS, SHINGLE, SEED = 3, 3, 42
#: Distinct fingerprints of one variant above which pairs give way to hubs.
CROWDED = 4096
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
#: Shingles whose bits are counted at once.
BLOCK = 1 << 16


def fingerprint(text: str | None) -> int:
    """Signed, as a column of long holds it."""
    words = _WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    starts = [0]
    for w in words:
        starts.append(starts[-1] + len(w) + 1)
    ends = starts[SHINGLE:] if len(words) >= SHINGLE else starts[-1:]
    hashes = np.fromiter((digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends, strict=False)), np.uint64, len(ends))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BLOCK):
        bits = np.unpackbits(hashes[i : i + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: Sequence[Column] = ()) -> DataFrame:
    """Per row: the id and ``bits`` (long), and the columns of ``more``."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *more)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("bits", T.LongType()), *rows.schema.fields[2:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(x.as_py()) for x in batch.column(1)], pa.int64()), *batch.columns[2:]], schema.names)

    return rows.mapInArrow(run, schema)


def _variants(nodes: DataFrame) -> DataFrame:
    """(bits, half, out, variant): a row for each half and each bit left out of it;
    ``out`` has that bit."""
    keys = [(half, out) for half in (0, 1) for out in range(32)]
    each = nodes.select("bits", F.explode(F.array(*(F.struct(F.lit(h).alias("half"), F.lit(1 << o).cast("long").alias("out"), F.lit(~(1 << o) & 0xFFFFFFFF).alias("mask"), F.lit((32 * h + o) << 32).cast("long").alias("name")) for h, o in keys))).alias("k"))
    part = F.when(F.col("k.half") == 0, F.col("bits").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("bits", 32))
    return each.select("bits", F.col("k.half").alias("half"), F.col("k.out").alias("out"), F.col("k.name").bitwiseOR(part.bitwiseAND(F.col("k.mask"))).alias("variant"))


def _within(n: int) -> list[int]:
    """Masks of up to ``n`` bits, as signed longs."""
    flips = {0}
    for _ in range(n):
        flips |= {f ^ (1 << b) for f in flips for b in range(64)}
    return sorted(f - (1 << 64) if f >> 63 else f for f in flips if f.bit_count() <= n)


def _balls(nodes: DataFrame, n: int) -> DataFrame:
    return nodes.select("bits", F.explode(F.lit(np.array(_within(n), np.int64))).alias("flip")).select("bits", F.col("bits").bitwiseXOR(F.col("flip")).alias("hub"))


def links(nodes: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """(a, b), a < b: enough links between the distinct ``bits`` of ``nodes`` for
    all components. Outside crowded variants these are all pairs within BITS."""
    variants = _variants(nodes)
    full = staged(variants.groupBy("variant").count().where(F.col("count") > crowded).select("variant"), "crowded")
    thin = variants
    hubs = None
    if full.take(1):
        thin = variants.join(full, "variant", "left_anti")
        members = staged(variants.join(full, "variant", "left_semi").select("bits").distinct(), "members")
        least = _balls(members, 1).groupBy("hub").agg(F.min("bits").alias("a"))
        hubs = _balls(members, 2).join(least.hint("merge"), "hub").where(F.col("a") != F.col("bits")).select(F.least("a", "bits").alias("a"), F.greatest("a", "bits").alias("b")).distinct()
    left, right = thin.select("variant", "half", "out", F.col("bits").alias("a")), thin.select("variant", F.col("bits").alias("b"))
    differing: Column = F.col("a").bitwiseXOR(F.col("b"))
    low, high = differing.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(differing, 32)
    own = F.when(F.col("half") == 0, low).otherwise(high)
    here = ((own == 0) & (F.col("out") == 1)) | (own == F.col("out"))
    first = (F.col("half") == 0) | (F.bit_count(low) > 1)
    # the rows of a Generate are underestimated, so that sides as large as the corpus would be broadcast
    pairs = left.join(right.hint("merge"), (left["variant"] == right["variant"]) & (F.col("a") < F.col("b")) & (F.bit_count(differing) <= BITS) & here & first).select("a", "b")
    return pairs.unionByName(hubs) if hubs is not None else pairs


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowded: int = CROWDED, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs``: the id, bits (long), component_id (the least id that its
    links reach), component_size, root (what all rows of a component share), and the
    columns of ``carry``."""
    into, out_of = carrying(docs, carry)
    prints = staged(fingerprints(docs, id_col, text_col, into), "prints")
    nodes = staged(prints.groupBy("bits").agg(F.min("id").alias("id"), F.count("*").alias("n")), "nodes")
    of = _rooted(nodes, "bits", components(links(nodes.select("bits"), crowded)))
    # one fingerprint can own a third of the rows: a skewed partition of this join is split as it runs
    return prints.join(of.hint("merge"), F.col("bits") == F.col("of")).select(F.col("id").alias(id_col), "bits", "component_id", "component_size", "root", *out_of)


def near_duplicates_of_sets(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), crowded: int = signatures.CROWDED) -> DataFrame:
    """The same by the similarity of the sets of shingles (see ``signatures``): per row of
    ``docs``, the id, node (names its set), component_id, component_size, root and ``carry``."""
    into, out_of = carrying(docs, carry)
    rows, nodes, roots = signatures.similar(docs, similarity, shingle, id_col, text_col, into, crowded)
    of = _rooted(nodes, "node", roots)
    return rows.join(of.hint("merge"), F.col("node") == F.col("of")).select(F.col("id").alias(id_col), "node", "component_id", "component_size", "root", *out_of)


def _rooted(nodes: DataFrame, key: str, roots: DataFrame) -> DataFrame:
    """(of, root, component_id, component_size), written: for each of ``nodes`` (key, id, n)."""
    named = nodes.join(roots, nodes[key] == roots["node"], "left").select(nodes[key].alias("of"), "id", "n", F.coalesce("root", nodes[key]).alias("root"))
    whole = named.groupBy("root").agg(F.min("id").alias("component_id"), F.sum("n").alias("component_size"))
    return staged(named.select("of", "root").join(whole, "root"), "rooted")
