"""Near-duplicates at a similarity of shingle sets that fingerprints can't reach.

Sets of similarity 0.8 have fingerprints that differ in some ten of 64 bits; cut into
segments of which one differs by at most one bit, that leaves segments of ten bits, which
tell nothing among millions of texts. So the deletion variants are taken of signatures
whose places agree as often as the sets do, instead of bits: ``SEGMENTS`` segments of
``PLACES`` least hashes (min-hashes) each, indexed with each one of the places left out.
Two sets meet when some segment differs in at most one place, and what meets is verified
on the whole sets. Sets of similarity s meet with probability
1 - (1 - s^n - n (1 - s) s^(n - 1))^m, n places in m segments: 0.998 at 0.8, 1 at 0.95.

Sets that share a variant are paired; where more than ``CROWDED`` do, each is at first paired
with one of them only, the one whose hash with the variant is least. That makes one component
of most large groups. The sets of the variants that still hold several components are open:
any of them that lie in different components are compared if their prefixes meet, which those
of similar sets always do (a prefix is a set's |A| - ceil(s |A|) + 1 rarest shingles). So no
link between sets that share a variant is lost, and sets that share frequent shingles only
aren't paired.

Texts are lower-cased (A-Z) and cut into words as for fingerprints. A text of fewer words
than a shingle is one shingle, one without a word the empty set, which is like itself only.
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

from .common import UPPER, addressed, alone, staged
from .components import components

SEGMENTS, PLACES = 6, 6
#: Sets of one variant above which each is paired with one of them first.
CROWDED = 32
#: Bits of a shingle's hash by which its frequency is counted: 2^18 counts go to all executors.
COUNTED = 18
#: Shingles whose least hashes are taken at once; words that a worker remembers.
BLOCK, REMEMBERED = 1 << 14, 200_000
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
_words: dict[bytes, int] = {}
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads what is alike."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_rng = np.random.default_rng(11)
_FACTORS, _TERMS = (_rng.integers(0, 1 << 63, SEGMENTS * PLACES, np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def shingles(text: str | None, size: int) -> np.ndarray:
    """The hashes of a text's distinct shingles, sorted."""
    words = _WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if len(_words) > REMEMBERED:
        _words.clear()
    each = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        h = _words.get(w)
        if h is None:
            h = _words[w] = xxhash.xxh64_intdigest(w)
        each[i] = h
    n = min(size, len(words))
    if not n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        total = (total + each[k : len(words) - n + 1 + k]) * _ODD
    return np.unique(_mixed(total + np.uint64(n)))


def signature(found: np.ndarray) -> np.ndarray:
    """The least hash of a set under each of the signature's functions."""
    least = np.full(SEGMENTS * PLACES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(found), BLOCK):
        least = np.minimum(least, (found[i : i + BLOCK, None] * _FACTORS + _TERMS).min(0))
    return least


def variants(signatures: np.ndarray) -> np.ndarray:
    """Of each row: a hash for each segment and each place left out of it."""
    own = _mixed(signatures.reshape(-1, SEGMENTS, PLACES) + np.arange(SEGMENTS * PLACES, dtype=np.uint64).reshape(SEGMENTS, PLACES) * _ODD)
    rest = own.sum(2, dtype=np.uint64)[:, :, None] - own
    return _mixed(rest + np.arange(SEGMENTS * PLACES, dtype=np.uint64).reshape(SEGMENTS, PLACES)).reshape(-1, SEGMENTS * PLACES)


def _signed(rows: DataFrame, size: int) -> DataFrame:
    """(id, node, variants, and what follows) of (id, text, and what follows). ``node`` names the set of shingles."""
    names = ["id", "node", "variants", *rows.columns[2:]]
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("node", T.BinaryType()), T.StructField("variants", T.ArrayType(T.LongType())), *rows.schema.fields[2:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("signatures", _words.clear)
        for batch in batches:
            nodes, signs = [], []
            for text in batch.column(1):
                found = shingles(text.as_py(), size)
                nodes.append(xxhash.xxh3_128_digest(found.tobytes()))
                signs.append(signature(found))
            made = variants(np.array(signs, np.uint64).reshape(-1, SEGMENTS * PLACES)).view(np.int64)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, made.size + 1, SEGMENTS * PLACES), pa.int32()), pa.array(made.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.binary()), flat, *batch.columns[2:]], names)

    return rows.mapInArrow(run, schema)


def _sets(rows: DataFrame, size: int) -> DataFrame:
    """(node, shingles) of (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("signatures", _words.clear)
        for batch in batches:
            found = [shingles(text.as_py(), size).view(np.int64) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["node", "shingles"])

    return rows.select("node", "text").mapInArrow(run, "node binary, shingles array<long>")


def candidates(nodes: DataFrame, crowded: int = CROWDED) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b), a < b, of nodes that share a variant, and (variant, node) of the crowded
    variants, whose nodes are paired with one of them only."""
    every = nodes.select("node", F.explode("variants").alias("variant"))
    # a count by hash comes first: most variants are of one node
    counts = staged(every.groupBy("variant").count().where(F.col("count") > 1).select(F.col("variant").alias("of"), (F.col("count") > crowded).alias("full")), "counts")
    shared = staged(every.join(counts.hint("merge"), F.col("variant") == F.col("of")).drop("of"), "shared")
    thin, thick = shared.where(~F.col("full")), shared.where("full").select("variant", "node")
    left, right = thin.select("variant", F.col("node").alias("a")), thin.select("variant", F.col("node").alias("b"))
    pairs = left.join(right.hint("merge"), "variant").where(F.col("a") < F.col("b")).select("a", "b")
    order = F.struct(F.xxhash64("variant", "node").alias("order"), F.col("node"))
    hubs = staged(thick.groupBy("variant").agg(F.min(order)["node"].alias("hub")).select(F.col("variant").alias("of"), "hub"), "hubs")
    spokes = thick.join(hubs.hint("merge"), F.col("variant") == F.col("of")).where(F.col("node") != F.col("hub"))
    return staged(pairs.union(spokes.select(F.least("node", "hub"), F.greatest("node", "hub"))).distinct(), "pairs"), thick


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sets are similar."""
    one, two = sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))
    shared = F.size(F.array_intersect("of_a", "of_b"))
    # |A & B| / |A | B| >= s, without a division
    enough = shared >= F.lit(similarity) * (F.size("of_a") + F.size("of_b") - shared)
    lengths = (F.size("of_a") >= F.lit(similarity) * F.size("of_b")) & (F.size("of_b") >= F.lit(similarity) * F.size("of_a"))
    return pairs.join(one, "a").join(two, "b").where(lengths).where(enough).select("a", "b")


def open_nodes(thick: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, root), written: the nodes of crowded variants that hold several components."""
    own = roots.select(F.col("node").alias("of"), "root")
    rooted = staged(thick.join(own, F.col("node") == F.col("of"), "left").select("variant", "node", F.coalesce("root", "node").alias("root")), "rooted")
    several = rooted.groupBy("variant").agg(F.min("root").alias("least"), F.max("root").alias("most")).where(F.col("least") != F.col("most")).select("variant")
    return staged(rooted.join(staged(several, "several").hint("merge"), "variant", "left_semi").select("node", "root").distinct(), "open")


def met(nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b), a < b, of ``nodes`` (node, root) that lie in different components and whose prefixes
    meet. In a shingle, its largest component isn't paired with itself."""
    counts = np.zeros(1 << COUNTED, np.int64)
    for r in sets.select(F.explode("shingles").alias("s")).groupBy(F.shiftrightunsigned("s", 64 - COUNTED).alias("place")).count().toLocalIterator():
        counts[r["place"]] = r["count"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.asarray(s.as_py(), np.int64).view(np.uint64) for s in batch.column(1)]
            # any order serves that is the same for all sets
            own = [s[np.lexsort((s, counts[s >> np.uint64(64 - COUNTED)]))[: len(s) - int(np.ceil(similarity * len(s) - 1e-9)) + 1]] for s in found]
            of = pa.array(np.repeat(np.arange(len(own)), [len(s) for s in own]))
            flat = np.concatenate([np.zeros(0, np.uint64), *own]).view(np.int64)
            sizes = pa.array(np.array([len(s) for s in found], np.int32))
            at = pa.array(np.concatenate([np.zeros(0, np.int32), *(np.arange(len(s), dtype=np.int32) for s in own)]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), sizes.take(of), at, pa.array(flat)], ["node", "n", "at", "shingle"])

    prefixes = sets.select("node", "shingles").mapInArrow(run, "node binary, n int, at int, shingle long")
    every = staged(prefixes.join(nodes, "node"), "prefixes")
    groups = every.groupBy("shingle", "root").agg(F.count("*").alias("count"), F.min("n").alias("n")).groupBy("shingle").agg(F.max_by("root", "count").alias("major"), F.count("*").alias("roots"), F.min("n").alias("least"))
    several = staged(groups.where(F.col("roots") > 1).select(F.col("shingle").alias("of"), "major", "least"), "several")

    def early(n: Column, at: Column, other: Column) -> Column:
        """Whether a shingle at this place can be the first that a set shares with one of ``other`` shingles:
        similar ones share (|A| + |B|) s / (1 + s), and what follows has to suffice for that."""
        return n - at >= (n + other) * F.lit(similarity / (1 + similarity)) - F.lit(1e-6)

    # the smallest partner asks for the least, so that most places of sets of like sizes are left out at once
    shared = staged(every.join(several.hint("merge"), F.col("shingle") == F.col("of")).where(early(F.col("n"), F.col("at"), F.greatest("least", F.ceil(F.col("n") * similarity - F.lit(1e-6))))).drop("of", "least"), "shared")
    left = shared.where(F.col("root") != F.col("major")).select("shingle", F.col("node").alias("a"), F.col("root").alias("root_a"), F.col("n").alias("n_a"), F.col("at").alias("at_a"))
    right = shared.select("shingle", "major", F.col("node").alias("b"), F.col("root").alias("root_b"), F.col("n").alias("n_b"), F.col("at").alias("at_b"))
    once = (F.col("root_b") == F.col("major")) | (F.col("a") < F.col("b"))
    lengths = (F.col("n_a") >= F.lit(similarity) * F.col("n_b")) & (F.col("n_b") >= F.lit(similarity) * F.col("n_a"))
    places = early(F.col("n_a"), F.col("at_a"), F.col("n_b")) & early(F.col("n_b"), F.col("at_b"), F.col("n_a"))
    pairs = left.join(right.hint("merge"), "shingle").where((F.col("root_a") != F.col("root_b")) & once & lengths & places)
    return staged(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "met")


def similar(docs: DataFrame, similarity: float, size: int, id_col: str, text_col: str, more: Sequence[Column] = (), crowded: int = CROWDED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (id, node, and the columns of ``more``), nodes (node, id, n) and the components (node, root) of the
    links between nodes whose sets have a Jaccard similarity of ``similarity`` at least."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *more)
    rows = addressed(own, *own.columns)
    signed = staged(_signed(rows, size), "signed")
    nodes = staged(signed.groupBy("node").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.min("_row").alias("_row"), F.first("variants").alias("variants")), "nodes")

    def sets_of(members: DataFrame) -> DataFrame:
        # only the texts of these nodes are read again, one of each node
        few = staged(members.join(nodes.select("node", "_row"), "node").select("node", F.col("_row").alias("_of")), "members")
        return staged(_sets(rows.join(few, F.col("_row") == F.col("_of")), size), "sets")

    pairs, thick = candidates(nodes, crowded)
    sets = sets_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    roots = components(_alike(pairs, sets, similarity))
    several = open_nodes(thick, roots)
    if several.take(1):
        # every node of a crowded variant is in a pair with its hub, so that its set is at hand
        own_sets = sets.join(several.select("node"), "node", "left_semi")
        fresh = _alike(met(several, own_sets, similarity), own_sets, similarity)
        known = roots.where(F.col("node") != F.col("root")).select(F.col("root").alias("a"), F.col("node").alias("b"))
        roots = components(known.union(fresh))
    return signed.drop("variants", "_row"), nodes.select("node", "id", "n"), roots
