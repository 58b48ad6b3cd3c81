"""Exact top-k by inner product over a pivot-distance index.

Vectors become integers, floor(scale * x). Each is keyed by its nearest pivot and its
distance to that, as an angle: between directions, angles keep the triangle inequality.
Pivots are the centres of a bounded sample, and grow with the square root of the rows. A
pivot's rows are cut into annuli at quantiles of their distance, of some ``ANNULUS`` rows
each; an annulus knows its rows' least and largest distance to its own pivot and to
``OTHERS`` further ones, and their least and largest length. An annulus of more than
``BLOCK`` rows, as where one vector makes up a third of them, is dealt over blocks by
a hash of the id.

With the angles t(q, p) to a pivot and [low, high] of an annulus's rows to the same, no row
is nearer to the query than max(0, t - high, low - t): its score is at most the lengths'
product times the cosine of that. A query sorts the annuli by this bound and expands: first
the best, enough for ``ROUNDS[0]`` rows; then, with the k-th score so far as floor, those of
the next ``ROUNDS[1]`` rows whose bound reaches it; then all others that do. A bound is
never below the true score, so nothing that belongs to the result is left out.

How much the bounds stop depends on the vectors: where these keep to clusters it is most of
the rows, where directions are spread evenly over many dimensions it is next to nothing, for
any index of distances (see the README for figures).

Defined cases: vectors that are null, or hold null or non-finite components, take no part;
shorter vectors, empty ones too, count as filled with zeros; equal scores go to the smaller
id; a null id takes no part; rows that repeat an id are candidates each, but one query
(with the least of their vectors), whose own id is none of its candidates; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

SCALE, TOP = 1024, 10
#: Pivots at most, and rows of the sample for each of them; annuli of a pivot at most (a power of two).
PIVOTS, SAMPLED, ANNULI = 1024, 16, 64
#: Rows of an annulus, about; further pivots that each knows its distances to; rows of a block, queries of a block.
ANNULUS, OTHERS, BLOCK, QUERIES = 1024, 4, 2048, 256
#: Rows in the annuli that are opened in each round but the last, about.
ROUNDS = (200, 4000)
#: Angles are taken to be wrong by less than this.
SLACK = 1e-6


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row at length 1 (zeros stay), and the lengths."""
    length = np.sqrt((x * x).sum(1))
    return x / np.where(length > 0, length, 1)[:, None], length


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1, 1))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact: floats while every partial sum is below 2^53, else integers."""
    if not a.size or not b.size or np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2.0**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _centres(sample: np.ndarray, n: int) -> np.ndarray:
    """At most ``n`` directions, each the mean of those of the sample that are nearest to
    it; at first, each is the one that is farthest from those before."""
    at, near = sample[:1], sample @ sample[0]
    while len(at) < n and near.min() < 1 - 1e-9:
        at = np.vstack([at, sample[near.argmin()]])
        near = np.maximum(near, sample @ at[-1])
    for _ in range(4):
        near = (sample @ at.T).argmax(1)
        total = np.zeros_like(at)
        np.add.at(total, near, sample)
        moved, length = _directions(total)
        at = np.where(length[:, None] > 0, moved, at)
    return at


def top_k(vectors: DataFrame, is_query: Callable[[F.Column], F.Column], k: int = TOP, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, report: dict | None = None) -> DataFrame:
    """``is_query``: from the id's column whether a row is a query. Returns query_id,
    rank, ``id_col`` and score. ``report``, if given, gets ``opened``: the share of all pairs
    of query and row that lie in annuli that were opened."""
    spark = vectors.sparkSession
    whole = F.transform(F.col(vector_col), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    finite = F.col(vector_col).isNotNull() & F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = staged(vectors.where(F.col(id_col).isNotNull() & finite).select(F.col(id_col).cast("long").alias("id"), whole.alias("v")), "vectors")
    n_rows, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    schema = f"query_id long, rank int, `{id_col}` long, score long"
    if not n_rows:
        return spark.createDataFrame([], schema)
    n_pivots = max(1, min(PIVOTS, round(n_rows**0.5 / 2)))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(n_pivots * SAMPLED).toPandas()
    pivots = _centres(_directions(_matrix(sample["v"], width))[0], n_pivots)
    n_others = min(OTHERS, len(pivots))

    def key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, length = _directions(_matrix(batch["v"], width))
            angle = _angles(x, pivots)
            cell = angle.argmin(1)
            yield batch.assign(cell=cell.astype(np.int32), distance=angle[np.arange(len(x)), cell], others=list(angle[:, :n_others]), length=length)

    keyed = staged(rows.mapInPandas(key, "id long, v array<long>, cell int, distance double, others array<double>, length double"), "keyed")
    # a row for each pivot at most: its rows, and where quantiles of their distance lie
    quantiles = [i / ANNULI for i in range(1, ANNULI)]
    cuts = {}
    for r in keyed.groupBy("cell").agg(F.count("*").alias("n"), F.percentile_approx("distance", quantiles, 1000).alias("cuts")).collect():
        step = ANNULI // min(ANNULI, 1 << (max(1, r["n"] // ANNULUS).bit_length() - 1))
        cuts[r["cell"]] = np.unique(r["cuts"][step - 1 :: step][: ANNULI // step - 1])

    def ring(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = np.zeros(len(batch), np.int32)
            cell, distance = batch["cell"].to_numpy(), batch["distance"].to_numpy()
            for c in np.unique(cell):
                here = cell == c
                # a value that many rows share is an annulus by itself
                out[here] = np.searchsorted(cuts[c], distance[here], "left") + np.searchsorted(cuts[c], distance[here], "right")
            yield batch.assign(ring=out)

    ringed = staged(keyed.mapInPandas(ring, "id long, v array<long>, cell int, distance double, others array<double>, length double, ring int"), "ringed")
    spread = [f(c).alias(f"{name}{i}") for name, f in (("low", F.min), ("high", F.max)) for i, c in enumerate([F.col("distance"), *(F.get("others", j) for j in range(n_others)), F.col("length")])]
    directory = ringed.groupBy("cell", "ring").agg(F.count("*").alias("n"), *spread).orderBy("cell", "ring").toPandas()
    cells, size = directory["cell"].to_numpy(), directory["n"].to_numpy()
    low, high = (directory[[f"{name}{i}" for i in range(n_others + 2)]].to_numpy() for name in ("low", "high"))
    parts = spark.createDataFrame([(int(c), int(r), i, int(n), int(n) // BLOCK + 1) for i, (c, r, n) in enumerate(zip(cells, directory["ring"], size, strict=True))], "cell int, ring int, ring_no int, n long, parts int")
    blocks = (
        ringed.join(F.broadcast(parts), ["cell", "ring"])
        .groupBy("ring_no", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"))
        .agg(F.collect_list(F.struct("id", "v")).alias("rows"))
    )
    blocks = staged(blocks.select("ring_no", "part", F.col("rows.id").alias("ids"), F.col("rows.v").alias("vs")), "blocks")

    def bounds(x: np.ndarray) -> np.ndarray:
        """The largest score that a row of each annulus can have with each query."""
        q, length = _directions(x)
        angle = _angles(q, pivots)
        least = np.zeros((len(x), len(cells)))
        for i, own in enumerate([angle[:, cells], *(angle[:, [j]] for j in range(n_others))]):
            least = np.maximum(least, np.maximum(own - high[:, i], low[:, i] - own) - SLACK)
        cosine = np.cos(np.minimum(least, np.pi))
        # what rounding may have taken from a bound is small beside this
        most = length[:, None] * np.where(cosine > 0, high[:, -1], low[:, -1]) * cosine
        return most + np.abs(most) * 1e-9 + 1

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The annuli that each query opens in this round, by the floor and the rows that were opened before."""
        for batch in batches:
            able = bounds(_matrix(batch["v"], width))
            order = np.argsort(-able, axis=1, kind="stable")
            before = np.zeros_like(able)
            ahead = size[order]
            np.put_along_axis(before, order, np.cumsum(ahead, axis=1) - ahead, 1)
            floor, done, most = (batch[c].to_numpy(dtype=float)[:, None] for c in ("floor", "done", "most"))
            at = np.nonzero((before >= done) & (before < most) & (able >= floor))
            yield pd.DataFrame({"ring_no": at[1].astype(np.int32), "id": batch["id"].to_numpy()[at[0]], "v": batch["v"].to_numpy()[at[0]]})

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ids, vs, qids, qvs in zip(batch["ids"], batch["vs"], batch["qids"], batch["qvs"], strict=True):
                ids, qids = np.asarray(ids), np.asarray(qids)
                s = _products(_matrix(qvs, width), _matrix(vs, width))
                s = np.where(qids[:, None] == ids, np.iinfo(np.int64).min, s)
                order = np.lexsort((np.broadcast_to(ids, s.shape), ~s), axis=1)[:, :k] if len(ids) > k else np.broadcast_to(np.arange(len(ids)), s.shape)
                got = np.take_along_axis(s, order, 1)
                frame = pd.DataFrame({"query_id": np.repeat(qids, order.shape[1]), "id": ids[order].ravel(), "score": got.ravel()})
                yield frame[frame["score"] != np.iinfo(np.int64).min]

    def best(of: DataFrame) -> DataFrame:
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return of.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    queries = rows.where(is_query(F.col("id"))).groupBy("id").agg(F.min("v").alias("v"))
    n_queries = queries.count()
    packed, met, pairs, done = n_queries // QUERIES + 1, None, 0, 0
    for most in [*ROUNDS, float("inf")]:
        most = max(most, k + 1)
        if most != float("inf") and most >= n_rows:
            continue
        floors = queries.withColumn("floor", F.lit(float("-inf")))
        if met is not None:
            # with fewer than k so far, anything can still belong
            known = met.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("floor"))
            floors = queries.join(known, F.col("id") == F.col("query_id"), "left").select("id", "v", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
        open_ = floors.withColumns({"done": F.lit(float(done)), "most": F.lit(float(most))}).mapInPandas(opened, "ring_no int, id long, v array<long>")
        packs = staged(open_.groupBy("ring_no", (F.pmod(F.xxhash64("id"), F.lit(packed))).alias("pack")).agg(F.collect_list(F.struct("id", "v")).alias("q")), "packs")
        if report is not None:
            pairs += packs.join(parts, "ring_no").agg(F.coalesce(F.sum(F.size("q") * F.col("n")), F.lit(0))).first()[0]
        found = blocks.join(packs, "ring_no").select("ids", "vs", F.col("q.id").alias("qids"), F.col("q.v").alias("qvs")).mapInPandas(scored, "query_id long, id long, score long")
        met = staged(best(found if met is None else met.drop("rank").unionByName(found)), "met")
        done = most
    if report is not None:
        report["opened"] = pairs / max(1, n_queries * n_rows)
    return met.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
