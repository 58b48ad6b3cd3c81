"""Quality by a factorisation machine.

A document's features are its hashed words, statistics of its form and its length
as the table states it. The machine adds to a linear score the interactions of all
pairs of features, each the product of their latent vectors; by the identity
sum over i<j of <v_i, v_j> x_i x_j = (|sum v_i x_i|^2 - sum |v_i x_i|^2) / 2
that takes time in proportion to the features.

It is fitted in one task, on at most ``MOST`` labelled rows, by AdaGrad from a fixed
seed: the driver gets the machine, not the rows, and sends it to the workers with the
task (about 1.2 MB whatever the corpus).

Defined cases: null and empty texts have no words and are scored by their
statistics; texts of any length are read whole, one at a time; null labels are none, of
several labels of an id the largest counts; a null id is scored and never learnt from;
without any label the score is 0.5; rows that repeat an id are scored one by one; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carrying
from .features import STATISTICS, hashed, mapped, sample, structure

#: Labelled rows to fit on, at most; buckets of hashed words; latent factors.
MOST, BUCKETS, FACTORS = 8_000, 1 << 14, 8
EPOCHS, BATCH, RATE, DECAY = 10, 64, 0.05, 1e-5
#: Score from which a document counts as good.
GOOD = 0.3


def held_out(id_col: Column) -> Column:
    """The rows whose labels are never learnt from."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(5)) == 0


def features(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Buckets, their values (of length 1 as a vector), statistics."""
    text = text or ""
    words = text.split()
    counts = Counter(words)
    index, n = hashed(counts)
    value = np.log1p(n)
    if len(value):
        value /= np.sqrt((value**2).sum())
    return index % BUCKETS, value, structure(text, words, counts, n_chars)


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    latent: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def rows(self, found: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All rows' features one after the other, and where each row begins."""
        stats = np.clip((np.array([f[2] for f in found]) - self.mean) / self.scale, -4, 4) / 2
        index = np.concatenate([x for f, s in zip(found, stats, strict=True) for x in (f[0], np.arange(BUCKETS, BUCKETS + STATISTICS))])
        value = np.concatenate([x for f, s in zip(found, stats, strict=True) for x in (f[1], s)])
        starts = np.cumsum([0, *(len(f[0]) + STATISTICS for f in found[:-1])])
        return index, value, starts

    def score(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The logit of each row, and sum v_i x_i."""
        each = self.latent[index] * value[:, None]
        total = np.add.reduceat(each, starts)
        pairs = (total**2 - np.add.reduceat(each**2, starts)).sum(1) / 2
        return self.bias + np.add.reduceat(self.linear[index] * value, starts) + pairs, total


def fit(found: list[tuple], labels: np.ndarray, seed: int = 7) -> Machine:
    stats = np.array([f[2] for f in found])
    rng = np.random.default_rng(seed)
    size = BUCKETS + STATISTICS
    m = Machine(0.0, np.zeros(size), rng.normal(0, 0.05, (size, FACTORS)), stats.mean(0), stats.std(0) + 1e-6)
    bias_sum, linear_sum, latent_sum = 1e-8, np.full(size, 1e-8), np.full((size, FACTORS), 1e-8)
    for _ in range(EPOCHS):
        order = rng.permutation(len(found))
        for i in range(0, len(order), BATCH):
            part = order[i : i + BATCH]
            index, value, starts = m.rows([found[j] for j in part])
            logit, total = m.score(index, value, starts)
            error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[part]) / len(part)
            row = np.repeat(np.arange(len(part)), np.diff([*starts, len(index)]))
            g = error[row] * value
            used, at = np.unique(index, return_inverse=True)
            linear = np.bincount(at, g) + DECAY * m.linear[used]
            own = g[:, None] * (total[row] - m.latent[index] * value[:, None])
            latent = np.stack([np.bincount(at, own[:, f]) for f in range(FACTORS)], 1) + DECAY * m.latent[used]
            bias_sum += error.sum() ** 2
            m.bias -= RATE * error.sum() / np.sqrt(bias_sum)
            linear_sum[used] += linear**2
            m.linear[used] -= RATE * linear / np.sqrt(linear_sum[used])
            latent_sum[used] += latent**2
            m.latent[used] -= RATE / 4 * latent / np.sqrt(latent_sum[used])
    return m


def trained(docs: DataFrame, labels: DataFrame, most: int = MOST) -> Machine | None:
    """From the rows that aren't held out. ``docs`` needs doc_id, text, n_chars."""
    rows = sample(docs, labels, "quality", most, ~held_out(F.col("doc_id")), "doc_id", "text", "n_chars")

    def make(ids, texts, marks, n_chars):
        found = [features(t, n) for t, n in zip(texts, n_chars, strict=True)]
        return ids, marks, *([f[k] for f in found] for k in range(3))

    out = pa.schema([("id", pa.int64()), ("label", pa.int32()), ("index", pa.list_(pa.int32())), ("value", pa.list_(pa.float32())), ("stats", pa.list_(pa.float64()))])
    found = mapped(rows.select("id", "text", "label", F.col("n_chars").cast("long")), make, out)
    # the order of rows decides what is learnt: theirs doesn't depend on where they were read
    got = found.repartition(1).sortWithinPartitions("id", "label", "stats", "index", "value").mapInArrow(learn, "bias double, linear binary, latent binary, mean binary, scale binary").collect()
    if not got:
        return None
    bias, linear, *rest = got[0]
    latent, mean, scale = (np.frombuffer(x) for x in rest)
    return Machine(bias, np.frombuffer(linear), latent.reshape(-1, FACTORS), mean, scale)


def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The machine that is fitted on all rows; none of no rows. They stay in the columns that they came in."""
    found, marks = [], []
    for b in batches:
        columns = [(c.values.to_numpy(), c.offsets.to_numpy()) for c in (b.column(k) for k in ("index", "value", "stats"))]
        found += [tuple(v[o[i] : o[i + 1]] for v, o in columns) for i in range(b.num_rows)]
        marks += b.column("label").to_pylist()
    if found:
        bias, *rest = astuple(fit(found, (np.array(marks) > 0).astype(float)))
        yield pa.RecordBatch.from_pydict({"bias": [float(bias)]} | {k: [x.tobytes()] for k, x in zip(("linear", "latent", "mean", "scale"), rest, strict=True)})


def scored(docs: DataFrame, machine: Machine | None, id_col: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs``: the id, held_out, score (0 to 1, higher: better), predicted,
    and the columns of ``carry`` as they are (which may be the id again)."""

    def make(ids, texts, n_chars):
        if machine is None or not ids:
            return ids, [0.5] * len(ids)
        scores = []
        for i in range(0, len(ids), 256):
            logit, _ = machine.score(*machine.rows([features(t, n) for t, n in zip(texts[i : i + 256], n_chars[i : i + 256], strict=True)]))
            scores += (1 / (1 + np.exp(-np.clip(logit, -30, 30)))).tolist()
        return ids, scores

    into, out_of = carrying(docs, carry)
    out = pa.schema([("id", pa.int64()), ("score", pa.float64())])
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col("text"), F.col("n_chars").cast("long"), *into)
    got = mapped(rows, make, out, tuple(f"_carried{i}" for i in range(len(carry))))
    own = [F.col("id").alias(id_col)] if id_col not in carry else []
    return got.select(*own, F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"), *out_of)
