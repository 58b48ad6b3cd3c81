"""Toxicity by a classifier chain.

Four categories are predicted one after the other: ``terms_1``, ``terms_2``, ``terms_3`` (a
toxic text that holds a telling feature of the first, second or third group) and ``toxic``
itself. Only the last is labelled. Telling features are those that toxic labelled rows hold and others
don't; they form groups by the rows that they share, so that vocabularies that don't mix,
as those of languages, are categories of their own. Each category has a logistic model
over hashed words and word beginnings, statistics of the text's form and the
probabilities of the categories before it; the first three weigh telling features only, as a
language's other words would speak for a group of its terms. Beginnings have several lengths, as languages that
put words together hold a term as a stem; a feature that occurs 2, 4 or 8 times is a
feature of its own for each, as a stem that harmless texts hold once may be telling where
it returns. The earlier probabilities are out-of-fold in training, telling features and
groups included, so that a later model learns from them as it will see them.

The chain is fitted on the driver on at most ``MOST`` labelled rows, and has a size of
its own (its buckets with a weight, some 100 kB), whatever the corpus. Rows held out (as for
quality) are never learnt from. The threshold of ``toxic`` is that with the best F1 on its
out-of-fold predictions.

Defined cases: null and empty texts are scored by their statistics; texts of any length are
read whole, one at a time; null labels are none, of several labels of an id the largest
counts; a null id is scored and never learnt from; without labels of both kinds all
probabilities are 0; rows that repeat an id are scored one by one; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass, field
from itertools import chain as chained

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import EDGES, STATISTICS, hashed, mapped, sample, structure
from .quality import held_out

CATEGORIES = ("terms_1", "terms_2", "terms_3", "toxic")
GROUPS = len(CATEGORIES) - 1
#: Labelled rows to fit on, at most; buckets of hashed features; folds.
MOST, BUCKETS, FOLDS = 12_000, 1 << 18, 3
#: Letters of a word's beginnings; numbers of occurrences that are features.
BEGINNINGS, TIMES = (4, 5, 6, 7), (1, 2, 4, 8)
EPOCHS, BATCH, RATE, DECAY = 6, 64, 0.1, 1e-4
#: A feature is telling if it is this many times likelier in toxic rows, and in so many of them at least.
LIKELIER, SEEN = 30, 4
#: Share of a telling feature's rows that a group has to cover to take it in.
COVERED = 0.6
#: Log odds from which a bucket has a weight, and share of them that it starts from.
ODDS, START = 3.0, 0.2
#: Words whose beginnings a worker remembers.
REMEMBERED = 400_000
#: Between the buckets of a feature's numbers of times.
_STEP = 0x9E3779B1
_starts: dict[str, tuple[int, ...]] = {}


def _beginnings(word: str) -> tuple[int, ...]:
    found = _starts.get(word)
    if found is None:
        if len(_starts) > REMEMBERED:
            _starts.clear()
        found = _starts[word] = tuple(zlib.crc32(b"^" + word[:n].encode("utf-8", "surrogatepass")) for n in BEGINNINGS if len(word) > n)
    return found


def _words(text: str | None) -> tuple[str, list[str], Counter]:
    text = text or ""
    plain = [w.strip(EDGES) for w in text.lower().split()]
    words = Counter(plain)
    words.pop("", None)
    return text, plain, words


def features(text: str | None) -> tuple[np.ndarray, list[float]]:
    """Buckets of words and beginnings, for each number of times that they reach; statistics."""
    text, plain, words = _words(text)
    index, n = hashed(words)
    starts = [_beginnings(w) for w in words]
    flat = np.fromiter(chained.from_iterable(starts), np.int64)
    each, back = np.unique(np.concatenate([index, flat]), return_inverse=True)
    times = np.bincount(back, np.concatenate([n, np.repeat(n, np.fromiter(map(len, starts), np.int64, len(starts)))]), len(each))
    found = [each[times >= t] + t * _STEP for t in TIMES]
    return np.unique(np.concatenate(found) % BUCKETS), structure(text, plain, words, None)


@dataclass
class Linear:
    bias: float
    weights: np.ndarray  # of the buckets
    dense: np.ndarray  # of statistics and earlier probabilities

    def logit(self, index: np.ndarray, starts: np.ndarray, dense: np.ndarray) -> np.ndarray:
        return self.bias + np.add.reduceat(np.append(self.weights[index], 0), starts) * (np.diff([*starts, len(index)]) > 0) + dense @ self.dense


@dataclass
class Chain:
    mean: np.ndarray
    scale: np.ndarray
    models: list[Linear] = field(default_factory=list)
    threshold: float = 0.5
    #: The buckets with a weight; the models' weights are theirs once the chain is ``packed``.
    buckets: np.ndarray | None = None

    def dense(self, stats: list[list[float]]) -> np.ndarray:
        return np.clip((np.array(stats).reshape(-1, STATISTICS) - self.mean) / self.scale, -3, 3) / 3

    def predict(self, found: list[tuple]) -> np.ndarray:
        """(rows, categories)"""
        index, starts = _joined([f[0] for f in found])
        x, out = self.dense([f[1] for f in found]), []
        for model in self.models:
            out.append(_probability(model.logit(index, starts, x)))
            x = np.hstack([x, out[-1][:, None]])
        return np.stack(out, 1)

    def packed(self) -> Chain:
        kept = np.nonzero(np.any([m.weights != 0 for m in self.models], axis=0))[0]
        return Chain(self.mean, self.scale, [Linear(m.bias, m.weights[kept], m.dense) for m in self.models], self.threshold, kept)


class Reader:
    """``features`` of a packed chain: only buckets with a weight, by their place among them.
    Most words have none in any form, which is remembered."""

    def __init__(self, chain: Chain):
        self.places = {int(b): i for i, b in enumerate(chain.buckets)}
        # by a form's hash modulo BUCKETS: whether any of its numbers of times has a weight
        flags = np.zeros(BUCKETS, np.uint8)
        for t in TIMES:
            flags[(chain.buckets - t * _STEP) % BUCKETS] = 1
        self.flags = flags.tobytes()
        self.known: dict[str, tuple[int, ...]] = {}

    def _useful(self, word: str) -> tuple[int, ...]:
        flags, raw = self.flags, zlib.crc32(word.encode("utf-8", "surrogatepass"))
        found = [raw] if flags[raw % BUCKETS] else []
        for n in BEGINNINGS:
            if len(word) <= n:
                break
            if flags[(start := zlib.crc32(b"^" + word[:n].encode("utf-8", "surrogatepass"))) % BUCKETS]:
                found.append(start)
        return tuple(found)

    def features(self, text: str | None) -> tuple[np.ndarray, list[float]]:
        text, plain, words = _words(text)
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        times: dict[int, int] = {}
        for word, n in words.items():
            useful = known.get(word)
            if useful is None:
                useful = known[word] = self._useful(word)
            for f in useful:
                times[f] = times.get(f, 0) + n
        found = {self.places.get((f + t * _STEP) % BUCKETS, -1) for f, n in times.items() for t in TIMES if n >= t} - {-1}
        return np.array(sorted(found), np.int64), structure(text, plain, words, None)


_readers: dict[bytes, Reader] = {}


def reader(chain: Chain) -> Reader:
    """One for each worker process and chain."""
    name = chain.buckets.tobytes()
    if name not in _readers:
        _readers.clear()
        _readers[name] = Reader(chain)
    return _readers[name]


def _probability(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit, -10, 10)))


def _joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([*parts, np.zeros(0, np.int64)]).astype(np.int64), np.cumsum([0, *map(len, parts[:-1])])


def _odds(rows: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many rows hold each bucket, of those that are marked and of the others."""
    index, mark = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64), np.repeat(y, np.fromiter(map(len, rows), np.int64, len(rows)))
    return np.bincount(index[mark > 0], minlength=BUCKETS), np.bincount(index[mark <= 0], minlength=BUCKETS)


def _fit(rows: list[np.ndarray], dense: np.ndarray, y: np.ndarray, seed: int, among: set[int] | None = None) -> Linear:
    """Starts from the log odds of each bucket, as a naive Bayes model would. Only
    buckets that speak for the mark have a weight: of the many that texts are full of,
    weak evidence either way would add up to more than a few terms do."""
    rng = np.random.default_rng(seed)
    yes, no = _odds(rows, y)
    odds = np.log((yes + 0.5) / (y.sum() + 1)) - np.log((no + 0.5) / ((1 - y).sum() + 1))
    tells = (yes + no >= SEEN) & (odds > ODDS)
    if among is not None:
        tells &= np.isin(np.arange(BUCKETS), list(among))
    rows = [r[tells[r]] for r in rows]
    m = Linear(float(np.log((y.sum() + 0.5) / ((1 - y).sum() + 0.5))), np.where(tells, odds, 0) * START, np.zeros(dense.shape[1]))
    sums, dense_sum, bias_sum = np.full(BUCKETS, 1e-4), np.full(dense.shape[1], 1e-4), 1e-4
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), BATCH):
            part = order[i : i + BATCH]
            at, starts = _joined([rows[j] for j in part])
            error = (1 / (1 + np.exp(-np.clip(m.logit(at, starts, dense[part]), -30, 30))) - y[part]) / len(part)
            used, back = np.unique(at, return_inverse=True)
            g = np.bincount(back, np.repeat(error, np.diff([*starts, len(at)])), len(used)) + DECAY * m.weights[used]
            sums[used] += g**2
            m.weights[used] -= RATE * g / np.sqrt(sums[used])
            gd = error @ dense[part]
            dense_sum += gd**2
            m.dense -= RATE * gd / np.sqrt(dense_sum)
            bias_sum += error.sum() ** 2
            m.bias -= RATE * error.sum() / np.sqrt(bias_sum)
    return m


def _groups(rows: list[np.ndarray], toxic: np.ndarray) -> list[set[int]]:
    """The telling features in groups. One begins with the feature that most toxic rows
    hold among those that are left, and takes in any whose rows it covers in part, until
    there is none; the last takes in all that are left."""
    yes, no = _odds(rows, toxic)
    telling = np.nonzero((yes >= SEEN) & (yes / toxic.sum() >= LIKELIER * (no + 0.2) / (1 - toxic).sum()))[0]
    place = np.full(BUCKETS, -1)
    place[telling] = np.arange(len(telling))
    held = np.zeros((len(telling), int(toxic.sum())), bool)
    for j, i in enumerate(np.nonzero(toxic > 0)[0]):
        own = place[rows[i]]
        held[own[own >= 0], j] = True
    size, left, out = held.sum(1), np.ones(len(telling), bool), []
    for _ in range(GROUPS - 1):
        own = np.zeros(len(telling), bool)
        if left.any():
            own[np.where(left, size, -1).argmax()] = True
            while True:
                rows_of = held[own].any(0)
                more = left & ~own & (held[:, rows_of].sum(1) >= COVERED * size)
                if not more.any():
                    break
                own |= more
        left &= ~own
        out.append(set(telling[own].tolist()))
    return [*out, set(telling[left].tolist())]


def _categories(rows: list[np.ndarray], toxic: np.ndarray, like: list[set[int]] | None = None) -> tuple[np.ndarray, list[set[int]]]:
    """Labels of all categories, from the labels of the last; the groups, in the order of
    those that they are like, if any."""
    groups = _groups(rows, toxic)
    if like:
        rest = list(range(len(groups)))
        order = []
        for g in like:
            order.append(max(rest, key=lambda i: (len(groups[i] & g), -i)))
            rest.remove(order[-1])
        groups = [groups[i] for i in order]
    held = np.zeros((BUCKETS, len(groups)), bool)
    for k, g in enumerate(groups):
        held[list(g), k] = True
    return np.hstack([toxic[:, None] * np.array([held[r].any(0) for r in rows], float).reshape(-1, len(groups)), toxic[:, None]]), groups


def fit(ids: np.ndarray, found: list[tuple], toxic: np.ndarray) -> Chain | None:
    if not 0 < toxic.sum() < len(toxic):
        return None
    stats = np.array([f[1] for f in found])
    chain = Chain(stats.mean(0), stats.std(0) + 1e-6)
    rows, x, fold = [f[0] for f in found], chain.dense([f[1] for f in found]), ids // 7 % FOLDS
    labels, groups = _categories(rows, toxic)
    parts = []  # of each fold: its rows, the others, and what the others' labels make of the categories
    for f in range(FOLDS):
        here, there = np.nonzero(fold == f)[0], np.nonzero(fold != f)[0]
        if len(here) and 0 < toxic[there].sum() < len(there):
            parts.append((here, there, *_categories([rows[i] for i in there], toxic[there], groups)))
    for k in range(len(CATEGORIES)):
        chain.models.append(_fit(rows, x, labels[:, k], k, set().union(*groups) if k < GROUPS else None))
        p = _probability(chain.models[-1].logit(*_joined(rows), x)) if len(parts) < FOLDS else np.zeros(len(rows))
        for here, there, own, telling in parts:
            m = _fit([rows[i] for i in there], x[there], own[:, k], k, set().union(*telling) if k < GROUPS else None)
            p[here] = _probability(m.logit(*_joined([rows[i] for i in here]), x[here]))
        x = np.hstack([x, p[:, None]])
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(toxic[order])
    best = int(np.argmax(2 * right / (np.arange(1, len(p) + 1) + toxic.sum())))
    chain.threshold = float((p[order[best]] + p[order[min(best + 1, len(p) - 1)]]) / 2)
    return chain


def trained(docs: DataFrame, labels: DataFrame, most: int = MOST) -> Chain | None:
    rows = sample(docs, labels, "toxic", most, ~held_out(F.col("doc_id")))

    def make(ids, texts, marks):
        found = [features(t) for t in texts]
        return ids, marks, *([f[k] for f in found] for k in range(2))

    out = pa.schema([("id", pa.int64()), ("label", pa.int32()), ("index", pa.list_(pa.int32())), ("stats", pa.list_(pa.float64()))])
    got = mapped(rows, make, out).toArrow().combine_chunks().sort_by("id")
    if not got.num_rows:
        return None
    index = [part for chunk in got["index"].chunks for part in np.split(chunk.flatten().to_numpy(), np.cumsum(chunk.value_lengths().to_numpy())[:-1])]
    chain = fit(got["id"].to_numpy(), list(zip(index, got["stats"].to_pylist(), strict=True)), (got["label"].to_numpy() > 0).astype(float))
    return chain and chain.packed()


def scored(docs: DataFrame, chain: Chain | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: the id, p_<category> of each, score (that of ``toxic``), toxic.
    ``chain``: packed, as ``trained`` returns it."""

    def make(ids, texts):
        if chain is None or not ids:
            return ids, *([0.0] * len(ids) for _ in CATEGORIES)
        read = reader(chain).features
        p = np.concatenate([chain.predict([read(t) for t in texts[i : i + 256]]) for i in range(0, len(ids), 256)])
        return ids, *p.T.tolist()

    names = [f"p_{c}" for c in CATEGORIES]
    out = pa.schema([("id", pa.int64()), *((n, pa.float64()) for n in names)])
    got = mapped(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), make, out)
    return got.select(F.col("id").alias(id_col), *names, F.col("p_toxic").alias("score"), (F.col("p_toxic") >= F.lit(chain.threshold if chain else 1.0)).cast("int").alias("toxic"))
