"""Substring deduplication by sliding sentence spans.

A text is cut into sentences at full stops, exclamation and question marks and line
ends; one of more than ``PIECE`` words is cut on, so that no sentence is long: after
each word whose hash is the least among its ``NEAR`` neighbours on either side, and,
where these are over ``PIECE`` words apart, after the least in between. What precedes
a passage so moves only its first cuts, and its copies soon have the same ones. From
each sentence on, and back from each, the shortest run of at least ``RUN`` sentences
and ``WORDS`` words is hashed (words only; white space doesn't count). Runs join
globally by hash. The first place of a run, by document id and position, stays;
sentences that any other place covers are removed.

Runs that begin and end at every sentence make a passage be covered from the first
cut that its copies share to the last, if ``RUN`` sentences and ``WORDS`` words lie
between these.

Defined cases: null and empty texts, and those without a run, stay as they are; a
text may be removed in whole, which leaves it empty; a null id comes before all
others; rows that repeat an id, null ones too, are texts of their own, in the order of
their places in the files; texts of any length are read whole, one at a time; an empty table gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import addressed, staged

RUN, WORDS, PIECE = 3, 24, 12
#: Words on either side among which one has the least hash where a long sentence is cut after it.
NEAR = 2
_ODD = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(r"\S+")


#: Bytes of texts that are cut together. A longer text is cut alone.
TOGETHER = 1 << 20


class Sentences(NamedTuple):
    """The sentences of several texts, one after the other."""

    #: UTF-8 of the words, each with a space or, at the end of a line, a line feed behind it.
    joined: bytes
    #: Where each word ends in ``joined``.
    stops: np.ndarray
    #: The words before each sentence, and all.
    before: np.ndarray
    #: The sentences before each text, and all.
    of: np.ndarray

    def words(self) -> list[str]:
        return self.joined.decode("utf-8", "surrogatepass").split()


def _cut_on(joined: bytes, stops: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The ``ends`` of sentences, and where those of over ``PIECE`` words are cut."""
    begins = np.concatenate([[0], ends])[:-1]
    long = np.nonzero(ends - begins > PIECE)[0]
    if not len(long):
        return ends
    a, b = begins[long], ends[long]
    last = np.cumsum(b - a)
    size = int(last[-1])
    spans = zip((np.concatenate([[-1], stops])[a] + 1).tolist(), stops[b - 1].tolist())
    # the last word of each is the least, so that none beside it is
    rank = np.zeros(size + 2 * NEAR, np.int64)
    rank[NEAR : NEAR + size] = np.fromiter((crc32(w) for x, y in spans for w in joined[x:y].split()), np.int64, size) + 1
    rank[last + NEAR - 1] = 0
    left = np.minimum.reduce([rank[k : k + size] for k in range(NEAR)])
    right = np.minimum.reduce([rank[k : k + size] for k in range(NEAR + 1, 2 * NEAR + 1)])
    own = rank[NEAR : NEAR + size]
    cuts = [np.nonzero((own < left) & (own <= right) & (own > 0))[0] + 1]
    every = np.sort(np.concatenate([[0], cuts[0], last]))
    at, end = every[:-1], every[1:]
    while (far := end - at > PIECE).any():
        at, end = at[far], end[far]
        # the last of the least
        at = at + PIECE - own[at[:, None] + np.arange(PIECE - 1, NEAR - 1, -1)].argmin(1)
        cuts.append(at)
    # of each word of a long sentence, its place among all
    place = np.arange(size) + np.repeat(b - last, b - a)
    return np.sort(np.concatenate([ends, place[np.concatenate(cuts) - 1] + 1]))


def cut_together(texts: Iterable[str | None]) -> Sentences:
    """The sentences of ``texts``."""
    each = ["".join([f"{own}\n" for line in (text or "").splitlines() if (own := " ".join(line.split()))]).encode("utf-8", "surrogatepass") for text in texts]
    joined = b"".join(each)
    seen = np.frombuffer(joined, np.uint8)
    # no other byte of a word is one of these
    stops = np.nonzero((seen == 0x20) | (seen == 0x0A))[0]
    ends = _cut_on(joined, stops, np.nonzero((seen[stops] == 0x0A) | np.isin(seen[stops - 1], np.frombuffer(b".!?", np.uint8)))[0] + 1)
    words = np.searchsorted(stops, np.cumsum([0, *map(len, each)]))
    return Sentences(joined, stops, np.concatenate([[0], ends]), np.searchsorted(ends, words, "right"))


def cut(text: str) -> list[list[str]]:
    """The words of each sentence."""
    found = cut_together([text])
    words, before = found.words(), found.before.tolist()
    return [words[a:b] for a, b in zip(before, before[1:])]


def runs(found: Sentences) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, first sentence of those of the text, sentences) of each run, without repeats, in the order of their places."""
    before, n = found.before, len(found.before) - 1
    text = np.repeat(np.arange(len(found.of) - 1), np.diff(found.of))
    low, high, start = found.of[text], found.of[text + 1], np.arange(n)
    # forth: the least end with enough words and sentences; back: the largest start, if it isn't that one's end
    end = np.maximum(np.searchsorted(before, before[:-1] + WORDS), start + RUN)
    begin = np.minimum(np.searchsorted(before, before[1:] - WORDS, "right") - 1, start + 1 - RUN)
    forth, back = np.nonzero(end <= high)[0], np.nonzero(begin >= low)[0]
    back = back[end[begin[back]] != back + 1]
    first, stop = np.concatenate([forth, begin[back]]), np.concatenate([end[forth], back + 1])
    order = np.argsort(first, kind="stable")
    first, stop = first[order], stop[order]
    spans = zip((np.concatenate([[-1], found.stops])[before[:-1]] + 1).tolist(), found.stops[before[1:] - 1].tolist())
    each = np.fromiter((xxhash.xxh64_intdigest(found.joined[a:b]) for a, b in spans), np.uint64, n)
    # a polynomial over the sentences' hashes, modulo 2^64: sums of any run from prefix sums
    inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
    with np.errstate(over="ignore"):
        powers, back_powers = (np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, x))])[:n] for x in (_ODD, inverse))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(each * powers)])
        value = (sums[stop] - sums[first]) * back_powers[first]
        value ^= (stop - first).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return value.view(np.int64), text[first], (first - low[first]).astype(np.int32), (stop - first).astype(np.int32)


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches``, those together whose texts (the second column) are cut together."""
    for batch in batches:
        start = size = 0
        for i, k in enumerate(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()):
            if i > start and size + k > TOGETHER:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += k
        if start < len(batch):
            yield batch.slice(start)


def repeated(rows: DataFrame) -> DataFrame:
    """(_row, runs: first, n): for each of ``rows`` (id, text, _row) that loses any sentences,
    the runs that cover them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            run, text, first, n = map(pa.array, runs(cut_together(batch.column(1).to_pylist())))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(text), batch.column(2).take(text), run, first, n], ["id", "_row", "run", "first", "n"])

    every = staged(rows.select("id", "text", "_row").mapInArrow(run, "id long, _row struct<file: long, at: long>, run long, first int, n int"), "runs")
    # most runs are unique: a count by hash is all that is gathered of them. One run can stand in a third of the
    # documents: what it is joined with is written first, so that a skewed partition of a join is split as it runs
    twice = staged(every.groupBy("run").count().where(F.col("count") > 1).select(F.col("run").alias("of")), "twice")
    shared = staged(every.join(twice.hint("merge"), F.col("run") == F.col("of")).drop("of"), "shared")
    place = F.struct(F.col("id").isNotNull(), "id", "_row", "first")
    firsts = staged(shared.groupBy("run").agg(F.min(place).alias("place")).select(F.col("run").alias("of"), F.col("place._row").alias("first_row"), F.col("place.first").alias("first_at")), "firsts")
    others = shared.join(firsts.hint("merge"), F.col("run") == F.col("of")).where((F.col("_row") != F.col("first_row")) | (F.col("first") != F.col("first_at")))
    # a text has at most two runs for each of its sentences
    return staged(others.groupBy("_row").agg(F.collect_list(F.struct("first", "n")).alias("runs")), "gone")


def _within(first: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """Of each of ``size`` sentences, whether any of the runs covers it."""
    steps = np.bincount(first, minlength=size + 1) - np.bincount(first + n, minlength=size + 1)
    return np.cumsum(steps)[:size] > 0


def covered(found: list[dict] | None) -> list[int]:
    """The sentences that any of the runs covers."""
    if not found:
        return []
    first, n = (np.array([r[k] for r in found], np.int64) for k in ("first", "n"))
    return np.nonzero(_within(first, n, int((first + n).max())))[0].tolist()


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: the id, n_sentences, n_removed, removed_words, text (what is
    left; as it was where nothing is removed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            texts = batch.column(1).to_pylist()
            found = cut_together(texts)
            covers = batch.column(2).flatten()
            first, n = (covers.field(k).to_numpy().astype(np.int64) for k in ("first", "n"))
            first += np.repeat(found.of[:-1], pc.fill_null(pc.list_value_length(batch.column(2)), 0).to_numpy())
            gone = _within(first, n, len(found.before) - 1)
            removed, words = (np.diff(np.concatenate([[0], np.cumsum(x)])[found.of]) for x in (gone, gone * np.diff(found.before)))
            for k in np.nonzero(removed)[0].tolist():
                low, high = found.of[k : k + 2].tolist()
                ends = (found.before[low : high + 1] - found.before[low]).tolist()
                text = texts[k]
                places, kept, at = [m.span() for m in _WORD.finditer(text)], [], 0
                for i in np.nonzero(gone[low:high])[0].tolist():
                    kept.append(text[at : places[ends[i]][0]])
                    at = places[ends[i + 1] - 1][1]
                text = "".join(kept) + text[at:]
                texts[k] = text.strip() and text
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (np.diff(found.of), removed, words)), pa.array(texts, pa.string())], [id_col, "n_sentences", "n_removed", "removed_words", "text"])

    rows = addressed(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "id", "text")
    gone = repeated(rows).withColumnRenamed("_row", "_of")
    kept = rows.join(gone, F.col("_row") == F.col("_of"), "left")
    return kept.select("id", "text", "runs").mapInArrow(run, f"`{id_col}` long, n_sentences long, n_removed long, removed_words long, text string")
