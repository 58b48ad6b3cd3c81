"""What the classifiers of this subpackage read from a text, and how they get labels."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import alone

#: Words whose hashes a worker remembers.
REMEMBERED = 250_000
_hashes: dict[str, int] = {}
#: Marks that are stripped from a word's ends where it is taken as a word.
EDGES = ".,;:!?\"'()[]{}*#%$&|-"
STATISTICS = 15
#: Rows of a batch that are worked on at once.
PIECE = 1024


def hashed(words: Counter) -> tuple[np.ndarray, np.ndarray]:
    """CRC-32 of each distinct word, and its count."""
    if len(_hashes) > REMEMBERED:
        _hashes.clear()
    out = np.empty(len(words), np.int64)
    for i, w in enumerate(words):
        h = _hashes.get(w)
        if h is None:
            h = _hashes[w] = zlib.crc32(w.encode("utf-8", "surrogatepass"))
        out[i] = h
    return out, np.fromiter(words.values(), np.float64, len(words))


def structure(text: str, words: list[str], counts: Counter, n_chars: int | None) -> list[float]:
    """Statistics of a text's form, and its metadata (n_chars; null counts as the text's own length)."""
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    n, size, lines = len(words) or 1, int(raw.sum()) or 1, text.split("\n")
    upper, lower = int(raw[65:91].sum()), int(raw[97:123].sum())
    of = lambda marks: int(raw[np.frombuffer(marks, np.uint8)].sum())
    return [
        np.log1p(len(words)),
        size / n,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        upper / (upper + lower + 1),
        int(raw[48:58].sum()) / size,
        of(b"&*$#%@^~<>=+_\\") / n,
        of(b"!?") / n,
        of(b"|") / n,
        of(b".,;:") / n,
        len(lines) / n,
        1 - len(set(lines)) / len(lines),
        int(raw[128:].sum()) / size,
        np.log1p(len(text) if n_chars is None else max(0, n_chars)),
    ]


def sample(docs: DataFrame, labels: DataFrame, label_col: str, most: int, trains: Column, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """At most ``most`` labelled documents for which ``trains`` holds, taken by the
    hash of their id: (id, text, label, and ``more``). Null labels are none. The ids
    are few, so the documents are found without shuffling them."""
    few = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & trains).groupBy(id_col).agg(F.max(label_col).alias("label")).orderBy(F.xxhash64(id_col), id_col).limit(most)
    few = few.select(F.col(id_col).cast("long").alias("id"), F.col("label").cast("int").alias("label"))
    # what else the documents hold is left behind first, so that no name is there twice
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *more)
    return own.join(F.broadcast(few), "id").select("id", "text", "label", *more)


def mapped(rows: DataFrame, make, out: pa.Schema, carried: tuple[str, ...] = ()) -> DataFrame:
    """``make``: a list of columns from a batch's columns, as lists of Python values. The
    ``carried`` ones come last in ``rows``; ``make`` doesn't see them, and they follow as they are."""
    kinds = {pa.int64(): "long", pa.int32(): "int", pa.float64(): "double", pa.list_(pa.int32()): "array<int>", pa.list_(pa.float32()): "array<float>", pa.list_(pa.float64()): "array<double>"}
    schema = T.StructType.fromDDL(", ".join(f"`{f.name}` {kinds[f.type]}" for f in out))
    for c in carried:
        schema = schema.add(rows.schema[c])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("features", _hashes.clear)
        for whole in batches:
            # in pieces, as Python's values and the columns made of them take several times a batch
            for at in range(0, max(1, whole.num_rows), PIECE):
                batch = whole.slice(at, PIECE)
                n = batch.num_columns - len(carried)
                own = [pa.array(c, f.type) for c, f in zip(make(*(c.to_pylist() for c in batch.columns[:n])), out, strict=True)]
                yield pa.RecordBatch.from_arrays([*own, *batch.columns[n:]], [*out.names, *carried])

    return rows.mapInArrow(run, schema)
