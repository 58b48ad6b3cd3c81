"""Byte-level BPE encoding and decoding.

Texts are cut by a pattern; each distinct piece of a batch is encoded once. Pieces
of like length form padded matrices of token ids, and in each round every row of a
matrix merges its leftmost pair of minimum rank; ranks are found by hashing the
pair, and merged rows close up. A row leaves when no pair is left to merge.

The pattern has to put a boundary before each space between two other characters
(as those of byte-level vocabularies do): texts are cut there first, and what
stands between two cuts is remembered with its ids, written as decimals.

Defined cases: null and empty text have no tokens; texts may be of any length, as
pieces, not texts, are rows; a piece above ``LONG`` bytes takes its merges from a
heap, in the same order, as a matrix needs a round for each merge.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alone

#: Bytes above which a piece is merged by heap.
LONG = 256
#: Cells of one matrix, and words that a worker remembers in each of two generations.
CELLS, REMEMBERED = 1 << 20, 300_000
#: Rows of a batch that are held as Python's values at once.
PIECE = 2048
#: Characters of text that are worked on at once.
CHUNK = 4 << 20


class PairTable:
    """(left, right) -> rank by open addressing in flat arrays."""

    def __init__(self, pairs: np.ndarray, ranks: np.ndarray):
        self.bits = int(len(pairs) * 2).bit_length()
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        at, left = self._slot(pairs), np.arange(len(pairs))
        while len(left):
            free = self.keys[at[left]] < 0
            tried = left[free]
            _, first = np.unique(at[tried], return_index=True)
            won = tried[first]
            self.keys[at[won]], self.ranks[at[won]] = pairs[won], ranks[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            at[left] = np.where(self.keys[at[left]] >= 0, at[left] + 1 & (1 << self.bits) - 1, at[left])

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, pairs: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where there is none."""
        at, out, open_ = self._slot(pairs), np.full(len(pairs), -1, np.int32), np.arange(len(pairs))
        while len(open_):
            seen = self.keys[at]
            hit = seen == pairs[open_]
            out[open_[hit]] = self.ranks[at[hit]]
            going = ~hit & (seen >= 0)
            open_, at = open_[going], at[going] + 1 & (1 << self.bits) - 1
        return out


class ByteBpe:
    """``path``: a file of ranks, a base64 token and its rank on each line."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.vocab = {b: a for a, b in self.ranks.items()}
        self.width = max(self.vocab) + 1
        self.split = regex.compile(pattern).findall
        # whichever two tokens make up a third can be merged into it
        found = [(self.ranks[t[:i]] * self.width + self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        pairs = np.array(found, np.int64).reshape(-1, 2)
        self.pairs = PairTable(pairs[:, 0], pairs[:, 1].astype(np.int32))
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.digits = list(map(str, range(self.width)))
        self.by_digits = {str(i): t for i, t in self.vocab.items()}
        #: Word, without the space before it -> ids as decimals; for a text's first word, and for others.
        self.known: tuple[dict[str, str], dict[str, str]] = ({}, {})
        self.older: tuple[dict[str, str], dict[str, str]] = ({}, {})

    def _merge_matrix(self, pieces: list[bytes], width: int) -> list[tuple[int, ...]]:
        n, none = len(pieces), np.int32(self.width)
        size = np.fromiter(map(len, pieces), np.int64, n)
        inside = np.arange(width) < size[:, None]
        ids = np.full((n, width), -1, np.int32)
        ids[inside] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = np.full((n, width), none, np.int32)  # of the pair that begins here

        def look(rows: np.ndarray, at: np.ndarray) -> None:
            a, b = ids[rows, at].astype(np.int64), ids[rows, at + 1]
            got = self.pairs.find(a * self.width + b)
            ranks[rows, at] = np.where((a >= 0) & (b >= 0) & (got >= 0), got, none)

        rows, at = np.nonzero(inside[:, 1:])
        look(rows, at)
        out: list[tuple[int, ...]] = [()] * n
        names = np.arange(n)
        column = np.arange(width)
        while len(names):
            at = ranks.argmin(1)
            rows = np.arange(len(names))
            best = ranks[rows, at]
            if (over := best == none).any():
                for i in np.nonzero(over)[0]:
                    out[names[i]] = tuple(ids[i, : size[i]].tolist())
                going = ~over
                names, ids, ranks, size, at, best = names[going], ids[going], ranks[going], size[going], at[going], best[going]
                rows = np.arange(len(names))
                if not len(names):
                    break
            ids[rows, at] = best
            # what stands right of the merged pair closes up
            shift = np.minimum(column + (column > at[:, None]), width - 1)
            ids, ranks = np.take_along_axis(ids, shift, 1), np.take_along_axis(ranks, shift, 1)
            size -= 1
            ids[rows, np.minimum(size, width - 1)] = -1
            last = size[rows] - 1
            ranks[rows, last] = none
            some = np.nonzero(at < last)[0]
            ranks[some, at[some]] = none
            look(some, at[some])
            some = np.nonzero(at > 0)[0]
            look(some, at[some] - 1)
        return out

    def _merge_heap(self, piece: bytes) -> tuple[int, ...]:
        ids = [int(self.single[b]) for b in piece]
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        texts: list[bytes | None] = [self.vocab[i] for i in ids]
        heap: list[tuple[int, int, bytes]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] >= 0 and (both := texts[i] + texts[after[i]]) in self.ranks:
                heapq.heappush(heap, (self.ranks[both], i, both))

        for i in range(len(ids) - 1):
            offer(i)
        while heap:
            rank, i, both = heapq.heappop(heap)
            j = after[i] if texts[i] is not None else -1
            if j < 0 or texts[i] + texts[j] != both:
                continue
            ids[i], texts[i], texts[j], after[i] = rank, both, None, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(i)
            offer(before[i])
        return tuple(i for i, t in zip(ids, texts, strict=True) if t is not None)

    def merge(self, pieces: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """The ids of each distinct piece."""
        out: dict[str, tuple[int, ...]] = {}
        lengths: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode("utf-8", "surrogatepass")
            if (whole := self.ranks.get(raw)) is not None:
                out[piece] = (whole,)
            elif len(raw) > LONG:
                out[piece] = self._merge_heap(raw)
            else:
                lengths.setdefault(max(4, 1 << (len(raw) - 1).bit_length()), []).append((piece, raw))
        for width, found in lengths.items():
            for i in range(0, len(found), step := max(1, CELLS // width)):
                part = found[i : i + step]
                out.update(zip((p for p, _ in part), self._merge_matrix([r for _, r in part], width), strict=True))
        return out

    def _learn(self, words: set[str], rest: int) -> None:
        known, older = self.known[rest], self.older[rest]
        fresh = words.difference(known)
        kept = [word for word in fresh if word in older]
        known.update((word, older[word]) for word in kept)
        fresh.difference_update(kept)
        cut = {word: self.split(" " * rest + word) for word in fresh}
        ids = self.merge({p for own in cut.values() for p in own})
        written = {p: " ".join(map(self.digits.__getitem__, t)) for p, t in ids.items()}
        known.update((word, " ".join(map(written.__getitem__, own))) for word, own in cut.items())

    def encode(self, texts: list[str | None]) -> Iterator[str]:
        """The ids of each text as decimals with one space between, in order."""
        i = 0
        while i < len(texts):
            cut, size = [], 0
            while i < len(texts) and (size == 0 or size < CHUNK):
                text = texts[i] or ""
                # at a space with no other white space beside it
                cut.append(_LONE_SPACE.split(text) if _SPACES.search(text) else text.split(" "))
                size += len(text) + 1
                i += 1
            if max(map(len, self.known)) > REMEMBERED:
                self.older, self.known = self.known, ({}, {})
            self._learn({own[0] for own in cut}, 0)
            self._learn({word for own in cut for word in own[1:]}, 1)
            first, others = self.known[0], self.known[1].__getitem__
            for own in cut:
                yield first[own[0]] + (" " + " ".join(map(others, own[1:])) if len(own) > 1 else "")

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.vocab.__getitem__, ids))

    def decode_decimals(self, ids: str) -> bytes:
        return b"".join(map(self.by_digits.__getitem__, ids.split(" "))) if ids else b""


#: White space beside a space, or a space at either end; a space that stands alone.
_SPACES, _LONE_SPACE = re.compile(r"\s |[ ]\s|^ | $"), re.compile(r"(?<=\S) (?=\S)")
_loaded: dict[tuple[str, str], ByteBpe] = {}


def codec(path: str, pattern: str) -> ByteBpe:
    """One for each worker process."""
    alone("bpe", _loaded.clear)
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBpe(path, pattern)
    return _loaded[path, pattern]


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: the id and ``tokens`` (array of int)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            values, ends = [], [0]
            for text in bpe.encode(batch.column(1).to_pylist()):
                ids = np.array(text.split(), np.int32)
                values.append(ids)
                ends.append(ends[-1] + len(ids))
            flat = pa.array(np.concatenate(values) if values else np.zeros(0, np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], [id_col, "tokens"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` long, tokens array<int>")


def decoded(rows: DataFrame, path: str, pattern: str, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """Per row: the id and ``content`` (binary), the bytes that its tokens stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(t or ()) for t in batch.column(1).to_pylist()], pa.binary())], [id_col, "content"])

    return rows.select(F.col(id_col).cast("long").alias(id_col), F.col(tokens_col).alias("tokens")).mapInArrow(run, f"`{id_col}` long, content binary")


def digested(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_tokens: bool = False) -> DataFrame:
    """Encodes and decodes again in one pass. Per row: the id, n_tokens, ids_sha256
    (of the decimal ids, joined by one space), decoded_sha256 and, if asked for,
    tokens (array of int)."""
    schema = f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", tokens array<int>" * with_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in (whole.slice(at, PIECE) for whole in batches for at in range(0, max(1, whole.num_rows), PIECE)):
            start, n, ids_sha, sha, values = 0, [], [], [], []

            def made() -> pa.RecordBatch:
                columns = [batch.column(0).slice(start, len(n)), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(sha, pa.string())]
                if with_tokens:
                    flat = pa.array(np.concatenate([np.zeros(0, np.int32), *values]), pa.int32())
                    columns.append(pa.ListArray.from_arrays(pa.array([0, *np.cumsum(n, dtype=np.int64).tolist()], pa.int32()), flat))
                return pa.RecordBatch.from_arrays(columns, [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "tokens"][: len(columns)])

            held = 0
            for ids in bpe.encode(batch.column(1).to_pylist()):
                n.append(ids.count(" ") + bool(ids))
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                sha.append(hashlib.sha256(bpe.decode_decimals(ids)).hexdigest())
                if with_tokens:
                    values.append(np.fromstring(ids, np.int32, sep=" ") if ids else np.zeros(0, np.int32))
                    held += n[-1]
                    if held >= CELLS:
                        yield made()
                        start, held, n, ids_sha, sha, values = start + len(n), 0, [], [], [], []
            yield made()

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text")).mapInArrow(run, schema)
