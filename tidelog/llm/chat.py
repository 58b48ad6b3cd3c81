"""Chat formatting at the level of tokens.

Each segment of text is encoded by itself as ordinary tokens, and the ids of the
template's control marks, which lie beyond the vocabulary, are spliced in between;
no content can yield them. The loss mask is a prefix sum over +1 where an
assistant's text begins and -1 where it ends. Since the formatted conversation can
also be read as characters, control strings that occur in content are escaped there,
reversibly.

    system     <<SYS>> text <</SYS>>
    user       [INST] text [/INST]
    assistant  <s> text </s>
    others     <<ROLE>> role <</ROLE>> [INST] text [/INST]

(without the spaces). Rows are encoded where they are read, however they are shared out
among conversations; for digests, what is read back is sorted by conversation and turn
and passes one by one, so that a conversation of any length takes the memory of a batch.

Defined cases: null text is empty; a null role is the empty role; null turns come
first; rows that tie on turn are ordered by role and text, so equal ones count each;
texts of any length are read whole; a null conv_id is a conversation of its own; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import codec

#: Control strings, in the order of their reserved ids.
MARKS = ("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "<<ROLE>>", "<</ROLE>>")
SYS, END_SYS, INST, END_INST, BEGIN, END, ROLE, END_ROLE = range(len(MARKS))
#: Marks a control string in content as text; doubled where it stands for itself.
ESCAPE = "\N{SYMBOL FOR ESCAPE}"
_CONTROL = re.compile("|".join(map(re.escape, MARKS)))
_ESCAPED = re.compile(f"{ESCAPE}({ESCAPE}?)")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + ESCAPE + m[0][1:], text.replace(ESCAPE, ESCAPE * 2))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Template:
    def __init__(self, path: str, pattern: str):
        self.bpe = codec(path, pattern)
        self.base = self.bpe.width  # the first reserved id

    def turns(self, rows: list[tuple[str | None, str | None]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The tokens of each (role, text) and their loss mask."""
        texts = [escape(x or "") for row in rows for x in row]
        ids = [np.array(x.split(), np.int64) for x in self.bpe.encode(texts)]
        for i, (role, _) in enumerate(rows):
            said, body = ids[2 * i], ids[2 * i + 1]
            name = role or ""
            if name == "system":
                parts = [[SYS], body, [END_SYS]]
            elif name == "user":
                parts = [[INST], body, [END_INST]]
            elif name == "assistant":
                parts = [[BEGIN], body, [END]]
            else:
                parts = [[ROLE], said, [END_ROLE], [INST], body, [END_INST]]
            tokens = np.concatenate([np.array(p, np.int64) + self.base if isinstance(p, list) else p for p in parts])
            steps = np.zeros(len(tokens) + 1, np.int64)
            if name == "assistant":
                steps[1] += 1
                steps[1 + len(body)] -= 1
            yield tokens, np.cumsum(steps[:-1]) > 0

    def text(self, tokens: np.ndarray) -> str:
        """Escaped, as it stands between marks."""
        return self.bpe.decode(tokens.tolist()).decode("utf-8", "surrogatepass")

    def written(self, tokens: np.ndarray) -> str:
        """All tokens as characters, marks included."""
        out, start = [], 0
        for at in [*np.nonzero(tokens >= self.base)[0].tolist(), len(tokens)]:
            out.append(self.text(tokens[start:at]))
            if at < len(tokens):
                out.append(MARKS[tokens[at] - self.base])
            start = at + 1
        return "".join(out)

    def read(self, tokens: np.ndarray) -> Iterator[tuple[str, str]]:
        """The (role, text) of each turn that the tokens hold."""
        at = np.nonzero(tokens >= self.base)[0].tolist()
        role = None
        for a, b in zip(at[::2], at[1::2], strict=True):
            mark, body = int(tokens[a] - self.base), unescape(self.text(tokens[a + 1 : b]))
            if mark == ROLE:
                role = body
            else:
                yield role if role is not None else {SYS: "system", INST: "user", BEGIN: "assistant"}[mark], body
                role = None


_READ = pa.schema([("role", pa.string()), ("text", pa.string()), ("learnt", pa.bool_()), ("chars", pa.int64()), ("n_tokens", pa.int64())])
_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_tokens", pa.int64())])


def formatted(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per turn: conv_id, turn, role, text, tokens (array of int), loss (array of
    boolean). The tokens of a conversation's turns, sorted by turn, role and text, one after
    the other, are its formatted form. Encodes rows where they are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = Template(path, pattern)
        for batch in batches:
            made = list(template.turns(list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True))))
            tokens = pa.array([t for t, _ in made], pa.list_(pa.int32()))
            loss = pa.array([m for _, m in made], pa.list_(pa.bool_()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int64()), batch.column(2), batch.column(3), tokens, loss], ["conv_id", "turn", "role", "text", "tokens", "loss"])

    keep = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return keep.mapInArrow(run, "conv_id long, turn long, role string, text string, tokens array<int>, loss array<boolean>")


def digested(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """Formats each conversation and reads it back. Per conversation: conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens.

    A turn is encoded and read back where its row is read; what is read goes to its
    conversation's task, which only puts it through the digests. They take one turn
    after the other, so that part can't be split."""

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = Template(path, pattern)
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for tokens, loss in template.turns(list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True))):
                ((role, text),) = template.read(tokens)
                learnt = unescape(template.text(tokens[loss]))
                if learnt not in ("", text):
                    raise ValueError("the loss mask holds part of a turn's text")
                for column, x in zip(out, (role, text, bool(learnt), len(template.written(tokens)), len(tokens)), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(x, f.type) for x, f in zip(out, _READ, strict=True))], ["conv_id", "turn", *_READ.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None
        for batch in batches:
            done = []
            for conv, _, role, text, learnt, chars, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now[0] != conv:
                    if now:
                        done.append(now)
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if learnt:
                    now[3] += len(text)
                    now[4].update(text.encode("utf-8", "surrogatepass"))
                now[5] += chars
                now[6] += n
            yield _closed(done, _DIGESTS)
        yield _closed([now] if now else [], _DIGESTS)

    keep = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    read = keep.mapInArrow(back, "conv_id long, turn long, role string, text string, learnt boolean, chars long, n_tokens long")
    together = read.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return together.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long")


def _closed(found: list[list], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*([c, n, t.hexdigest(), k, s.hexdigest(), f, m] for c, n, t, k, s, f, m in found), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)] if found else [pa.array([], f.type) for f in schema], schema=schema)
