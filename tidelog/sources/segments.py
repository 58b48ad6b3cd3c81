"""Log segments: a reader and writer of the binary record format as a data source.

``spark.dataSource.register(SegmentSource)``; ``spark.read.format("segments")
.option("path", directory)``, each segment a partition; ``df.write.format("segments")``
with path, ts_ns, event_type, file_size, payload. Both need a directory that all
executors share. ``read_segments`` reads from any store that Spark reads.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions.codec import decrypt, encrypt, header
from ..model import HEADER, HEADER_BYTES, RECORD, SEGMENT_BYTES, SEGMENT_MAGIC, SEGMENT_VERSION

_PREAMBLE = SEGMENT_MAGIC + struct.pack("<I", SEGMENT_VERSION)


def records(raw: bytes) -> Iterator[tuple[str, int, int, int, int, int, bytes]]:
    """SC3: (path, ts_ns, event_type, path_len, delta_size, file_size, payload); a torn end ends it."""
    at = len(_PREAMBLE)
    while at + HEADER_BYTES <= len(raw):
        ts, kind, path_len, delta, size = struct.unpack_from(HEADER, raw, at)
        end = at + HEADER_BYTES + path_len + delta
        if path_len == 0 or end > len(raw):
            return
        body = at + HEADER_BYTES
        yield raw[body : body + path_len].decode("utf-8", "replace"), ts, kind, path_len, delta, size, raw[body + path_len : end]
        at = end


def is_segment(raw: bytes) -> bool:
    """SC2."""
    return len(raw) >= len(_PREAMBLE) and raw.startswith(SEGMENT_MAGIC)


def read_segments(spark: SparkSession, directory: str, repo: str = "", key: bytes | None = None) -> DataFrame:
    """SC1-SC4 over any store: Spark lists and reads the files, each is parsed where it
    was read. ``seq`` is the order in the store: segment number, then place. With ``key``,
    payloads are opened. Files that are no segments are skipped: see ``segment_report``."""
    if key is not None:
        return opened(read_segments(spark, directory, repo), key)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, raw in zip(batch["path"], batch["content"], strict=True):
                if not is_segment(raw):
                    continue
                first = int(os.path.basename(path).split(".")[0])
                rows = [(repo, p, ts, i, kind, n, delta, size, data) for i, (p, ts, kind, n, delta, size, data) in enumerate(records(raw))]
                yield pd.DataFrame(rows, columns=["repo", "path", "ts_ns", "_at", "event_type", "path_len", "delta_size", "file_size", "payload"]).assign(_segment=first)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ttd").load(directory).select("path", "content")
    out = files.mapInPandas(parse, "repo string, path string, ts_ns bigint, _at bigint, event_type tinyint, path_len int, delta_size bigint, file_size bigint, payload binary, _segment bigint")
    # a segment has fewer than 2^26 records, as each takes 26 bytes of 64 MiB at least; segments are numbered
    # densely, by their names alone
    number = F.substring_index(F.substring_index("path", "/", -1), ".", 1).cast("bigint")
    index = files.select(number.alias("_segment")).withColumn("_n", F.row_number().over(Window.orderBy("_segment")) - 1)
    return out.join(index, "_segment").withColumn("seq", F.col("_n") * (1 << 26) + F.col("_at")).select("repo", "path", "ts_ns", "seq", "event_type", "path_len", "delta_size", "file_size", "payload")


def segment_report(spark: SparkSession, directory: str) -> DataFrame:
    """SC2: (file, fault, n_records, torn_bytes) of each file that a read of ``directory`` meets;
    a fault ("short" or "magic") means that it was skipped, torn bytes were not read."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, raw in zip(batch["path"], batch["content"], strict=True):
                fault = "short" if len(raw) < len(_PREAMBLE) else None if is_segment(raw) else "magic"
                n, used = 0, len(_PREAMBLE)
                for r in records(raw) if fault is None else ():
                    n, used = n + 1, used + HEADER_BYTES + r[3] + r[4]
                out.append((os.path.basename(path), fault, n, len(raw) - used if fault is None else 0))
            yield pd.DataFrame(out, columns=["file", "fault", "n_records", "torn_bytes"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ttd").load(directory).select("path", "content")
    return files.mapInPandas(parse, "file string, fault string, n_records bigint, torn_bytes bigint")


#: Bytes that sealing adds to a payload: nonce and tag.
SEAL_BYTES = 28


def _bound(delta_size: Column) -> Column:
    """What a payload is sealed along with: its record's header, with the size in the clear, and path."""
    path = F.col("path").cast("binary")
    return F.concat(header(F.col("ts_ns"), F.col("event_type"), F.length(path), delta_size, F.col("file_size")), path)


def sealed(log: DataFrame, key: bytes) -> DataFrame:
    """SC4: the log with encrypted payloads; empty ones stay empty."""
    some = F.length("payload") > 0
    made = F.when(some, encrypt(F.col("payload"), key, _bound(F.length("payload")))).otherwise(F.col("payload"))
    return log.withColumn("payload", made).withColumn("delta_size", F.length("payload").cast("bigint"))


def opened(log: DataFrame, key: bytes) -> DataFrame:
    """SC4: the log as it was, sizes too. A payload, header or path that was changed fails the job."""
    some = F.length("payload") > 0
    plain = F.when(some, decrypt(F.col("payload"), key, _bound(F.length("payload") - SEAL_BYTES))).otherwise(F.col("payload"))
    return log.withColumn("payload", plain).withColumn("delta_size", F.length("payload").cast("bigint"))


class _Segment(InputPartition):
    def __init__(self, path: str, n: int):
        self.path, self.n = path, n


class _Reader(DataSourceReader):
    def __init__(self, directory: str, repo: str):
        self.directory, self.repo = directory, repo

    def partitions(self) -> list[_Segment]:
        names = sorted((n for n in os.listdir(self.directory) if n.endswith(".ttd") and n[:-4].isdigit()), key=lambda n: int(n[:-4]))
        return [_Segment(os.path.join(self.directory, n), i) for i, n in enumerate(names)]

    def read(self, partition: _Segment) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            raw = f.read()
        if is_segment(raw):
            for i, (path, ts, kind, n, delta, size, data) in enumerate(records(raw)):
                yield self.repo, path, ts, partition.n * (1 << 26) + i, kind, n, delta, size, data


class SegmentSource(DataSource):
    """For a directory that every executor can open."""

    @classmethod
    def name(cls) -> str:
        return "segments"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("repo", ""))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], [f.name for f in schema.fields], int(self.options.get("most", SEGMENT_BYTES)))


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[int, str]]


class _Writer(DataSourceWriter):
    """SK1. Tasks write files that no reader lists; the commit gives those of the tasks
    that count their names, later than all segments that are there. A task that is
    run again leaves nothing behind that is read."""

    def __init__(self, directory: str, names: list[str], most: int):
        self.directory, self.names, self.most = directory, names, most

    def write(self, rows: Iterator) -> _Written:
        os.makedirs(self.directory, exist_ok=True)
        done: list[tuple[int, str]] = []
        out, first = bytearray(), None

        def close() -> None:
            name = os.path.join(self.directory, f".{uuid.uuid4().hex}.part")
            with open(name, "wb") as f:
                f.write(_PREAMBLE + out)
                f.flush()
                os.fsync(f.fileno())
            done.append((first, name))

        for row in rows:
            r = dict(zip(self.names, row, strict=True))
            path, payload = r["path"].encode(), bytes(r["payload"] or b"")
            if out and len(out) + HEADER_BYTES + len(path) + len(payload) > self.most:
                close()
                out, first = bytearray(), None
            first = r["ts_ns"] if first is None else first
            out += struct.pack(HEADER, r["ts_ns"], r["event_type"], len(path), len(payload), r["file_size"]) + path + payload
        if out:
            close()
        return _Written(done)

    def commit(self, messages: list) -> None:
        there = [int(n[:-4]) for n in os.listdir(self.directory) if n.endswith(".ttd") and n[:-4].isdigit()]
        last = max(there, default=-1)
        for first, name in sorted(x for m in messages if m for x in m.files):
            last = max(first, last + 1)
            os.replace(name, os.path.join(self.directory, f"{last:020d}.ttd"))

    def abort(self, messages: list) -> None:
        for _, name in (x for m in messages if m for x in m.files):
            os.remove(name)
