"""Schemas and codes of the data model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the record format.
CREATE, MODIFY, DELETE, RENAME, CREATE_DEDUP = 1, 2, 3, 4, 5
LABELS = {CREATE: "CREATE", MODIFY: "MODIFY", DELETE: "DELETE", RENAME: "RENAME", CREATE_DEDUP: "CREATE_D"}
#: Which of them `log`, `log --since` and `extlog` name.
LOG_LABELS = EXTLOG_LABELS = (CREATE, MODIFY, DELETE, CREATE_DEDUP)
SINCE_LABELS = (CREATE, MODIFY, DELETE)
SEGMENT_MAGIC, SEGMENT_VERSION, SEGMENT_BYTES = b"TTDLTA01", 1, 64 << 20
HEADER = "<QBIIQ"
HEADER_BYTES = 25
BLOCK_BYTES, HASH_BYTES, DEDUP_FROM, LARGEST_FILE = 64 << 10, 32, 1 << 20, 64 << 20
DEBOUNCE_MS, COMPACT_ABOVE = 200, 15

RECORD = "repo STRING, path STRING, ts_ns BIGINT, seq BIGINT, event_type TINYINT, path_len INT, delta_size BIGINT, file_size BIGINT, payload BINARY"
TAG = "name STRING, ts_ns BIGINT, seq BIGINT"
ANNOTATION = "ts_ns BIGINT, path STRING, summary STRING"
BLOCK = "hash BINARY, size INT, data BINARY"
BLOCK_REF = "path STRING, ts_ns BIGINT, pos INT, hash BINARY"


def label(event_type: Column, unknown: str = "???", only: tuple[int, ...] = tuple(LABELS)) -> Column:
    """the name of an event code."""
    out = F.lit(unknown)
    for code in only:
        out = F.when(event_type == code, LABELS[code]).otherwise(out)
    return out


def is_full(event_type: Column) -> Column:
    """Whether a record resets the state of its path."""
    return event_type.isin(CREATE, DELETE, CREATE_DEDUP)
