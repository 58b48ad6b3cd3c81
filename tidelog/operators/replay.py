"""Replay of byte deltas: the ordered fold that algebra can't express."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codec import delta_decode_bytes, delta_encode_bytes
from ..model import COMPACT_ABOVE, CREATE, CREATE_DEDUP, DELETE, MODIFY
from ..plans.anchor import pruned
from .blocks import resolved
from .temporal import VersionLog


def versions(log: DataFrame, pool: DataFrame | None = None) -> DataFrame:
    """Per record of a log with payload: content after it (null if the path
    doesn't exist then) and fault. A path's records pass one by one, sorted, so only
    one content is held however long the chain. A MODIFY with an empty payload
    empties the file; a fault is named once for each path, and what follows isn't
    judged. Deduplicated records get their contents from ``pool`` (hash, size, data); a block
    that is missing or damaged is the fault "block", as is any such record without a pool."""
    pooled = pool is not None
    if pooled:
        log = resolved(log, pool)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, broken = None, None, False
        for batch in batches:
            contents, faults = [], []
            for r in batch.itertuples(index=False):
                if (r.repo, r.path) != key:
                    key, state, broken = (r.repo, r.path), None, False
                fault, payload = None, bytes(r.payload or b"")
                if r.event_type == DELETE:
                    state = None
                elif r.event_type == CREATE_DEDUP and (not pooled or r.payload is None):
                    state, fault = None, "block"
                elif r.event_type in (CREATE, CREATE_DEDUP):
                    state = payload
                elif r.event_type == MODIFY:
                    if state is None:
                        fault = "no base"
                    else:
                        try:
                            state = delta_decode_bytes(state, payload)
                        except Exception:  # whatever a damaged delta makes of it
                            fault = "delta"
                if fault is None and r.event_type != DELETE and len(state or b"") != r.file_size:
                    fault = "size"
                contents.append(None if broken or fault else state)
                faults.append(None if broken else fault)
                broken = broken or fault is not None
            yield pd.DataFrame({"repo": batch["repo"], "path": batch["path"], "ts_ns": batch["ts_ns"], "seq": batch["seq"], "event_type": batch["event_type"], "content": contents, "fault": faults})

    rows = log.select("repo", "path", "ts_ns", "seq", F.col("event_type").cast("int"), F.col("file_size").cast("bigint"), "payload")
    ordered = rows.repartition("repo", "path").sortWithinPartitions("repo", "path", "ts_ns", "seq")
    return ordered.mapInPandas(fold, "repo string, path string, ts_ns bigint, seq bigint, event_type int, content binary, fault string")


def content_as_of(log: DataFrame, until: int | None = None, pool: DataFrame | None = None, scope: str | None = None) -> DataFrame:
    """Path and content at a time (of one path or of those under it, with a
    scope), from each path's anchor on; ``fault`` where it can't be told."""
    rows = VersionLog(log).where(scope, until=until).df
    state = versions(pruned(rows), pool)
    last = state.groupBy("repo", "path").agg(F.max_by(F.struct("event_type", "content", "fault"), F.struct("ts_ns", "seq")).alias("r"), F.min("fault").alias("fault"))
    return last.where(F.col("r.event_type") != DELETE).select("repo", "path", "r.content", "fault")


def restored(log: DataFrame, until: int | None, pool: DataFrame | None = None, scope: str | None = None) -> DataFrame:
    """Of the paths that the log has in ``scope``: restored, errors, skipped (not there then)."""
    every = VersionLog(log).where(scope).paths()
    state = content_as_of(log, until, pool, scope).withColumn("there", F.lit(True))
    met = every.join(state, ["repo", "path"], "left")
    return met.agg(
        F.count(F.when(F.col("there") & F.col("fault").isNull(), 1)).alias("restored"),
        F.count(F.when(F.col("fault").isNotNull(), 1)).alias("errors"),
        F.count(F.when(F.col("there").isNull(), 1)).alias("skipped"),
    )


def against_current(log: DataFrame, current: DataFrame, until: int | None = None, pool: DataFrame | None = None) -> DataFrame:
    """Per path that either side has, the content of then (empty if there was
    none) beside that of ``current`` (path, content): path, old, new."""
    then = content_as_of(log, until, pool).select("path", F.col("content").alias("old"))
    met = then.join(current.select("path", F.col("content").alias("new")), "path", "full")
    return met.select("path", *(F.coalesce(c, F.lit(b"")).alias(c) for c in ("old", "new")))


def compacted(log: DataFrame, above: int = COMPACT_ABOVE) -> DataFrame:
    """T11 with payloads: a log that replays to the same contents at the times that are
    left. Each collapsing run is its first record and one at its last one's place: the
    delta from the first content to the last, or that content if it is smaller. Paths
    that don't replay stay as they are, so that the fault still shows."""
    names = ["repo", "path", "ts_ns", "seq", "event_type", "delta_size", "file_size", "payload"]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = state = None
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                payload = bytes(r.payload or b"")
                if r.place == 0:
                    out.append((r.repo, r.path, r.ts_ns, r.seq, r.event_type, len(payload), r.file_size, payload))
                elif r.place == 1:
                    first = state = payload
                    out.append((r.repo, r.path, r.ts_ns, r.seq, r.event_type, len(payload), r.file_size, payload))
                else:
                    state = payload if r.event_type == CREATE else delta_decode_bytes(state, payload) if payload else b""
                    if r.place == 3:
                        delta = delta_encode_bytes(first, state)
                        kind, made = (MODIFY, delta) if first and state and len(delta) < len(state) else (CREATE, state)
                        out.append((r.repo, r.path, r.ts_ns, r.seq, kind, len(made), r.file_size, made))
            yield pd.DataFrame(out, columns=names)

    rows = log.select("repo", "path", F.col("ts_ns").cast("bigint"), F.col("seq").cast("bigint"), F.col("event_type").cast("int"), F.length("payload").cast("bigint").alias("delta_size"), F.col("file_size").cast("bigint"), "payload")
    told = VersionLog(rows).runs(above)
    # a run begins with a CREATE, so it replays by itself
    bad = versions(told.where(F.col("n").isNotNull())).where("fault IS NOT NULL").select("repo", "path").distinct().withColumn("_bad", F.lit(True))
    place = F.when(F.col("n").isNull() | F.col("_bad").isNotNull(), 0).when(F.col("seq") == F.col("first_seq"), 1).when(F.col("seq") == F.col("last_seq"), 3).otherwise(2)
    told = told.join(bad, ["repo", "path"], "left").select(*names, place.alias("place"))
    ordered = told.repartition("repo", "path").sortWithinPartitions("repo", "path", "ts_ns", "seq")
    return ordered.mapInPandas(fold, "repo string, path string, ts_ns bigint, seq bigint, event_type int, delta_size bigint, file_size bigint, payload binary")
