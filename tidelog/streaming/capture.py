"""Change capture: debounced events and the state machine that makes records of them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.codec import delta_encode_bytes
from ..model import CREATE, DEBOUNCE_MS, DELETE, MODIFY

RECORDS = "path string, ts_ns bigint, event_type int, payload binary, file_size bigint, reason string"


#: Kinds of events after which a path is gone, and those that end a session at once.
GONE, CLOSES = ("delete", "moved_from"), ("close", "delete", "moved_from")


def event_kind(kind: Column) -> Column:
    """ST4: a rename is a deletion and a modification."""
    return F.when(kind.isin(*GONE), DELETE).otherwise(MODIFY)


def sessions(events: DataFrame, gap: str = f"{DEBOUNCE_MS} milliseconds", ts: str = "ts", key: str = "path") -> DataFrame:
    """ST1, for a batch or a stream with a watermark: events of a path that are no
    further apart than ``gap``."""
    return events.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")).drop("w")


def islands(events: DataFrame, gap_us: int, closes: Column | None = None, ts_us: str = "ts_us", order: str = "seq", key: str = "path") -> DataFrame:
    """ST1, ST2 for a batch: sessions that also end at a closing event."""
    w = Window.partitionBy(key).orderBy(ts_us, order)
    cut = (F.col(ts_us) - F.lag(ts_us).over(w)) > gap_us
    if closes is not None:
        cut = cut | F.coalesce(F.lag(closes).over(w), F.lit(False))
    rows = events.withColumn("_session", F.sum(F.coalesce(cut, F.lit(False)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, F.col("_session").cast("bigint").alias("session")).agg(F.count("*").alias("n"), F.min(ts_us).alias("first_us"), F.max(ts_us).alias("last_us"))


class Debounce(StatefulProcessor):
    """ST1-ST3 for a stream of (path, ts, kind) with a watermark: a session of a path ends once the
    watermark has passed its last event by more than the gap, as events that come late can join two
    sessions until then, or at once with a closing event or a deletion. Its kind is that of the last
    event: a deletion is overridden by what follows in its session."""

    def __init__(self, gap_ms: int = DEBOUNCE_MS):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getListState("sessions", "first_ms bigint, last_ms bigint, n bigint, event_type int")

    def _kept(self, open_ones: list[tuple]) -> None:
        """What is open from now on, and when the first of it ends. Each call to the state is a round trip."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if open_ones:
            self.state.put(open_ones)
            self.handle.registerTimer(min(last for _, last, _, _ in open_ones) + self.gap_ms + 1)
        else:
            self.state.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ended, open_ones, now = [], [], None
        found = pd.concat(list(rows)).sort_values(["at_ms", "order"], kind="stable")
        events = [(at, at, 1, DELETE if kind in GONE else MODIFY, kind in CLOSES) for at, kind in zip(found["at_ms"].tolist(), found["kind"].tolist(), strict=True)]
        # a session that is open takes part like an event that lasts
        for first, last, n, kind, closes in sorted([(*s, False) for s in self.state.get()] + events, key=lambda s: s[0]):
            if now is not None and first - now[1] > self.gap_ms:
                open_ones.append(now)
                now = None
            if now is None:
                now = (first, last, n, kind)
            else:
                now = (now[0], max(now[1], last), now[2] + n, kind if last >= now[1] else now[3])
            if closes:
                ended.append((key[0], *now))
                now = None
        self._kept(open_ones if now is None else [*open_ones, now])
        yield pd.DataFrame(ended, columns=_SESSION)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until, open_ones = timerValues.getCurrentWatermarkInMs(), [tuple(s) for s in self.state.get()]
        ended = [s for s in open_ones if s[1] + self.gap_ms + 1 <= until]
        self._kept([s for s in open_ones if s[1] + self.gap_ms + 1 > until])
        yield pd.DataFrame([(key[0], *s) for s in ended], columns=_SESSION)

    def close(self) -> None:
        pass


_SESSION = ["path", "first_ms", "last_ms", "n", "event_type"]


def debounced(events: DataFrame, gap_ms: int = DEBOUNCE_MS, lateness: str = "1 second", order: str | None = None) -> DataFrame:
    """Sessions (path, first_ms, last_ms, n, event_type) of a stream of (path, ts, kind). Events of
    one path and millisecond come by ``order``, a column of the stream, if one is named."""
    # times as numbers: pandas would get them in the session's time zone
    timed = events.select("path", "ts", "kind", F.unix_millis("ts").alias("at_ms"), (F.col(order) if order else F.lit(0)).alias("order"))
    late = timed.withWatermark("ts", lateness)
    return late.groupBy("path").transformWithStateInPandas(Debounce(gap_ms), "path string, first_ms bigint, last_ms bigint, n bigint, event_type int", "Append", "EventTime")


def enriched(events: DataFrame, contents: DataFrame) -> DataFrame:
    """ST5: what is there when a path has had an event, whatever the event said: (path,
    ts_ns, content), null if nothing is. ``contents`` (path, content) is read anew in each batch."""
    return events.select("path", "ts_ns").join(contents.select("path", "content"), "path", "left")


def settled(reads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """of reads with size and mtime before and after, those that held still, and the
    events that have the others read again."""
    same = (F.col("size") == F.col("size_after")) & (F.col("mtime") == F.col("mtime_after"))
    return reads.where(same), reads.where(~same).select("path", "ts_ns", F.lit(MODIFY).alias("event_type"))


def step(state: tuple | None, content: bytes | None, ts_ns: int, start_ns: int) -> tuple[tuple | None, list[tuple]]:
    """ST6: (content, anchored, baseline_pending) and what is there now (None: nothing)
    to the state after it and records (ts_ns, event_type, payload, file_size, reason)."""
    if content is None:
        recorded = state is not None and not state[2]
        return None, [(ts_ns, DELETE, b"", 0, "gone")] if recorded else []
    if state is None:
        return (content, True, False), [(ts_ns, CREATE, content, len(content), "new")]
    old, anchored, pending = state
    if content == old:
        return state, []
    if pending:
        first = (start_ns, CREATE, old, len(old), "original")
        return (content, True, False), [first, _change(old, content, ts_ns)]
    if not anchored:
        return (content, True, False), [(ts_ns, CREATE, content, len(content), "reanchored")]
    return (content, True, False), [_change(old, content, ts_ns)]


def _change(old: bytes, new: bytes, ts_ns: int) -> tuple:
    delta = delta_encode_bytes(old, new) if old and new else b""
    return (ts_ns, MODIFY, delta, len(new), "changed") if delta else (ts_ns, CREATE, new, len(new), "rewritten")


class Capture(StatefulProcessor):
    """``step`` over a stream of (path, ts_ns, content), with the state of each path kept
    by Spark. A path's rows of one batch are sorted in memory, which the source's limit of a
    batch (as ``maxFilesPerTrigger``) bounds: their order counts across the pieces they come in."""

    def __init__(self, start_ns: int = 0):
        self.start_ns = start_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("file", "content binary, anchored boolean, pending boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = self.state.get() if self.state.exists() else None
        now = None if now is None else (bytes(now[0]), now[1], now[2])
        out = []
        for r in pd.concat(list(rows)).sort_values("ts_ns", kind="stable").itertuples(index=False):
            now, made = step(now, None if r.content is None else bytes(r.content), r.ts_ns, self.start_ns)
            out += [(key[0], *m) for m in made]
        if now is None:
            self.state.clear()
        else:
            self.state.update(now)
        yield pd.DataFrame(out, columns=["path", "ts_ns", "event_type", "payload", "file_size", "reason"])

    def handleInitialState(self, key, initial: pd.DataFrame, timerValues) -> None:
        """ST7: a file with history is not anchored; one without waits with its first content."""
        r = initial.iloc[0]
        self.state.update((bytes(r["content"]), False, not r["has_history"]))

    def close(self) -> None:
        pass


def captured(snapshots: DataFrame, start_ns: int = 0, initial: DataFrame | None = None) -> DataFrame:
    """``snapshots``: a stream of (path, ts_ns, content); ``initial``: (path, content, has_history)."""
    return snapshots.groupBy("path").transformWithStateInPandas(
        Capture(start_ns), RECORDS, "Append", "None", initialState=initial.groupBy("path") if initial is not None else None
    )


def captured_batch(snapshots: DataFrame, start_ns: int = 0, initial: DataFrame | None = None) -> DataFrame:
    """The same over a bounded table, sorted rows passing one by one."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, now = None, None
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if r.path != key:
                    key, now = r.path, None
                if r.seeded:
                    now = (bytes(r.content), False, r.seeded == 2)
                    continue
                now, made = step(now, None if r.content is None else bytes(r.content), r.ts_ns, start_ns)
                out += [(key, *m) for m in made]
            yield pd.DataFrame(out, columns=["path", "ts_ns", "event_type", "payload", "file_size", "reason"])

    rows = snapshots.select("path", "ts_ns", "content", F.lit(0).alias("seeded"))
    if initial is not None:
        rows = rows.unionByName(initial.select("path", F.lit(None).cast("bigint").alias("ts_ns"), "content", F.when(F.col("has_history"), 1).otherwise(2).alias("seeded")))
    # a path's initial state has no time, so it comes first
    return rows.repartition("path").sortWithinPartitions("path", "ts_ns").mapInPandas(fold, RECORDS)


def running_totals(records: DataFrame) -> DataFrame:
    """A7, for a stream in update mode."""
    return records.groupBy("repo").agg(F.count("*").alias("deltas"), F.sum("delta_size").alias("bytes"))
