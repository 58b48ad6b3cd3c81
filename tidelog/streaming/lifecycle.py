"""Starting, stopping and watching the streaming queries of several repos."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.joins import rescanned
from ..session import started
from ..sources.tables import write_status

#: Milliseconds between two looks at what is pending.
TICK_MS = 50


def ticks(spark: SparkSession, every_ms: int = TICK_MS) -> DataFrame:
    """SC10: a stream of (timestamp, value), one row every so often."""
    return spark.readStream.format("rate").option("rowsPerSecond", max(1, 1000 // every_ms)).load()


class Repos:
    """T17, ST11-ST13: a streaming query for each repo, by name. ``source`` makes its stream and
    ``sink`` writes one, so that a query that has ended or failed, as where its root was away for
    a while, begins again from its checkpoint."""

    def __init__(self, spark: SparkSession, checkpoints: str):
        self.spark, self.checkpoints = spark, checkpoints.rstrip("/")
        self.made: dict[str, tuple[Callable[[], DataFrame], Callable[[DataFrame, int], None], dict]] = {}

    def running(self) -> dict[str, StreamingQuery]:
        """The queries of these repos that are active."""
        return {q.name: q for q in self.spark.streams.active if q.name in self.made}

    def start(self, name: str, source: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None], **trigger) -> StreamingQuery:
        """``trigger``: as of ``DataStreamWriter.trigger``. A name that runs is an error."""
        if name in self.running():
            raise ValueError(f"{name} is running")
        self.made[name] = (source, sink, trigger)
        out = source().writeStream.queryName(name).foreachBatch(sink).option("checkpointLocation", f"{self.checkpoints}/{name}")
        return started(self.spark, out.trigger(**trigger) if trigger else out)

    def stop(self, name: str) -> None:
        if query := self.running().get(name):
            query.stop()
            query.awaitTermination()

    def remove(self, name: str) -> None:
        self.stop(name)
        self.made.pop(name, None)

    def restart(self, name: str) -> StreamingQuery:
        self.stop(name)
        source, sink, trigger = self.made[name]
        return self.start(name, source, sink, **trigger)

    def recover(self) -> list[str]:
        """Starts what should run and doesn't."""
        gone = [name for name in self.made if name not in self.running()]
        for name in gone:
            self.restart(name)
        return gone

    def progress(self) -> list[tuple[str, bool, int]]:
        """ST14: (name, whether active, rows of the last batch)."""
        now = self.running()
        return [(name, name in now, (now[name].lastProgress or {}).get("numInputRows", 0) if name in now else 0) for name in self.made]


def publish(totals: DataFrame, path: str) -> None:
    """SK11, ST14: a status snapshot of (root, deltas, bytes, files, lost)."""
    write_status(totals, path)


def reconciling(current: Callable[[], DataFrame], emit: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """ST8, ST12: a sink for a stream of snapshots (path, digest; a whole walk in each batch):
    emits (path, event_type) of what the walk says and ``current()`` (path, digest) doesn't, so
    that events that were lost are made up for."""

    def sink(walk: DataFrame, _: int) -> None:
        emit(rescanned(current(), walk.select("path", "digest")))

    return sink
