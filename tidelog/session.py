"""Session settings that the library relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

#: The setting for the store of streaming state, the store that Spark has by default, which can't
#: keep the state of ``transformWithState``, and the one that can.
STORE = "spark.sql.streaming.stateStore.providerClass"
PLAIN, ROCKS = (f"org.apache.spark.sql.execution.streaming.state.{name}StateStoreProvider" for name in ("HDFSBacked", "RocksDB"))


def session(app: str = "tidelog", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive plans, RocksDB for streaming state. Whatever the cluster sets stays."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    own = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        STORE: ROCKS,
    }
    return builder.config(map=own | conf).getOrCreate()


def started(spark: SparkSession, out: DataStreamWriter) -> StreamingQuery:
    """Starts a stream with its state in RocksDB, in a session of any making. A store other than
    Spark's default stays, and so does the session's setting: a stream copies it as it starts."""
    own = spark.conf.get(STORE)
    if own != PLAIN:
        return out.start()
    spark.conf.set(STORE, ROCKS)
    try:
        return out.start()
    finally:
        spark.conf.unset(STORE)
        if spark.conf.get(STORE) != own:
            spark.conf.set(STORE, own)


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder in the one that all executors share (``spark.checkpoint.dir``), removed
    when the session's JVM ends. A local master without that setting gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidelog-"))
        found = spark.sparkContext.getCheckpointDir()
    own = f"{found.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    # what isn't there can't be marked for removal, and what is written has to be new
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return f"{own}/data"


def opened_by_python(path: str) -> str:
    """Of a folder on a file system that Python opens, too."""
    return path.removeprefix("file://").removeprefix("file:")
