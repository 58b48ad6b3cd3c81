"""Rewrites of a log before it is folded."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import is_full


def pruned(rows: DataFrame, key: tuple[str, ...] = ("repo", "path")) -> DataFrame:
    """The records of each path from its last full one on: that resets the state, so
    a fold over the rest gives the same. It hides what is corrupt before; checks must
    not use it. One scan and one shuffle by path, which a fold by path uses again."""
    at = F.struct("ts_ns", "seq")
    anchor = F.max(F.when(is_full(F.col("event_type")), at)).over(Window.partitionBy(*key))
    return rows.withColumn("_anchor", anchor).where(F.col("_anchor").isNull() | (at >= F.col("_anchor"))).drop("_anchor")
