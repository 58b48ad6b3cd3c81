"""The test tables as version logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import CREATE, DELETE, MODIFY


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nanoseconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) * 1000


def vlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as change records: a user is a path, an error deletes it."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "signup", CREATE).when(F.col("event_type") == "error", DELETE).otherwise(MODIFY)
    gone = F.col("event_type") == "error"
    return e.select(
        F.concat(F.lit("r"), (F.col("user_id") % 4).cast("string")).alias("repo"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"),
        nanoseconds(F.col("ts")).alias("ts_ns"),
        F.col("event_id").alias("seq"),
        kind.alias("event_type"),
        F.when(gone, F.lit(0)).otherwise(F.get_json_object("props", "$.k").cast("bigint")).cast("bigint").alias("delta_size"),
        F.when(gone, F.lit(0)).otherwise(F.round(F.col("value") * 100).cast("bigint")).cast("bigint").alias("file_size"),
    )


def vchain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as version chains: each turn is a revision of a file."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("path"), F.col("turn").alias("rev"), F.coalesce("text", F.lit("")).alias("content"))


def vfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), F.col("doc_id"), F.coalesce("text", F.lit("")).alias("content"))


def vorders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").cast("string").alias("path"), nanoseconds(F.col("o_orderdate")).alias("ts_ns"), F.col("o_orderkey").alias("seq"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("file_size"))


def vpaths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages' addresses as paths, without the scheme."""
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
