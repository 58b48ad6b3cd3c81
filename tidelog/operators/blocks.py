"""Content-addressed blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import BLOCK_BYTES, CREATE, CREATE_DEDUP, DEDUP_FROM, HASH_BYTES


def split(files: DataFrame, size: int = BLOCK_BYTES, content: str = "content", digest=lambda c: F.sha2(c, 256)) -> DataFrame:
    """A row for each block of each file: the file's other columns, pos from 0,
    data, hash, size. None for empty content."""
    data = F.col(content)
    n = F.ceil(F.length(data) / F.lit(size)).cast("int")
    cut = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.substring(data, i * size + 1, F.lit(size))))
    out = files.select(*[c for c in files.columns if c != content], F.posexplode(cut).alias("pos", "data"))
    return out.withColumn("hash", digest(F.col("data"))).withColumn("size", F.length("data"))


def new_blocks(found: DataFrame, pool: DataFrame) -> DataFrame:
    """SK6: one row for each hash that the pool lacks."""
    return found.groupBy("hash").agg(F.first("data").alias("data"), F.first("size").alias("size")).join(pool.select("hash"), "hash", "left_anti")


def reassembled(refs: DataFrame, pool: DataFrame, key: list[str], joined: Column | None = None) -> DataFrame:
    """Content by the blocks in order, and whether any was missing (then null)."""
    met = refs.select(*key, "pos", "hash").join(pool.select("hash", "data"), "hash", "left")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "data"))), lambda x: x["data"])
    out = met.groupBy(*key).agg(parts.alias("_parts"), F.bool_or(F.col("data").isNull()).alias("missing"))
    return out.select(*key, F.when(~F.col("missing"), F.array_join("_parts", "")).alias("content"), "missing")


def collectable(pool: DataFrame, refs: DataFrame, scan_clean: bool = True) -> DataFrame:
    """Blocks that nothing refers to; none unless the scan of the references was clean."""
    if not scan_clean:
        return pool.limit(0)
    return pool.join(refs.select("hash"), "hash", "left_anti")


def dedup_ratio(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("n_blocks"), F.count_distinct("hash").alias("n_distinct"))


def verified(refs: DataFrame, pool: DataFrame, digest=lambda c: F.sha2(c, 256)) -> DataFrame:
    """T12 for blocks: each reference with what is wrong with its block, if anything."""
    met = refs.join(pool.select("hash", F.col("size").alias("_size"), F.col("data").alias("_data")), "hash", "left")
    fault = F.when(F.col("_data").isNull(), "missing").when(F.length("_data") != F.col("_size"), "size").when(digest(F.col("_data")) != F.col("hash"), "hash")
    return met.withColumn("fault", fault).drop("_size", "_data")


def deduplicated(records: DataFrame, at_least: int = DEDUP_FROM, size: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """SK3: full records of ``at_least`` bytes as CREATE_DEDUP, whose payload is the
    hashes of the content's blocks (32 bytes each): the log, the references (repo, path, ts_ns,
    seq, pos, hash) and the blocks, each once (hash, size, data)."""
    large = (F.col("event_type") == CREATE) & (F.length("payload") >= at_least)
    key = ["repo", "path", "ts_ns", "seq"]
    found = split(records.where(large).select(*key, "payload"), size, "payload", digest=lambda c: F.unhex(F.sha2(c, 256)))
    n = F.ceil(F.length("payload") / F.lit(size)).cast("int")
    hashes = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.sha2(F.substring(F.col("payload"), i * size + 1, F.lit(size)), 256))
    log = records.withColumns({"payload": F.when(large, F.unhex(F.array_join(hashes, ""))).otherwise(F.col("payload")), "event_type": F.when(large, CREATE_DEDUP).otherwise(F.col("event_type"))})
    pool = found.groupBy("hash").agg(F.first("size").alias("size"), F.first("data").alias("data"))
    return log, found.select(*key, "pos", "hash"), pool


def references(log: DataFrame) -> DataFrame:
    """(repo, path, ts_ns, seq, pos, hash): the blocks that the log's CREATE_DEDUP records name."""
    some = log.where((F.col("event_type") == CREATE_DEDUP) & (F.length("payload") >= HASH_BYTES))
    pos = F.sequence(F.lit(0), (F.length("payload") / HASH_BYTES).cast("int") - 1)
    each = some.select("repo", "path", "ts_ns", "seq", "payload", F.explode(pos).alias("pos"))
    return each.select("repo", "path", "ts_ns", "seq", "pos", F.substring(F.col("payload"), F.col("pos") * HASH_BYTES + 1, F.lit(HASH_BYTES)).alias("hash"))


def resolved(log: DataFrame, pool: DataFrame) -> DataFrame:
    """J2 in a log: CREATE_DEDUP records with their content as payload, put together from
    ``pool``; null where a block is missing, has another size or another hash."""
    key = ["repo", "path", "ts_ns", "seq"]
    met = verified(references(log), pool, digest=lambda c: F.unhex(F.sha2(c, 256))).join(pool.select("hash", "data"), "hash", "left")
    # as digits, since parts of bytes can't be joined at once
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "data"))), lambda x: F.hex(x["data"]))
    whole = met.groupBy(*key).agg(F.unhex(F.array_join(parts, "")).alias("_content"), F.max(F.col("fault").isNotNull()).alias("_broken"))
    is_dedup = F.col("event_type") == CREATE_DEDUP
    content = F.when(~F.col("_broken"), F.col("_content"))
    return log.join(whole, key, "left").withColumn("payload", F.when(is_dedup, content).otherwise(F.col("payload"))).drop("_content", "_broken")
