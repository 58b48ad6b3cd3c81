"""The thin queries over this subpackage's operators, with production parameters."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import annuli, bpe, chat, licenses, mixing, quality, simhash, spans, toxicity
from .common import shared_dir, table
from .digest_index import DigestIndex

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digested(table(spark, sf_dir, "documents"), RANKS, PATTERN)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id", "component_size")


def op3_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.deduplicated(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.trained(docs, table(spark, sf_dir, "labels")))


def new_index(spark: SparkSession) -> DigestIndex:
    name = f"digest_index_{uuid.uuid4().hex}"
    return DigestIndex(spark, name, f"{shared_dir(spark)}/{name}")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = new_index(spark)
    found = index.ingest(table(spark, sf_dir, "documents"))
    index.drop()
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents"))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annuli.top_k(table(spark, sf_dir, "embeddings"), lambda id_: id_ % 100 == 0)


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return chat.digested(rows.union(own), RANKS, PATTERN).drop("n_tokens")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_simhash, op3_sentence_spans, op4_quality, op5_exact_dedup, op6_licenses, op7_top_k, op8_chat, op9_toxicity, op10_mixing, pipeline)}
