"""From raw documents to tokens, in five stages. Each gets the documents that the one
before has kept and returns documents, with the same columns; the last returns tokens.

Decisions are made for rows, not for ids: a row goes by its own text, whatever other rows
share its doc_id. Rows are told apart by their place in the files that they are read from
(``addressed``), or by a number given as they are written, if they aren't read from files.

Defined cases: null and empty texts are documents like others (equal to each other, and one
of them stays); a row with a null doc_id is kept or dropped by the same rules, and stays only
where no copy of its text has an id; of rows equal in id and text one stays; of rows that
repeat an id with different texts each stands for itself; ties go to the row that is read
last (exact_dedup) or first (near_dedup); texts of any length are read whole; an empty
table gives no rows in any stage; columns beyond those of documents are left behind,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import bpe, mixing, quality, simhash
from tidelog.llm.common import addressed, staged, table
from tidelog.llm.queries import PATTERN, RANKS, new_index

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near-duplicates: words of a shingle, similarity of the sets of shingles.
SHINGLE, SIMILARITY = 5, 0.8


def _only(rows: DataFrame, stays: DataFrame) -> DataFrame:
    """The ``rows`` whose place ``stays`` holds."""
    return rows.join(stays.select(F.col("_row").alias("_stays")), F.col("_row") == F.col("_stays"), "left_semi").select(*COLUMNS)


def good_ones(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the quality classifier rejects. It learns from the labels of these documents."""
    scores = quality.scored(docs, quality.trained(docs, table(spark, sf_dir, "labels")), carry=COLUMNS)
    return scores.where(F.col("predicted") == 1).select(*COLUMNS)


def distinct_ones(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts."""
    rows = addressed(docs, *COLUMNS)
    index = new_index(spark)
    kept = index.ingest(rows, carry=("_row",)).where("kept")
    index.drop()
    # several rows are kept where they repeat the id, too
    return _only(rows, kept.groupBy("digest").agg(F.max("_row").alias("_row")))


def unlike_ones(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, that with the least id."""
    rows = addressed(docs, *COLUMNS)
    found = simhash.near_duplicates_of_sets(rows, SIMILARITY, SHINGLE, carry=("_row",))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))["_row"]
    return _only(rows, found.groupBy("root").agg(first.alias("_row")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that sources reach their target weights."""
    rows = addressed(docs, *COLUMNS)
    taken = mixing.mixed(rows, carry=("_row",)).where(F.col("copies") > 0).select(F.col("_row").alias("_taken"), F.col("copies").cast("int").alias("_copies"))
    met = rows.join(taken, F.col("_row") == F.col("_taken"))
    return met.select(*COLUMNS, F.explode(F.sequence(F.lit(1), "_copies"))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each text, which is decoded again; a row for each copy."""
    return bpe.digested(docs, RANKS, PATTERN, with_tokens=True)


STAGES = [("quality", good_ones), ("exact_dedup", distinct_ones), ("near_dedup", unlike_ones), ("mixing", mix), ("byte_bpe", tokens)]
#: The classifier, the hashing and the merges have no SQL form; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
