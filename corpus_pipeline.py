"""Corpus pipeline: quality, near duplicates, personal data, mix of sources, token ids.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is written as Parquet and
read again by the next. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlens.llm import bpe, jaccard_join, mixing, pii, quality
from peerlens.llm.queries import THRESHOLD
from peerlens.session import ship_package, written_table
from peerlens.sources.tables import read_table


def shipped(stage):
    """A stage whose Python workers have the package."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None  # a classifier, shingle sets and token ids are not SQL; tests/llm compares each stage with brute force


@shipped
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier, learned on this stage's input, scores below the threshold."""
    stats = written_table(docs.select("doc_id", quality.statistics("text").alias("x")), "pipeline-statistics")
    model = quality.train(stats, read_table(spark, sf_dir, "labels"))
    kept = docs.withColumn("score", quality.scored(model, quality.statistics("text")))
    return kept.where(F.col("score") >= THRESHOLD).select(*COLUMNS)


@shipped
def keep_one_of_a_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each component of near duplicates one document: that with the smallest id, one with an id before one without."""
    rows = docs.withColumn("row", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text"))
    found = jaccard_join.join_components(rows.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id").distinct()
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    first = found.join(rows.select("row", "doc_id").distinct(), "row").groupBy("component_id").agg(F.min(order).alias("first"))
    return rows.join(first.select("first.row"), "row", "left_semi").dropDuplicates(["row"]).select(*COLUMNS)


@shipped
def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the name of its kind; n_chars follows the text."""
    return pii.redact_pii(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@shipped
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's share asks: whole passes as copies, and the rest as its blocks of words.

    A copy is the document as it is; a part is the chosen words joined by single spaces. A document of which the mix
    takes nothing goes.
    """
    taken = mixing.mixed_documents(docs)
    return taken.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@shipped
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document (little-endian, packed) and whether they decode to its bytes again."""
    ids = bpe.encode_documents(docs).withColumn("back", bpe.decode("ids"))
    same = F.col("back") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return ids.select("doc_id", "lang", "source", bpe.n_tokens("ids").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_a_group),
    ("personal_data", redact_personal_data),
    ("mix", mix_sources),
    ("encode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage returns is written before the next reads it."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
