"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next one.

Quality classifier, n-gram Jaccard join (one document of each group stays), secret scans (secrets are masked), mixing
sources to target weights, best-fit packing. All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.llm import mixing, ngram_join, packing, quality, secrets
from sluice.llm.common import Scratch, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near duplicates; rows without an id stay.

    Rows of one id are one document: that of smallest text hash stays. Only rows of repeated ids are ordered by text.
    """
    groups = ngram_join.components(docs.select("doc_id", "text")).where("doc_id is not null")
    groups = groups.groupBy(F.col("doc_id").alias("key")).agg(F.count("*").alias("rows"), F.bool_or(F.col("doc_id") == F.col("component_id")).alias("first"))
    # Only ids that go, or come several times, are joined to the documents: the rows that stay as they are need not meet anything.
    other = Scratch(spark, "pipeline").save(groups.where("not first or rows > 1"), "other")
    held = docs.where("doc_id is not null").select(F.col("doc_id").alias("key"), F.struct("*").alias("row"))  # the columns can't clash with any of docs
    once = held.join(other.select("key"), "key", "left_anti").select("row.*")
    many = held.join(other.where("first").select("key"), "key", "left_semi")
    others = (F.col("row")[c] for c in docs.columns if c not in ("doc_id", "text"))
    order = Window.partitionBy("key").orderBy(F.xxhash64("row.text"), "row.text", *others)
    first = many.withColumn("place", F.row_number().over(order)).where("place = 1").select("row.*")
    return once.unionByName(first).unionByName(docs.where("doc_id is null"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and n_chars counted anew."""
    return secrets.mask(docs).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents up to a budget of 80 % of the tokens, a source at most twice."""
    return mixing.mix(docs, percent=80, max_epochs=2, seed="pipeline")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens; `row` tells a document from its repetition in another epoch."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", keep_quality),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("secret_scans", mask_secrets),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: SQL can't express the trees, the forest and the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole `documents` table."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
