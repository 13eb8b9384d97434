"""The pipeline's stages: each takes (spark, docs, folder) and returns a DataFrame; all but the last keep the columns of ``docs``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import decontaminate, minhash, pieces, secrets, toxicity
from waymark.llm.session import prepare
from waymark.session import read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the toxicity models do not call toxic; they learn from the labels of ``folder``."""
    prepare(spark)
    scored = toxicity.score_toxicity(docs, read_table(spark, folder, "labels"), keep=docs.columns)
    return scored.where("predicted = 0").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each near-duplicate class, that of the smallest id."""
    del folder
    prepare(spark)
    return minhash.keep_first(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents into which no item of ``folder``'s benchmark leaks."""
    prepare(spark)
    return decontaminate.without_leaks(docs, read_table(spark, folder, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, their secrets replaced by a mark and ``n_chars`` counted again."""
    del spark, folder
    clean = secrets.redact(secrets.find_secrets(docs))
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """(doc_id, n_tokens, ids): the piece ids of every document."""
    del folder
    prepare(spark)
    coded = pieces.encode(docs, pieces.load_pieces())
    return coded.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids")
