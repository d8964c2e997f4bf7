"""Corpus pipeline over documents: quality, near duplicates, benchmark leaks, secrets, pieces.

Every stage works on all rows that its predecessor kept and returns the columns of documents; the last returns pieces.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from helioscape.llm import decontaminate, jaccard_join, pieces, quality, secrets
from helioscape.llm.queries import PIECE_MODEL, quality_model, secret_model, table
from helioscape.operators.spark_support import stored


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose chance of the best grade is below the model's threshold, and those without words."""
    model = quality_model(docs, table(spark, sf_dir, "labels"))
    return quality.good_texts(docs, "text", model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of every group of linked documents the one with the smallest id, once; rows without an id or words stay."""
    members, _ = jaccard_join.similar_sets(docs, "doc_id", "text")
    winners = members.where("id = component").select(F.col("id").alias("doc_id")).distinct()
    named = docs.where("doc_id is not null").join(winners, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.select(docs.columns).unionByName(docs.where("doc_id is null"))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of ten words of a benchmark item."""
    return decontaminate.without_leaks(docs, "text", table(spark, sf_dir, "benchmark"), "item_id", "text", width=10)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in texts by a mark; documents stay, n_chars follows the text."""
    masked = secrets.mask_secrets(docs, "text", secret_model(docs))
    return masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces and ids of every text."""
    encoded = pieces.encode_texts(docs, "doc_id", "text", pieces.read_vocabulary(PIECE_MODEL))
    return encoded.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("secret scans", mask_secrets),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: The classifier, the network and the piece paths are beyond SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each stage returns is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = stored(docs, f"pipeline-{number}")
    return docs
