"""The corpus pipeline: quality rules, toxicity, near-duplicates, mixing and token encoding, one stage after the other.

Every stage takes the rows that the one before it kept, in the columns of ``documents``, and its decisions take effect:
rejected documents go, one document of each near-duplicate group stays, and the mix repeats or leaves out documents.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.llm import bpe, jaccard, mixing, quality, toxicity
from millrace.llm.batches import quoted
from millrace.llm.queries import TOXIC_AT, vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the cascade rejects; null and empty texts have too few words and go, repeated rows are judged alike."""
    return quality.quality_cascade(docs, quality.plan_cascade(docs)).where("kept").select(*_columns(docs))


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold; the model learns from the labelled rows among them.

    Null and empty texts score 0 and stay; repeated rows score alike. Without labels of both classes all stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.score(docs, toxicity.fit_from(docs, labels)).where(F.col("score") < TOXIC_AT).select(*_columns(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four fifths and more of its five-word shingles: the one with the smallest id.

    Rows without an id stay; of rows that share an id one stays.
    """
    found = jaccard.similar_documents(docs.select("doc_id", "text"), size=5, similarity=80)
    first = found.where("doc_id = component_id").groupBy("doc_id").agg((F.count("*") > 1).alias("twice"))
    kept = docs.select("doc_id", F.struct(*_columns(docs)).alias("row")).join(first, "doc_id")
    twice = kept.where("twice").groupBy("doc_id").agg(F.min_by("row", F.md5("row.text")).alias("row"))
    return kept.where("not twice").select("row.*").union(twice.select("row.*")).union(docs.where("doc_id is null"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, a document taken in part if at least half of it is taken.

    Null and empty texts have no words and are not taken; a null source is a source; repeated rows are taken one by one.
    """
    return mixing.repeated(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded text of every document; null and empty texts have no token.

    Of the other columns it returns doc_id, lang and source only, whatever else the documents have.
    """
    return bpe.digests(bpe.encode_decode(docs.select("doc_id", "lang", "source", "text"), vocabulary()).drop("text"))


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(quoted(c)) for c in docs.columns]


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxic_documents),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("bpe", tokens),
]

#: Training and encoding have no SQL form; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
