"""The corpus pipeline: quality rules, near-dedup, substring dedup, secret scans, packing.

Every stage but the last returns the columns of documents; n_chars follows the text. Null ids and texts pass through:
a null text has no words, so that the first stage rejects it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.llm import minhash, packing, quality, secrets, substring
from gridloom.llm.queries import tokenizer
from gridloom.llm.shared import dropped, stored


def _measured(texts: DataFrame, like: DataFrame) -> DataFrame:
    """texts with the columns of `like` in order, n_chars anew."""
    return texts.withColumn("n_chars", F.length("text").cast("long")).select(*like.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that neither the base test nor a learned rule rejects."""
    whole = docs.select("doc_id", "text", F.struct(*(c for c in docs.columns if c != "text")).alias("row"))
    judged, _ = quality.judge(whole, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=("doc_id", "row", "text"))
    return judged.where("kept").select("row.*", "text").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of every group of near copies; an id goes if all its rows are copies of others."""
    gone = minhash.near_duplicates(docs, n=5, threshold=80).groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).where("NOT kept")
    return docs.join(gone.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages that a document of a smaller id holds; texts that lose nothing stay as they are."""
    whole = docs.select("doc_id", "text", F.struct(*(c for c in docs.columns if c != "text")).alias("row"))
    left = substring.dedup(whole, keep=("row",), verbatim=True)
    return _measured(left.select("row.*", "text"), docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every secret found; the findings are in a ledger of this run's own."""
    ledger, _ = secrets.update(spark, docs.select("text"), secrets.fresh_ledger(spark))
    return _measured(secrets.masked(docs, ledger), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 4096 tokens."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("quality rules", quality_rules), ("near-dedup", near_dedup), ("substring dedup", substring_dedup), ("secret scan", secret_scan), ("packing", pack)]
#: Learned rules and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        after = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if i:
            dropped(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
