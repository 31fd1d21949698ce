"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegrid.llm import linetemplates, neardup, packing, repeats, resample
from pulsegrid.llm.store import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by importance resampling towards good labelled text."""
    return resample.keep_sampled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _retold(cut: DataFrame, docs: DataFrame, gone: str) -> DataFrame:
    """Columns of ``docs`` with the count of characters of changed texts; documents of which nothing is left go."""
    changed = F.col(gone) > 0
    kept = cut.where(~changed | (F.trim(F.col("text")) != ""))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines whose template recurs across documents."""
    return _retold(linetemplates.drop_recurring_lines(docs, min_verbatim=1), docs, "__n_dropped")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with 0.8 similarity on five-word shingles."""
    return neardup.keep_one(docs, words=5, percent=80)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 13 words or more that a document with a smaller id has."""
    return _retold(repeats.remove_repeats(docs), docs, "__n_removed")


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 ids, sources in proportion in every window."""
    return packing.pack(docs).withColumnsRenamed({"id": "doc_id", "queue": "source"})


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("minhash near-dedup", near_duplicates),
    ("substring dedup", passages),
    ("packing", sequences),
]

#: No SQL for templates, hashing of n-grams and token ids; tests/llm compares run() with the stages, and brute-force forms of single stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
