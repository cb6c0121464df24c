"""Stages from raw documents to a training mix.

Each stage takes the documents that its predecessor kept and returns documents;
they are written as Parquet and read again as the next stage's input.  The last
stage adds the place in the mix.  Extra columns of the input are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlespark.llm import decontaminate, language, lines, minhash, mixing
from candlespark.llm.common import saved, session, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; null texts and texts without a letter go."""
    docs = docs.select(*COLUMNS)
    content = language.dictionaries(docs.withColumn("learn", F.lit(True)))
    return language.predict(docs, content).where("NOT rejected").select(*COLUMNS)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that another document keeps for them."""
    docs = docs.select(*COLUMNS)
    kept = lines.apply(docs, lines.keep_bitmaps(docs))
    return kept.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class (five-word shingles, similarity 0.8)."""
    return minhash.keep_one(docs.select(*COLUMNS)).select(*COLUMNS)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the slot of their block and the place in it."""
    return mixing.mix(docs.select(*COLUMNS), carry=("text", "lang", "n_chars"))


def _stage(fn):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return fn(session(spark), docs, sf_dir)

    run_stage.__name__, run_stage.__doc__ = fn.__name__, fn.__doc__
    return run_stage


STAGES = [
    ("language ID", _stage(identify_language)),
    ("line dedup", _stage(drop_shared_lines)),
    ("near-duplicates", _stage(drop_near_duplicates)),
    ("decontamination", _stage(drop_benchmark_leaks)),
    ("source mix", _stage(mix_sources)),
]

#: Compression, similarity and fingerprints have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = saved(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
