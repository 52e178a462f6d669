"""A training corpus from raw documents, stage by stage: language ID, near-dedup, benchmark decontamination, removal of
personal data, packing.

Each stage takes all rows that the one before kept. Stages that judge rows apart from their texts number them first and
take out those that go by number, so ids may be null or repeat, and texts aren't shuffled. Null texts have no language and
go first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import language_id, near_copies, pii
from ledgerline.llm.common import Numbered, saved
from ledgerline.llm.decontamination import decontaminate
from ledgerline.llm.packing import pack

#: SQL can express neither fingerprints nor tokens; the tests hold each stage against brute force.
ORACLE_SQL = None


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a language that can be learned from the labelled ones; texts of little more
    than a word or two (16 trigrams) are told by their letters alone."""
    return language_id.in_a_learned_language(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (Jaccard similarity of five-word shingles at least 0.8): the one of the
    smallest id (null first)."""
    return near_copies.one_of_each_group(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    stored = Numbered(docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("doc")), "documents")
    found = decontaminate(stored.table.select("row", F.col("doc.text").alias("text")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="row")
    return stored.marked(found.filter("contaminated").select("row", "contaminated")).filter("mark IS NULL").select("doc.*")


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind; n_chars follows."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return pack(docs)


STAGES = [
    ("language_id", languages),
    ("near_dedup", one_of_each_group),
    ("decontamination", clean_of_benchmark),
    ("pii", without_personal_data),
    ("packing", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
