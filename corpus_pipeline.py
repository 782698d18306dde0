"""A corpus pipeline of five stages: language, near-duplicates, repeated passages, benchmarks, ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. `run` writes each
stage's rows as Parquet in the shared folder and reads them back, so a lost executor repeats no stage.
"""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adfathom.llm.decontaminate import without_benchmark
from adfathom.llm.languages import fit, identify, training_rows
from adfathom.llm.near_dups import keep_first
from adfathom.llm.pieces import encode_documents
from adfathom.llm.shared import Scratch
from adfathom.llm.substrings import dedup_texts


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; null texts, texts without letters and rejected ones go."""
    model = fit(training_rows(docs))
    prefix = "_stage_"
    while any(name.lower().startswith(prefix) for name in docs.columns):
        prefix = "_" + prefix
    return identify(docs, model, prefix=prefix).where(f"{prefix}accepted").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near-duplicates."""
    return keep_first(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the 50-word passages that an earlier one holds; n_chars follows the text."""
    cut = dedup_texts(docs)
    if "n_chars" not in cut.columns:
        return cut
    kind = cut.schema["n_chars"].dataType
    return cut.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their ids, the number of ids and a checksum of them."""
    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), digest=True)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("sentencepiece_ids", sentencepiece_ids),
]

#: Training, similarity and tokenization have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents of a folder."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parent))
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
