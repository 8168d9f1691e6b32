"""A corpus run end to end: what the quality rules keep, without near copies, benchmark passages and secrets, as token ids.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept; all but the last return the
columns of ``docs`` as they were given, extra ones included. Null and empty texts do not pass the quality rules, so later stages meet
them only when run alone: they are then one group of near copies, hold no benchmark words and no secrets, and give no
ids. Empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spacetide.llm import byte_bpe, decontaminate, quality, secret_scan, simhash
from spacetide.llm.text import fresh
from spacetide.session import cut_lineage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or fall below the likelihood-ratio threshold go."""
    return quality.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies the document with the smallest doc_id stays."""
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too much of the benchmark go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every finding in a text is replaced by its kind in brackets; ``n_chars``, if it is there, follows the new text."""
    (spans,) = fresh(docs, "found_spans")
    found = secret_scan.scan(docs, redact=True, column=spans)
    if "n_chars" in docs.columns:
        count = F.length("text").cast(docs.schema["n_chars"].dataType)
        found = found.withColumn("n_chars", F.when(F.size(spans) > 0, count).otherwise(F.col("n_chars")))
    return found.select(*docs.columns)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids, offsets, round_trip)``: ids and their byte offsets in the text as little-endian unsigned 32-bit integers, and whether decoding gives the text back."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = byte_bpe.encode(docs.select("doc_id", "text"), path, offsets="offsets", decoded="decoded")
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", "offsets", same.alias("round_trip"))


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scans),
    ("byte-level bpe", byte_level_bpe),
]

#: SQL has neither the likelihood ratio's hash nor the merges; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
