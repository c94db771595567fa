"""The corpus pipeline: five stages of the llm operators over documents.

Each stage gets (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet to the
shared folder and reads it again as the next one's docs. All but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, decontam, pii, quality_model, simhash
from plumbline.llm._common import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps; it is fitted to the labelled ones of docs."""
    ratings = table(spark, sf_dir, "labels").select("doc_id", quality_model.graded().alias("grade"))
    return quality_model.selected(docs, ratings)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: those that SimHash links, as in op6, and those whose shingles are alike."""
    return simhash.deduplicated(docs, radius=simhash.RADIUS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold long passages of benchmark items; shorter ones are cut out."""
    return _counted(decontam.decontaminated(docs, table(spark, sf_dir, "benchmark")))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind."""
    return _counted(pii.redacted(docs))


def _counted(docs: DataFrame) -> DataFrame:
    """docs with n_chars as its text has now."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), "n_chars")) if "n_chars" in docs.columns else docs


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, its count of them, and whether decoding gives the text back."""
    keep = tuple(c for c in docs.columns if c not in ("text", "n_chars", "ids", "n_tokens", "same"))
    return bpe.encode_decode(docs, keep, output=_checked, schema="ids array<int>, n_tokens bigint, same boolean")


def _checked(_: bpe.Codec, text: str, ids: list[int], decoded: bytes) -> dict:
    return {"ids": ids, "n_tokens": len(ids), "same": decoded == text.encode()}


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("redact", redact),
    ("encode", encode),
]

#: No SQL expresses a fitted classifier or an automaton; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        docs = written(out, name) if name != STAGES[-1][0] else out
    return docs
