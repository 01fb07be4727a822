"""A training-data pipeline over `documents`: five stages, each written and read again before the next.

quality      rows that the quality classifier rejects go
near_dedup   one document of each group of near duplicates stays, the one with the smallest id
decontam     documents that overlap a benchmark item go
pii          entities in the text give way to surrogates, under the key quirework.pii.key; n_chars follows the text
packing      the remaining documents, cut and packed into token sequences

All stages but the last return the columns of documents. Of rows that repeat id and text one stays; rows without an id stay. Null ids, repeated rows, null, empty and very long texts take
the results that the operators define; an empty table passes through. SQL cannot express the trained classifier or the packing, so
ORACLE_SQL is None and the stages are tested against brute-force versions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm import decontam, neardup, packing, pii, quality
from quirework.llm.common import table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = neardup.near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    again = written(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "again")
    if again.isEmpty():
        return kept
    once = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(once.select(docs.columns))


def decontam_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.replace_entities(docs, pii.key_of(spark, pii.PUBLIC_KEY))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontam", decontam_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents; what lies between two stages is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
