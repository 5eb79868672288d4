"""The corpus pipeline: stages that each read what the one before has kept.

Quality sampling rejects documents, near-duplicates leave one of each group, documents that hold a benchmark
item go, secrets are masked, and the rest is mixed to the sources' target weights along the curriculum.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cairn.llm.decontaminate import decontaminate
from cairn.llm.jobs import checkpoint_folder, read
from cairn.llm.mixing import mixture
from cairn.llm.neardup import keep_first
from cairn.llm.resample import keep_sample
from cairn.llm.secrets import redact

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by importance resampling."""
    return keep_sample(docs, read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    return keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked and ``n_chars`` counted anew."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, by training position, with the words taken and the positions."""
    return mixture(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("minhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scan", secrets),
    ("mixing to target weights", mixing),
]

#: SQL cannot state sampling by a fitted model or similarity stages; tests hold the stages against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.

    Each but the last is written as Parquet to a folder of this run below the shared checkpoint folder, and the next
    reads it from there, so a lost executor costs the tasks of one stage.
    """
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.schema(docs.schema).parquet(f"{folder}/{k}")
    return docs


PIPELINE_QUERIES = {"pipeline": run}
PIPELINE_SQL = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
