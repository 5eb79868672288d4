"""Small tables with the cases every operator must stand: nulls, empty and long texts, ties, repeats, clashing names."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "id long, size long, taken long, positions long, log_weight double, row string, key string, part long, page string, words long, root long, digest string, bucket long"


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}x{rng.randrange(3)}" for _ in range(n))


def awkward_rows() -> list[tuple]:
    long_text = prose(1, 60_000, 5_000)
    return [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \n\t ", "en", None, 3),
        (4, "one", None, "a", 3),
        (5, long_text, "en", "b", len(long_text)),
        (6, prose(2, 80), "en", "a", None),
        (7, prose(2, 80), "en", "a", 1),  # a copy
        (8, prose(3, 80), "de", "c", 1),
        (8, prose(3, 80), "de", "c", 1),  # a repeated row
        (None, prose(4, 60), "de", "c", 1),
        (None, None, None, None, None),
        (9, "é\x00 \U0001f600 ſ İ password=ſecret", "fr", "", 1),
        (10, "x" * 5_000, "en", "a", 1),
    ]


def awkward(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(awkward_rows(), SCHEMA)


def clashing(docs: DataFrame) -> DataFrame:
    """The same rows with columns that have the names operators use inside."""
    from pyspark.sql import functions as F

    names = [field.split() for field in CLASHING.split(", ")]
    return docs.select("*", *(F.lit(None).cast(kind).alias(name) for name, kind in names))


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def rows(frame: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in frame.collect()), key=repr)
