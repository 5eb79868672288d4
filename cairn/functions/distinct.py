"""Exact sets of ids that can be stored and merged.

A set is a few rows, one for each range of 64 ids that it has some of: the
range's number and a bitmap in one number. Many small sets of scattered ids thus
take no more rows than ids. Sets of the same keys from several days, loads or
tables are merged by or-ing the bitmaps, so a distinct count over all of them
needs only the stored rows, and its cost does not grow with the rows counted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def id_sets(rows: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """(keys, bucket, bitmap): the set of whole numbers of a column, per key; nulls are in no set."""
    ids = rows.where(F.col(column).isNotNull()).select(*keys, F.col(column).cast("long").alias("_id"))
    bit = F.expr("shiftleft(1L, cast(_id & 63L as int))")
    return ids.select(*keys, F.shiftright("_id", 6).alias("bucket"), bit.alias("_bit")).groupBy(*keys, "bucket").agg(F.bit_or("_bit").alias("bitmap"))


def merge_sets(sets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The union of the sets of each key; keys that are not named are merged over."""
    return sets.groupBy(*keys, "bucket").agg(F.bit_or("bitmap").alias("bitmap"))


def set_sizes(sets: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """The number of ids in the union of the sets of each key."""
    return merge_sets(sets, keys).groupBy(*keys).agg(F.sum(F.bit_count("bitmap")).alias(name))


def store_sets(sets: DataFrame, path: str, load: str) -> None:
    """Add the sets of one day or load to a folder; a load that is there already is an error."""
    sets.write.mode("error").parquet(f"{path}/load={load}")


def stored_sets(spark: SparkSession, path: str) -> DataFrame:
    """The sets of all loads; a key comes once for each load that has it."""
    return spark.read.parquet(path)
