"""Column helpers that fix the value rules every operator shares.

All helpers return Spark columns built from built-in functions, so they stay
inside whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The shapes of a leading number, a leading integer, and a text
# that is a number as a whole.
LEADING_NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
LEADING_INTEGER = r"^\s*([+-]?\d+)"
WHOLE_NUMBER = r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*$"

SiteIds = Sequence[int] | DataFrame | None


def leading_number(text: Column) -> Column:
    """The number a text starts with, null when it starts with none."""
    hit = F.regexp_extract(text, LEADING_NUMBER, 1)
    return F.when(hit != "", hit).try_cast("double")


def leading_integer(text: Column) -> Column:
    """The integer a text starts with, null when it starts with none."""
    hit = F.regexp_extract(text, LEADING_INTEGER, 1)
    return F.when(hit != "", hit).try_cast("bigint")


def finite_number(text: Column) -> Column:
    """The value of a text that is a finite number as a whole, else null."""
    number = F.when(text.rlike(WHOLE_NUMBER), F.trim(text)).try_cast("double")
    return F.when(F.abs(number) < F.lit(float("inf")), number)


def truthy(value: Column) -> Column:
    """Present and not zero. Null-free boolean."""
    return F.coalesce(value != 0, F.lit(False))


def truthy_text(value: Column) -> Column:
    """Present and not empty. Null-free boolean."""
    return F.coalesce(value != "", F.lit(False))


def half_up(value: Column) -> Column:
    """Round to an integer with halves going towards positive infinity."""
    return F.floor(value + F.lit(0.5))


# A list longer than this is no IN predicate but a table of ids, and one of up to so many ids (8 bytes
# each) is sent to all tasks.
LISTED_IDS, SENT_IDS = 1_000, 4_000_000


def _id_table(df: DataFrame, wanted: list) -> DataFrame:
    """A list of ids as a table, made from one Arrow array."""
    return df.sparkSession.createDataFrame(pa.table({"_id": pa.array(wanted)}))


def ids_of(df: DataFrame, ids: SiteIds, column: str = "site_id") -> DataFrame:
    """Keep the rows whose ``column`` is among ``ids``.

    ``None`` keeps every row and an empty list keeps none. A short list becomes an IN
    predicate that reaches the scan. Of a long one the least and the largest id reach the
    scan, and the ids become a table for a left semi join: below any shuffle or explode of the
    rows, and without one itself up to :data:`SENT_IDS`. A DataFrame of ids becomes a left
    semi join, whose strategy Spark picks from its size.
    """
    if ids is None:
        return df
    if isinstance(ids, DataFrame):
        return df.join(ids.select(F.col(ids.columns[0]).alias(column)), column, "left_semi")
    wanted = list(dict.fromkeys(i for i in ids if i is not None))
    if not wanted:
        return df.where(F.lit(False))
    if len(wanted) <= LISTED_IDS:
        return df.where(F.col(column).isin(wanted))
    table = _id_table(df, wanted).withColumnRenamed("_id", column)
    if len(wanted) <= SENT_IDS:
        table = F.broadcast(table)
    return df.where(F.col(column).between(min(wanted), max(wanted))).join(table, column, "left_semi")


def best_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in ``order``.

    An aggregate, not a window, so each map task sends at most one row per key
    and a hot key never gathers its rows in one task. Every order column must
    sort ascending; negate numbers to sort descending.
    """
    rest = [c for c in df.columns if c not in keys]
    picked = F.min_by(F.struct(*rest), F.struct(*order)).alias("_best")
    return df.groupBy(*keys).agg(picked).select(*keys, "_best.*").select(*df.columns)
