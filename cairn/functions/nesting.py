"""Nesting child rows into documents of bounded size.

A document gathers every child of one key into one row, and one key may own a
third of all rows. The caller therefore says into how many slices the documents
of every key are cut. A child row goes to one slice by a hash of its own
identity, whatever the size of the key, and a slice without rows is left out.
The slices of a key hold every child once, and joining their lists gives the
whole document; one slice is the whole document.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

SLICE, PART, PARTS = "_slice", "part", "parts"


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; columns a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def child_rows(
    df: DataFrame, keys: Sequence[str], field: str, identity: Sequence[str] | None = None
) -> DataFrame:
    """Keys, the child as one struct column named ``field``, and its slice."""
    rest = [c for c in df.columns if c not in keys]
    identity = [*keys, *rest] if identity is None else identity
    return df.select(*keys, F.xxhash64(*identity).alias(SLICE), F.struct(*rest).alias(field))


def header_rows(df: DataFrame, keys: Sequence[str], field: str, *, first: bool = False) -> DataFrame:
    """Like :func:`child_rows` for the one row that describes the key itself.

    ``first`` puts it into part 0. That is computed, as a constant part would fall
    out of the join of the branches, and the nested rows would move once more.
    """
    rest = [c for c in df.columns if c not in keys]
    home = F.pmod(F.xxhash64(*keys), F.lit(1)) if first else F.xxhash64(*keys)
    return df.select(*keys, home.alias(SLICE), F.struct(*rest).alias(field))


def into_parts(rows: DataFrame, key: str, slices: int) -> DataFrame:
    """Add part, and bring each (key, part) into one partition.

    The aggregations above all group by (key, part, ...), so this is the only
    shuffle of the child rows.
    """
    placed = rows.withColumn(PART, F.pmod(F.col(SLICE), F.lit(slices)).cast("int")).drop(SLICE)
    return placed.repartition(key, PART)


def into_keyed_parts(rows: DataFrame, key: str, slices: int) -> DataFrame:
    """Like :func:`into_parts`, with keys that join: a null key is some value in the parts from ``slices`` on.

    :func:`with_null_keys` takes that back.
    """
    part = F.pmod(F.col(SLICE), F.lit(slices)) + F.when(F.col(key).isNull(), F.lit(slices)).otherwise(F.lit(0))
    some = F.coalesce(F.col(key), F.lit("0").cast(rows.schema[key].dataType))
    placed = rows.withColumns({PART: part.cast("int"), key: some}).drop(SLICE)
    return placed.repartition(key, PART)


def with_null_keys(rows: DataFrame, key: str, slices: int) -> DataFrame:
    own = F.when(F.col(PART) < F.lit(slices), F.col(key))
    return rows.withColumns({key: own, PART: F.pmod(F.col(PART), F.lit(slices)).cast("int")})


def grouped(rows: DataFrame, *keys: str) -> GroupedData:
    """Group rows that lie by their first keys, sorted.

    The levels of a nesting group by fewer and fewer of the same keys: the sort of the lowest
    one serves them all, and no level holds or spills its groups.
    """
    return rows.sortWithinPartitions(*keys).groupBy(*keys)


def gather(column: Column | str) -> Column:
    """The non-null values of a bounded part as a sorted list."""
    return F.sort_array(F.collect_list(column))


def flat_documents(
    key: str,
    header: DataFrame,
    children: Mapping[str, DataFrame],
    slices: int,
) -> DataFrame:
    """One level of nesting: a header and named lists of children per key."""
    fields = [c for c in header.columns if c != key]
    branches = [header_rows(header, [key], "_header", first=True)]
    branches += [child_rows(df, [key], name) for name, df in children.items()]
    nested = into_parts(stack(branches), key, slices)
    nested = grouped(nested, key, PART).agg(
        F.max("_header").alias("_header"), *[gather(name).alias(name) for name in children]
    )
    return nested.select(
        key,
        PART,
        F.lit(slices).alias(PARTS),
        *[F.col(f"_header.{f}").alias(f) for f in fields],
        *children,
    )
