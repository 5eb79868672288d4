"""Dotted paths through nested documents, resolved on the DataFrame schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def path_rows(documents: DataFrame, path: str) -> DataFrame:
    """One row per element at ``path``, as ``site_id`` and ``item``.

    Array segments explode, so a document with a missing or empty array gives
    no row. Struct segments are only stepped into. An element spread over
    several parts of a document counts once, in its home part.
    """
    rows, column = documents, None
    for name in path.split("."):
        column = F.col(name) if column is None else column.getField(name)
        picked = rows.select("site_id", column.alias("item"))
        kind = picked.schema["item"].dataType
        if isinstance(kind, T.ArrayType):
            rows = picked.select("site_id", F.explode("item").alias("item"))
        else:
            rows = picked.where(F.col("item").isNotNull())
        column = F.col("item")
    kind = rows.schema["item"].dataType
    if isinstance(kind, T.StructType) and "is_home" in kind.fieldNames():
        rows = rows.where("item.is_home")
    return rows


def path_matches(
    kind: T.DataType, value: Column, names: list[str], test: tuple[str, object]
) -> Column:
    """Whether any value reached through ``names`` passes ``test``.

    Values of another type than the wanted one never pass, whatever the
    comparison.
    """
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        return F.exists(
            value, lambda x: F.coalesce(path_matches(inner, x, names, test), F.lit(False))
        )
    if names:
        if not isinstance(kind, T.StructType) or names[0] not in kind.fieldNames():
            return F.lit(False)
        return path_matches(kind[names[0]].dataType, value.getField(names[0]), names[1:], test)
    operator, wanted = test
    is_number = isinstance(kind, T.NumericType)
    if isinstance(wanted, str) != isinstance(kind, T.StringType):
        return F.lit(False)
    if not isinstance(wanted, str) and not is_number:
        return F.lit(False)
    if operator == "gt":
        return value > F.lit(wanted)
    if operator == "lt":
        return value < F.lit(wanted)
    return value == F.lit(wanted)


def schema_path(documents: DataFrame, path: str) -> tuple[T.DataType | None, list[str]]:
    first, *rest = path.split(".")
    if first not in documents.columns:
        return None, rest
    return documents.schema[first].dataType, rest
