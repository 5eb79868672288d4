"""Stored JSON collections: documents read as they are, without a schema.

A document is a ``variant`` value, so documents of one collection may differ in
fields and types. Paths are resolved on the values: a dotted path goes through
objects, and through the elements of any list on its way.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBERS = ("BIGINT", "DOUBLE", "FLOAT", "DECIMAL")


def read_collection(
    spark: SparkSession,
    path: str,
    key: str,
    ids: Iterable[object] | None = None,
    fields: Mapping[str, str] | None = None,
    kind: str = "bigint",
) -> DataFrame:
    """(key, doc) of a folder of JSON lines; ``doc`` is the whole document.

    ``ids`` keeps the documents of some keys. ``fields`` names paths without lists and
    their types; the result then has these columns in place of the document.
    """
    docs = spark.read.option("singleVariantColumn", "doc").json(path)
    return _picked(docs.select(F.try_variant_get("doc", f"$.{key}", kind).alias(key), "doc"), key, ids, fields)


def store_collection(documents: DataFrame, path: str, key: str) -> None:
    """Write nested documents as JSON lines, one a document or part of one."""
    documents.select(F.to_json(F.struct(*documents.columns)).alias("value")).write.mode("error").text(path)


def read_variants(
    spark: SparkSession, path: str, key: str, ids: Iterable[object] | None = None, fields: Mapping[str, str] | None = None
) -> DataFrame:
    """As :func:`read_collection`, from a folder that :func:`store_variants` has written.

    Only the asked fields of a document leave the scan, and row groups without
    the ids are passed over.
    """
    return _picked(spark.read.parquet(path), key, ids, fields)


def store_variants(collection: DataFrame, path: str, key: str) -> None:
    """Write (key, doc) as Parquet, in the order of the key, so that a key is in few files and row groups."""
    collection.select(key, "doc").repartitionByRange(key).sortWithinPartitions(key).write.mode("error").parquet(path)


def _picked(docs: DataFrame, key: str, ids: Iterable[object] | None, fields: Mapping[str, str] | None) -> DataFrame:
    if ids is not None:
        docs = docs.where(F.col(key).isin(list(ids)))
    if fields is None:
        return docs
    return docs.select(key, *(F.try_variant_get("doc", f"$.{p}", kind).alias(p.replace(".", "_")) for p, kind in fields.items()))


def is_collection(documents: DataFrame) -> bool:
    return "doc" in documents.columns and isinstance(documents.schema["doc"].dataType, T.VariantType)


def _elements(values: Column) -> Column:
    """Values with lists replaced by their elements."""
    return F.flatten(F.transform(values, lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))))


def values_at(doc: Column, path: str) -> Column:
    """All values that a path reaches, as a list of variants."""
    values = F.array(doc)
    for name in path.split("."):
        if "'" in name and '"' in name:
            raise ValueError(f"a path cannot hold both kinds of quotes: {name}")
        step = f'$["{name}"]' if "'" in name else f"$['{name}']"
        inside = F.transform(_elements(values), lambda v: F.try_variant_get(v, step, "variant"))
        values = F.filter(inside, lambda v: v.isNotNull())
    return _elements(values)


def _is_number(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    found = kind.isin(*NUMBERS[:3]) | kind.startswith(NUMBERS[3])
    return found


def value_matches(doc: Column, path: str, test: tuple[str, object]) -> Column:
    """Whether any value at a path passes a test; values of another type than the wanted one never do."""
    operator, wanted = test

    def passes(value: Column) -> Column:
        if isinstance(wanted, str):
            # Other values would be turned into text.
            own = F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))
        else:
            own = F.when(_is_number(value), F.try_variant_get(value, "$", "double"))
        hit = own > wanted if operator == "gt" else own < wanted if operator == "lt" else own == wanted
        return F.coalesce(hit, F.lit(False))

    return F.exists(values_at(doc, path), passes)


def search_collection(documents: DataFrame, key: str, path: str, operator: str, wanted: object) -> DataFrame:
    """Ids of the documents with a value at ``path`` that passes; for "ne" those without an equal one.

    A document may lie in several rows, so the rows vote; a row votes where it lies.
    """
    hit = value_matches(F.col("doc"), path, ("eq" if operator == "ne" else operator, wanted))
    found = documents.select(F.col(key).alias("id"), hit.alias("hit")).groupBy("id").agg(F.bool_or("hit").alias("hit"))
    return found.where(~F.col("hit") if operator == "ne" else F.col("hit")).select("id")


def collection_fields(documents: DataFrame, paths: Sequence[str], key: str) -> DataFrame:
    """(key, path, value): every value at some paths as JSON text, for a look at mixed documents."""
    each = F.array(*(F.struct(F.lit(p).alias("path"), values_at(F.col("doc"), p).alias("values")) for p in paths))
    rows = documents.select(key, F.inline(each)).select(key, "path", F.explode("values").alias("value"))
    return rows.select(key, "path", F.to_json("value").alias("value"))
