"""Exports and document sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.semantics import SiteIds, ids_of
from cairn.sources.tables import Tables

HEADER_COLUMNS = (
    "site_id",
    "site_name",
    "national_site_identifier",
    "site_description",
    "latitude_dd",
    "longitude_dd",
)


def site_headers(t: Tables, site_ids: SiteIds = None) -> DataFrame:
    """The six header columns of the sites."""
    return ids_of(t["site"], site_ids).select(*HEADER_COLUMNS)


def export_sites(documents: DataFrame, method_ids: Sequence[int] = ()) -> DataFrame:
    """Documents whose datasets and data groups are cut to the chosen methods.

    No chosen method keeps no dataset and no data group.
    """
    wanted = F.array(*[F.lit(m) for m in method_ids]).cast("array<bigint>")
    cut = documents.withColumn(
        "datasets", F.filter("datasets", lambda d: F.array_contains(wanted, d.method_id))
    )
    if "data_groups" in documents.columns:
        cut = cut.withColumn(
            "data_groups",
            F.filter(
                F.transform(
                    "data_groups",
                    lambda g: g.withField(
                        "values", F.filter(g["values"], lambda v: F.array_contains(wanted, v.method_id))
                    ),
                ),
                lambda g: F.size(g["values"]) > 0,
            ),
        )
    return cut


def save_documents(
    documents: DataFrame, path: str, key: str, *, stored: str | None = None, buckets: int, fmt: str = "parquet"
) -> None:
    """Write documents to the new folder ``path``, by a bucket of their key.

    The documents stored in ``stored``, if given, come along unless their key is
    written anew, with all slices of a key together. The old folder stays as it
    is, so readers move on when the new one is complete. A folder that exists
    already is an error, never overwritten.
    """
    whole = documents
    if stored is not None:
        current = documents.sparkSession.read.format(fmt).load(stored).drop("bucket")
        whole = replace_documents(current, documents, key)
    placed = whole.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    (
        placed.repartition(buckets, "bucket", F.pmod(F.xxhash64(*[c for c in (key, "part") if c in whole.columns]), F.lit(8)))
        .write.mode("error")
        .partitionBy("bucket")
        .format(fmt)
        .save(path)
    )


def replace_documents(current: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """The stored documents with those of ``fresh`` put in place of the same keys."""
    kept = current.join(fresh.select(key).distinct(), key, "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)
