"""Structural summaries: counts per method, domain, country, feature and type."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.distinct import id_sets, set_sizes
from cairn.functions.semantics import SiteIds, ids_of, truthy_text
from cairn.operators.dating import site_age_summary
from cairn.operators.documents import path_table
from cairn.operators.domains import domain_methods
from cairn.operators.facts import (
    entities,
    groups,
    methods,
    of_methods,
    sample_rows,
    site_datasets,
)
from cairn.operators.paths import path_rows
from cairn.sources.tables import Tables

COUNTRY_TYPE_ID = 1
COUNTRY_TYPE = "Country"
BUILDING_TYPE_ID = 62


def _count() -> object:
    return F.count(F.lit(1))


def _named_counts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per key and ``id`` with the first name of each id.

    Counting per (id, name) first keeps the large step a hash aggregation; only
    its short result meets the minimum over texts.
    """
    per_name = rows.groupBy(*keys, "id", "name").agg(_count().alias("n"))
    return (
        per_name.groupBy(*keys, "id")
        .agg(F.min("name").alias("name"), F.sum("n").alias("n"))
        .orderBy(F.desc("n"), *keys, "id")
    )


def dataset_site_sets(t: Tables, site_ids: SiteIds = None) -> DataFrame:
    """The sites of every (method, dataset), as sets to store and merge."""
    return id_sets(of_methods(t, site_datasets(t, site_ids)), ["method_id", "dataset_id"], "site_id")


def method_sample_sets(t: Tables, site_ids: SiteIds = None) -> DataFrame:
    """The samples of every method, as sets to store and merge."""
    rows = entities(t).select("sample_group_id", "physical_sample_id", "dataset_id")
    if site_ids is not None:
        rows = rows.join(groups(t, site_ids).select("sample_group_id"), "sample_group_id", "left_semi")
    return id_sets(of_methods(t, rows), ["method_id"], "physical_sample_id")


def dataset_summaries(t: Tables, site_ids: SiteIds = None, *, sets: DataFrame | None = None) -> DataFrame:
    """Per method: distinct sites and (site, dataset) pairs.

    ``sets`` of :func:`dataset_site_sets`, from any number of loads, take the
    place of the rows.
    """
    if sets is not None:
        sites = set_sizes(sets, ["method_id"], "site_count")
        pairs = set_sizes(sets, ["method_id", "dataset_id"], "n").groupBy("method_id").agg(F.sum("n").alias("dataset_count"))
        counts = sites.join(pairs, "method_id")
    else:
        pairs = of_methods(t, site_datasets(t, site_ids))
        per_site = pairs.groupBy("method_id", "site_id").agg(_count().alias("datasets"))
        counts = per_site.groupBy("method_id").agg(
            _count().alias("site_count"), F.sum("datasets").alias("dataset_count")
        )
    names = methods(t).select("method_id", "method_name")
    return counts.join(names, "method_id", "left").select(
        "method_id", "method_name", "site_count", "dataset_count"
    )


def analysis_methods(t: Tables, site_ids: SiteIds = None) -> DataFrame:
    """Datasets per analysis method, with the method's attributes."""
    counts = (
        of_methods(t, site_datasets(t, site_ids))
        .groupBy("method_id")
        .agg(_count().alias("dataset_count"))
    )
    meta = methods(t).select("method_id", "method_name", "method_group_id", "record_type_id")
    return counts.join(meta, "method_id", "left")


def sample_methods(t: Tables, site_ids: SiteIds = None) -> DataFrame:
    """Sample groups per sampling method, with the method's attributes."""
    counts = (
        ids_of(t["sample_group"], site_ids)
        .groupBy("method_id")
        .agg(_count().alias("sample_group_count"))
    )
    meta = t["method"].select("method_id", "method_name", "method_group_id")
    return counts.join(meta, "method_id", "left")


def domains_overview(t: Tables, site_ids: SiteIds = None) -> DataFrame:
    """Datasets per domain; a dataset counts in every domain that lists its method."""
    per_method = (
        of_methods(t, site_datasets(t, site_ids)).groupBy("method_id").agg(_count().alias("n"))
    )
    listed = domain_methods(t).select("domain_id", "title", "method_id").distinct()
    return (
        listed.join(per_method, "method_id")
        .groupBy("domain_id", "title")
        .agg(F.sum("n").alias("dataset_count"))
    )


def domain_sample_summary(
    t: Tables, site_ids: SiteIds = None, *, sets: DataFrame | None = None
) -> DataFrame:
    """Distinct samples per method of every domain, with the domain's total.

    The total adds its methods up, so a sample analysed by two methods of one
    domain counts twice. Domains and methods without samples stay, with zero.
    ``sets`` of :func:`method_sample_sets`, from any number of loads, take the
    place of the rows.
    """
    rows = entities(t).select("sample_group_id", "physical_sample_id", "dataset_id")
    if site_ids is not None:
        rows = rows.join(groups(t, site_ids).select("sample_group_id"), "sample_group_id", "left_semi")
    if sets is not None:
        per_method = set_sizes(sets, ["method_id"], "sample_count")
    else:
        per_method = (
            of_methods(t, rows)
            .groupBy("method_id")
            .agg(F.count_distinct("physical_sample_id").alias("sample_count"))
        )
    listed = domain_methods(t)
    filled = listed.join(per_method, "method_id", "left").withColumn(
        "sample_count", F.coalesce("sample_count", F.lit(0)).cast("bigint")
    )
    totals = filled.groupBy("domain_id").agg(F.sum("sample_count").alias("domain_sample_count"))
    names = methods(t).select("method_id", "method_name")
    return (
        filled.join(totals, "domain_id")
        .join(names, "method_id", "left")
        .select(
            "domain_id",
            "method_pos",
            "method_id",
            "method_name",
            "sample_count",
            "domain_sample_count",
        )
        .orderBy("domain_id", "method_pos")
    )


def countries(t: Tables, site_ids: SiteIds = None) -> DataFrame:
    """Distinct sites per country with a non-empty name."""
    is_country = (F.col("location_type_id") == COUNTRY_TYPE_ID) | (
        F.col("location_type") == COUNTRY_TYPE
    )
    places = t["location"].where(is_country & truthy_text(F.col("location_name")))
    return (
        ids_of(t["site_location"], site_ids)
        .join(places, "location_id")
        .groupBy("location_id", F.col("location_name").alias("country_name"))
        .agg(F.count_distinct("site_id").alias("site_count"))
        .orderBy(F.desc("site_count"), "country_name", "location_id")
    )


def feature_types(
    t: Tables, site_ids: SiteIds = None, *, per_site: bool = False
) -> DataFrame:
    """Sample features per feature type, optionally per site."""
    site = per_site or site_ids is not None
    rows = sample_rows(t, "sample_feature", site_ids, site=site)
    keys = ["site_id"] if per_site else []
    named = rows.select(
        *keys, F.col("feature_type_id").alias("id"), F.col("feature_type_name").alias("name")
    )
    return _named_counts(named, keys)


# The variables the grouped summary knows, as document paths.
VARIABLE_PATHS = {
    "sampleFeatures": ("sample_groups.physical_samples.features", "feature_type_id", "feature_type_name"),
    "sampleMethods": ("sample_groups", "method_id", "sample_group_name"),
}


def _elements(source: Tables | DataFrame, path: str, site_ids: SiteIds) -> DataFrame:
    """The elements at a document path: from flat tables, or from stored documents."""
    if isinstance(source, Tables):
        return path_table(source, path, site_ids)
    return path_rows(ids_of(source, site_ids), path).select("site_id", "item.*")


def path_summary(
    source: Tables | DataFrame,
    path: str,
    id_field: str = "id",
    name_field: str = "name",
    site_ids: SiteIds = None,
    *,
    per_site: bool = False,
) -> DataFrame:
    """Count the elements at a document path by one of their fields.

    ``source`` is the tables, whose one flat table for the path is read, or
    documents read from storage.
    """
    keys = ["site_id"] if per_site else []
    rows = _elements(source, path, site_ids)
    named = rows.select(*keys, F.col(id_field).alias("id"), F.col(name_field).alias("name"))
    return _named_counts(named, keys)


def path_count(source: Tables | DataFrame, path: str, site_ids: SiteIds = None) -> DataFrame:
    """Number of elements at a document path; one row, 0 when empty."""
    return _elements(source, path, site_ids).agg(_count().alias("n"))


def grouped_by_variable(t: Tables, name: str, site_ids: SiteIds = None) -> DataFrame:
    if name not in VARIABLE_PATHS:
        raise ValueError(f"unknown variable {name!r}")
    path, id_field, name_field = VARIABLE_PATHS[name]
    return path_summary(t, path, id_field, name_field, site_ids)


def building_types(t: Tables, site_ids: SiteIds = None) -> DataFrame:
    """Sample-group descriptions of the building type, counted by text."""
    rows = t["sample_group_description"].where(F.col("type_id") == BUILDING_TYPE_ID)
    if site_ids is not None:
        rows = rows.join(groups(t, site_ids), "sample_group_id", "left_semi")
    return (
        rows.groupBy(F.col("group_description").alias("name"))
        .agg(_count().alias("n"))
        .orderBy(F.desc("n"), "name")
    )


def samples_count(t: Tables, site_ids: SiteIds = None) -> DataFrame:
    rows = t["physical_sample"].select("physical_sample_id", "sample_group_id")
    if site_ids is not None:
        rows = rows.join(groups(t, site_ids), "sample_group_id", "left_semi")
    return rows.agg(_count().alias("n"))


def sample_types(t: Tables, site_ids: SiteIds = None) -> DataFrame:
    rows = t["physical_sample"]
    if site_ids is not None:
        rows = rows.join(groups(t, site_ids), "sample_group_id", "left_semi")
    return (
        rows.groupBy("sample_type_id", F.col("sample_type_name").alias("name"))
        .agg(_count().alias("n"))
        .orderBy(F.desc("n"), "sample_type_id", "name")
    )


def sites_with_sample_coordinates(t: Tables, *, distinct: bool = False) -> DataFrame:
    """One row per sample that has a coordinate, or per site with ``distinct``."""
    located = sample_rows(t, "sample_coordinate").select("site_id", "physical_sample_id")
    rows = located.distinct()
    return rows.select("site_id").distinct() if distinct else rows


def dating_overview(t: Tables, site_ids: SiteIds = None) -> DataFrame:
    return site_age_summary(t, site_ids).select(
        "site_id", F.col("older").alias("age_older"), F.col("younger").alias("age_younger")
    )


# The measurement tables counted by the census.
CENSUS_ROLES = (
    "abundance",
    "aggregate_sample",
    "analysis_entity_dimension",
    "analysis_value",
    "ceramic",
    "dendro",
    "dendro_date",
    "entity_age",
    "geochronology",
    "isotope",
    "measured_value",
    "prep_method",
    "relative_date",
    "tephra_date",
)


def entity_census(
    t: Tables, entity_ids: SiteIds = None, roles: Sequence[str] | None = None
) -> DataFrame:
    """Rows per (measurement table, entity). Tables without a row, or not bound, give zero.

    The entity keys of all tables go through one aggregation that counts per
    table; the tables are never joined to each other.
    """
    asked = list(CENSUS_ROLES if roles is None else roles)
    unknown = [r for r in asked if r not in CENSUS_ROLES]
    if unknown:
        raise ValueError(f"unknown tables {unknown}")
    bound = [r for r in asked if r in t or f"{r}_flat" in t]
    key = "analysis_entity_id"
    marked = ids_of(entities(t).select(key), entity_ids, key).withColumn("_role", F.lit(-1))
    for role in bound:
        source = t[f"{role}_flat"] if f"{role}_flat" in t else t[role]
        rows = ids_of(source.select(key), entity_ids, key)
        marked = marked.unionByName(rows.withColumn("_role", F.lit(asked.index(role))))
    counts = [F.count_if(F.col("_role") == k).alias(role) for k, role in enumerate(asked)]
    known = F.count_if(F.col("_role") == -1).alias("_known")
    wide = marked.groupBy(F.col(key).alias("entity_id")).agg(known, *counts).where("_known > 0")
    return wide.unpivot("entity_id", asked, "table_name", "n")
