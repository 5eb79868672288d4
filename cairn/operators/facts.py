"""Flat joins that the summaries, profiles and documents share.

Each fact is the smallest join that carries the keys a job groups by. When a
``*_flat`` role is bound it already holds the keys of the levels above the leaf
and only the dimension lookups remain.

``with_site=False`` leaves the group-to-site join out. Every group belongs to
exactly one site, so a job over all sites that does not group by site gets the
same rows without the largest shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.semantics import SiteIds, best_by, ids_of
from cairn.sources.tables import Tables

ABUNDANCE_METHOD = 3


def groups(t: Tables, site_ids: SiteIds = None) -> DataFrame:
    return ids_of(t["sample_group"], site_ids).select("sample_group_id", "site_id")


def with_site(t: Tables, df: DataFrame, site_ids: SiteIds = None) -> DataFrame:
    """Add ``site_id`` to rows that carry ``sample_group_id``."""
    if "site_id" in df.columns:
        return ids_of(df, site_ids)
    return df.join(groups(t, site_ids), "sample_group_id")


# Where the rows of a table point to, in order: role, key, kind of join, and the
# columns taken (all that are new, if None). Roles that are not bound are passed over.
LOOKUPS: dict[str, tuple[tuple[str, str, str, tuple[str, ...] | None], ...]] = {
    "sample_feature": (("feature", "feature_id", "left", None), ("feature_type", "feature_type_id", "left", None)),
    "sample_description": (("sample_description_type", "sample_description_type_id", "left", None),),
    "sample_location": (("sample_location_type", "sample_location_type_id", "left", None),),
    "sample_alt_ref": (("alt_ref_type", "alt_ref_type_id", "left", None),),
    "sample_dimension": (("dimension", "dimension_id", "left", ("unit_id",)),),
    "sample_coordinate": (("coordinate_method_dimension", "coordinate_method_dimension_id", "inner", None),),
    "sample_horizon": (("horizon", "horizon_id", "inner", None),),
    "sample_group_coordinate": (
        ("coordinate_method_dimension", "coordinate_method_dimension_id", "inner", None),
        ("dimension", "dimension_id", "inner", ("unit_id",)),
    ),
    "sample_group_context": (("sampling_context", "sampling_context_id", "left", None),),
    "site_other_record": (("record_type", "record_type_id", "left", None), ("biblio", "biblio_id", "left", None)),
    "dataset": (
        ("method", "method_id", "left", ("method_group_id",)),
        ("project", "project_id", "left", None),
        ("project_type", "project_type_id", "left", None),
    ),
    "dataset_contact": (("contact", "contact_id", "left", None),),
    "taxon_common_name": (("language", "language_id", "left", None),),
    "taxon_red_list": (
        ("rdb_code", "rdb_code_id", "inner", None),
        ("rdb_system", "rdb_system_id", "inner", None),
        ("location", "location_id", "inner", ("location_name", "location_type_id")),
        ("location_type", "location_type_id", "inner", None),
        ("biblio", "biblio_id", "inner", None),
    ),
    "taxon_seasonality": (
        ("season", "season_id", "left", None),
        ("season_type", "season_type_id", "left", None),
        ("location", "location_id", "left", ("location_name",)),
    ),
    "species_association": (("association_type", "association_type_id", "inner", None),),
}


def joined(t: Tables, role: str) -> DataFrame:
    """The rows of a table with the columns of the tables they point to."""
    rows = t[role]
    for lookup, key, how, columns in LOOKUPS.get(role, ()):
        if lookup in t and key in rows.columns:
            other = t[lookup]
            taken = [c for c in columns or other.columns if c not in rows.columns]
            rows = rows.join(other.select(key, *taken), key, how)
    return rows


def _with_group(t: Tables, df: DataFrame) -> DataFrame:
    if "sample_group_id" in df.columns:
        return df
    return df.join(
        t["physical_sample"].select("physical_sample_id", "sample_group_id"),
        "physical_sample_id",
    )


def sample_rows(
    t: Tables, role: str, site_ids: SiteIds = None, *, site: bool = True
) -> DataFrame:
    """Rows of a sample-level child table with group and, if asked, site keys."""
    rows = _with_group(t, joined(t, role))
    return with_site(t, rows, site_ids) if site else rows


def entities(t: Tables) -> DataFrame:
    """Analysis entities with their sample and sample group."""
    if "entity_flat" in t:
        return t["entity_flat"]
    return _with_group(t, t["analysis_entity"])


def leaf(t: Tables, role: str) -> DataFrame:
    """A per-entity measurement table with sample, group and dataset keys."""
    if f"{role}_flat" in t:
        return t[f"{role}_flat"]
    keys = entities(t).select(
        "analysis_entity_id", "physical_sample_id", "sample_group_id", "dataset_id"
    )
    return t[role].join(keys, "analysis_entity_id")


def of_methods(
    t: Tables, df: DataFrame, method_ids: Sequence[int] | None = None
) -> DataFrame:
    """Add ``method_id`` through the dataset, keeping only the given methods."""
    dataset = t["dataset"].select("dataset_id", "method_id")
    if method_ids is not None:
        dataset = dataset.where(F.col("method_id").isin(list(method_ids)))
    return df.join(dataset, "dataset_id")


def entity_facts(t: Tables, site_ids: SiteIds = None) -> DataFrame:
    return of_methods(t, with_site(t, entities(t), site_ids))


def abundance_facts(
    t: Tables,
    site_ids: SiteIds = None,
    method_ids: Sequence[int] | None = None,
    *,
    site: bool = True,
) -> DataFrame:
    rows = leaf(t, "abundance")
    if method_ids is not None:
        rows = of_methods(t, rows, method_ids)
    if site or site_ids is not None:
        rows = with_site(t, rows, site_ids)
    return rows


def value_facts(t: Tables, site_ids: SiteIds = None) -> DataFrame:
    """Keyed values: one row per (entity, key, value)."""
    if "value_flat" in t:
        rows = t["value_flat"]
    else:
        names = t["value_class"].select("value_class_id", F.col("name").alias("key"))
        named = t["physical_sample"].select("physical_sample_id", "sample_name")
        rows = (
            leaf(t, "analysis_value")
            .join(names, "value_class_id", "left")
            .join(named, "physical_sample_id")
            .withColumnRenamed("analysis_value", "value")
        )
    return with_site(t, rows, site_ids)


def age_facts(t: Tables, site_ids: SiteIds = None) -> DataFrame:
    rows = leaf(t, "entity_age")
    return with_site(t, rows, site_ids)


# The dating methods read from laboratory measurements.
LABORATORY_DATING_METHODS = (151, 148, 38, 150, 152, 160)


def dating_facts(
    t: Tables, laboratory_methods: Sequence[int] = LABORATORY_DATING_METHODS
) -> DataFrame:
    """One row of dating fields per entity.

    Entities of laboratory-dated datasets take their measurement; all others
    take their relative date. Where an entity has several, the smallest id wins.
    """
    if "dating_flat" in t:
        return t["dating_flat"]
    keyed = of_methods(
        t,
        entities(t).select(
            "analysis_entity_id", "physical_sample_id", "sample_group_id", "dataset_id"
        ),
    )
    is_lab = F.col("method_id").isin(list(laboratory_methods))
    measured = keyed.where(is_lab).join(
        best_by(t["geochronology"], ["analysis_entity_id"], [F.col("geochron_id")]),
        "analysis_entity_id",
    )
    first_date = best_by(
        t["relative_date"].select(
            "analysis_entity_id", "relative_date_id", "relative_age_id"
        ),
        ["analysis_entity_id"],
        [F.col("relative_date_id")],
    )
    relative = (
        keyed.where(~is_lab)
        .join(first_date, "analysis_entity_id")
        .join(t["relative_age"], "relative_age_id", "left")
    )
    return (
        measured.withColumn("is_laboratory", F.lit(True))
        .unionByName(
            relative.withColumn("is_laboratory", F.lit(False)), allowMissingColumns=True
        )
        .drop("method_id")
    )


def site_datasets(t: Tables, site_ids: SiteIds = None) -> DataFrame:
    """Distinct (site, dataset): a site owns the datasets of its entities.

    Pairs are not made distinct by group first, as that would shuffle them once more by another key.
    """
    pairs = entities(t).select("sample_group_id", "dataset_id")
    return with_site(t, pairs, site_ids).select("site_id", "dataset_id").distinct()


def sites_using(
    t: Tables,
    method_ids: Sequence[int] = (),
    method_group_ids: Sequence[int] = (),
) -> DataFrame:
    """Distinct sites that use one of the methods or method groups of a family."""
    wanted = methods(t).where(
        F.col("method_id").isin(list(method_ids))
        | F.col("method_group_id").isin(list(method_group_ids))
    )
    datasets = (
        t["dataset"]
        .select("dataset_id", "method_id")
        .join(wanted.select("method_id"), "method_id", "left_semi")
    )
    rows = entities(t).select("sample_group_id", "dataset_id")
    used = rows.join(datasets.select("dataset_id"), "dataset_id", "left_semi")
    return with_site(t, used).select("site_id").distinct()


def methods(t: Tables) -> DataFrame:
    """The analysis methods (a smaller table than all methods, where bound)."""
    return t["analysis_method"] if "analysis_method" in t else t["method"]
