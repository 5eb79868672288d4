"""Taxon rankings, distributions, references and shared taxonomy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.semantics import SiteIds, ids_of
from cairn.operators.facts import ABUNDANCE_METHOD, abundance_facts
from cairn.sources.tables import Tables


def taxonomy(t: Tables) -> DataFrame:
    """taxon to genus to family to order, one row per taxon."""
    return (
        t["taxon"]
        .join(t["genus"], "genus_id")
        .join(t["family"], "family_id")
        .join(t["taxon_order"], "order_id")
        .select(
            "taxon_id",
            "species",
            "author_id",
            "genus_id",
            "genus_name",
            "family_id",
            "family_name",
            "order_id",
            "order_name",
        )
    )


def top_taxa(
    t: Tables, site_ids: SiteIds = None, k: int = 20, method_id: int = ABUNDANCE_METHOD
) -> DataFrame:
    """The k taxa with the largest total abundance, with their names.

    The sum combines on the map side and the ranking keeps k rows per partition;
    names are looked up for the k winners only.
    """
    facts = abundance_facts(t, site_ids, [method_id], site=site_ids is not None)
    totals = facts.groupBy("taxon_id").agg(
        F.coalesce(F.sum("abundance"), F.lit(0)).cast("bigint").alias("abundance")
    )
    best = totals.orderBy(F.desc("abundance"), "taxon_id").limit(k)
    named = (
        best.join(t["taxon"].select("taxon_id", "genus_id", "species"), "taxon_id", "left")
        .join(t["genus"], "genus_id", "left")
        .join(t["family"], "family_id", "left")
    )
    return named.select(
        "taxon_id",
        "abundance",
        F.col("family_name").alias("family"),
        F.col("genus_name").alias("genus"),
        "species",
    )


def taxon_distribution(
    t: Tables, taxon_ids: SiteIds = None, method_id: int = ABUNDANCE_METHOD
) -> DataFrame:
    """Per (taxon, site): summed abundance with the site's name and position."""
    facts = ids_of(abundance_facts(t, None, [method_id]), taxon_ids, "taxon_id")
    totals = facts.groupBy("taxon_id", "site_id").agg(
        F.coalesce(F.sum("abundance"), F.lit(0)).cast("bigint").alias("abundance")
    )
    return totals.join(t["site"], "site_id").select(
        "taxon_id",
        "site_id",
        "site_name",
        F.col("longitude_dd").alias("lon"),
        F.col("latitude_dd").alias("lat"),
        "abundance",
    )


def taxon_references(t: Tables, taxon_ids: SiteIds = None) -> DataFrame:
    """Authors and taxonomy notes of each taxon; empty where it has no author."""
    taxa = ids_of(t["taxon"], taxon_ids, "taxon_id").select("taxon_id", "author_id")
    notes = t["taxon_note"].select("taxon_id", "taxonomy_notes")
    joined = taxa.join(t["taxon_author"], "author_id", "left").join(notes, "taxon_id", "left")
    has_author = F.col("author_name").isNotNull()
    return joined.select(
        "taxon_id",
        "author_name",
        F.when(has_author, F.col("taxonomy_notes")).alias("taxonomy_notes"),
    )


def site_taxa(t: Tables, site_ids: SiteIds = None, language_ids: Sequence[int] = ()) -> DataFrame:
    """Distinct (site, taxon) with names and the count of each attribute kind.

    The attribute tables are first reduced to one row per taxon, so no product
    of attribute lists is ever formed.
    """
    pairs = abundance_facts(t, site_ids).select("site_id", "taxon_id").distinct()
    common = t["taxon_common_name"]
    if language_ids:
        common = common.where(F.col("language_id").isin(list(language_ids)))
    common = common.groupBy("taxon_id").agg(F.count(F.lit(1)).alias("common_names"))
    measured = t["taxon_measured"].groupBy("taxon_id").agg(
        F.count(F.lit(1)).alias("measured_attributes")
    )
    notes = t["taxon_note"].groupBy("taxon_id").agg(F.count(F.lit(1)).alias("notes"))
    attributes = (
        taxonomy(t)
        .join(common, "taxon_id", "left")
        .join(measured, "taxon_id", "left")
        .join(notes, "taxon_id", "left")
        .fillna(0, ["common_names", "measured_attributes", "notes"])
    )
    return pairs.join(attributes, "taxon_id").select(
        "site_id",
        "taxon_id",
        "species",
        "genus_name",
        "family_name",
        "order_name",
        "common_names",
        "measured_attributes",
        "notes",
    )


def species_associations(t: Tables, taxon_ids: SiteIds = None) -> DataFrame:
    """Associations of a taxon with the taxonomy of the taxon it is tied to."""
    links = ids_of(t["species_association"], taxon_ids, "taxon_id")
    if "association_type" in t:
        links = links.join(t["association_type"], "association_type_id")
    other = taxonomy(t).withColumnRenamed("taxon_id", "associated_taxon_id")
    return links.join(other, "associated_taxon_id")


# The attribute lists of a taxon that belong to the taxa of a site.
SITE_TAXON_ATTRIBUTES = {
    "common_names": ("taxon_common_name", "common_name"),
    "measured_attributes": ("taxon_measured", "data"),
    "notes": ("taxon_note", "taxonomy_notes"),
    "seasonality": ("taxon_seasonality", "activity_type"),
    "distribution": ("taxon_distribution_note", "distribution_text"),
    "biology": ("taxon_biology", "biology_text"),
}


def site_taxon_attributes(
    t: Tables, site_ids: SiteIds = None, language_ids: Sequence[int] = ()
) -> DataFrame:
    """(site_id, taxon_id, kind, value): the attributes of each taxon a site has, one row each."""
    pairs = abundance_facts(t, site_ids).select("site_id", "taxon_id").distinct()
    found = None
    for kind, (role, column) in SITE_TAXON_ATTRIBUTES.items():
        if role not in t:
            continue
        rows = t[role]
        if kind == "common_names" and language_ids:
            rows = rows.where(F.col("language_id").isin(list(language_ids)))
        rows = rows.select("taxon_id", F.lit(kind).alias("kind"), F.col(column).cast("string").alias("value"))
        found = rows if found is None else found.unionByName(rows)
    return pairs.join(found, "taxon_id").select("site_id", "taxon_id", "kind", "value")
