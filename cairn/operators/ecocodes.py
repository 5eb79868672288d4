"""Habitat codes of taxa, weighted by the abundance of the taxa that carry them.

Every profile first sums abundance per (scope, taxon). That table is at most as
long as the distinct taxa of each scope, so the join with the code table never
multiplies raw counts and a taxon that holds a third of all counts is already
folded before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.semantics import SiteIds, ids_of
from cairn.operators.dating import site_age_summary
from cairn.operators.facts import ABUNDANCE_METHOD, abundance_facts, sample_rows
from cairn.operators.taxa import top_taxa
from cairn.sources.tables import Tables

DEFAULT_SYSTEM = 2


def _codes(t: Tables, system_id: int | None = DEFAULT_SYSTEM) -> DataFrame:
    """Distinct (taxon, definition) of one code system."""
    group = t["ecocode_group"]
    if system_id is not None:
        group = group.where(F.col("ecocode_system_id") == system_id)
    wanted = t["ecocode_definition"].join(
        group.select("ecocode_group_id"), "ecocode_group_id", "left_semi"
    )
    return (
        t["ecocode"]
        .select("taxon_id", "ecocode_definition_id")
        .distinct()
        .join(wanted, "ecocode_definition_id", "left_semi")
    )


def _definitions(t: Tables) -> DataFrame:
    return t["ecocode_definition"].select(
        "ecocode_definition_id", "ecocode_group_id", "abbreviation", "name"
    )


def taxon_ecocodes(
    t: Tables, taxon_ids: SiteIds = None, system_id: int = DEFAULT_SYSTEM
) -> DataFrame:
    codes = ids_of(_codes(t, system_id), taxon_ids, "taxon_id")
    return codes.join(_definitions(t), "ecocode_definition_id").select(
        "taxon_id",
        F.col("ecocode_definition_id").alias("definition_id"),
        F.col("ecocode_group_id").alias("group_id"),
        "abbreviation",
        "name",
    )


def scope_taxa(facts: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Summed abundance per scope and taxon."""
    return facts.groupBy(*scope, "taxon_id").agg(
        F.coalesce(F.sum("abundance"), F.lit(0)).cast("bigint").alias("abundance")
    )


def code_members(t: Tables, facts: DataFrame, scope: Sequence[str]) -> DataFrame:
    """One row per scope, code and taxon: the long form of the code bundles."""
    codes = _codes(t).withColumnRenamed("ecocode_definition_id", "definition_id")
    return scope_taxa(facts, scope).join(codes, "taxon_id")


def _bundles(t: Tables, facts: DataFrame, scope: Sequence[str]) -> DataFrame:
    # (scope, taxon) is unique here and so is (taxon, code): a plain count of the
    # member rows is the number of distinct taxa.
    return (
        code_members(t, facts, scope)
        .groupBy(*scope, "definition_id")
        .agg(F.count(F.lit(1)).alias("taxa_count"), F.sum("abundance").alias("abundance"))
    )


def site_ecocodes(t: Tables, site_ids: SiteIds = None) -> DataFrame:
    """Per (site, code): distinct taxa and summed abundance."""
    return _bundles(t, abundance_facts(t, site_ids, [ABUNDANCE_METHOD]), ["site_id"])


def site_ecocode_bundles(t: Tables, site_ids: SiteIds = None) -> DataFrame:
    """:func:`site_ecocodes` with the oldest and youngest age of the site."""
    ages = site_age_summary(t, site_ids).select(
        "site_id", F.col("older").alias("age_older"), F.col("younger").alias("age_younger")
    )
    return site_ecocodes(t, site_ids).join(ages, "site_id", "left")


def site_ecocode_taxa(t: Tables, site_ids: SiteIds = None) -> DataFrame:
    """The taxa behind :func:`site_ecocodes`, one row each."""
    return code_members(t, abundance_facts(t, site_ids, [ABUNDANCE_METHOD]), ["site_id"])


def site_ecocodes_by_sample(t: Tables, site_ids: SiteIds = None) -> DataFrame:
    """Per (site, sample, code); a sample without codes keeps one empty row."""
    facts = abundance_facts(t, site_ids, [ABUNDANCE_METHOD], site=site_ids is not None)
    per_sample = _bundles(t, facts, ["physical_sample_id"])
    every = sample_rows(t, "physical_sample", site_ids).select("site_id", "physical_sample_id")
    return every.join(per_sample, "physical_sample_id", "left").select(
        "site_id",
        "physical_sample_id",
        "definition_id",
        F.coalesce("taxa_count", F.lit(0)).cast("bigint").alias("taxa_count"),
        F.coalesce("abundance", F.lit(0)).cast("bigint").alias("abundance"),
    )


def dataset_ecocodes(t: Tables, dataset_ids: SiteIds = None) -> DataFrame:
    facts = ids_of(abundance_facts(t, site=False), dataset_ids, "dataset_id")
    return _bundles(t, facts, ["dataset_id"])


def dataset_ecocodes_by_sample(t: Tables, dataset_ids: SiteIds = None) -> DataFrame:
    facts = ids_of(abundance_facts(t, site=False), dataset_ids, "dataset_id")
    return _bundles(t, facts, ["dataset_id", "physical_sample_id"])


def ecocodes_summary(
    t: Tables, site_ids: SiteIds = None, *, by_abbreviation: bool = False
) -> DataFrame:
    """Summed abundance per code over many sites.

    ``by_abbreviation`` groups by the abbreviation first and keeps, per
    definition, the abbreviation that sorts first: definitions that share an
    abbreviation then fall into the smallest definition id.
    """
    facts = abundance_facts(t, site_ids, [ABUNDANCE_METHOD], site=site_ids is not None)
    codes = _codes(t).withColumnRenamed("ecocode_definition_id", "definition_id")
    totals = (
        scope_taxa(facts, [])
        .join(codes, "taxon_id")
        .groupBy("definition_id")
        .agg(F.sum("abundance").alias("abundance"))
    )
    names = _definitions(t).select(
        F.col("ecocode_definition_id").alias("definition_id"), "abbreviation", "name"
    )
    named = totals.join(names, "definition_id")
    if not by_abbreviation:
        return named.groupBy("definition_id").agg(
            F.min("abbreviation").alias("abbreviation"),
            F.min("name").alias("name"),
            F.max("abundance").alias("abundance"),
        )
    merged = named.groupBy("abbreviation").agg(
        F.min("definition_id").alias("definition_id"),
        F.min_by("name", "definition_id").alias("name"),
        F.sum("abundance").alias("abundance"),
    )
    return merged.groupBy("definition_id").agg(
        F.min("abbreviation").alias("abbreviation"),
        F.min_by("name", "abbreviation").alias("name"),
        F.min_by("abundance", "abbreviation").alias("abundance"),
    )


def site_ecocode_summary(t: Tables, site_ids: SiteIds = None) -> DataFrame:
    """Per code over the given sites: summed abundance and summed taxa counts."""
    bundles = site_ecocodes(t, site_ids)
    names = _definitions(t).select(
        F.col("ecocode_definition_id").alias("definition_id"), "abbreviation", "name"
    )
    return (
        bundles.groupBy("definition_id")
        .agg(F.sum("abundance").alias("abundance"), F.sum("taxa_count").alias("taxa_count"))
        .join(names, "definition_id")
        .select("definition_id", "abbreviation", "name", "abundance", "taxa_count")
        .orderBy(F.desc("abundance"), "definition_id")
    )


def ecocode_across_sites(
    t: Tables, definition_id: int, site_ids: SiteIds = None
) -> DataFrame:
    """One code over many sites. Only its own taxa reach the aggregation."""
    carriers = _codes(t).where(F.col("ecocode_definition_id") == definition_id)
    facts = abundance_facts(t, None, [ABUNDANCE_METHOD], site=False).join(
        carriers.select("taxon_id"), "taxon_id", "left_semi"
    )
    if "site_id" not in facts.columns:
        facts = facts.join(
            ids_of(t["sample_group"], site_ids).select("sample_group_id", "site_id"),
            "sample_group_id",
        )
    per_taxon = scope_taxa(facts, ["site_id"])
    return (
        per_taxon.groupBy("site_id")
        .agg(F.sum("abundance").alias("abundance"), F.count(F.lit(1)).alias("taxa_count"))
        .withColumn("definition_id", F.lit(definition_id).cast("bigint"))
        .select("site_id", "definition_id", "abundance", "taxa_count")
        .orderBy(F.desc("abundance"), "site_id")
    )


def ecocodes_for_sites(
    t: Tables, site_ids: SiteIds = None, mode: str = "abundance", k: int = 20
) -> DataFrame:
    """Codes of the k most abundant taxa: species count and, by mode, abundance."""
    weight = F.sum("abundance") if mode == "abundance" else F.lit(0).cast("bigint")
    best = top_taxa(t, site_ids, k).select("taxon_id", "abundance")
    if mode not in ("abundance", "species"):
        best = best.where(F.lit(False))
    codes = _codes(t).withColumnRenamed("ecocode_definition_id", "definition_id")
    return (
        codes.join(best, "taxon_id")
        .groupBy("definition_id")
        .agg(F.count(F.lit(1)).alias("species"), weight.alias("abundance"))
    )
