"""Statistics of one keyed variable over sites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.semantics import SiteIds, finite_number, ids_of
from cairn.operators.facts import value_facts
from cairn.sources.tables import Tables

TREE_SPECIES = "Tree species"


def _of_key(t: Tables, key: str, site_ids: SiteIds) -> DataFrame:
    return value_facts(t, site_ids).where(F.col("key") == key).select("site_id", "value")


def _text() -> object:
    return F.coalesce("value", F.lit("null")).alias("value")


def variable_counts(t: Tables, key: str = TREE_SPECIES, site_ids: SiteIds = None) -> DataFrame:
    """Rows per value of the key."""
    return _of_key(t, key, site_ids).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def variable_average_per_site(t: Tables, key: str, site_ids: SiteIds = None) -> DataFrame:
    """Mean, count and extremes of the numeric values of each site with the key."""
    rows = _of_key(t, key, site_ids).withColumn("number", finite_number(F.col("value")))
    return rows.groupBy("site_id").agg(
        F.avg("number").alias("average"),
        F.count("number").alias("n"),
        F.min("number").alias("min"),
        F.max("number").alias("max"),
    )


def _value_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("site_id", _text()).agg(F.count(F.lit(1)).alias("n"))


def variable_categories_per_site(t: Tables, key: str, site_ids: SiteIds = None) -> DataFrame:
    """Count, share and site totals of every value of the key."""
    counts = _value_counts(_of_key(t, key, site_ids))
    totals = counts.groupBy("site_id").agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("unique_values")
    )
    return counts.join(totals, "site_id").select(
        "site_id",
        "value",
        "n",
        F.round(F.col("n") / F.col("total") * 100, 2).alias("percentage"),
        "total",
        "unique_values",
    )


def variable_per_site(t: Tables, key: str, site_ids: SiteIds = None) -> DataFrame:
    """Numeric mean for sites with any numeric value, value counts for the others."""
    rows = _of_key(t, key, site_ids)
    counts = _value_counts(rows).withColumn("number", finite_number(F.col("value")))
    weighted = F.col("number") * F.col("n")
    totals = counts.groupBy("site_id").agg(
        (F.sum(weighted) / F.sum(F.when(F.col("number").isNotNull(), F.col("n")))).alias(
            "average"
        ),
        F.sum(F.when(F.col("number").isNotNull(), F.col("n"))).alias("numeric_n"),
        F.sum("n").alias("total"),
    )
    numeric = totals.where("numeric_n IS NOT NULL").select(
        "site_id",
        F.lit("numeric").alias("kind"),
        "average",
        F.lit(None).cast("string").alias("value"),
        F.col("numeric_n").alias("n"),
        "total",
    )
    category = counts.join(totals.where("numeric_n IS NULL"), "site_id").select(
        "site_id",
        F.lit("category").alias("kind"),
        F.lit(None).cast("double").alias("average"),
        "value",
        "n",
        "total",
    )
    return numeric.unionByName(category)


def value_class_listing(t: Tables) -> DataFrame:
    """The value-class table as it is."""
    return t["value_class"]


def value_classes_used(
    t: Tables, site_ids: SiteIds = None, method_ids: Sequence[int] | None = None
) -> DataFrame:
    """The value classes that occur in values, once each; of the given methods, if any are given."""
    used = value_facts(t, site_ids).select("value_class_id").distinct()
    classes = ids_of(t["value_class"], method_ids, "method_id")
    return classes.join(used, "value_class_id", "left_semi")


def dating_uncertainties(t: Tables, class_ids: tuple[int, ...] = (134, 137)) -> DataFrame:
    """Uncertainty codes referenced by dating ranges of the given value classes."""
    values = value_facts(t).where(F.col("value_class_id").isin(list(class_ids)))
    used = (
        t["dating_range"]
        .where(F.col("dating_uncertainty_id").isNotNull())
        .join(values, "analysis_value_id", "left_semi")
        .select("dating_uncertainty_id")
        .distinct()
    )
    return ids_of(t["dating_uncertainty"], used, "dating_uncertainty_id")
