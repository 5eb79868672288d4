"""The lookup tables of a site: every code that its rows refer to, with the code's own fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.nesting import stack
from cairn.functions.semantics import SiteIds, ids_of
from cairn.operators.datagroups import abundance_lookups
from cairn.operators.dating import dating_labs
from cairn.operators.documents import site_biblio_lookup, site_lookups
from cairn.operators.domains import domains
from cairn.operators.facts import abundance_facts, leaf, value_facts, with_site
from cairn.operators.taxa import taxonomy
from cairn.sources.tables import Tables

# The role that describes the codes of a kind, its key, and the field that names a code.
DESCRIBED = {
    "method": ("method", "method_id", "method_name"),
    "prep_method": ("method", "method_id", "method_name"),
    "unit": ("unit", "unit_id", "unit_name"),
    "dimension": ("dimension", "dimension_id", "dimension_name"),
    "horizon": ("horizon", "horizon_id", "horizon_name"),
    "contact": ("contact", "contact_id", "contact_name"),
    "value_class": ("value_class", "value_class_id", "name"),
    "dating_uncertainty": ("dating_uncertainty", "dating_uncertainty_id", "description"),
    "isotope_measurement": ("isotope_measurement", "isotope_measurement_id", "measurement_name"),
    "isotope_standard": ("isotope_standard", "isotope_standard_id", "standard_name"),
    "isotope_type": ("isotope_type", "isotope_type_id", "isotope_type_name"),
    "isotope_value_specifier": ("isotope_value_specifier", "isotope_value_specifier_id", "name"),
}
COLUMNS = ("site_id", "kind", "id", "name", "attributes")


def _entries(rows: DataFrame, kind: str, key: str, name: Column | None, *fields: str) -> DataFrame:
    """Rows that already hold the fields of their code."""
    own = [c for c in (fields or rows.columns) if c not in ("site_id", key)]
    return rows.select(
        "site_id",
        F.lit(kind).alias("kind"),
        F.col(key).cast("bigint").alias("id"),
        (F.lit(None) if name is None else name).cast("string").alias("name"),
        F.to_json(F.struct(*own)).alias("attributes"),
    )


def _described(t: Tables, pairs: DataFrame) -> DataFrame:
    """(site, kind, id) with the fields of the code. All kinds join one table of codes, once."""
    codes = []
    for kind in DESCRIBED:
        role, key, name = DESCRIBED[kind]
        if role in t:
            rows = t[role]
            own = [c for c in rows.columns if c != key]
            named = F.col(name) if name in rows.columns else F.lit(None)
            codes.append(
                rows.select(
                    F.lit(kind).alias("kind"),
                    F.col(key).cast("bigint").alias("id"),
                    named.cast("string").alias("name"),
                    F.to_json(F.struct(*own)).alias("attributes"),
                )
            )
    if not codes:
        return pairs.select("site_id", "kind", "id", *(F.lit(None).cast("string").alias(c) for c in COLUMNS[3:]))
    return pairs.join(stack(codes), ["kind", "id"], "left").select(*COLUMNS)


def site_lookup_tables(t: Tables, site_ids: SiteIds = None) -> DataFrame:
    """(site_id, kind, id, name, attributes) of every code a site refers to; ``attributes`` is JSON text.

    Pairs of site and code are made distinct before a code's fields join, so the
    wide part meets few rows. A code that its table does not know keeps null fields. Kinds
    whose tables are not bound are left out.
    """
    pairs = [site_lookups(t, site_ids)]

    def used(rows: DataFrame, kind: str, column: str) -> None:
        if column in rows.columns:
            pairs.append(rows.select("site_id", F.lit(kind).alias("kind"), F.col(column).cast("bigint").alias("id")))

    if "value_flat" in t or "analysis_value" in t:
        values = value_facts(t, site_ids)
        used(values.select("site_id", "value_class_id").distinct(), "value_class", "value_class_id")
        if "dating_range" in t and "dating_uncertainty_id" in t["dating_range"].columns:
            ranges = t["dating_range"].select("analysis_value_id", "dating_uncertainty_id")
            used(values.select("site_id", "analysis_value_id").join(ranges, "analysis_value_id"), "dating_uncertainty", "dating_uncertainty_id")
    if "isotope_flat" in t or "isotope" in t:
        isotopes = with_site(t, leaf(t, "isotope"), site_ids)
        for kind in ("measurement", "standard", "type", "value_specifier"):
            used(isotopes, f"isotope_{kind}", f"isotope_{kind}_id")
        used(isotopes, "unit", "unit_id")
    parts = [_described(t, stack(pairs).where("id IS NOT NULL").distinct())]

    parts.append(_entries(site_biblio_lookup(t, site_ids), "biblio", "biblio_id", F.col("title")))
    if "abundance" in t or "abundance_flat" in t:
        found = abundance_facts(t, site_ids).select("site_id", "taxon_id").distinct().join(taxonomy(t), "taxon_id")
        parts.append(_entries(found, "taxon", "taxon_id", F.concat_ws(" ", "genus_name", "species")))
        named = abundance_lookups(t, site_ids)
        parts.append(named.select("site_id", "kind", F.col("id").cast("bigint").alias("id"), "name", F.to_json(F.struct("name")).alias("attributes")))
    if "dating_lab" in t:
        parts.append(_entries(dating_labs(t, site_ids), "dating_lab", "dating_lab_id", F.col("lab_name")))
    if "domain_clause" in t:
        # Every site lists all domains: a few rows, the codes of one small table.
        listed = domains(t)
        every = ids_of(t["site"], site_ids).select("site_id").crossJoin(F.broadcast(listed))
        parts.append(_entries(every, "domain", "domain_id", F.col("title")))
    return stack(parts).select(*COLUMNS)
