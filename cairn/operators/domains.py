"""Domains: named lists of method ids, parsed out of a text clause."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.sources.tables import Tables


def listed_ids(clause: Column) -> Column:
    """Ids of the first ``in (...)`` list; empty for a sub-select or no list."""
    inside = F.regexp_extract(clause, r"(?i)in\s*\(([^)]+)\)", 1)
    plain = ~inside.rlike("(?i)select")
    numbers = F.transform(
        F.split(inside, ","),
        lambda part: F.regexp_extract(part, r"^\s*([+-]?\d+)", 1).try_cast("bigint"),
    )
    empty = F.array().cast("array<bigint>")
    return F.when(plain, F.filter(numbers, lambda n: n.isNotNull())).otherwise(empty)


def digit_run_ids(clause: Column) -> Column:
    """Every run of digits in the clause, wherever it stands."""
    runs = F.regexp_extract_all(clause, F.lit(r"(\d+)"), 1)
    return F.transform(runs, lambda run: run.try_cast("bigint"))


def domains(t: Tables, *, digit_runs: bool = False, drop_empty: bool = True) -> DataFrame:
    """domain_id, code, title and the ordered array of method ids."""
    parse = digit_run_ids if digit_runs else listed_ids
    rows = t["domain_clause"].select(
        F.col("facet_id").alias("domain_id"),
        F.col("facet_code").alias("code"),
        F.col("display_title").alias("title"),
        parse(F.col("clause")).alias("method_ids"),
    )
    return rows.where(F.size("method_ids") > 0) if drop_empty else rows


def domain_methods(t: Tables) -> DataFrame:
    """One row per (domain, position, method)."""
    return domains(t).select(
        "domain_id", "title", F.posexplode("method_ids").alias("method_pos", "method_id")
    )
