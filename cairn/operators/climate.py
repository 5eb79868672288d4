"""Mutual climatic range: overlap and density of per-taxon climate matrices.

A taxon's matrix has 36 rows (temperature range) of 60 cells (maximum
temperature). Each row is one 60-bit number, and a taxon is one record with an
array of 36 numbers. A reconstruction joins the distinct taxa of a scope with
that record, spreads the 36 rows, and aggregates bits and cell counts per
(scope, row); the partial aggregates combine before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.semantics import SiteIds, half_up, ids_of
from cairn.operators.facts import ABUNDANCE_METHOD, abundance_facts
from cairn.sources.tables import Tables

ROWS, COLUMNS = 36, 60
ALL_ONES = 2**COLUMNS - 1

RANGES = ("tmax_hi", "tmax_lo", "tmin_hi", "tmin_lo", "trange_hi", "trange_lo")
CENTRES = ("cog_mid_tmax", "cog_mid_trange")


def row_bits(data: Column) -> Column:
    """Sixty cells as a number; short rows count as zeros at the end."""
    cells = F.rpad(F.regexp_replace(F.substring(data, 1, COLUMNS), "[^1]", "0"), COLUMNS, "0")
    return F.conv(cells, 2, 10).cast("bigint")


def bits_text(bits: Column) -> Column:
    return F.lpad(F.conv(bits.cast("string"), 10, 2), COLUMNS, "0")


def taxon_matrix(t: Tables) -> DataFrame:
    """One record per taxon: an array of 36 row numbers, null where a row is missing."""
    bits = t["mcr_matrix"].select("taxon_id", "mcr_row", row_bits(F.col("mcr_data")).alias("bits"))
    rows = [F.max(F.when(F.col("mcr_row") == r, F.col("bits"))) for r in range(1, ROWS + 1)]
    return bits.groupBy("taxon_id").agg(F.array(*rows).alias("rows"))


def taxon_mcr(t: Tables, taxon_ids: SiteIds = None) -> DataFrame:
    """Envelope of each named taxon: name, climate summary and ordered rows."""
    row = [F.max(F.when(F.col("mcr_row") == r, F.col("mcr_data"))) for r in range(1, ROWS + 1)]
    rows = t["mcr_matrix"].groupBy("taxon_id").agg(F.array_compact(F.array(*row)).alias("matrix"))
    names = ids_of(t["mcr_name"], taxon_ids, "taxon_id")
    return names.join(t["mcr_summary"], "taxon_id", "left").join(rows, "taxon_id", "left")


def taxa_matrices(t: Tables, taxon_ids: SiteIds = None) -> DataFrame:
    """Raw matrix rows of the taxa that have a name."""
    rows = ids_of(t["mcr_matrix"], taxon_ids, "taxon_id")
    return rows.join(t["mcr_name"].select("taxon_id"), "taxon_id", "left_semi").select(
        "taxon_id", "mcr_row", "mcr_data"
    )


def scope_taxa(t: Tables, scope: str, ids: SiteIds = None) -> DataFrame:
    """Distinct (scope, taxon) with a name and a matrix.

    Site scope reads abundance-method datasets only; dataset scope reads all.
    """
    if scope == "site":
        facts = abundance_facts(t, ids, [ABUNDANCE_METHOD])
    elif scope == "dataset":
        facts = ids_of(abundance_facts(t, site=False), ids, "dataset_id")
    else:
        raise ValueError(f"unknown scope {scope!r}")
    pairs = facts.select(F.col(f"{scope}_id").alias("scope"), "taxon_id").distinct()
    return _named(t, pairs)


def _named(t: Tables, pairs: DataFrame) -> DataFrame:
    return pairs.join(t["mcr_name"].select("taxon_id"), "taxon_id", "left_semi")


def _row_aggregates(t: Tables, pairs: DataFrame, *aggregates: Column) -> DataFrame:
    """Aggregate bits per (scope, row). Missing rows take part as null bits."""
    spread = pairs.join(taxon_matrix(t), "taxon_id").select(
        "scope", F.posexplode("rows").alias("row", "bits")
    )
    return spread.groupBy("scope", "row").agg(*aggregates)


def _stride(t: Tables) -> int:
    """How far apart the cells that are counted in one number lie, so that no count runs into the next.

    A taxon counts once a scope, so a count is at most the number of taxa with a
    matrix, which is a code table.
    """
    taxa = t["mcr_matrix"].agg(F.count_distinct("taxon_id").alias("n")).first()["n"]
    return next(s for s in (12, 15, 20, 30, 60) if s == COLUMNS or taxa < 1 << s)


def _cell_sums(stride: int) -> list[Column]:
    """Numbers that each hold the counts of the cells ``stride`` apart, as fields of ``stride`` bits.

    Every stride divides a row, so shifting a row and keeping its bits at multiples
    of the stride gives one addend for several cells at once.
    """
    mask = F.lit(sum(1 << at for at in range(0, COLUMNS, stride)))
    return [
        F.coalesce(F.sum(F.shiftrightunsigned("bits", k).bitwiseAND(mask)), F.lit(0)).cast("bigint").alias(f"_c{k}")
        for k in range(stride)
    ]


def _cell_counts(stride: int) -> Column:
    """Taxa per cell of one matrix row, first column first, from :func:`_cell_sums`."""
    field = F.lit((1 << stride) - 1)
    places = range(COLUMNS - 1, -1, -1)
    return F.array(*(F.shiftrightunsigned(f"_c{p % stride}", p // stride * stride).bitwiseAND(field).cast("bigint") for p in places))


def _bounds(found: DataFrame, bits: str, *extra: Column) -> DataFrame:
    """First and last row and column with a set bit, per scope."""
    some = F.col(bits) != 0
    text = bits_text(F.col("_any"))
    merged = found.groupBy("scope").agg(
        F.max("taxa").alias("taxa_count"),
        F.min(F.when(some, F.col("row"))).cast("bigint").alias("row_min"),
        F.max(F.when(some, F.col("row"))).cast("bigint").alias("row_max"),
        F.bit_or(bits).alias("_any"),
        *extra,
    )
    hit = F.col("_any") != 0
    return (
        merged.withColumn(
            "col_min", F.when(hit, F.locate("1", text) - 1).cast("bigint")
        )
        .withColumn("col_max", F.when(hit, COLUMNS - F.locate("1", F.reverse(text))).cast("bigint"))
        .drop("_any")
    )


def _overlap(t: Tables, pairs: DataFrame) -> DataFrame:
    return _row_aggregates(
        t,
        pairs,
        F.coalesce(F.bit_and("bits"), F.lit(ALL_ONES).cast("bigint")).alias("both"),
        F.count(F.lit(1)).alias("taxa"),
    )


def mcr_reconstruction(t: Tables, scope: str = "site", ids: SiteIds = None) -> DataFrame:
    """Overlap matrix per scope: 36 rows of 60 cells, 1 where every taxon has 1."""
    return _overlap(t, scope_taxa(t, scope, ids)).select(
        "scope", F.col("row").cast("bigint").alias("row"), bits_text(F.col("both")).alias("bits")
    )


def mcr_reconstruction_summary(
    t: Tables, scope: str = "site", ids: SiteIds = None
) -> DataFrame:
    """Taxa count and the bounds of the overlap, per scope."""
    return _bounds(_overlap(t, scope_taxa(t, scope, ids)), "both").select(
        "scope", "taxa_count", "col_min", "col_max", "row_min", "row_max"
    )


def mcr_density(t: Tables, scope: str = "site", ids: SiteIds = None) -> DataFrame:
    """Taxa per cell, every cell of every scope."""
    stride = _stride(t)
    return (
        _row_aggregates(t, scope_taxa(t, scope, ids), *_cell_sums(stride))
        .select("scope", "row", F.posexplode(_cell_counts(stride)).alias("col", "n"))
        .select(
            "scope",
            F.col("row").cast("bigint").alias("row"),
            F.col("col").cast("bigint").alias("col"),
            "n",
        )
    )


LEAN_COLUMNS: Sequence[str] = (
    "taxa_count",
    "tmax_lo", "tmax_hi", "tmin_lo", "tmin_hi", "trange_lo", "trange_hi",
    "cog_tmax", "cog_trange",
    "col_min", "col_max", "row_min", "row_max",
    "peak_row", "peak_col", "peak_n",
)


def _lean(t: Tables, pairs: DataFrame) -> DataFrame:
    """Density bounds, peak cell and climate statistics per scope."""
    top, stride = F.array_max("counts"), _stride(t)
    cells = _row_aggregates(
        t,
        pairs,
        F.bit_or("bits").alias("any"),
        F.count(F.lit(1)).alias("taxa"),
        *_cell_sums(stride),
    ).withColumn("counts", _cell_counts(stride)).select(
        "scope",
        F.col("row").cast("bigint").alias("row"),
        F.coalesce("any", F.lit(0)).cast("bigint").alias("any"),
        "taxa",
        top.alias("top"),
        (F.array_position("counts", top) - 1).alias("top_col"),
    )
    # First peak in row-major order: most taxa, then smallest row; within a row
    # array_position already gives the smallest column.
    peak = F.max_by(
        F.struct("row", F.col("top_col").alias("col"), F.col("top").alias("n")),
        F.struct("top", -F.col("row")),
    ).alias("peak")
    bounds = _bounds(cells, "any", peak)
    with_matrix = t["mcr_matrix"].select("taxon_id").distinct()
    both = F.col("cog_mid_tmax").isNotNull() & F.col("cog_mid_trange").isNotNull()
    climate = (
        pairs.join(with_matrix, "taxon_id", "left_semi")
        .join(t["mcr_summary"], "taxon_id", "left")
        .groupBy("scope")
        .agg(
            *[F.min(c).alias(c) for c in RANGES if c.endswith("_lo")],
            *[F.max(c).alias(c) for c in RANGES if c.endswith("_hi")],
            half_up(F.avg(F.when(both, F.col("cog_mid_tmax")))).alias("cog_tmax"),
            half_up(F.avg(F.when(both, F.col("cog_mid_trange")))).alias("cog_trange"),
        )
    )
    seen = F.col("peak.n") > 0
    return (
        bounds.join(climate, "scope")
        .withColumn("peak_row", F.when(seen, F.col("peak.row")))
        .withColumn("peak_col", F.when(seen, F.col("peak.col")))
        .withColumn("peak_n", F.when(seen, F.col("peak.n")))
        .select("scope", *LEAN_COLUMNS)
    )


def mcr_aggregate(t: Tables, site_ids: SiteIds = None) -> DataFrame:
    """One reconstruction over a set of sites, each taxon counted once."""
    facts = abundance_facts(t, site_ids, [ABUNDANCE_METHOD], site=site_ids is not None)
    taxa = facts.select("taxon_id").distinct()
    pairs = _named(t, taxa.withColumn("scope", F.lit(0).cast("bigint")))
    return _lean(t, pairs)


def mcr_by_site(t: Tables, site_ids: Sequence[int] | None = None) -> DataFrame:
    """One reconstruction per requested site, in the requested order.

    Sites without taxa stay, with a count of 0 and nulls. Without a list every
    site is returned, ordered by id.
    """
    found = _lean(t, scope_taxa(t, "site", site_ids))
    if site_ids is None:
        wanted = t["site"].select(F.col("site_id").alias("scope"), F.col("site_id").alias("position"))
    else:
        wanted = t.spark.createDataFrame(
            [(s, p) for p, s in enumerate(site_ids)], "scope bigint, position bigint"
        )
    return (
        wanted.join(found, "scope", "left")
        .withColumn("taxa_count", F.coalesce("taxa_count", F.lit(0)).cast("bigint"))
        .orderBy("position")
        .select("position", "scope", *LEAN_COLUMNS)
    )
