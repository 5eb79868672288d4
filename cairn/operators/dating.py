"""Ages: range histogram, extremes, spans and chronologies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.semantics import SiteIds, ids_of, leading_integer, truthy
from cairn.operators.facts import age_facts, dating_facts, value_facts
from cairn.sources.tables import Tables

# The value classes that hold germination and felling years.
GERMINATION_CLASS = 134
FELLING_CLASS = 137


def _site_ranges(t: Tables, site_ids: SiteIds) -> DataFrame:
    """(site, low, high) per age: a point age is a range of length zero."""
    ages = age_facts(t, site_ids)
    low = F.coalesce("age", "age_younger").cast("double")
    high = F.coalesce("age", "age_older").cast("double")
    return (
        ages.select("site_id", low.alias("a"), high.alias("b"))
        .where("a IS NOT NULL AND b IS NOT NULL")
        .select("site_id", F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
    )


# Bin marks of one site are kept in 64-bit words; this many bits are used of each.
_WORD_BITS = 60


def _bin_words(first: Column, last: Column, bins: int) -> list[Column]:
    """Marks of the bins first..last, cut into words of ``_WORD_BITS`` bins."""
    words = []
    for base in range(0, bins, _WORD_BITS):
        low = F.greatest(first - base, F.lit(0)).cast("int")
        high = F.least(last - base, F.lit(_WORD_BITS - 1)).cast("int")
        one = F.lit(1).cast("bigint")
        run = F.call_function("shiftleft", one, high - low + 1) - 1
        marks = F.call_function("shiftleft", run, low)
        words.append(F.when(low <= high, marks).otherwise(F.lit(0).cast("bigint")))
    return words


def datings_histogram(
    t: Tables, site_ids: SiteIds = None, bins: int = 20, *, include_max: bool = False
) -> DataFrame:
    """Sites per equal-width age bin; a site counts once in every bin it spans.

    Each range becomes a bit mask over the bins. The masks of a site are or-ed
    together before the shuffle, so one short row per site reaches the counting
    step and nothing is exploded, however many ages a site has. The age limits
    take one pass of their own and reach the ages as a single broadcast row.

    A range of length zero at the very maximum falls in no bin, because only
    the last index is capped; ``include_max`` caps the first index too.
    """
    ranges = _site_ranges(t, site_ids)
    limits = ranges.agg(
        F.min("low").alias("lowest"), F.max("high").alias("highest")
    ).select(
        "lowest",
        F.when(F.col("highest") > F.col("lowest"), (F.col("highest") - F.col("lowest")) / bins)
        .otherwise(F.lit(1.0))
        .alias("width"),
    )
    # A global aggregate always gives exactly one row.
    placed = ranges.crossJoin(F.broadcast(limits))
    first = F.greatest(F.lit(0), F.floor((F.col("low") - F.col("lowest")) / F.col("width")))
    last = F.least(
        F.lit(bins - 1), F.floor((F.col("high") - F.col("lowest")) / F.col("width"))
    )
    if include_max:
        first = F.least(F.lit(bins - 1), first)
    words = _bin_words(first, last, bins)
    names = [f"w{i}" for i in range(len(words))]
    edges = ["lowest", "width"]
    per_site = (
        placed.select("site_id", *edges, *[w.alias(n) for w, n in zip(words, names)])
        .groupBy("site_id")
        .agg(*[F.bit_or(n).alias(n) for n in names], *[F.max(e).alias(e) for e in edges])
    )
    bit_counts = [
        F.sum(F.getbit(F.col(names[i // _WORD_BITS]), F.lit(i % _WORD_BITS)).cast("bigint"))
        for i in range(bins)
    ]
    counted = per_site.agg(
        F.array(*bit_counts).alias("counts"),
        F.count(F.lit(1)).alias("sites_with_datings"),
        *[F.max(e).alias(e) for e in edges],
    )
    total = t["site"].agg(F.count(F.lit(1)).alias("total_sites"))
    return (
        counted.crossJoin(F.broadcast(total))
        .where(F.col("lowest").isNotNull())
        .select("*", F.posexplode("counts").alias("bin", "site_count"))
        .select(
            F.col("bin").cast("bigint").alias("bin"),
            (F.col("lowest") + F.col("bin") * F.col("width")).alias("bin_start"),
            (F.col("lowest") + (F.col("bin") + 1) * F.col("width")).alias("bin_end"),
            "site_count",
            "total_sites",
            "sites_with_datings",
        )
        .orderBy("bin")
    )


def _whole(value: Column) -> Column:
    """Cut a number towards zero."""
    return value.cast("double").cast("bigint")


def site_age_summary(t: Tables, site_ids: SiteIds = None) -> DataFrame:
    """Per site: largest older age and smallest younger age; zero means absent."""
    ages = age_facts(t, site_ids)
    older, younger = F.col("age_older"), F.col("age_younger")
    return ages.groupBy("site_id").agg(
        F.max(F.when(truthy(older), _whole(older))).alias("older"),
        F.min(F.when(truthy(younger), _whole(younger))).alias("younger"),
    )


def dating_candidates(dated: DataFrame) -> DataFrame:
    """Older and younger candidates of each entity, in the order they are tried."""

    def candidate(order: int, kind: str, present: Column, older: Column, younger: Column):
        return F.when(
            present,
            F.struct(
                F.lit(order).alias("rank"),
                F.lit(kind).alias("type"),
                older.alias("older"),
                younger.alias("younger"),
            ),
        )

    def both(*names: str) -> Column:
        present = F.lit(True)
        for name in names:
            present = present & truthy(F.col(name))
        return present

    options = F.array(
        candidate(
            0, "c14", both("c14_age_older", "c14_age_younger"),
            _whole(F.col("c14_age_older")), _whole(F.col("c14_age_younger")),
        ),
        candidate(
            1, "cal", both("cal_age_older", "cal_age_younger"),
            _whole(F.col("cal_age_older")), _whole(F.col("cal_age_younger")),
        ),
        candidate(
            2, "other", both("age", "error_older", "error_younger"),
            _whole(F.col("age")) - _whole(F.col("error_older")),
            _whole(F.col("age")) + _whole(F.col("error_younger")),
        ),
    )
    return dated.withColumn("c", F.explode(options)).where(F.col("c").isNotNull())


def dataset_dating_span(t: Tables, site_ids: SiteIds = None) -> DataFrame:
    """Per dataset: the oldest and youngest candidate with type and entity.

    Ties go to the smaller entity id, then to the candidate that is tried first.
    """
    dated = dating_facts(t)
    if site_ids is not None:
        groups = ids_of(t["sample_group"], site_ids).select("sample_group_id")
        dated = dated.join(groups, "sample_group_id", "left_semi")
    rows = dating_candidates(dated).select("dataset_id", "analysis_entity_id", "c.*")
    pick = F.struct("type", "analysis_entity_id", "older", "younger")
    first = rows.groupBy("dataset_id").agg(
        F.min_by(pick, F.struct(-F.col("older"), "analysis_entity_id", "rank")).alias("o"),
        F.min_by(pick, F.struct("younger", "analysis_entity_id", "rank")).alias("y"),
    )
    return first.select(
        "dataset_id",
        F.col("o.older").alias("older"),
        F.col("o.type").alias("older_type"),
        F.col("o.analysis_entity_id").alias("older_entity"),
        F.col("y.younger").alias("younger"),
        F.col("y.type").alias("younger_type"),
        F.col("y.analysis_entity_id").alias("younger_entity"),
    )


def dendro_extremes(
    t: Tables,
    site_ids: SiteIds = None,
    germination_class: int = GERMINATION_CLASS,
    felling_class: int = FELLING_CLASS,
) -> DataFrame:
    """Per site: earliest germination year and latest felling year.

    Germination reads the low bound of its value class and felling the high
    bound of its own; missing and zero years do not count.
    """
    ranges = t["dating_range"].select("analysis_value_id", "low_value", "high_value")
    rows = value_facts(t, site_ids).join(ranges, "analysis_value_id")
    kind = F.col("value_class_id")
    born = F.when(
        (kind == germination_class) & truthy(F.col("low_value")), F.col("low_value")
    )
    felled = F.when((kind == felling_class) & truthy(F.col("high_value")), F.col("high_value"))
    keyed = rows.select(
        "site_id", "dataset_id", "analysis_entity_id", born.alias("born"), felled.alias("felled")
    ).where("born IS NOT NULL OR felled IS NOT NULL")
    pick = F.struct("dataset_id", "analysis_entity_id")
    oldest = F.when(F.col("born").isNotNull(), F.struct("born", "analysis_entity_id"))
    youngest = F.when(
        F.col("felled").isNotNull(), F.struct(-F.col("felled"), "analysis_entity_id")
    )
    found = keyed.groupBy("site_id").agg(
        F.min("born").alias("age_older"),
        F.min_by(pick, oldest).alias("o"),
        F.max("felled").alias("age_younger"),
        F.min_by(pick, youngest).alias("y"),
    )
    dendro = F.lit("dendro")
    return found.select(
        "site_id",
        "age_older",
        F.col("o.dataset_id").alias("older_dataset_id"),
        F.col("o.analysis_entity_id").alias("older_analysis_entity_id"),
        F.when(F.col("age_older").isNotNull(), dendro).alias("older_type"),
        "age_younger",
        F.col("y.dataset_id").alias("younger_dataset_id"),
        F.col("y.analysis_entity_id").alias("younger_analysis_entity_id"),
        F.when(F.col("age_younger").isNotNull(), dendro).alias("younger_type"),
    )


def site_time(
    t: Tables,
    site_ids: SiteIds = None,
    germination_class: int = GERMINATION_CLASS,
    felling_class: int = FELLING_CLASS,
) -> DataFrame:
    """Chronology of every requested site; sites without dendro years keep nulls."""
    found = dendro_extremes(t, site_ids, germination_class, felling_class)
    return ids_of(t["site"], site_ids).select("site_id").join(found, "site_id", "left")


def to_bp(year: Column, reference_year: int) -> Column:
    """Calendar year to years before the 1950 origin shifted by a reference year."""
    return year - F.lit(reference_year - 1950)


def dendro_years_bp(
    t: Tables,
    reference_year: int,
    site_ids: SiteIds = None,
    germination_class: int = GERMINATION_CLASS,
    felling_class: int = FELLING_CLASS,
) -> DataFrame:
    found = dendro_extremes(t, site_ids, germination_class, felling_class)
    return found.select(
        "site_id",
        to_bp(F.col("age_older"), reference_year).alias("older_bp"),
        to_bp(F.col("age_younger"), reference_year).alias("younger_bp"),
    )


def dating_labs(t: Tables, site_ids: SiteIds = None) -> DataFrame:
    """Distinct (site, laboratory) for laboratory ids that start with a number."""
    dated = dating_facts(t).select(
        "sample_group_id", leading_integer(F.col("dating_lab_id")).alias("dating_lab_id")
    )
    groups = ids_of(t["sample_group"], site_ids).select("sample_group_id", "site_id")
    return (
        dated.where(F.col("dating_lab_id").isNotNull())
        .distinct()
        .join(groups, "sample_group_id")
        .select("site_id", "dating_lab_id")
        .distinct()
        .join(t["dating_lab"], "dating_lab_id")
        .select("site_id", "dating_lab_id", "lab_name")
    )
