"""Data groups: the long form of every measurement family.

All families give the same columns, so they can be united:

    site_id, type, data_group_id, dataset_id, physical_sample_id,
    analysis_entity_id, method_id, key, value_string, value_double,
    value_type, data

``data`` is the JSON text of a complex value. Sample names are left out of the
rows and looked up by :func:`with_sample_names` where a caller wants them, as
that lookup is a join on the largest key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.semantics import SiteIds, leading_number, truthy, truthy_text
from cairn.operators.facts import (
    LABORATORY_DATING_METHODS,
    abundance_facts,
    age_facts,
    dating_facts,
    leaf,
    methods,
    of_methods,
    sample_rows,
    site_datasets,
    sites_using,
    value_facts,
    with_site,
)
from cairn.sources.tables import Tables

# The methods and method groups that make up each family.
ABUNDANCE_METHODS = (3, 6, 8, 15, 40, 111)
DATING_METHODS = (
    14, 38, 39, 127, 128, 129, 130, 131, 132, 133, 134, 135, 136, 137, 138, 139, 140, 141, 142,
    143, 144, 146, 147, 148, 149, 151, 152, 153, 154, 155, 156, 157, 158, 159, 160, 161, 162, 163,
    164, 165, 167, 168, 169, 170, 174, 176,
)
DATING_METHOD_GROUPS = (19, 20, 3)
MEASURED_METHOD_GROUPS = (2,)
CERAMIC_METHODS = (171, 172)
ADNA_METHODS = (175,)
DENDRO_METHODS = (10,)
VALUE_METHOD_FALLBACK = 10

COLUMNS = (
    "site_id", "type", "data_group_id", "dataset_id", "physical_sample_id",
    "analysis_entity_id", "method_id", "key", "value_string", "value_double",
    "value_type", "data",
)


def _rows(
    df: DataFrame,
    kind: str,
    *,
    group: Column,
    key: Column,
    text: Column | None = None,
    number: Column | None = None,
    value_type: Column | str = "simple",
    data: Column | None = None,
) -> DataFrame:
    null_text, null_number = F.lit(None).cast("string"), F.lit(None).cast("double")
    value_type = F.lit(value_type) if isinstance(value_type, str) else value_type
    return df.select(
        "site_id",
        F.lit(kind).alias("type"),
        group.cast("string").alias("data_group_id"),
        F.col("dataset_id").cast("bigint").alias("dataset_id"),
        F.col("physical_sample_id").cast("bigint").alias("physical_sample_id"),
        F.col("analysis_entity_id").cast("string").alias("analysis_entity_id"),
        F.col("method_id").cast("bigint").alias("method_id"),
        key.cast("string").alias("key"),
        (null_text if text is None else text.cast("string")).alias("value_string"),
        (null_number if number is None else number.cast("double")).alias("value_double"),
        value_type.alias("value_type"),
        (null_text if data is None else data).alias("data"),
    )


def with_sample_names(t: Tables, rows: DataFrame) -> DataFrame:
    names = t["physical_sample"].select("physical_sample_id", "sample_name")
    return rows.join(names, "physical_sample_id", "left")


def abundance_details(
    t: Tables, site_ids: SiteIds = None, method_ids: Sequence[int] = ABUNDANCE_METHODS
) -> DataFrame:
    """Abundances with their identification levels and modifications.

    Both lists hold distinct entries, folded on the map side, so their length is
    bounded by the short tables of levels and modification types.
    """
    levels = t["identification_level"].groupBy("abundance_id").agg(
        F.sort_array(F.collect_set(F.struct("level_id", "level_name"))).alias("levels")
    )
    changes = t["modification"].groupBy("abundance_id").agg(
        F.sort_array(
            F.collect_set(F.struct("modification_type_id", "modification_type_name"))
        ).alias("modifications")
    )
    return (
        abundance_facts(t, site_ids, method_ids)
        .join(levels, "abundance_id", "left")
        .join(changes, "abundance_id", "left")
    )


def abundance_values(
    t: Tables, site_ids: SiteIds = None, method_ids: Sequence[int] = ABUNDANCE_METHODS
) -> DataFrame:
    """One row per abundance, keyed by the sample."""
    rows = abundance_details(t, site_ids, method_ids)
    fields = ["taxon_id", "abundance", "abundance_element_id", "levels", "modifications"]
    data = F.to_json(F.struct(*[f for f in fields if f in rows.columns]))
    return _rows(
        rows,
        "abundance",
        group=F.col("dataset_id"),
        key=F.col("physical_sample_id"),
        number=F.col("abundance"),
        value_type="complex",
        data=data,
    )


def _fields(rows: DataFrame, names: Sequence[str]) -> Column:
    """The named columns as (key, text, number) entries, in order."""
    kinds = dict(rows.dtypes)
    null_text, null_number = F.lit(None).cast("string"), F.lit(None).cast("double")
    entries = []
    for name in names:
        if name in kinds:
            is_text = kinds[name] == "string"
            entries.append(
                F.struct(
                    F.lit(name).alias("key"),
                    (F.col(name) if is_text else null_text).alias("text"),
                    (null_number if is_text else F.col(name).cast("double")).alias("number"),
                )
            )
    return F.array(*entries)


# The fields of the two kinds of dating, in output order.
LABORATORY_FIELDS = (
    "geochron_id", "dating_lab_id", "lab_number", "age", "error_older", "error_younger",
    "delta_13c", "notes", "dating_uncertainty_id", "dating_uncertainty",
    "dating_uncertainty_desc",
)
RELATIVE_FIELDS = (
    "relative_date_id", "relative_age_id", "relative_age_name", "c14_age_older",
    "c14_age_younger", "cal_age_older", "cal_age_younger", "age_type", "age_location_name",
)


def dating_values(
    t: Tables,
    site_ids: SiteIds = None,
    method_ids: Sequence[int] | None = DATING_METHODS,
    laboratory_methods: Sequence[int] = LABORATORY_DATING_METHODS,
) -> DataFrame:
    """One row per (entity, dating field); each kind of dating has its own fields.

    ``method_ids`` are the methods of the family, of which ``laboratory_methods``
    are read from laboratory measurements and the others from relative dates.
    """
    dated = of_methods(t, dating_facts(t, laboratory_methods), method_ids)
    rows = with_site(t, dated, site_ids)
    fields = F.when(F.col("is_laboratory"), _fields(rows, LABORATORY_FIELDS)).otherwise(
        _fields(rows, RELATIVE_FIELDS)
    )
    return _rows(
        rows.select("*", F.inline(fields)),
        "dating",
        group=F.col("dataset_id"),
        key=F.col("key"),
        text=F.col("text"),
        number=F.col("number"),
        value_type="complex",
    )


# The fields of an entity age, in output order.
AGE_FIELDS = (
    "age",
    "age_older",
    "age_younger",
    "age_range",
    "chronology_id",
    "dating_specifier",
)


def entity_age_values(
    t: Tables, site_ids: SiteIds = None, method_ids: Sequence[int] | None = DATING_METHODS
) -> DataFrame:
    """One row per present, non-zero, non-empty age field of the dating family; of all datasets without methods."""
    ages = of_methods(t, age_facts(t, site_ids), method_ids)
    rows = ages.select("*", F.inline(_fields(ages, AGE_FIELDS))).where(
        truthy(F.col("number")) | truthy_text(F.col("text"))
    )
    return _rows(
        rows,
        "dating",
        group=F.col("dataset_id"),
        key=F.col("key"),
        text=F.col("text"),
        number=F.col("number"),
    )


def group_headers(t: Tables, rows: DataFrame) -> DataFrame:
    """Per group: entity and sample where all rows share one, and its references.

    Distinct counts and extremes only; no list of rows is gathered.
    """
    entity, sample = F.col("analysis_entity_id"), F.col("physical_sample_id")

    def shared(column: Column) -> Column:
        return F.when(F.min(column) == F.max(column), F.max(column))

    heads = rows.groupBy("site_id", "type", "data_group_id").agg(
        shared(entity).alias("analysis_entity_id"),
        shared(sample).alias("physical_sample_id"),
        F.count(F.lit(1)).alias("n"),
    )
    references = (
        group_references(t, rows)
        .groupBy("site_id", "type", "data_group_id")
        .agg(F.count(F.lit(1)).alias("biblio_count"), F.min("biblio_id").alias("first_biblio_id"))
    )
    return heads.join(references, ["site_id", "type", "data_group_id"], "left").fillna(
        0, ["biblio_count"]
    )


def group_references(t: Tables, rows: DataFrame) -> DataFrame:
    """Distinct (site, type, group, reference) over the datasets of each group."""
    keys = ["site_id", "type", "data_group_id"]
    return (
        rows.select(*keys, "dataset_id")
        .distinct()
        .join(t["dataset"].select("dataset_id", "biblio_id"), "dataset_id")
        .where(truthy(F.col("biblio_id")))
        .select(*keys, "biblio_id")
        .distinct()
    )


def measured_values(
    t: Tables,
    site_ids: SiteIds = None,
    method_group_ids: Sequence[int] = MEASURED_METHOD_GROUPS,
) -> DataFrame:
    """Leading number where there is one, else the text; raw text in ``data``."""
    wanted = methods(t).where(F.col("method_group_id").isin(list(method_group_ids)))
    datasets = t["dataset"].select("dataset_id", "method_id")
    datasets = datasets.join(wanted.select("method_id"), "method_id", "left_semi")
    rows = leaf(t, "measured_value").drop("method_id").join(datasets, "dataset_id")
    rows = with_site(t, rows, site_ids)
    raw = F.col("measured_value")
    number = leading_number(raw)
    return _rows(
        rows,
        "measured_values",
        group=F.col("dataset_id"),
        key=F.col("physical_sample_id"),
        text=F.when(number.isNull(), raw),
        number=number,
        data=raw,
    )


def entity_prep_methods(t: Tables) -> DataFrame:
    """Distinct (entity, preparation method)."""
    return t["prep_method"].select("analysis_entity_id", "method_id").distinct()


def isotopes(
    t: Tables, site_ids: SiteIds = None, method_ids: Sequence[int] = ()
) -> DataFrame:
    """Isotope measurements of the given methods, with their lookups.

    No method is listed by default, so nothing is returned until some are given.
    """
    rows = of_methods(t, leaf(t, "isotope"), method_ids)
    rows = with_site(t, rows, site_ids)
    for role, key in (
        ("isotope_measurement", "isotope_measurement_id"),
        ("isotope_standard", "isotope_standard_id"),
        ("isotope_type", "isotope_type_id"),
        ("isotope_value_specifier", "isotope_value_specifier_id"),
        ("unit", "unit_id"),
    ):
        if role in t and key in rows.columns:
            rows = rows.join(t[role], key, "left")
    hidden = {"site_id", "sample_group_id", "dataset_id", "method_id", "analysis_entity_id"}
    data = F.to_json(F.struct(*sorted(c for c in rows.columns if c not in hidden)))
    return _rows(
        rows,
        "isotope",
        group=F.col("dataset_id"),
        key=F.col("physical_sample_id"),
        text=F.col("measurement_value"),
        value_type="complex",
        data=data,
    )


def ceramics(
    t: Tables, site_ids: SiteIds = None, method_ids: Sequence[int] = CERAMIC_METHODS
) -> DataFrame:
    """Ceramic attributes, one group per sample of every site that has ceramics.

    A sample without attributes keeps one row with a null key and no method;
    the others carry the method of their attribute.
    """
    inside = sites_using(t, method_ids)
    lookup = t["ceramic_lookup"].select("ceramics_lookup_id", F.col("name").alias("key"), "method_id")
    values = (
        leaf(t, "ceramic")
        .select(
            "physical_sample_id",
            "dataset_id",
            "analysis_entity_id",
            "ceramics_lookup_id",
            "measurement_value",
        )
        .join(lookup, "ceramics_lookup_id")
    )
    every = (
        sample_rows(t, "physical_sample", site_ids)
        .select("site_id", "physical_sample_id")
        .join(inside, "site_id", "left_semi")
    )
    return _rows(
        every.join(values, "physical_sample_id", "left"),
        "ceramic",
        group=F.col("physical_sample_id"),
        key=F.col("key"),
        text=F.col("measurement_value"),
    )


# The fields of a dating range that travel with a value.
RANGE_FIELDS = (
    "low_value",
    "high_value",
    "low_is_uncertain",
    "high_is_uncertain",
    "low_qualifier",
    "age_type_id",
    "season_id",
    "dating_uncertainty_id",
    "is_variant",
)


def _ranged_values(t: Tables, site_ids: SiteIds, kind: str, gate: Sequence[int] | None) -> DataFrame:
    values = value_facts(t, site_ids)
    if gate is not None:
        values = values.join(sites_using(t, gate), "site_id", "left_semi")
    rows = values.join(t["dating_range"], "analysis_value_id", "left")
    fields = [f for f in RANGE_FIELDS if f in rows.columns]
    dated = truthy(F.col("low_value")) | truthy(F.col("high_value"))
    method = F.col("method_id") if "method_id" in rows.columns else F.lit(None)
    rows = rows.withColumn(
        "method_id", F.coalesce(method.cast("bigint"), F.lit(VALUE_METHOD_FALLBACK))
    )
    return _rows(
        rows,
        kind,
        group=F.col("physical_sample_id"),
        key=F.col("key"),
        text=F.col("value"),
        value_type=F.when(dated, "complex").otherwise("simple"),
        data=F.when(dated, F.to_json(F.struct(*fields))),
    )


def adna_values(
    t: Tables, site_ids: SiteIds = None, method_ids: Sequence[int] = ADNA_METHODS
) -> DataFrame:
    """Keyed values per sample; complex where a dating range has a bound."""
    return _ranged_values(t, site_ids, "adna", method_ids)


def dendro_values(
    t: Tables, site_ids: SiteIds = None, method_ids: Sequence[int] = DENDRO_METHODS
) -> DataFrame:
    """Keyed tree-ring values per sample; complex where a dating range has a bound."""
    return _ranged_values(t, site_ids, "dendro", method_ids)


def dendro_sites(t: Tables) -> DataFrame:
    """Measurement and date rows of all sites in one table."""
    measures = value_facts(t).select(
        "site_id", "physical_sample_id", "value_class_id", "key",
        F.col("value").alias("value_string"), F.lit("measurement").alias("kind"),
        F.lit(None).cast("bigint").alias("low_value"),
        F.lit(None).cast("bigint").alias("high_value"),
    )
    ranges = t["dating_range"].select("analysis_value_id", "low_value", "high_value")
    dates = (
        value_facts(t)
        .join(ranges, "analysis_value_id")
        .select(
            "site_id", "physical_sample_id", "value_class_id", "key",
            F.col("value").alias("value_string"), F.lit("date").alias("kind"),
            F.col("low_value").cast("bigint").alias("low_value"),
            F.col("high_value").cast("bigint").alias("high_value"),
        )
        .distinct()
    )
    return measures.unionByName(dates)


def dated_values(
    t: Tables,
    site_ids: SiteIds = None,
    method_ids: Sequence[int] | None = DATING_METHODS,
    laboratory_methods: Sequence[int] = LABORATORY_DATING_METHODS,
) -> DataFrame:
    """All values of the dating family: dates and entity ages."""
    dates = dating_values(t, site_ids, method_ids, laboratory_methods)
    return dates.unionByName(entity_age_values(t, site_ids, method_ids))


# --- families ------------------------------------------------------------------------


@dataclass(frozen=True)
class Family:
    """A measurement family: how its rows are made, and which sites take part in it.

    ``rows(t, site_ids, **options)`` gives the columns of the module docstring
    for the sites (all when None). A site takes part if one of its datasets has one of
    the methods or a method of one of the groups.
    """

    name: str
    rows: Callable[..., DataFrame]
    methods: tuple[int, ...] = ()
    method_groups: tuple[int, ...] = ()


_FAMILIES: dict[str, Family] = {}
_KINDS = dict.fromkeys(COLUMNS, "string") | dict.fromkeys(("site_id", "dataset_id", "physical_sample_id", "method_id"), "bigint") | {"value_double": "double"}


def register_family(family: Family) -> Family:
    """Add a family; gates and united groups know it from then on."""
    if not family.name or family.name in _FAMILIES:
        raise ValueError(f"the family {family.name!r} has no name or is there already")
    if not callable(family.rows):
        raise TypeError(f"the rows of the family {family.name!r} cannot be made")
    for ids in (family.methods, family.method_groups):
        if not all(isinstance(i, int) for i in ids):
            raise TypeError(f"the methods and groups of the family {family.name!r} are whole numbers")
    _FAMILIES[family.name] = family
    return family


def remove_family(name: str) -> None:
    del _FAMILIES[name]


def family(name: str) -> Family:
    if name not in _FAMILIES:
        raise ValueError(f"unknown family {name!r}")
    return _FAMILIES[name]


def family_names() -> list[str]:
    return list(_FAMILIES)


def family_rows(t: Tables, name: str, site_ids: SiteIds = None, **options: object) -> DataFrame:
    """The rows of a family, their columns checked."""
    rows = family(name).rows(t, site_ids, **options)
    kinds = dict(rows.dtypes)
    wrong = [c for c, kind in _KINDS.items() if kinds.get(c) != kind]
    if wrong:
        raise TypeError(f"the family {name!r} lacks {', '.join(f'{c} {_KINDS[c]}' for c in wrong)}")
    return rows.select(*COLUMNS)


for _family in (
    Family("abundance", abundance_values, ABUNDANCE_METHODS),
    Family("dating", dated_values, DATING_METHODS, DATING_METHOD_GROUPS),
    Family("measured_values", measured_values, (), MEASURED_METHOD_GROUPS),
    Family("ceramic", ceramics, CERAMIC_METHODS),
    Family("adna", adna_values, ADNA_METHODS),
    Family("dendro", dendro_values, DENDRO_METHODS),
    Family("isotope", isotopes),
):
    register_family(_family)


def family_sites(t: Tables) -> DataFrame:
    """Distinct (family, site): which families a site takes part in."""
    rules = F.array(
        *[
            F.when(
                F.col("method_id").isin(list(each.methods)) | F.col("method_group_id").isin(list(each.method_groups)),
                F.lit(each.name),
            )
            for each in _FAMILIES.values()
        ]
    )
    method_families = (
        methods(t)
        .select("method_id", F.explode(rules).alias("family"))
        .where("family IS NOT NULL")
    )
    used = of_methods(t, site_datasets(t)).select("site_id", "method_id").distinct()
    return used.join(method_families, "method_id").select("family", "site_id").distinct()


def gate(t: Tables, name: str) -> DataFrame:
    """Distinct sites that take part in a family."""
    return sites_using(t, family(name).methods, family(name).method_groups)


def abundance_lookups(t: Tables, site_ids: SiteIds = None) -> DataFrame:
    """Abundance elements and modification types each site uses."""
    facts = abundance_facts(t, site_ids)
    elements = (
        facts.select("site_id", F.col("abundance_element_id").alias("id"))
        .distinct()
        .join(
            t["abundance_element"].select(
                F.col("abundance_element_id").alias("id"), F.col("element_name").alias("name")
            ),
            "id",
        )
    )
    changes = (
        facts.select("site_id", "abundance_id")
        .join(t["modification"], "abundance_id")
        .select(
            "site_id",
            F.col("modification_type_id").alias("id"),
            F.col("modification_type_name").alias("name"),
        )
        .distinct()
    )
    columns = ["site_id", "kind", "id", "name"]
    return (
        elements.withColumn("kind", F.lit("abundance_element"))
        .select(*columns)
        .unionByName(changes.withColumn("kind", F.lit("modification_type")).select(*columns))
    )


def data_groups(
    t: Tables,
    site_ids: SiteIds = None,
    method_ids: Sequence[int] | None = None,
    *,
    families: dict[str, dict] | None = None,
    gated: bool = False,
) -> DataFrame:
    """All families united, limited to the chosen methods.

    ``families`` maps a family to keyword arguments for its rows, such as a method
    list of its own; without it every registered family takes part. ``gated`` leaves
    out the rows of sites that do not take part in a family.
    """
    united = None
    for name, options in (families or {n: {} for n in _FAMILIES}).items():
        rows = family_rows(t, name, site_ids, **options)
        if gated:
            rows = rows.join(gate(t, name), "site_id", "left_semi").select(*COLUMNS)
        if method_ids is not None:
            rows = rows.where(F.col("method_id").isin(list(method_ids)))
        united = rows if united is None else united.unionByName(rows)
    return united
