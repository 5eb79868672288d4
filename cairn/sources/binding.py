"""Roles bound to the order, event and embedding sample tables.

Customers act as sites, orders as sample groups, (order, line number) pairs as
samples, order lines as analysis entities, suppliers as datasets, nations as
methods, regions as domains, parts as taxa, the words of a part name as
habitat codes, events as keyed values, and embeddings as climate matrices.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.session import configure
from cairn.sources.tables import Tables

AGE_ORIGIN = "2002-01-01"
# Sampling methods are numbered from here, after the analysis methods.
SAMPLING_METHOD_BASE = 100
REGION_LOCATION_BASE = 1000


def _priority() -> Column:
    return F.substring("o_orderpriority", 1, 1).cast("bigint")


def _sample_id() -> Column:
    return F.col("l_orderkey") * 10 + F.col("l_linenumber")


def _entity_id() -> Column:
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents)


def _word_id(word: Column | str) -> Column:
    """A 60-bit number for a whole word."""
    return F.conv(F.substring(F.md5(word), 1, 15), 16, 10).cast("bigint")


def word_number(word: str) -> int:
    """The number :func:`_word_id` gives a word."""
    return int(hashlib.md5(word.encode()).hexdigest()[:15], 16)


def _event_sample_id() -> Column:
    """A sample for each user and day; negative, as the samples of lines are positive."""
    return -(F.col("user_id") * 100_000 + F.unix_date(F.to_date("ts")))


def _days_before_origin(day: str) -> Column:
    return F.datediff(F.lit(AGE_ORIGIN).cast("date"), F.col(day).cast("date")).cast("double")


def bind(spark: SparkSession, folder: str) -> Tables:
    """Roles over the sample tables in ``folder``."""
    configure(spark)

    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{name}.parquet")

    raw = Tables(
        spark,
        {
            name: (lambda n=name: read(n))
            for name in (
                "region nation customer supplier part orders lineitem events embeddings documents"
            ).split()
        },
    )

    # --- places ---------------------------------------------------------

    def site() -> DataFrame:
        return raw["customer"].select(
            F.col("c_custkey").alias("site_id"),
            F.col("c_name").alias("site_name"),
            F.col("c_mktsegment").alias("national_site_identifier"),
            F.concat(F.lit("Segment "), F.lower("c_mktsegment")).alias("site_description"),
            (F.col("c_acctbal") / 100).alias("latitude_dd"),
            F.col("c_nationkey").cast("double").alias("longitude_dd"),
        )

    def location() -> DataFrame:
        country = raw["nation"].select(
            F.col("n_nationkey").cast("bigint").alias("location_id"),
            F.col("n_name").alias("location_name"),
            F.lit(1).cast("bigint").alias("location_type_id"),
            F.lit("Country").alias("location_type"),
        )
        area = raw["region"].select(
            (F.col("r_regionkey") + REGION_LOCATION_BASE).cast("bigint").alias("location_id"),
            F.col("r_name").alias("location_name"),
            F.lit(2).cast("bigint").alias("location_type_id"),
            F.lit("Region").alias("location_type"),
        )
        return country.unionByName(area)

    def site_location() -> DataFrame:
        region_of = raw["nation"].select(
            "n_nationkey", (F.col("n_regionkey") + REGION_LOCATION_BASE).alias("region_id")
        )
        both = F.array(F.col("c_nationkey").cast("bigint"), F.col("region_id").cast("bigint"))
        return (
            raw["customer"]
            .join(region_of, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(F.col("c_custkey").alias("site_id"), F.explode(both).alias("location_id"))
        )

    # --- groups and samples -----------------------------------------------

    def sample_group() -> DataFrame:
        return raw["orders"].select(
            F.col("o_orderkey").alias("sample_group_id"),
            F.col("o_custkey").alias("site_id"),
            (_priority() + SAMPLING_METHOD_BASE).alias("method_id"),
            F.ascii("o_orderstatus").cast("bigint").alias("sampling_context_id"),
            F.col("o_orderpriority").alias("sample_group_name"),
            F.concat(F.lit("Status "), F.col("o_orderstatus")).alias("sample_group_description"),
        )

    def sample_group_description() -> DataFrame:
        return raw["orders"].select(
            F.col("o_orderkey").alias("sample_group_id"),
            (_priority() + 60).alias("type_id"),
            F.col("o_orderpriority").alias("type_name"),
            F.col("o_orderstatus").alias("group_description"),
        )

    def physical_sample() -> DataFrame:
        # Several lines can share a sample; the smallest type and date describe it.
        return (
            raw["lineitem"]
            .groupBy("l_orderkey", "l_linenumber")
            .agg(
                F.char(F.min(F.ascii("l_returnflag"))).alias("flag"),
                F.min("l_shipdate").alias("day"),
            )
            .select(
                _sample_id().alias("physical_sample_id"),
                F.col("l_orderkey").alias("sample_group_id"),
                F.ascii("flag").cast("bigint").alias("sample_type_id"),
                F.col("flag").alias("sample_type_name"),
                F.concat_ws("/", "l_orderkey", "l_linenumber").alias("sample_name"),
                F.date_format("day", "yyyy-MM-dd").alias("date_sampled"),
            )
        )

    def sample_feature() -> DataFrame:
        return raw["lineitem"].select(
            _sample_id().alias("physical_sample_id"),
            F.col("l_orderkey").alias("sample_group_id"),
            F.col("l_suppkey").alias("feature_id"),
            F.ascii("l_linestatus").cast("bigint").alias("feature_type_id"),
            F.col("l_linestatus").alias("feature_type_name"),
        )

    def sample_coordinate() -> DataFrame:
        return (
            raw["lineitem"]
            .where(F.col("l_tax") > 0.04)
            .select(
                _sample_id().alias("physical_sample_id"),
                F.col("l_orderkey").alias("sample_group_id"),
                F.col("l_linenumber").cast("bigint").alias("dimension_id"),
                F.lit(201).cast("bigint").alias("coordinate_method_id"),
                F.col("l_extendedprice").alias("measurement"),
                F.col("l_linestatus").alias("accuracy"),
            )
        )

    def _sample_child(*columns: Column) -> DataFrame:
        return raw["lineitem"].select(
            _sample_id().alias("physical_sample_id"), F.col("l_orderkey").alias("sample_group_id"), *columns
        )

    line = F.col("l_linenumber").cast("bigint")

    def sample_description() -> DataFrame:
        kind = (line % 5).alias("sample_description_type_id")
        return _sample_child(kind, F.concat(F.lit("flag "), "l_returnflag").alias("description"))

    def sample_location() -> DataFrame:
        return _sample_child((line % 5).alias("sample_location_type_id"), F.col("l_linestatus").alias("location"))

    def sample_alt_ref() -> DataFrame:
        ref = F.concat(F.lit("ref "), F.col("l_partkey").cast("string"))
        return _sample_child((line % 5).alias("alt_ref_type_id"), ref.alias("alt_ref"))

    def sample_dimension() -> DataFrame:
        return _sample_child(
            line.alias("dimension_id"), (line + 210).alias("method_id"), F.col("l_quantity").alias("dimension_value")
        )

    def sample_horizon() -> DataFrame:
        return _sample_child((F.col("l_suppkey") % 8).alias("horizon_id"))

    def _region_type(key: str, name: str):
        def role() -> DataFrame:
            return raw["region"].select(F.col("r_regionkey").cast("bigint").alias(key), F.col("r_name").alias(name))

        return role

    def horizon() -> DataFrame:
        return raw["region"].select(
            F.col("r_regionkey").cast("bigint").alias("horizon_id"),
            F.col("r_name").alias("horizon_name"),
            (F.col("r_regionkey") + 220).cast("bigint").alias("method_id"),
        )

    def dimension() -> DataFrame:
        return raw["nation"].select(
            F.col("n_nationkey").cast("bigint").alias("dimension_id"),
            F.col("n_name").alias("dimension_name"),
            (F.col("n_regionkey") + 20).cast("bigint").alias("unit_id"),
        )

    def coordinate_method_dimension() -> DataFrame:
        return raw["nation"].select(
            F.col("n_nationkey").cast("bigint").alias("coordinate_method_dimension_id"),
            (F.col("n_regionkey") + 230).cast("bigint").alias("coordinate_method_id"),
            (F.col("n_nationkey") % 9).cast("bigint").alias("dimension_id"),
        )

    def sample_group_coordinate() -> DataFrame:
        return raw["orders"].select(
            F.col("o_orderkey").alias("sample_group_id"),
            (F.col("o_orderkey") % 30).alias("coordinate_method_dimension_id"),
            F.col("o_totalprice").alias("measurement"),
            F.col("o_orderstatus").alias("position_accuracy"),
        )

    def sample_group_note() -> DataFrame:
        # Groups of one status have notes, the others show groups without any.
        rows = raw["orders"].where(F.col("o_orderstatus") == "F")
        return rows.select(F.col("o_orderkey").alias("sample_group_id"), F.lower("o_orderpriority").alias("note"))

    def sample_group_context() -> DataFrame:
        return raw["orders"].select(
            F.col("o_orderkey").alias("sample_group_id"), (F.col("o_custkey") % 5).alias("sampling_context_id")
        )

    def site_other_record() -> DataFrame:
        return raw["customer"].select(
            F.col("c_custkey").alias("site_id"),
            (F.col("c_custkey") % 6).alias("record_type_id"),
            F.lower("c_mktsegment").alias("description"),
        )

    def project() -> DataFrame:
        return raw["nation"].select(
            F.col("n_nationkey").cast("bigint").alias("project_id"),
            F.col("n_name").alias("project_name"),
            F.col("n_regionkey").cast("bigint").alias("project_type_id"),
        )

    def dataset_contact() -> DataFrame:
        return raw["supplier"].select(
            F.col("s_suppkey").alias("dataset_id"),
            F.explode(F.array(F.col("s_suppkey") % 5, F.col("s_suppkey") % 7)).alias("contact_id"),
        )

    # --- entities, datasets, methods -----------------------------------------

    def entity_flat() -> DataFrame:
        return raw["lineitem"].select(
            _entity_id().alias("analysis_entity_id"),
            _sample_id().alias("physical_sample_id"),
            F.col("l_orderkey").alias("sample_group_id"),
            F.col("l_suppkey").alias("dataset_id"),
        )

    def analysis_entity() -> DataFrame:
        return entity_flat().drop("sample_group_id")

    def prep_method() -> DataFrame:
        codes = F.array(F.col("l_linenumber") + 300, F.ascii("l_returnflag") + 300)
        rows = entity_flat_with(codes.cast("array<bigint>").alias("codes"))
        return rows.select("*", F.explode("codes").alias("method_id")).drop("codes")

    def dataset() -> DataFrame:
        return raw["supplier"].select(
            F.col("s_suppkey").alias("dataset_id"),
            F.col("s_name").alias("dataset_name"),
            F.col("s_nationkey").cast("bigint").alias("method_id"),
            (F.col("s_suppkey") % 200).alias("biblio_id"),
            (F.col("s_suppkey") % 7).alias("project_id"),
        )

    def method() -> DataFrame:
        analysis = raw["nation"].select(
            F.col("n_nationkey").cast("bigint").alias("method_id"),
            F.col("n_name").alias("method_name"),
            F.col("n_regionkey").cast("bigint").alias("method_group_id"),
            F.col("n_regionkey").cast("bigint").alias("record_type_id"),
            (F.col("n_regionkey") + 10).cast("bigint").alias("unit_id"),
        )
        sampling = (
            raw["orders"]
            .select("o_orderpriority")
            .distinct()
            .select(
                (_priority() + SAMPLING_METHOD_BASE).alias("method_id"),
                F.col("o_orderpriority").alias("method_name"),
                F.lit(99).cast("bigint").alias("method_group_id"),
                F.lit(99).cast("bigint").alias("record_type_id"),
                F.lit(99).cast("bigint").alias("unit_id"),
            )
        )
        return analysis.unionByName(sampling)

    def analysis_method() -> DataFrame:
        return raw["nation"].select(
            F.col("n_nationkey").cast("bigint").alias("method_id"),
            F.col("n_name").alias("method_name"),
            F.col("n_regionkey").cast("bigint").alias("method_group_id"),
            F.col("n_regionkey").cast("bigint").alias("record_type_id"),
            (F.col("n_regionkey") + 10).cast("bigint").alias("unit_id"),
        )

    def record_type() -> DataFrame:
        # The region called ASIA stands for the record type that marks DNA work.
        name = F.when(F.col("r_name") == "ASIA", F.lit("DNA")).otherwise(F.col("r_name"))
        return raw["region"].select(
            F.col("r_regionkey").cast("bigint").alias("record_type_id"),
            name.alias("record_type_name"),
        )

    def domain_clause() -> DataFrame:
        # One row per region and at most one id per nation.
        listed = F.concat_ws(
            ", ", F.sort_array(F.collect_list("n_nationkey")).cast("array<string>")
        )
        clauses = raw["nation"].groupBy("n_regionkey").agg(listed.alias("ids"))
        return (
            raw["region"]
            .join(clauses, F.col("r_regionkey") == F.col("n_regionkey"))
            .select(
                F.col("r_regionkey").cast("bigint").alias("facet_id"),
                F.lower("r_name").alias("facet_code"),
                F.col("r_name").alias("display_title"),
                F.concat(F.lit("method_id in ("), "ids", F.lit(")")).alias("clause"),
            )
        )

    # --- references ------------------------------------------------------------

    def _reference(key: Column, biblio_id: Column, rows: DataFrame, *, year: bool, authors: bool):
        missing = F.lit(None).cast("string")
        return rows.select(
            key,
            biblio_id.alias("biblio_id"),
            F.concat(F.lit("Work "), biblio_id.cast("string")).alias("title"),
            (F.concat(F.lit("y"), biblio_id.cast("string")) if year else missing).alias("year"),
            (F.concat(F.lit("a"), biblio_id.cast("string")) if authors else missing).alias(
                "authors"
            ),
        )

    def site_reference() -> DataFrame:
        c = F.col("c_custkey")
        return _reference(c.alias("site_id"), c % 150, raw["customer"], year=False, authors=False)

    def group_reference() -> DataFrame:
        o = F.col("o_orderkey")
        return _reference(
            o.alias("sample_group_id"), o % 170, raw["orders"], year=True, authors=False
        )

    def dataset_reference() -> DataFrame:
        s = F.col("s_suppkey")
        return _reference(s.alias("dataset_id"), s % 200, raw["supplier"], year=True, authors=True)

    # --- taxa -----------------------------------------------------------------

    def taxon() -> DataFrame:
        return raw["part"].select(
            F.col("p_partkey").alias("taxon_id"),
            F.regexp_extract("p_brand", r"(\d+)", 1).cast("bigint").alias("genus_id"),
            (F.col("p_size") % 9).cast("bigint").alias("author_id"),
            F.col("p_name").alias("species"),
        )

    def genus() -> DataFrame:
        number = F.regexp_extract("p_brand", r"(\d+)", 1).cast("bigint")
        return (
            raw["part"]
            .select(number.alias("genus_id"), F.col("p_brand").alias("genus_name"))
            .distinct()
            .withColumn("family_id", F.col("genus_id") % 5)
        )

    def family() -> DataFrame:
        return raw["region"].select(
            F.col("r_regionkey").cast("bigint").alias("family_id"),
            F.concat(F.lit("Family "), F.col("r_name")).alias("family_name"),
            (F.col("r_regionkey") % 2).cast("bigint").alias("order_id"),
        )

    def taxon_order() -> DataFrame:
        return (
            raw["region"]
            .where(F.col("r_regionkey") < 2)
            .select(
                F.col("r_regionkey").cast("bigint").alias("order_id"),
                F.concat(F.lit("Order "), F.col("r_name")).alias("order_name"),
                F.lit(1).cast("bigint").alias("record_type_id"),
            )
        )

    def taxon_author() -> DataFrame:
        return (
            raw["part"]
            .select((F.col("p_size") % 9).cast("bigint").alias("author_id"))
            .distinct()
            .select("author_id", F.concat(F.lit("Author "), "author_id").alias("author_name"))
            .where("author_id <> 0")
        )

    def taxon_note() -> DataFrame:
        return (
            raw["part"]
            .where(F.col("p_size") > 25)
            .select(
                F.col("p_partkey").alias("taxon_id"),
                F.lower("p_type").alias("taxonomy_notes"),
            )
        )

    def taxon_common_name() -> DataFrame:
        return raw["part"].select(
            F.col("p_partkey").alias("taxon_id"),
            F.explode(F.split("p_name", " ")).alias("common_name"),
            (F.col("p_size") % 3).cast("bigint").alias("language_id"),
        )

    def taxon_measured() -> DataFrame:
        return raw["part"].select(
            F.col("p_partkey").alias("taxon_id"),
            F.lit("size").alias("attribute_type"),
            F.col("p_size").cast("double").alias("data"),
        )

    def _taxon_child(*columns: Column) -> DataFrame:
        return raw["part"].select(F.col("p_partkey").alias("taxon_id"), *columns)

    size = F.col("p_size").cast("bigint")

    def taxon_image() -> DataFrame:
        return _taxon_child(F.concat(F.lit("img-"), F.col("p_partkey").cast("string")).alias("image_name"))

    def taxon_seasonality() -> DataFrame:
        return _taxon_child(
            (size % 7).alias("season_id"), (size % 25).alias("location_id"), F.lower("p_brand").alias("activity_type")
        )

    def season() -> DataFrame:
        return raw["region"].select(
            F.col("r_regionkey").cast("bigint").alias("season_id"),
            F.lower("r_name").alias("season_name"),
            (F.col("r_regionkey") % 2).cast("bigint").alias("season_type_id"),
        )

    def taxon_distribution_note() -> DataFrame:
        return _taxon_child(F.concat(F.lit("found in "), F.lower("p_type")).alias("distribution_text"))

    def taxon_biology() -> DataFrame:
        return _taxon_child(F.concat(F.lit("lives on "), F.lower("p_brand")).alias("biology_text"))

    def taxon_red_list() -> DataFrame:
        return _taxon_child((size % 30).alias("rdb_code_id"), (size % 25).alias("location_id"))

    def rdb_code() -> DataFrame:
        return raw["nation"].select(
            F.col("n_nationkey").cast("bigint").alias("rdb_code_id"),
            F.col("n_name").alias("category"),
            F.col("n_regionkey").cast("bigint").alias("rdb_system_id"),
        )

    def taxon_specimen() -> DataFrame:
        return _taxon_child(F.concat(F.lit("specimen "), size.cast("string")).alias("specimen"))

    def taxon_order_code() -> DataFrame:
        return _taxon_child((size * 10).alias("taxonomic_code"), (size % 5).alias("taxonomic_order_system_id"))

    def taxon_identification_key() -> DataFrame:
        return _taxon_child(F.upper("p_brand").alias("key_text"))

    # --- habitat codes ----------------------------------------------------------

    def ecocode() -> DataFrame:
        words = raw["part"].select(
            F.col("p_partkey").alias("taxon_id"), F.explode(F.split("p_name", " ")).alias("word")
        )
        return words.select(
            "taxon_id", _word_id(F.col("word")).alias("ecocode_definition_id")
        ).distinct()

    def ecocode_definition() -> DataFrame:
        words = raw["part"].select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
        return words.select(
            _word_id(F.col("word")).alias("ecocode_definition_id"),
            (F.length("word") % 3).cast("bigint").alias("ecocode_group_id"),
            F.upper(F.substring("word", 1, 2)).alias("abbreviation"),
            F.col("word").alias("name"),
        )

    def ecocode_group() -> DataFrame:
        return (
            raw["region"]
            .where(F.col("r_regionkey") < 3)
            .select(
                F.col("r_regionkey").cast("bigint").alias("ecocode_group_id"),
                F.when(F.col("r_regionkey") < 2, 2).otherwise(3).cast("bigint").alias(
                    "ecocode_system_id"
                ),
                F.col("r_name").alias("group_name"),
            )
        )

    def abundance_flat() -> DataFrame:
        return raw["lineitem"].select(
            _entity_id().alias("abundance_id"),
            _entity_id().alias("analysis_entity_id"),
            _sample_id().alias("physical_sample_id"),
            F.col("l_orderkey").alias("sample_group_id"),
            F.col("l_suppkey").alias("dataset_id"),
            F.col("l_partkey").alias("taxon_id"),
            F.col("l_quantity").cast("bigint").alias("abundance"),
            F.ascii("l_returnflag").cast("bigint").alias("abundance_element_id"),
        )

    def abundance() -> DataFrame:
        return abundance_flat().drop("physical_sample_id", "sample_group_id", "dataset_id")

    def abundance_element() -> DataFrame:
        return (
            raw["lineitem"]
            .select("l_returnflag")
            .distinct()
            .select(
                F.ascii("l_returnflag").cast("bigint").alias("abundance_element_id"),
                F.concat(F.lit("Element "), "l_returnflag").alias("element_name"),
            )
        )

    def identification_level() -> DataFrame:
        return (
            raw["lineitem"]
            .where(F.col("l_linestatus") == "F")
            .select(
                _entity_id().alias("abundance_id"),
                F.col("l_linenumber").cast("bigint").alias("level_id"),
                F.concat(F.lit("level "), F.col("l_linenumber").cast("string")).alias(
                    "level_name"
                ),
            )
        )

    def modification() -> DataFrame:
        return (
            raw["lineitem"]
            .where(F.col("l_returnflag") == "R")
            .select(
                _entity_id().alias("abundance_id"),
                F.ascii("l_linestatus").cast("bigint").alias("modification_type_id"),
                F.col("l_linestatus").alias("modification_type_name"),
            )
        )

    # --- ages and datings ----------------------------------------------------------

    def entity_age_flat() -> DataFrame:
        ordered = raw["orders"].select(
            "o_orderkey",
            F.col("o_custkey").alias("site_id"),
            _days_before_origin("o_orderdate").alias("order_age"),
        )
        point = F.col("l_linenumber") == 1
        return (
            raw["lineitem"]
            .join(ordered, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(
                "site_id",
                F.col("l_orderkey").alias("sample_group_id"),
                _sample_id().alias("physical_sample_id"),
                F.col("l_suppkey").alias("dataset_id"),
                _entity_id().alias("analysis_entity_id"),
                F.when(point, F.col("order_age")).alias("age"),
                F.when(~point, F.col("order_age")).alias("age_older"),
                F.when(~point, _days_before_origin("l_shipdate")).alias("age_younger"),
                F.when(point, F.col("l_returnflag")).alias("dating_specifier"),
                F.col("l_linenumber").cast("bigint").alias("chronology_id"),
            )
        )

    def dating_flat() -> DataFrame:
        quantity = F.col("l_quantity")
        flag = F.col("l_returnflag")
        cents = F.round(F.col("l_extendedprice") * 100)
        return raw["lineitem"].select(
            _entity_id().alias("analysis_entity_id"),
            _sample_id().alias("physical_sample_id"),
            F.col("l_orderkey").alias("sample_group_id"),
            F.col("l_suppkey").alias("dataset_id"),
            (flag == "N").alias("is_laboratory"),
            F.when(flag == "A", quantity * 100 + 0.5).alias("c14_age_older"),
            F.when(flag == "A", quantity * 90).alias("c14_age_younger"),
            F.when(flag == "R", quantity * 110).alias("cal_age_older"),
            F.when(flag == "R", quantity * 80 + 0.25).alias("cal_age_younger"),
            F.when(flag == "N", cents / 100 / 10).alias("age"),
            F.when(flag == "N", quantity).alias("error_older"),
            F.when(flag == "N", F.col("l_linenumber").cast("double") - 1).alias("error_younger"),
            F.when(
                flag == "N",
                F.concat(F.col("l_linenumber").cast("string"), F.lit("-lab")),
            ).alias("dating_lab_id"),
        )

    def dating_lab() -> DataFrame:
        return raw["nation"].select(
            F.col("n_nationkey").cast("bigint").alias("dating_lab_id"),
            F.concat(F.lit("Lab "), F.col("n_name")).alias("lab_name"),
        )

    # --- keyed values -----------------------------------------------------------------

    def _event_number() -> Column:
        return F.get_json_object("props", "$.k").cast("bigint")

    def _event_text() -> Column:
        k = _event_number()
        kind = F.col("event_type")
        return (
            F.when(kind == "signup", F.concat(F.lit("kind "), (k % 7).cast("string")))
            .when(
                (kind == "error") & (F.col("event_id") % 3 == 0),
                F.concat(k.cast("string"), F.lit(" approx")),
            )
            .when((kind == "click") & (F.col("user_id") % 5 == 0), F.lit("none"))
            .otherwise(F.round(F.col("value") * 100).cast("bigint").cast("string"))
        )

    def value_flat() -> DataFrame:
        return raw["events"].select(
            F.col("event_id").alias("analysis_value_id"),
            F.col("event_id").alias("analysis_entity_id"),
            _event_sample_id().alias("physical_sample_id"),
            F.concat_ws("/", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias(
                "sample_name"
            ),
            F.col("user_id").alias("site_id"),
            (F.col("event_id") % 50).alias("dataset_id"),
            _word_id("event_type").alias("value_class_id"),
            F.col("event_type").alias("key"),
            _event_text().alias("value"),
        )

    def value_class() -> DataFrame:
        kinds = raw["events"].select("event_type").distinct()
        return kinds.select(
            _word_id("event_type").alias("value_class_id"),
            F.col("event_type").alias("name"),
            (F.length("event_type") % 2).cast("bigint").alias("value_type_id"),
            (10 + 9 * (F.length("event_type") % 2)).cast("bigint").alias("method_id"),
        )

    def dating_range() -> DataFrame:
        low = 1000 + _event_number() * 5
        dated = F.col("event_type").isin("view", "purchase", "click")
        return (
            raw["events"]
            .where(dated)
            .select(
                F.col("event_id").alias("analysis_value_id"),
                F.when(F.col("event_id") % 11 != 0, low).alias("low_value"),
                F.when(
                    F.col("event_type") != "click", low + F.floor("value").cast("bigint")
                ).alias("high_value"),
                (F.col("event_id") % 2 == 0).alias("low_is_uncertain"),
                F.lit(1).cast("bigint").alias("age_type_id"),
                (F.col("event_id") % 4).alias("dating_uncertainty_id"),
            )
        )

    def measured_value_flat() -> DataFrame:
        line = F.col("l_linenumber")
        amount = F.col("l_quantity").cast("bigint").cast("string")
        text = (
            F.when(line == 7, F.concat(amount, F.lit(" mm")))
            .when(line == 6, F.concat(F.lit("<"), amount))
            .otherwise(amount)
        )
        return entity_flat_with(text.alias("measured_value"))

    def entity_flat_with(*extra: Column) -> DataFrame:
        return raw["lineitem"].select(
            _entity_id().alias("analysis_entity_id"),
            _sample_id().alias("physical_sample_id"),
            F.col("l_orderkey").alias("sample_group_id"),
            F.col("l_suppkey").alias("dataset_id"),
            *extra,
        )

    def ceramic_flat() -> DataFrame:
        return entity_flat_with(
            _entity_id().alias("ceramics_id"),
            F.col("l_linenumber").cast("bigint").alias("ceramics_lookup_id"),
            F.col("l_returnflag").alias("measurement_value"),
        )

    def ceramic_lookup() -> DataFrame:
        return raw["nation"].select(
            F.col("n_nationkey").cast("bigint").alias("ceramics_lookup_id"),
            F.concat(F.lit("Attribute "), F.col("n_nationkey").cast("string")).alias("name"),
            F.col("n_name").alias("description"),
            (17 + F.col("n_nationkey") % 2).cast("bigint").alias("method_id"),
        )

    def isotope_flat() -> DataFrame:
        line = F.col("l_linenumber").cast("bigint")
        return entity_flat_with(
            _entity_id().alias("isotope_id"),
            line.alias("isotope_measurement_id"),
            F.col("l_quantity").cast("bigint").cast("string").alias("measurement_value"),
            (line % 3).alias("unit_id"),
        )

    def isotope_measurement() -> DataFrame:
        return raw["nation"].select(
            F.col("n_nationkey").cast("bigint").alias("isotope_measurement_id"),
            F.col("n_name").alias("measurement_name"),
        )

    def unit() -> DataFrame:
        return raw["region"].select(
            F.col("r_regionkey").cast("bigint").alias("unit_id"),
            F.lower("r_name").alias("unit_name"),
        )

    def dating_uncertainty() -> DataFrame:
        return raw["region"].select(
            F.col("r_regionkey").cast("bigint").alias("dating_uncertainty_id"),
            F.col("r_name").alias("description"),
        )

    def species_association() -> DataFrame:
        return raw["part"].select(
            F.col("p_partkey").alias("taxon_id"),
            F.col("p_size").cast("bigint").alias("associated_taxon_id"),
            (F.col("p_size") % 7).cast("bigint").alias("association_type_id"),
        )

    def association_type() -> DataFrame:
        return raw["region"].select(
            F.col("r_regionkey").cast("bigint").alias("association_type_id"),
            F.col("r_name").alias("association_type"),
        )

    # --- climate matrices -----------------------------------------------------------

    def mcr_matrix() -> DataFrame:
        # A matrix has 60 columns by definition: dimensions 61 to 64 are no part of it.
        # Cell (row, column) holds 1 where dimension `column` times 50 exceeds row - 18.
        rows = raw["embeddings"].select(
            F.col("vec_id").alias("taxon_id"),
            F.slice("embedding", 1, 60).alias("v"),
            F.explode(F.sequence(F.lit(1), F.lit(36))).alias("mcr_row"),
        )
        cells = F.transform(
            "v",
            lambda x: F.when(x.cast("double") * 50 > F.col("mcr_row") - 18, "1").otherwise("0"),
        )
        return rows.select("taxon_id", "mcr_row", F.array_join(cells, "").alias("mcr_data"))

    def _scaled(position: int) -> Column:
        return F.floor(F.col("embedding")[position].cast("double") * 100).cast("bigint")

    def mcr_summary() -> DataFrame:
        names = "tmax_hi tmax_lo tmin_hi tmin_lo trange_hi trange_lo".split()
        some = F.col("vec_id") % 4 != 0
        return raw["embeddings"].select(
            F.col("vec_id").alias("taxon_id"),
            *[_scaled(i).alias(name) for i, name in enumerate(names)],
            F.when(some, _scaled(6)).alias("cog_mid_tmax"),
            F.when(some, _scaled(7)).alias("cog_mid_trange"),
        )

    def mcr_name() -> DataFrame:
        return raw["embeddings"].select(
            F.col("vec_id").alias("taxon_id"),
            F.concat(F.lit("Species "), F.col("vec_id").cast("string")).alias("mcr_species_name"),
            F.col("label").cast("bigint").alias("mcr_number"),
            F.lit(None).cast("string").alias("comparison_notes"),
        )

    def raw_document() -> DataFrame:
        return raw["documents"].select(
            F.col("doc_id").alias("site_id"),
            F.concat_ws(" ", "source", "lang").alias("site_name"),
            "text",
        )

    providers = {
        f.__name__: f
        for f in (
            site, location, site_location, sample_group, sample_group_description,
            physical_sample, sample_feature, sample_coordinate, entity_flat, analysis_entity,
            prep_method, dataset, method, analysis_method, record_type, domain_clause,
            site_reference, group_reference, dataset_reference,
            taxon, genus, family, taxon_order, taxon_author, taxon_note, taxon_common_name,
            taxon_measured, ecocode, ecocode_definition, ecocode_group,
            abundance_flat, abundance, abundance_element, identification_level, modification,
            entity_age_flat, dating_flat, dating_lab, value_flat, value_class, dating_range,
            measured_value_flat, ceramic_flat, ceramic_lookup,
            isotope_flat, isotope_measurement, unit, dating_uncertainty,
            species_association, association_type,
            mcr_matrix, mcr_summary, mcr_name, raw_document,
        )
    }
    providers |= {
        f.__name__: f
        for f in (
            sample_description, sample_location, sample_alt_ref, sample_dimension, sample_horizon, horizon,
            dimension, coordinate_method_dimension, sample_group_coordinate, sample_group_note,
            sample_group_context, site_other_record, project, dataset_contact,
            taxon_image, taxon_seasonality, season, taxon_distribution_note, taxon_biology, taxon_red_list,
            rdb_code, taxon_specimen, taxon_order_code, taxon_identification_key,
        )
    }
    # Short tables of types: the regions under other names.
    for role, key, name in (
        ("sample_description_type", "sample_description_type_id", "description_type"),
        ("sample_location_type", "sample_location_type_id", "location_type"),
        ("alt_ref_type", "alt_ref_type_id", "alt_ref_type"),
        ("sampling_context", "sampling_context_id", "sampling_context"),
        ("project_type", "project_type_id", "project_type_name"),
        ("contact", "contact_id", "contact_name"),
        ("language", "language_id", "language_name"),
        ("season_type", "season_type_id", "season_type"),
        ("rdb_system", "rdb_system_id", "rdb_system"),
        ("location_type", "location_type_id", "location_type"),
    ):
        providers[role] = _region_type(key, name)
    return Tables(spark, providers)
