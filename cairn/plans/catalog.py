"""Every job as a named query over the sample tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.distinct import store_sets, stored_sets
from cairn.functions.nesting import PART, PARTS
from cairn.operators import climate, datagroups, dating, documents, domains, ecocodes, facts
from cairn.operators import search as find
from cairn.operators import lookups, summaries, taxa, textindex, variables
from cairn.sources import collections, sinks
from cairn.sources.binding import bind, word_number
from cairn.sources.shared import shared_folder
from cairn.sources.store import Store
from cairn.sources.tables import Tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Sample-table stand-ins for family methods the tables do not contain.
DATING_METHODS = (1, 7, 12)
CERAMIC_METHODS = (17, 18)
ADNA_METHODS = (19,)
ISOTOPE_METHODS = (4, 9)
GERMINATION_CLASS = word_number("view")
FELLING_CLASS = word_number("purchase")


def query(name: str) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, folder: build(bind(spark, folder))
        return build

    return register


def joined(values: Column | str, separator: str = ",") -> Column:
    """A list as one text, for flat results."""
    column = F.col(values) if isinstance(values, str) else values
    return F.array_join(column.cast("array<string>"), separator)


# --- summaries --------------------------------------------------------------


@query("sum1_dataset_summaries")
def _(t: Tables) -> DataFrame:
    return summaries.dataset_summaries(t)


def _loads(t: Tables, make: Callable[[Tables, DataFrame], DataFrame]) -> DataFrame:
    """Sets of three loads of sites that overlap, stored one after the other and read back."""
    folder = shared_folder(t.spark, "sets")
    for k in range(3):
        store_sets(make(t, t["site"].where(F.col("site_id") % 3 != k).select("site_id")), folder, str(k))
    return stored_sets(t.spark, folder)


@query("sum1_dataset_summaries_of_loads")
def _(t: Tables) -> DataFrame:
    return summaries.dataset_summaries(t, sets=_loads(t, summaries.dataset_site_sets))


@query("sum5_domain_sample_summary_of_loads")
def _(t: Tables) -> DataFrame:
    rows = summaries.domain_sample_summary(t, sets=_loads(t, summaries.method_sample_sets))
    return rows.withColumn("method_pos", F.col("method_pos").cast("bigint"))


@query("sum2_analysis_methods")
def _(t: Tables) -> DataFrame:
    return summaries.analysis_methods(t)


@query("sum3_sample_methods")
def _(t: Tables) -> DataFrame:
    return summaries.sample_methods(t)


@query("sum4_domains_overview")
def _(t: Tables) -> DataFrame:
    return summaries.domains_overview(t)


@query("sum5_domain_sample_summary")
def _(t: Tables) -> DataFrame:
    return summaries.domain_sample_summary(t).withColumn(
        "method_pos", F.col("method_pos").cast("bigint")
    )


@query("sum6_countries")
def _(t: Tables) -> DataFrame:
    return summaries.countries(t)


@query("sum7_feature_types")
def _(t: Tables) -> DataFrame:
    return summaries.feature_types(t)


@query("sum7_feature_types_per_site")
def _(t: Tables) -> DataFrame:
    return summaries.feature_types(t, per_site=True)


@query("sum8_path_summary")
def _(t: Tables) -> DataFrame:
    return summaries.path_summary(t, "datasets", "method_id", "dataset_name")


@query("sum8_path_summary_per_site")
def _(t: Tables) -> DataFrame:
    return summaries.path_summary(
        t, "sample_groups.physical_samples", "sample_type_id", "sample_type_name", per_site=True
    )


@query("sum9_path_count")
def _(t: Tables) -> DataFrame:
    return summaries.path_count(t, "sample_groups.physical_samples.features")


@query("sum10_grouped_by_sample_features")
def _(t: Tables) -> DataFrame:
    return summaries.grouped_by_variable(t, "sampleFeatures")


@query("sum10_grouped_by_sample_methods")
def _(t: Tables) -> DataFrame:
    return summaries.grouped_by_variable(t, "sampleMethods")


@query("sum11_building_types")
def _(t: Tables) -> DataFrame:
    return summaries.building_types(t)


@query("sum12_samples_count")
def _(t: Tables) -> DataFrame:
    return summaries.samples_count(t)


@query("sum13_sample_types")
def _(t: Tables) -> DataFrame:
    return summaries.sample_types(t)


@query("sum14_sites_with_sample_coordinates")
def _(t: Tables) -> DataFrame:
    return summaries.sites_with_sample_coordinates(t)


@query("sum15_dating_overview")
def _(t: Tables) -> DataFrame:
    return summaries.dating_overview(t)


@query("sum16_entity_census")
def _(t: Tables) -> DataFrame:
    return summaries.entity_census(t)


# --- taxa ----------------------------------------------------------------------


@query("tax1_top_taxa")
def top_taxa(t: Tables) -> DataFrame:
    return taxa.top_taxa(t)


@query("tax2_taxon_distribution")
def _(t: Tables) -> DataFrame:
    return taxa.taxon_distribution(t)


@query("tax3_taxon_references")
def _(t: Tables) -> DataFrame:
    return taxa.taxon_references(t)


@query("tax4_taxonomy")
def _(t: Tables) -> DataFrame:
    return taxa.taxonomy(t)


@query("tax5_site_taxa")
def _(t: Tables) -> DataFrame:
    return taxa.site_taxa(t)


@query("tax5_site_taxon_attributes")
def _(t: Tables) -> DataFrame:
    return taxa.site_taxon_attributes(t)


@query("tax6_species_associations")
def _(t: Tables) -> DataFrame:
    return taxa.species_associations(t).select(
        "taxon_id", "association_type", "associated_taxon_id", "species", "genus_name", "order_name"
    )


# --- habitat codes -----------------------------------------------------------------


@query("eco1_taxon_ecocodes")
def _(t: Tables) -> DataFrame:
    return ecocodes.taxon_ecocodes(t)


@query("eco2_site_ecocodes")
def _(t: Tables) -> DataFrame:
    return ecocodes.site_ecocodes(t)


@query("eco2_site_ecocode_bundles")
def _(t: Tables) -> DataFrame:
    return ecocodes.site_ecocode_bundles(t)


@query("eco2_site_ecocode_taxa")
def _(t: Tables) -> DataFrame:
    return ecocodes.site_ecocode_taxa(t)


@query("eco3_site_ecocodes_by_sample")
def _(t: Tables) -> DataFrame:
    return ecocodes.site_ecocodes_by_sample(t)


@query("eco4_dataset_ecocodes")
def _(t: Tables) -> DataFrame:
    return ecocodes.dataset_ecocodes(t)


@query("eco5_dataset_ecocodes_by_sample")
def _(t: Tables) -> DataFrame:
    return ecocodes.dataset_ecocodes_by_sample(t)


@query("eco6_ecocodes_summary")
def _(t: Tables) -> DataFrame:
    return ecocodes.ecocodes_summary(t)


@query("eco6_ecocodes_summary_by_abbreviation")
def _(t: Tables) -> DataFrame:
    return ecocodes.ecocodes_summary(t, by_abbreviation=True)


@query("eco7_site_ecocode_summary")
def _(t: Tables) -> DataFrame:
    return ecocodes.site_ecocode_summary(t)


@query("eco8_ecocode_across_sites")
def _(t: Tables) -> DataFrame:
    return ecocodes.ecocode_across_sites(t, word_number("red"))


@query("eco9_ecocodes_for_sites_abundance")
def _(t: Tables) -> DataFrame:
    return ecocodes.ecocodes_for_sites(t, mode="abundance")


@query("eco9_ecocodes_for_sites_species")
def _(t: Tables) -> DataFrame:
    return ecocodes.ecocodes_for_sites(t, mode="species")


# --- climate ----------------------------------------------------------------------


@query("mcr1_taxon_mcr")
def _(t: Tables) -> DataFrame:
    return climate.taxon_mcr(t).withColumn("matrix", joined("matrix", "|"))


@query("mcr2_site_reconstruction")
def _(t: Tables) -> DataFrame:
    return climate.mcr_reconstruction(t, "site")


@query("mcr2_dataset_reconstruction")
def _(t: Tables) -> DataFrame:
    return climate.mcr_reconstruction(t, "dataset")


@query("mcr2_dataset_reconstruction_summary")
def _(t: Tables) -> DataFrame:
    return climate.mcr_reconstruction_summary(t, "dataset")


@query("mcr3_dataset_density")
def _(t: Tables) -> DataFrame:
    return climate.mcr_density(t, "dataset")


@query("mcr4_aggregate")
def _(t: Tables) -> DataFrame:
    return climate.mcr_aggregate(t)


@query("mcr5_by_site")
def _(t: Tables) -> DataFrame:
    return climate.mcr_by_site(t)


@query("mcr6_taxa_matrices")
def _(t: Tables) -> DataFrame:
    return climate.taxa_matrices(t).withColumn("mcr_row", F.col("mcr_row").cast("bigint"))


# --- dating ------------------------------------------------------------------------


def orders_as_sites(t: Tables) -> Tables:
    """Sample groups stand for sites: the ages of one customer span every bin."""
    group = F.col("sample_group_id").alias("site_id")
    ages = t["entity_age_flat"].drop("site_id").withColumn("site_id", F.col("sample_group_id"))
    return t.with_roles(entity_age_flat=ages, site=t["sample_group"].select(group))


@query("dat1_datings_histogram")
def _(t: Tables) -> DataFrame:
    return dating.datings_histogram(orders_as_sites(t))


@query("dat1_datings_histogram_with_max")
def _(t: Tables) -> DataFrame:
    return dating.datings_histogram(orders_as_sites(t), bins=70, include_max=True)


@query("dat2_site_age_summary")
def _(t: Tables) -> DataFrame:
    return dating.site_age_summary(t)


@query("dat3_dataset_dating_span")
def _(t: Tables) -> DataFrame:
    return dating.dataset_dating_span(t)


@query("dat4_dendro_extremes")
def _(t: Tables) -> DataFrame:
    return dating.dendro_extremes(t, None, GERMINATION_CLASS, FELLING_CLASS)


@query("dat5_site_time")
def _(t: Tables) -> DataFrame:
    return dating.site_time(t, None, GERMINATION_CLASS, FELLING_CLASS)


@query("dat6_dendro_years_bp")
def _(t: Tables) -> DataFrame:
    return dating.dendro_years_bp(t, 2024, None, GERMINATION_CLASS, FELLING_CLASS)


# --- keyed variables ------------------------------------------------------------------


@query("den1_variable_counts")
def _(t: Tables) -> DataFrame:
    return variables.variable_counts(t, "signup")


@query("den2_variable_average_per_site")
def _(t: Tables) -> DataFrame:
    return variables.variable_average_per_site(t, "error")


@query("den3_variable_categories_per_site")
def _(t: Tables) -> DataFrame:
    return variables.variable_categories_per_site(t, "signup")


@query("den4_variable_per_site")
def _(t: Tables) -> DataFrame:
    return variables.variable_per_site(t, "click")


@query("den5_value_class_listing")
def _(t: Tables) -> DataFrame:
    return variables.value_class_listing(t)


# --- search --------------------------------------------------------------------------


@query("srch1_sites")
def _(t: Tables) -> DataFrame:
    return find.search(t, "sites", "customer", page=2)


@query("srch1_sites_contains")
def _(t: Tables) -> DataFrame:
    return find.search(t, "sites", "00000012", limit=50)


@query("srch2_sample_groups")
def _(t: Tables) -> DataFrame:
    return find.search(t, "sample_groups", "medium", limit=50)


@query("srch3_datasets")
def _(t: Tables) -> DataFrame:
    return find.search(t, "datasets", "supplier", limit=50)


@query("srch4_methods")
def _(t: Tables) -> DataFrame:
    return find.search(t, "methods", "NATION_1", limit=50)


@query("srch4_methods_with_sampling")
def _(t: Tables) -> DataFrame:
    return find.search(t, "methods", "urgent", page=3)


@query("srch5_sites_in_domain")
def _(t: Tables) -> DataFrame:
    return find.search(t, "sites", "customer", limit=50, domain="palaeoentomology")


@query("srch5_methods_in_record_type_domain")
def _(t: Tables) -> DataFrame:
    return find.search(t, "methods", "nation", limit=50, domain="adna")


@query("srch1_sites_backslash")
def _(t: Tables) -> DataFrame:
    return find.search(t, "sites", "cust\\omer%1")


@query("srch6_counted_page")
def _(t: Tables) -> DataFrame:
    return find.search(t, "sites", "customer", page=4, limit=7, heap_rows=0)


@query("srch6_counted_page_of_groups")
def _(t: Tables) -> DataFrame:
    return find.search(t, "sample_groups", "medium", page=2, limit=30, heap_rows=0)


@query("srch6_page_past_the_end")
def _(t: Tables) -> DataFrame:
    return find.search(t, "sites", "customer", page=1_000_000_000, limit=1)


@query("srch7_free_text")
def _(t: Tables) -> DataFrame:
    return find.free_text(t, "furniture nation")


@query("srch7_free_text_negated")
def _(t: Tables) -> DataFrame:
    return find.free_text(t, "furniture machinery -asia")


@query("srch7_free_text_phrase")
def _(t: Tables) -> DataFrame:
    return find.free_text(t, '"segment furniture" nation')


@query("srch7_free_text_accents")
def _(t: Tables) -> DataFrame:
    return find.free_text(t, "fürnıtüre ňatioñ")


@query("srch7_free_text_in_lookups")
def _(t: Tables) -> DataFrame:
    return find.free_text(t, "asia brand element f y7 high")


@query("srch7_free_text_whole_documents")
def _(t: Tables) -> DataFrame:
    texts = t["raw_document"].select("site_id", F.lit(5).alias("weight"), "text")
    named = t.with_roles(site=t["raw_document"].select("site_id", "site_name"))
    return find.free_text(named, "thé que nation", texts=texts)


def _stored_collection(t: Tables, paths: list[str], site_ids=None) -> DataFrame:
    """Site documents written as JSON lines and read back without a schema."""
    folder = shared_folder(t.spark, "collection")
    collections.store_collection(documents.site_documents(t, site_ids, paths=paths, slices=SLICES), folder, "site_id")
    return collections.read_collection(t.spark, folder, "site_id")


@query("qry1_collection_equal")
def _(t: Tables) -> DataFrame:
    return find.search_sites(_stored_collection(t, ["datasets"]), "datasets.method_id", "3")


@query("qry1_collection_not")
def _(t: Tables) -> DataFrame:
    return find.search_sites(_stored_collection(t, ["datasets"]), "datasets.method_id", "not:3")


@query("src3_collection_projection")
def _(t: Tables) -> DataFrame:
    """Two fields of the documents of some sites, from JSON lines."""
    folder = shared_folder(t.spark, "collection")
    collections.store_collection(documents.site_documents(t, paths=["location"], slices=1), folder, "site_id")
    fields = {"site_name": "string", "latitude_dd": "double"}
    return collections.read_collection(t.spark, folder, "site_id", ids=range(1, 400, 3), fields=fields)


@query("flt1_many_sites")
def _(t: Tables) -> DataFrame:
    """A list of a million ids: abundances of every third site."""
    rows = facts.abundance_facts(t, range(1, 3_000_000, 3))
    return rows.groupBy("site_id").agg(F.count(F.lit(1)).alias("n"))


@query("srch7_free_text_indexed")
def _(t: Tables) -> DataFrame:
    """From a stored index of all documents; only the buckets of the query's words are read."""
    texts = t["raw_document"].select("site_id", F.lit(5).alias("weight"), "text")
    named = t.with_roles(site=t["raw_document"].select("site_id", "site_name"))
    index = textindex.index_texts(texts, shared_folder(t.spark, "text-index"))
    return find.free_text(named, 'thé in "que la" -"de que" -zanzibar', index=index)


def _documents_as_sites(t: Tables) -> Tables:
    return t.with_roles(site=t["raw_document"].select("site_id", F.col("text").alias("site_name")))


@query("srch1_two_terms")
def _(t: Tables) -> DataFrame:
    return find.search(_documents_as_sites(t), "sites", "the of", limit=50)


@query("srch1_three_terms")
def _(t: Tables) -> DataFrame:
    return find.search(_documents_as_sites(t), "sites", "of the and", limit=50)


@query("srch1_alternatives")
def _(t: Tables) -> DataFrame:
    return find.search(_documents_as_sites(t), "sites", "que la or the of", limit=50)


@query("srch1_sites_indexed")
def _(t: Tables) -> DataFrame:
    index = textindex.index_names(find.searchable_names(t), shared_folder(t.spark, "name-index"))
    return find.search(t, "sites", "00000012", limit=50, index=index)


@query("srch2_sample_groups_indexed")
def _(t: Tables) -> DataFrame:
    index = textindex.index_names(find.searchable_names(t), shared_folder(t.spark, "name-index"))
    return find.search(t, "sample_groups", "medium", limit=50, index=index)


def _search_sites(t: Tables, path: str, value: str) -> DataFrame:
    return find.search_sites(t, path, value)


@query("qry1_search_sites_equal")
def _(t: Tables) -> DataFrame:
    return _search_sites(t, "datasets.method_id", "3")


@query("qry1_search_sites_not")
def _(t: Tables) -> DataFrame:
    return _search_sites(t, "datasets.method_id", "not:3")


@query("qry1_search_sites_greater")
def _(t: Tables) -> DataFrame:
    path = "sample_groups.physical_samples.coordinates.measurement"
    return _search_sites(t, path, "gt:90000")


@query("qry1_search_sites_text")
def _(t: Tables) -> DataFrame:
    return _search_sites(t, "sample_groups.descriptions.group_description", "P")


@query("qry2_search_taxa")
def _(t: Tables) -> DataFrame:
    return find.search_taxa(t, "common_names.common_name", "anvil")


@query("qry2_search_taxa_not")
def _(t: Tables) -> DataFrame:
    return find.search_taxa(t, "measured_attributes.data", "not:12")


# --- data groups ---------------------------------------------------------------------


@query("grp1_abundance_values")
def _(t: Tables) -> DataFrame:
    return datagroups.abundance_values(t).drop("data")


@query("grp1_abundance_details")
def _(t: Tables) -> DataFrame:
    return datagroups.abundance_details(t).select(
        "site_id",
        "method_id",
        "abundance_id",
        "taxon_id",
        "abundance",
        F.coalesce(joined("levels.level_name"), F.lit("")).alias("levels"),
        F.coalesce(joined("modifications.modification_type_name"), F.lit("")).alias(
            "modifications"
        ),
    )


@query("grp2_dating_values")
def _(t: Tables) -> DataFrame:
    return datagroups.dating_values(t, method_ids=DATING_METHODS).drop("data")


@query("grp2_dating_values_of_the_family")
def _(t: Tables) -> DataFrame:
    return datagroups.dating_values(t).drop("data")


@query("grp3_entity_ages_of_the_family")
def _(t: Tables) -> DataFrame:
    return datagroups.entity_age_values(t).drop("data")


@query("grp13_gated_data_groups")
def _(t: Tables) -> DataFrame:
    """Rows of every family at the sites that take part in it, with the default methods."""
    rows = datagroups.data_groups(t, gated=True)
    return rows.groupBy("type", "site_id").agg(F.count(F.lit(1)).alias("n"))


@query("grp3_entity_age_values")
def _(t: Tables) -> DataFrame:
    return datagroups.entity_age_values(t, method_ids=DATING_METHODS).drop("data")


@query("grp4_group_headers")
def _(t: Tables) -> DataFrame:
    rows = datagroups.dating_values(t, method_ids=DATING_METHODS).unionByName(
        datagroups.entity_age_values(t, method_ids=DATING_METHODS)
    )
    return datagroups.group_headers(t, rows)


@query("grp4_group_references")
def _(t: Tables) -> DataFrame:
    rows = datagroups.dating_values(t, method_ids=DATING_METHODS).unionByName(
        datagroups.entity_age_values(t, method_ids=DATING_METHODS)
    )
    return datagroups.group_references(t, rows)


@query("grp5_measured_values")
def _(t: Tables) -> DataFrame:
    return datagroups.measured_values(t)


@query("grp6_isotopes")
def _(t: Tables) -> DataFrame:
    rows = datagroups.isotopes(t, method_ids=ISOTOPE_METHODS)
    return rows.withColumn("data", F.get_json_object("data", "$.measurement_name"))


@query("grp7_ceramics")
def _(t: Tables) -> DataFrame:
    return datagroups.ceramics(t, method_ids=CERAMIC_METHODS).drop("data")


@query("grp8_adna_values")
def _(t: Tables) -> DataFrame:
    return datagroups.adna_values(t, method_ids=ADNA_METHODS).withColumn(
        "data", F.get_json_object("data", "$.low_value")
    )


@query("grp9_dendro_values")
def _(t: Tables) -> DataFrame:
    return datagroups.dendro_values(t).withColumn(
        "data", F.get_json_object("data", "$.high_value")
    )


@query("grp10_value_classes_used")
def _(t: Tables) -> DataFrame:
    return variables.value_classes_used(t)


@query("grp10_value_classes_of_method")
def _(t: Tables) -> DataFrame:
    return variables.value_classes_used(t, None, [10])


@query("grp11_dating_uncertainties")
def _(t: Tables) -> DataFrame:
    return variables.dating_uncertainties(t, (GERMINATION_CLASS, FELLING_CLASS))


@query("grp12_dendro_sites")
def _(t: Tables) -> DataFrame:
    return datagroups.dendro_sites(t)


@query("grp13_family_sites")
def _(t: Tables) -> DataFrame:
    return datagroups.family_sites(t)


@query("grp14_abundance_lookups")
def _(t: Tables) -> DataFrame:
    return datagroups.abundance_lookups(t)


@query("grp15_dating_labs")
def _(t: Tables) -> DataFrame:
    return dating.dating_labs(t)


@query("grp_all_families")
def _(t: Tables) -> DataFrame:
    rows = datagroups.data_groups(
        t,
        families={
            "abundance": {},
            "dating": {"method_ids": DATING_METHODS},
            "measured_values": {},
            "ceramic": {"method_ids": CERAMIC_METHODS},
            "adna": {"method_ids": ADNA_METHODS},
            "dendro": {},
            "isotope": {"method_ids": ISOTOPE_METHODS},
        },
    )
    return rows.groupBy("type", "value_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("site_id").alias("sites"),
        F.count_distinct("data_group_id").alias("groups"),
    )


# --- documents -----------------------------------------------------------------------


# Into how many slices the documents of the queries are cut; results do not depend on it.
SLICES = 4


@query("doc1_site_documents_entities")
def _(t: Tables) -> DataFrame:
    paths = ["datasets.analysis_entities.prep_methods"]
    docs = documents.site_documents(t, paths=paths, slices=SLICES)
    return documents.entity_rows_of(docs).withColumn("prep_methods", joined("prep_methods"))


@query("doc1_site_documents_samples")
def _(t: Tables) -> DataFrame:
    inner = "sample_groups.physical_samples"
    paths = [f"{inner}.features", f"{inner}.coordinates"]
    docs = documents.site_documents(t, paths=paths, slices=SLICES)
    return documents.sample_rows_of(docs).select(
        "site_id",
        "sample_group_id",
        "physical_sample_id",
        "sample_type_name",
        "date_sampled",
        "features",
        "coordinates",
    )


@query("doc1_site_documents_in_parts")
def _(t: Tables) -> DataFrame:
    """Sizes of the whole documents, put together from slices."""
    docs = documents.site_documents(t, slices=7)
    nothing = F.lit(0).cast("bigint")

    def homes(items: Column) -> Column:
        return F.size(F.filter(items, lambda x: x.is_home))

    # Sizes are taken before slices meet, so that no document is moved or sorted for its site's name.
    sizes = docs.select(
        "site_id",
        "site_name",
        F.size("location").alias("locations"),
        homes(F.col("datasets")).alias("datasets"),
        F.aggregate("datasets", nothing, lambda a, d: a + F.size(d.analysis_entities)).alias("entities"),
        F.aggregate("sample_groups", nothing, lambda a, g: a + homes(g.physical_samples)).alias("samples"),
        (F.col(PART) >= F.col(PARTS)).alias("misplaced"),
    ).repartition("site_id")
    return sizes.groupBy("site_id").agg(
        F.max("site_name").alias("site_name"),
        *[F.sum(c).alias(c) for c in ("locations", "datasets", "entities", "samples")],
        F.count_if("misplaced").alias("misplaced"),
    )


@query("doc2_sample_group_children")
def _(t: Tables) -> DataFrame:
    names = ["descriptions", "biblio", "physical_samples"]
    docs = documents.site_documents(t, paths=[f"sample_groups.{n}" for n in names], slices=SLICES)
    keys = ["site_id", "sample_group_id"]
    rows = documents.group_rows_of(docs).select(*keys, "method_id", F.col("physical_samples").alias("samples"))
    description = documents.child_rows_of(docs, "sample_groups.descriptions")
    biblio = documents.child_rows_of(docs, "sample_groups.biblio")
    first_text = description.groupBy(*keys).agg(F.min("group_description").alias("description"))
    first_biblio = biblio.groupBy(*keys).agg(F.min("biblio_id").alias("biblio_id"))
    return rows.join(first_text, keys, "left").join(first_biblio, keys, "left")


@query("doc3_sample_children")
def _(t: Tables) -> DataFrame:
    path = "sample_groups.physical_samples.features"
    docs = documents.site_documents(t, paths=[path], slices=SLICES)
    return documents.child_rows_of(docs, path).select(
        "physical_sample_id", "feature_id", "feature_type_id", "feature_type_name"
    )


def _child_query(name: str, path: str, columns: str) -> None:
    """Register the rows of one document list, with the columns that their lookups give."""

    @query(name)
    def _(t: Tables) -> DataFrame:
        docs = documents.site_documents(t, paths=[path], slices=SLICES)
        return documents.child_rows_of(docs, path).select(*columns.split())


for _field, _columns in (
    ("coordinates", "measurement position_accuracy coordinate_method_id dimension_id unit_id"),
    ("notes", "note"),
    ("sampling_contexts", "sampling_context_id sampling_context"),
):
    _child_query(f"doc2_group_{_field}", f"sample_groups.{_field}", f"site_id sample_group_id {_columns}")
for _field, _columns in (
    ("descriptions", "sample_description_type_id description description_type"),
    ("locations", "sample_location_type_id location location_type"),
    ("alt_refs", "alt_ref_type_id alt_ref alt_ref_type"),
    ("dimensions", "dimension_id method_id dimension_value unit_id"),
    ("horizons", "horizon_id horizon_name method_id"),
):
    _child_query(f"doc3_sample_{_field}", f"sample_groups.physical_samples.{_field}", f"physical_sample_id {_columns}")
_child_query("doc5_dataset_contacts", "datasets.contacts", "site_id dataset_id contact_id contact_name")
_child_query("doc6_other_records", "other_records", "site_id record_type_id record_type_name description")
_child_query("doc1_site_lookup_tables", "lookup_tables", "site_id kind id")
_child_query("doc1_site_entity_ages", "analysis_entity_ages", "site_id analysis_entity_id age age_older age_younger")


@query("doc1_site_age_summary")
def _(t: Tables) -> DataFrame:
    docs = documents.site_documents(t, paths=["age_summary"], slices=SLICES)
    return documents.site_rows_of(docs).select("site_id", "age_older", "age_younger")


@query("doc5_dataset_projects")
def _(t: Tables) -> DataFrame:
    docs = documents.site_documents(t, paths=["datasets"], slices=SLICES)
    return documents.dataset_rows_of(docs).select(
        "site_id", "dataset_id", "method_group_id", "project_name", "project_type_name"
    )


@query("doc4_entity_prep_methods")
def _(t: Tables) -> DataFrame:
    return datagroups.entity_prep_methods(t)


@query("doc5_site_datasets")
def _(t: Tables) -> DataFrame:
    docs = documents.site_documents(t, paths=["datasets.analysis_entities"], slices=SLICES)
    return documents.dataset_rows_of(docs).select(
        "site_id",
        "dataset_id",
        "dataset_name",
        "method_id",
        "project_id",
        F.col("analysis_entities").alias("entities"),
    )


@query("doc6_site_locations_and_references")
def _(t: Tables) -> DataFrame:
    docs = documents.site_documents(t, paths=["location", "biblio"], slices=SLICES)

    def texts(path: str, key: str, field: str, name: str) -> DataFrame:
        rows = documents.child_rows_of(docs, path).groupBy("site_id")
        pairs = F.sort_array(F.collect_list(F.struct(key, field)))
        return rows.agg(joined(pairs[field]).alias(name))

    return (
        documents.site_rows_of(docs)
        .select("site_id", "site_name", "national_site_identifier")
        .join(texts("location", "location_id", "location_name", "locations"), "site_id", "left")
        .join(texts("biblio", "biblio_id", "title", "references"), "site_id", "left")
        .na.fill("", ["locations", "references"])
    )


@query("doc7_site_lookups")
def _(t: Tables) -> DataFrame:
    return documents.site_lookups(t)


@query("doc7_site_lookup_tables")
def _(t: Tables) -> DataFrame:
    """Names of the codes of all kinds that describe themselves; the other kinds are in doc7_site_lookups."""
    kinds = "biblio taxon abundance_element modification_type dating_lab dating_uncertainty value_class isotope_measurement domain".split()
    rows = lookups.site_lookup_tables(t).where(F.col("kind").isin(kinds))
    return rows.select("site_id", "kind", "id", "name", F.col("attributes").isNotNull().alias("described"))


@query("doc8_site_biblio_lookup")
def _(t: Tables) -> DataFrame:
    return documents.site_biblio_lookup(t)


@query("doc9_domains")
def _(t: Tables) -> DataFrame:
    return domains.domains(t).withColumn("method_ids", joined("method_ids"))


@query("doc9_domains_digit_runs")
def _(t: Tables) -> DataFrame:
    return domains.domains(t, digit_runs=True).withColumn("method_ids", joined("method_ids"))


@query("doc10_entities_by_dataset")
def _(t: Tables) -> DataFrame:
    rows = facts.entities(t).select("dataset_id", "analysis_entity_id", "physical_sample_id")
    nested = documents.group_entities_by_dataset(rows, slices=SLICES)
    return nested.groupBy("dataset_id").agg(
        F.sum(F.size("analysis_entities")).alias("entities"),
        F.min(F.array_min("analysis_entities.physical_sample_id")).alias("first_sample"),
        F.max(F.array_max("analysis_entities.physical_sample_id")).alias("last_sample"),
    )


@query("doc11_sample_group_datasets")
def _(t: Tables) -> DataFrame:
    return documents.sample_group_datasets(t)


@query("doc11_document_dataset_links")
def _(t: Tables) -> DataFrame:
    docs = documents.site_documents(t, paths=["sample_groups.dataset_ids"], slices=SLICES)
    keys = ["site_id", "sample_group_id"]
    links = documents.child_rows_of(docs, "sample_groups.dataset_ids").groupBy(*keys)
    lists = links.agg(joined(F.sort_array(F.collect_list("dataset_ids"))).alias("dataset_ids"))
    found = documents.group_rows_of(docs).select(*keys).join(lists, keys, "left")
    return found.na.fill("", ["dataset_ids"])


@query("doc12_taxon_documents")
def _(t: Tables) -> DataFrame:
    docs = documents.taxon_documents(t, slices=SLICES)

    def texts(path: str, field: str) -> DataFrame:
        rows = documents.child_rows_of(docs, path, "taxon_id").groupBy("taxon_id")
        return rows.agg(joined(F.sort_array(F.collect_list(field))).alias(path))

    measured = documents.child_rows_of(docs, "measured_attributes", "taxon_id")
    header = ["species", "genus_name", "family_name", "order_name", "author_name"]
    return (
        docs.groupBy("taxon_id")
        .agg(*[F.max(c).alias(c) for c in header])
        .join(texts("common_names", "common_name"), "taxon_id", "left")
        .join(texts("notes", "taxonomy_notes"), "taxon_id", "left")
        .na.fill("", ["common_names", "notes"])
        .join(measured.groupBy("taxon_id").agg(F.min("data").alias("size")), "taxon_id", "left")
    )


def _taxon_child_query(field: str, columns: str) -> None:
    @query(f"doc12_taxon_{field}")
    def _(t: Tables) -> DataFrame:
        docs = documents.taxon_documents(t, slices=SLICES)
        return documents.child_rows_of(docs, field, "taxon_id").select("taxon_id", *columns.split())


for _field, _columns in (
    ("images", "image_name"),
    ("seasonality", "season_id season_name season_type location_name activity_type"),
    ("distribution", "distribution_text"),
    ("biology", "biology_text"),
    ("rdb", "rdb_code_id category rdb_system location_name location_type"),
    ("specimens", "specimen"),
    ("taxonomic_order", "taxonomic_code taxonomic_order_system_id"),
    ("identification_keys", "key_text"),
    ("associations", "associated_taxon_id association_type"),
):
    _taxon_child_query(_field, _columns)


@query("doc13_ecocode_tree")
def _(t: Tables) -> DataFrame:
    tree = documents.ecocode_tree(t).select("taxon_id", F.explode("ecocodes").alias("s"))
    group = tree.select("taxon_id", "s.ecocode_system_id", F.explode("s.groups").alias("g"))
    return group.select(
        "taxon_id",
        "ecocode_system_id",
        "g.ecocode_group_id",
        "g.group_name",
        joined("g.codes.name").alias("codes"),
    )


@query("doc14_analysis_values")
def _(t: Tables) -> DataFrame:
    return documents.analysis_values(t).select(
        "site_id", "analysis_value_id", "key", "value", "class_name", "value_type_id"
    )


@query("doc15_datasets_extract")
def _(t: Tables) -> DataFrame:
    dendro = facts.of_methods(t, facts.site_datasets(t), [10]).select("site_id", "dataset_id")
    return documents.datasets_extract(t, None, [3, 5, 10], covered=dendro)


@query("doc16_data_groups_extract")
def _(t: Tables) -> DataFrame:
    rows = datagroups.measured_values(t).unionByName(datagroups.abundance_values(t))
    return documents.data_groups_extract(rows, None, [6, 12]).drop("data")


@query("doc17_sample_datasets")
def _(t: Tables) -> DataFrame:
    return documents.sample_datasets(t)


# --- exports ----------------------------------------------------------------------------


@query("src4_site_headers")
def _(t: Tables) -> DataFrame:
    return sinks.site_headers(t)


@query("src5_export_sites")
def _(t: Tables) -> DataFrame:
    rows = datagroups.measured_values(t)
    docs = documents.site_documents(t, paths=["datasets"], data_groups=rows, slices=SLICES)
    cut = sinks.export_sites(docs, [2, 7])
    values = documents.child_rows_of(cut, "data_groups").groupBy("site_id").agg(
        F.count_distinct("type", "data_group_id").alias("data_groups"),
        F.sum(F.size("values")).cast("bigint").alias("values"),
    )
    return (
        documents.site_rows_of(cut)
        .select("site_id", "datasets")
        .join(values, "site_id", "left")
        .na.fill(0, ["data_groups", "values"])
    )


@query("src6_replaced_documents")
def _(t: Tables) -> DataFrame:
    current = sinks.site_headers(t)
    fresh = current.where("latitude_dd < 20").withColumn("site_name", F.upper("site_name"))
    return sinks.replace_documents(current, fresh, "site_id")


def _later_tables(t: Tables) -> Tables:
    """The tables after a while: sites gone and renamed, and a dataset renamed that several sites use."""
    site, group = (t[role].where("site_id % 7 <> 0") for role in ("site", "sample_group"))
    renamed = F.when(F.col("latitude_dd") < 20, F.upper("site_name")).otherwise(F.col("site_name"))
    dataset = t["dataset"].withColumn("dataset_name", F.when(F.col("dataset_id") == 5, F.lit("Renamed")).otherwise(F.col("dataset_name")))
    return t.with_roles(site=site.withColumn("site_name", renamed), sample_group=group, dataset=dataset)


def _earlier_tables(t: Tables) -> Tables:
    return t.with_roles(**{role: t[role].where("site_id % 11 <> 3") for role in ("site", "sample_group")})


@query("src6_changed_sites")
def _(t: Tables) -> DataFrame:
    """What an incremental build would do: all lists of the documents count."""
    stored = documents.site_fingerprints(_earlier_tables(t))
    return documents.changed_sites(stored, documents.site_fingerprints(_later_tables(t))).select("site_id", "state")


@query("src6_refreshed_documents")
def _(t: Tables) -> DataFrame:
    """Documents stored once, brought up to date, and read back."""
    store = Store(shared_folder(t.spark, "documents"), "site_id", buckets=16, spread=2)
    for state in (_earlier_tables(t), _later_tables(t)):
        documents.refresh_documents(state, store, paths=["datasets"], slices=2)
    return documents.site_rows_of(store.read(t.spark, "documents")).select("site_id", "site_name", F.col("datasets").alias("n_datasets"))


@query("src7_domain_clauses")
def _(t: Tables) -> DataFrame:
    return t["domain_clause"]


@query("src2_keyed_lookup")
def _(t: Tables) -> DataFrame:
    return t.lookup("sample_group", "sample_group_name", "2-HIGH").select(
        "sample_group_id", "site_id", "method_id"
    )
