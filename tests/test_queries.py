"""Registered queries against SQL, against their normalised form, and for determinism.

CAIRN_ALL_QUERIES=1 checks every query; otherwise one or two per family run.
"""

import os

import pytest

import __spark_entry__ as entry
from cairn.operators import climate, ecocodes, facts, summaries, taxa
from cairn.plans.catalog import QUERIES
from cairn.plans.oracles import ORACLES
from cairn.sources.binding import bind
from tests.fixtures import rows
from tools.compare import compare, duck

FOLDER = "/root/testdata/sf0.001"
SOME = (
    "sum1_dataset_summaries sum5_domain_sample_summary tax1_top_taxa eco4_dataset_ecocodes "
    "mcr2_dataset_reconstruction_summary dat1_datings_histogram dat3_dataset_dating_span "
    "den3_variable_categories_per_site srch4_methods qry1_search_sites_not grp2_dating_values "
    "grp8_adna_values doc1_site_documents_in_parts doc8_site_biblio_lookup src5_export_sites"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no sample tables here")
NAMES = list(QUERIES) if os.environ.get("CAIRN_ALL_QUERIES") else SOME


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    line = compare(spark, duck(FOLDER), name, FOLDER)
    assert line.startswith("ok "), line


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["taxon_id", "abundance", "family", "genus", "species"]
    assert frame.count() > 0


def test_flat_roles_equal_the_normalised_tables(spark):
    flat = bind(spark, FOLDER)
    normal = flat.without("entity_flat", "abundance_flat")
    for job in (
        lambda t: taxa.top_taxa(t, method_id=8),
        summaries.dataset_summaries,
        lambda t: ecocodes.dataset_ecocodes(t, [1, 2]),
        lambda t: climate.mcr_reconstruction_summary(t, "dataset"),
        facts.site_datasets,
    ):
        assert rows(job(flat)) == rows(job(normal))


def test_partition_count_does_not_change_results(spark):
    names = ("dat3_dataset_dating_span", "srch2_sample_groups", "doc8_site_biblio_lookup")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for parts in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            found.append([rows(entry.queries()[n](spark, FOLDER)) for n in names])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]


def test_keys_of_the_binding_are_unique(spark):
    t = bind(spark, FOLDER)
    for role, key in (
        ("site", "site_id"), ("sample_group", "sample_group_id"), ("analysis_entity", "analysis_entity_id"),
        ("dataset", "dataset_id"), ("taxon", "taxon_id"), ("value_class", "value_class_id"), ("value_class", "name"),
        ("ecocode_definition", "ecocode_definition_id"), ("location", "location_id"), ("value_flat", "analysis_value_id"),
    ):
        assert t[role].count() == t[role].select(key).distinct().count(), (role, key)
    events = t["value_flat"].select("physical_sample_id").distinct()
    assert events.join(t["physical_sample"], "physical_sample_id").count() == 0
    words = {w for r in spark.read.parquet(f"{FOLDER}/part.parquet").collect() for w in r["p_name"].split()}
    assert t["ecocode_definition"].select("name").distinct().count() == len(words)
