"""Summaries, taxa, habitat codes, dating and variables on the hand-made tables."""

from math import floor

import pytest
from pyspark.sql import functions as F

from cairn.operators import dating, ecocodes, facts, summaries, taxa, variables
from cairn.operators.documents import site_documents
from tests.fixtures import by, rows


def test_dataset_summaries(roles):
    got = by(summaries.dataset_summaries(roles), "method_id")
    assert got[3] == {
        "method_id": 3, "method_name": "Insect count", "site_count": 3, "dataset_count": 3,
    }
    assert got[999]["dataset_count"] == 1
    assert rows(summaries.dataset_summaries(roles, [])) == []
    assert by(summaries.dataset_summaries(roles, [2]), "method_id")[3]["site_count"] == 1


def test_methods_and_domains(roles):
    assert by(summaries.analysis_methods(roles), "method_id")[8]["dataset_count"] == 1
    assert rows(summaries.sample_methods(roles).select("method_id", "sample_group_count")) == [
        (201, 3), (202, 2),
    ]
    # Method 60 is in both domains and 999 in none.
    got = rows(summaries.domains_overview(roles).select("domain_id", "dataset_count"))
    assert got == [(1, 5), (2, 1)]


def test_domain_sample_summary_adds_methods(roles):
    got = rows(
        summaries.domain_sample_summary(roles).select(
            "domain_id", "method_pos", "method_id", "sample_count", "domain_sample_count"
        )
    )
    # Sample 100 has methods 3 and 8 of one domain and counts twice.
    assert got == [(1, 0, 8, 1, 7), (1, 1, 3, 5, 7), (1, 2, 60, 1, 7), (2, 0, 60, 1, 1)]
    empty = rows(summaries.domain_sample_summary(roles, [3]).select("domain_id", "sample_count"))
    assert empty == [(1, 0), (1, 0), (1, 0), (2, 0)]


def test_countries(roles):
    got = [tuple(r) for r in summaries.countries(roles).collect()]
    assert got == [(1, "Norway", 2), (2, "Sweden", 1)]


def test_feature_types(roles):
    assert rows(summaries.feature_types(roles)) == [(7, "pit", 3), (8, "well", 1)]
    per_site = rows(summaries.feature_types(roles, per_site=True))
    assert per_site == [(1, 7, "pit", 1), (1, 8, "well", 1), (2, 7, "pit", 2)]
    assert rows(summaries.grouped_by_variable(roles, "sampleFeatures")) == [
        (7, "pit", 3), (8, "well", 1),
    ]
    with pytest.raises(ValueError, match="unknown variable"):
        summaries.grouped_by_variable(roles, "nothing")


@pytest.mark.parametrize("slices", [40, 3, 1])
def test_paths_count_the_same_for_any_part_size(spark, roles, tmp_path, slices):
    path = str(tmp_path / "documents")
    site_documents(roles, slices=slices).write.parquet(path)
    docs = spark.read.parquet(path)
    count = lambda path, ids=None: summaries.path_count(docs, path, ids).first()[0]
    assert count("sample_groups") == 5
    assert count("sample_groups.physical_samples") == 6
    assert count("sample_groups.physical_samples.features") == 4
    assert count("datasets") == 10
    assert count("datasets.analysis_entities") == 13
    assert count("sample_groups", []) == 0
    got = rows(summaries.path_summary(docs, "datasets", "method_id", "dataset_name", per_site=True))
    assert (1, 3, "Insects", 1) in got
    assert len(got) == 10


def test_small_summaries(roles):
    assert rows(summaries.building_types(roles)) == [("barn", 1), ("house", 2)]
    assert rows(summaries.building_types(roles, [2])) == [("barn", 1)]
    assert summaries.samples_count(roles).first()[0] == 6
    assert summaries.samples_count(roles, []).first()[0] == 0
    assert [tuple(r) for r in summaries.sample_types(roles).collect()] == [
        (1, "bulk", 4), (2, "core", 2),
    ]
    assert rows(summaries.sites_with_sample_coordinates(roles)) == [(1, 100), (2, 103)]
    assert rows(summaries.sites_with_sample_coordinates(roles, distinct=True)) == [(1,), (2,)]


def test_census_keeps_zero_rows(roles):
    got = by(summaries.entity_census(roles, [1, 9]), "table_name", "entity_id")
    assert got["abundance", 1]["n"] == 2
    assert got["prep_method", 1]["n"] == 3
    assert got["abundance", 9]["n"] == 0
    assert len(got) == 2 * len(summaries.CENSUS_ROLES)


def test_top_taxa_breaks_ties_by_id(roles):
    got = [tuple(r) for r in taxa.top_taxa(roles).collect()]
    assert got[:3] == [
        (22, 101, "Carabidae", "Bonus", "clara"),
        (20, 9, "Carabidae", "Ater", "aterrima"),
        (21, 9, "Carabidae", "Ater", "bruna"),
    ]
    assert got[-1][:2] == (23, 0)  # a null count adds nothing
    assert [r.taxon_id for r in taxa.top_taxa(roles, k=2).collect()] == [22, 20]
    assert [tuple(r)[:2] for r in taxa.top_taxa(roles, method_id=8).collect()] == [(20, 1000)]
    assert taxa.top_taxa(roles, []).count() == 0
    assert [r.taxon_id for r in taxa.top_taxa(roles, [2]).collect()] == [22, 24]


def test_taxon_jobs(roles):
    got = by(taxa.taxon_distribution(roles, [20, 22]), "taxon_id", "site_id")
    assert got[22, 4]["abundance"] == 1
    assert got[20, 1] == {
        "taxon_id": 20, "site_id": 1, "site_name": "Alpha", "lon": 15.0, "lat": 60.0, "abundance": 9,
    }
    references = by(taxa.taxon_references(roles), "taxon_id")
    assert references[20]["taxonomy_notes"] == "note a"
    assert references[21]["taxonomy_notes"] is None  # no author, no notes
    site_taxa = by(taxa.site_taxa(roles, language_ids=[1]), "site_id", "taxon_id")
    assert site_taxa[1, 20]["common_names"] == 1
    assert site_taxa[2, 22]["measured_attributes"] == 2
    assert taxa.species_associations(roles).select("taxon_id", "species").collect() == [(20, "clara")]


def test_site_ecocodes(roles):
    got = by(ecocodes.site_ecocodes(roles), "site_id", "definition_id")
    # Taxon 20 has 9 in site 1 (method 3 only), taxon 21 has 9; code 33 is of another system.
    assert got[1, 30] == {"site_id": 1, "definition_id": 30, "taxa_count": 2, "abundance": 18}
    assert got[1, 31]["abundance"] == 9
    assert got[1, 32] == {"site_id": 1, "definition_id": 32, "taxa_count": 1, "abundance": 0}
    assert set(got) == {(1, 30), (1, 31), (1, 32), (2, 31), (4, 31)}


def test_samples_without_codes_stay(roles):
    got = rows(ecocodes.site_ecocodes_by_sample(roles).where("definition_id IS NULL"))
    assert [r[1] for r in got] == [104]


def test_dataset_ecocodes_use_every_method(roles):
    got = by(ecocodes.dataset_ecocodes(roles), "dataset_id", "definition_id")
    assert got[1001, 30]["abundance"] == 1000
    by_sample = by(
        ecocodes.dataset_ecocodes_by_sample(roles, [1000]), "physical_sample_id", "definition_id"
    )
    assert by_sample[101, 30]["abundance"] == 5


def test_ecocode_summaries(roles):
    got = by(ecocodes.ecocodes_summary(roles), "definition_id")
    assert {k: v["abundance"] for k, v in got.items()} == {30: 18, 31: 110, 32: 0}
    merged = by(ecocodes.ecocodes_summary(roles, by_abbreviation=True), "abbreviation")
    assert merged["W"]["abundance"] == 128
    assert merged["W"]["definition_id"] == 30
    one = [r.definition_id for r in ecocodes.site_ecocode_summary(roles, [1]).collect()]
    assert one == [30, 31, 32]
    across = [tuple(r) for r in ecocodes.ecocode_across_sites(roles, 31).collect()]
    assert across == [(2, 31, 100, 1), (1, 31, 9, 1), (4, 31, 1, 1)]
    best = by(ecocodes.ecocodes_for_sites(roles, k=2), "definition_id")
    assert best[31] == {"definition_id": 31, "species": 2, "abundance": 110}
    species = by(ecocodes.ecocodes_for_sites(roles, mode="species"), "definition_id")
    assert species[30] == {"definition_id": 30, "species": 2, "abundance": 0}
    assert ecocodes.ecocodes_for_sites(roles, mode="other").count() == 0


def brute_histogram(ages, bins, include_max):
    ranges = []
    for site, age, older, younger in ages:
        a, b = (age, age) if age is not None else (younger, older)
        if a is not None and b is not None:
            ranges.append((site, min(a, b), max(a, b)))
    low, high = min(r[1] for r in ranges), max(r[2] for r in ranges)
    width = (high - low) / bins if high > low else 1.0
    hit = [set() for _ in range(bins)]
    for site, a, b in ranges:
        first, last = max(0, floor((a - low) / width)), min(bins - 1, floor((b - low) / width))
        if include_max:
            first = min(first, bins - 1)
        for i in range(first, last + 1):
            hit[i].add(site)
    return [len(h) for h in hit], len({r[0] for r in ranges})


SITE_AGES = [
    (1, 100.0, None, None),
    (1, None, 300.0, 200.0),
    (1, None, 150.0, 250.0),
    (2, None, None, None),
    (2, None, 0.0, 50.9),
    (4, 500.0, None, None),
]


@pytest.mark.parametrize("include_max", [False, True])
@pytest.mark.parametrize("bins", [20, 7, 130])
def test_histogram_against_loops(roles, bins, include_max):
    want, dated = brute_histogram(SITE_AGES, bins, include_max)
    got = dating.datings_histogram(roles, bins=bins, include_max=include_max).collect()
    assert [r.site_count for r in got] == want
    assert {(r.total_sites, r.sites_with_datings) for r in got} == {(5, dated)}
    if bins == 20:  # the point at the maximum falls in no bin unless asked for
        assert got[-1].site_count == (1 if include_max else 0)


def test_histogram_edges(roles):
    assert dating.datings_histogram(roles, [3]).count() == 0
    one = dating.datings_histogram(roles, [4]).collect()  # a single age: width 1
    assert [r.site_count for r in one] == [1] + [0] * 19
    assert (one[0].bin_start, one[0].bin_end) == (500.0, 501.0)


def test_site_age_summary(roles):
    got = by(dating.site_age_summary(roles), "site_id")
    assert got[1] == {"site_id": 1, "older": 300, "younger": 200}
    assert got[2] == {"site_id": 2, "older": None, "younger": 50}  # zero is absent
    assert by(summaries.dating_overview(roles), "site_id")[1]["age_older"] == 300


def test_dating_span(roles):
    got = by(dating.dataset_dating_span(roles), "dataset_id")
    # Smallest relative date of entity 7; entity 5 has a zero bound and gives nothing.
    assert got[1003] == {
        "dataset_id": 1003, "older": 3000, "older_type": "c14", "older_entity": 7,
        "younger": 2500, "younger_type": "c14", "younger_entity": 7,
    }
    assert (got[1002]["older"], got[1002]["younger"]) == (1970, 2040)
    assert set(got) == {1002, 1003}


def test_dating_span_ties(spark, roles):
    fields = (
        "analysis_entity_id long, physical_sample_id long, sample_group_id long, dataset_id long, "
        "is_laboratory boolean, c14_age_older double, c14_age_younger double, cal_age_older double, "
        "cal_age_younger double, age double, error_older double, error_younger double"
    )
    flat = spark.createDataFrame(
        [
            (2, 1, 1, 1, False, 50.0, 10.0, 50.0, 10.0, None, None, None),
            (1, 1, 1, 1, False, None, None, 50.0, 10.0, 60.0, 0.0, 5.0),
        ],
        fields,
    )
    got = dating.dataset_dating_span(roles.with_roles(dating_flat=flat)).first()
    assert (got.older, got.older_type, got.older_entity) == (50, "cal", 1)


def test_dendro_chronology(roles):
    got = by(dating.dendro_extremes(roles), "site_id")
    assert got[1]["age_older"] == 1100
    assert got[1]["older_analysis_entity_id"] == 3
    assert got[1]["age_younger"] == 1300
    assert got[1]["younger_type"] == "dendro"
    time = by(dating.site_time(roles, [1, 3]), "site_id")
    assert time[3]["age_older"] is None
    assert by(dating.dendro_years_bp(roles, 2024), "site_id")[1]["older_bp"] == 1026
    assert rows(dating.dating_labs(roles)) == [(2, 77, "Uppsala")]


def test_variables(roles):
    counts = dict(rows(variables.variable_counts(roles, "Key")))
    assert counts == {"12abc": 1, "": 1, None: 1, "Infinity": 1, "NaN": 1, "8": 1, "12": 1, "oak": 2, "pine": 1}
    averages = by(variables.variable_average_per_site(roles, "Key"), "site_id")
    assert averages[2] == {"site_id": 2, "average": 10.0, "n": 2, "min": 8.0, "max": 12.0}
    assert averages[4] == {"site_id": 4, "average": None, "n": 0, "min": None, "max": None}
    shares = by(variables.variable_categories_per_site(roles, "Key"), "site_id", "value")
    assert shares[4, "oak"]["percentage"] == 66.67
    assert shares[4, "oak"]["unique_values"] == 2
    assert shares[1, "null"]["n"] == 1
    mixed = by(variables.variable_per_site(roles, "Key"), "site_id", "value")
    assert mixed[2, None] == {
        "site_id": 2, "kind": "numeric", "average": 10.0, "value": None, "n": 2, "total": 4,
    }
    assert mixed[4, "oak"]["kind"] == "category"
    assert variables.variable_counts(roles, "Key", []).count() == 0


def test_value_lookups(roles):
    assert variables.value_class_listing(roles).count() == 4
    used = rows(variables.value_classes_used(roles).select("value_class_id"))
    assert used == [(134,), (137,), (500,)]
    assert rows(variables.dating_uncertainties(roles)) == [(1, "ca"), (2, "after")]


def test_keyed_lookup(roles):
    assert roles.lookup("sample_group", "site_id", 2).count() == 2
    with pytest.raises(ValueError, match="no column"):
        roles.lookup("site", "nope", 1)
    with pytest.raises(KeyError):
        roles["nope"]


def test_facts_keep_parents_out_when_unlinked(roles):
    assert facts.site_datasets(roles).count() == 10
    assert facts.entity_facts(roles).select(F.count_distinct("analysis_entity_id")).first()[0] == 13
