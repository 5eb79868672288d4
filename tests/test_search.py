"""Name search, free text and document path search."""

import pytest
from pyspark.sql import functions as F

from cairn.operators import search as find
from cairn.operators.documents import site_documents, taxon_documents
from tests.fixtures import rows


def hits(df):
    return [r.asDict() for r in df.collect() if r.site_id is not None]


def test_site_scores_and_flags(roles):
    got = hits(find.search(roles, "sites", "alpha"))
    assert [(h["site_name"], h["score"]) for h in got] == [
        ("Alpha", 11.0), ("Alpha farm", 5.0), ("Farm north alpha", 2.0),
    ]
    assert [h["is_exact"] for h in got] == [True, False, False]
    assert [h["is_prefix"] for h in got] == [False, True, False]
    assert [h["is_contains"] for h in got] == [False, False, True]
    both = hits(find.search(roles, "sites", "alpha farm"))
    assert [(h["site_id"], h["is_fts_only"]) for h in both] == [(4, False), (5, True)]


def test_wildcards_in_the_query_act_as_wildcards(roles):
    assert [h["site_id"] for h in hits(find.search(roles, "sites", "al%rm"))] == [4]
    assert [h["site_id"] for h in hits(find.search(roles, "sites", "b_ta"))] == [2]


def test_pages(roles):
    second = find.search(roles, "sites", "alpha", page=2, limit=2).collect()
    assert [(r.total_count, r.total_pages, r.has_more, r.site_id) for r in second] == [
        (3, 2, False, 5)
    ]
    for page in (9, 10_000_000):
        past = find.search(roles, "sites", "alpha", page=page).collect()
        assert [(r.total_count, r.site_id, r.has_more) for r in past] == [(3, None, False)]
    none = find.search(roles, "sites", "zzz").collect()
    assert [(r.total_count, r.total_pages) for r in none] == [(0, 0)]


def test_best_group_per_site(roles):
    got = hits(find.search(roles, "sample_groups", "core"))
    assert [h["site_id"] for h in got] == [1, 2, 4]
    assert [h["sample_group_id"] for h in got] == [10, 12, 14]
    # "Score" contains the word and the description holds it as a token.
    assert got[2]["is_contains"] and not got[2]["is_prefix"]
    assert got[0]["matched_value"] == "Core north core"


def test_dataset_and_method_names(roles):
    got = hits(find.search(roles, "datasets", "insects"))
    assert [(h["site_id"], h["dataset_id"], h["is_exact"]) for h in got] == [
        (1, 1000, True), (4, 1000, True), (2, 1000, True),
    ]
    methods = hits(find.search(roles, "methods", "count"))
    # Sampling methods take part: site 2 has method 202 as well as 3.
    assert [(h["site_id"], h["method_id"]) for h in methods] == [(1, 202), (2, 202), (4, 3)]


def test_domains(roles):
    assert [h["site_id"] for h in hits(find.search(roles, "sites", "alpha", domain="adna"))] == [4]
    limited = hits(find.search(roles, "methods", "count", domain="archaeobotany"))
    assert [(h["site_id"], h["method_id"]) for h in limited] == [(1, 8)]
    assert len(hits(find.search(roles, "sites", "alpha", domain=" General "))) == 3
    for bad in ({"domain": "nothing"}, {"category": "nothing"}, {"query": "a"}):
        arguments = {"category": "sites", "query": "alpha", **bad}
        with pytest.raises(ValueError):
            find.search(roles, **arguments)


def test_free_text_weighs_fields_and_ignores_accents(roles):
    got = [(r.site_id, r.score) for r in find.free_text(roles, "álpha").collect()]
    # Name 10; site 4 adds its description with 5.
    assert got == [(4, 15), (1, 10), (5, 10)]
    assert find.free_text(roles, "alpha", k=1).count() == 1
    assert find.free_text(roles, "-alpha").count() == 0


@pytest.mark.parametrize(
    ("value", "test"),
    [
        ("5", ("eq", 5)), ("not:5", ("ne", 5)), ("gt:5", ("gt", 5)), ("lt:-5", ("lt", -5)),
        ("12.5", ("eq", 12)), (".5", ("eq", 0.5)), ("oak", ("eq", "oak")),
        ("not:gt:3", ("gt", 3)), ("12abc", ("eq", 12)),
    ],
)
def test_path_values(value, test):
    assert find.path_test(value) == test


@pytest.mark.parametrize("slices", [20, 1])
def test_path_search(spark, roles, tmp_path, slices):
    path = str(tmp_path / "documents")
    site_documents(roles, slices=slices).write.parquet(path)
    docs = spark.read.parquet(path)

    def ids(p, v):
        found = [r[0] for r in rows(find.search_sites(docs, p, v))]
        assert found == [r[0] for r in rows(find.search_sites(roles, p, v))]  # the flat tables agree
        return found

    assert ids("datasets.method_id", "8") == [1]
    assert ids("datasets.method_id", "not:8") == [2, 3, 4, 5]  # missing paths count as other
    assert ids("sample_groups.physical_samples.features.feature_type_id", "gt:7") == [1]
    assert ids("sample_groups.physical_samples.coordinates.measurement", "lt:2") == [1]
    assert ids("site_name", "Beta") == [2]
    assert ids("site_name", "5") == []  # a number never equals a text
    assert ids("nothing.here", "5") == []
    assert ids("nothing.here", "not:5") == [1, 2, 3, 4, 5]


def test_taxon_path_search(roles):
    docs = taxon_documents(roles, slices=2)

    def ids(p, v):
        found = [r[0] for r in rows(find.search_taxa(docs, p, v))]
        assert found == [r[0] for r in rows(find.search_taxa(roles, p, v))]
        return found

    assert ids("measured_attributes.data", "12.5") == [22]  # read as 12
    assert ids("measured_attributes.data", "gt:12") == [20]
    assert ids("genus_name", "Ater") == [20, 21]


def test_counted_pages_equal_sorted_ones(roles):
    for page in (1, 2, 3, 9):
        for limit in (1, 2, 3):
            sorted_, counted = (
                rows(find.search(roles, "sites", "a%", page, limit, heap_rows=n)) for n in (10_000, 0)
            )
            assert sorted_ == counted
    assert find.search(roles, "sites", "a%", 1, 80, max_limit=80).count() >= 1


def test_negated_and_quoted_free_text(spark, roles):
    texts = spark.createDataFrame(
        [(1, 2, "old barn"), (1, 3, "wet barn"), (2, 1, "barn old"), (3, 1, "dry old-barn old")], "site_id long, weight int, text string"
    )
    found = lambda q: [(r.site_id, r.score) for r in find.free_text(roles, q, texts=texts).collect()]
    assert found("barn") == [(1, 5), (2, 1), (3, 1)]
    assert found("barn -wet") == [(2, 1), (3, 1)]
    assert found('"old barn"') == [(1, 7), (3, 3)]
    assert found('dry "barn old" -"old barn"') == [(2, 2)]
    assert found("-barn") == []


def test_free_text_asks_lookups_before_they_meet_their_sites(roles, monkeypatch):
    whole = find.site_texts(roles)
    words = [r[0] for r in whole.select(F.explode(F.split("text", "[^A-Za-z0-9]+"))).where("col <> ''").distinct().orderBy(F.expr("crc32(cast(col AS binary))")).limit(3).collect()]
    for query in [*words, "nothing", f"{words[0]} -{words[1]}"]:
        found = rows(find.free_text(roles, query))
        assert found == rows(find.free_text(roles, query, texts=whole)), query
        monkeypatch.setattr(find, "LISTED", 0)
        assert found == rows(find.free_text(roles, query)), query
        monkeypatch.undo()
    assert find.site_texts(roles, find._matters("nothing"))._jdf.queryExecution().optimizedPlan().toString().count("Join") < 4
