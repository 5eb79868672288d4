"""Documents without a schema against flat tables, and long lists of ids against short ones."""

import json

import pytest

from cairn.functions.semantics import LISTED_IDS, ids_of
from cairn.operators import search as find
from cairn.operators.documents import site_documents, taxon_documents
from cairn.sources import collections
from tests.fixtures import rows

PATHS = [
    ("datasets.method_id", "8"), ("datasets.method_id", "not:8"), ("sample_groups.physical_samples.features.feature_type_id", "gt:7"),
    ("sample_groups.physical_samples.coordinates.measurement", "lt:2"), ("site_name", "Beta"), ("site_name", "5"), ("nothing.here", "5"),
    ("nothing.here", "not:5"), ("datasets.dataset_name", "Insects"), ("datasets", "5"),
]


@pytest.mark.parametrize("slices", [5, 1])
def test_search_equals_flat_tables(spark, roles, tmp_path, slices):
    paths = ["datasets", "sample_groups.physical_samples.features", "sample_groups.physical_samples.coordinates"]
    collections.store_collection(site_documents(roles, paths=paths, slices=slices), str(tmp_path / "json"), "site_id")
    docs = collections.read_collection(spark, str(tmp_path / "json"), "site_id")
    collections.store_variants(docs, str(tmp_path / "parquet"), "site_id")
    stored = collections.read_variants(spark, str(tmp_path / "parquet"), "site_id")
    for path, value in PATHS:
        want = rows(find.search_sites(roles, path, value))
        assert rows(find.search_sites(docs, path, value)) == want, (path, value)
        assert slices == 1 or rows(find.search_sites(stored, path, value)) == want


def test_taxa(spark, roles, tmp_path):
    collections.store_collection(taxon_documents(roles, slices=1), str(tmp_path / "json"), "taxon_id")
    docs = collections.read_collection(spark, str(tmp_path / "json"), "taxon_id")
    for path, value in (("measured_attributes.data", "gt:12"), ("genus_name", "Ater")):
        assert rows(find.search_taxa(docs, path, value)) == rows(find.search_taxa(roles, path, value))


def test_mixed_documents(spark, tmp_path):
    made = [
        {"id": 1, "a": 5, "b": {"c": [1, "x"]}}, {"id": 2, "a": "5", "b": [{"c": 7}, {"c": {"d": 1}}, 3]}, {"id": 3, "a": [5.0, None], "it's": "q"},
        {"id": 4, "a": None, "b": "c"}, {"id": 5}, {"id": 6, "a": True, "b": {"c": [[1]]}}, {"id": 7, "a": 5.5, "b": [{"c": [8, 9]}, {"c": "y"}]},
    ]
    (tmp_path / "c.json").write_text("\n".join(json.dumps(d) for d in made))
    docs = collections.read_collection(spark, str(tmp_path / "c.json"), "id")

    def ids(path, value):
        return [r[0] for r in rows(find.search_documents(docs, "id", path, value))]

    assert ids("a", "5") == [1, 3] and ids("a", "not:5") == [2, 4, 5, 6, 7] and ids("a", "gt:5") == [7]
    assert ids("b.c", "x") == [1] and ids("b.c", "gt:6") == [2, 7] and ids("b.c", "lt:2") == [1]
    assert ids("b.c.d", "1") == [2] and ids("it's", "q") == [3] and ids("zzz", "not:1") == [1, 2, 3, 4, 5, 6, 7]
    assert [r["id"] for r in collections.read_collection(spark, str(tmp_path / "c.json"), "id", ids=[2, 9]).collect()] == [2]
    found = collections.collection_fields(docs, ["b.c"], "id").collect()
    assert (2, "b.c", "7") in {tuple(r) for r in found}


def test_only_asked_fields_and_ids_are_read(spark, roles, tmp_path):
    collections.store_collection(site_documents(roles, paths=["location"], slices=1), str(tmp_path / "json"), "site_id")
    docs = collections.read_collection(spark, str(tmp_path / "json"), "site_id")
    collections.store_variants(docs, str(tmp_path / "parquet"), "site_id")
    some = collections.read_variants(spark, str(tmp_path / "parquet"), "site_id", ids=[2, 4], fields={"site_name": "string"})
    assert {tuple(r) for r in some.collect()} == {tuple(r) for r in roles["site"].where("site_id IN (2, 4)").select("site_id", "site_name").collect()}
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "In(site_id" in plan
    assert "doc:variant" not in plan.split("ReadSchema")[1], plan  # a field of the document, not the whole


def test_long_lists_equal_short_ones(spark, tmp_path):
    spark.range(20_000).selectExpr("id * 7 AS site_id", "id AS v").write.parquet(str(tmp_path / "rows"))
    frame = spark.read.parquet(str(tmp_path / "rows"))
    wanted = [*range(0, 140_000, 3), None, 21]
    got = ids_of(frame, wanted)
    assert len(wanted) > LISTED_IDS
    assert rows(got) == rows(frame.where("site_id % 3 = 0"))
    plan = got.groupBy("v").count()._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan and "GreaterThanOrEqual(site_id" in plan
    assert plan.index("HashAggregate") < plan.index("BroadcastHashJoin")  # the filter is below the shuffle
    assert ids_of(frame, []).count() == 0 and ids_of(frame, [None]).count() == 0
    assert ids_of(frame.withColumn("site_id", frame["site_id"].cast("string")), [str(w) for w in wanted if w is not None]).count() == got.count()
