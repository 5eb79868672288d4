"""Incremental documents: what is rebuilt, what stays, and what a failure leaves."""

import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cairn.operators import documents
from cairn.operators.datagroups import data_groups
from cairn.sources.store import Store
from tests.fixtures import rows


def files(folder):
    return {str(p): hashlib.md5(p.read_bytes()).hexdigest() for p in Path(folder).rglob("*.parquet")}


def changed(roles):
    """Site 2 renamed, site 5 gone, a feature of site 1 renamed in its own table, and a new site."""
    site = roles["site"].where("site_id <> 5").withColumn("site_name", F.when(F.col("site_id") == 2, "Other").otherwise(F.col("site_name")))
    new = roles["site"].where("site_id = 5").withColumn("site_id", F.lit(50).cast("long"))
    return roles.with_roles(site=site.unionByName(new))


def test_only_changed_sites_are_rebuilt(spark, roles, tmp_path):
    slices = 3
    store = Store(str(tmp_path / "store"), "site_id", buckets=7, spread=2)
    assert store.read(spark, "documents") is None and store.version(spark) == 0
    first = documents.refresh_documents(roles, store, slices=slices)
    assert {tuple(r) for r in first.collect()} == {(k, "new") for k in (1, 2, 3, 4, 5)}
    assert documents.refresh_documents(roles, store, slices=slices).collect() == []
    assert store.version(spark) == 1
    before = files(tmp_path / "store")

    later = changed(roles)
    done = documents.refresh_documents(later, store, slices=slices)
    assert {tuple(r) for r in done.collect()} == {(2, "changed"), (5, "gone"), (50, "new")}
    after = files(tmp_path / "store")
    assert {k: after[k] for k in before} == before  # nothing is written over
    touched = {store.bucket_of(k) for k in (2, 5, 50)}
    fresh = {k for k in after.keys() - before.keys() if "/documents/" in k}
    assert fresh and all(any(f"bucket={b}/" in k for b in touched) for k in fresh)

    whole = documents.site_documents(later, slices=slices)
    assert rows(store.read(spark, "documents").select(*whole.columns)) == rows(whole)
    assert {r["site_id"] for r in store.read(spark, "documents", [2, 3, 5]).collect()} == {2, 3}


def test_a_lookup_that_changes_changes_its_sites(roles):
    stored = documents.site_fingerprints(roles)
    renamed = roles["dataset"].withColumn("dataset_name", F.concat("dataset_name", F.lit("!")))
    later = roles.with_roles(dataset=renamed.where("dataset_id = 1000").unionByName(roles["dataset"].where("dataset_id <> 1000")))
    with_dataset = {r["site_id"] for r in documents.path_table(roles, "datasets").where("dataset_id = 1000").collect()}
    found = documents.changed_sites(stored, documents.site_fingerprints(later)).collect()
    assert {r["site_id"] for r in found} == with_dataset and {r["state"] for r in found} == {"changed"}
    # A value that moves from one field to another, or a row that comes twice, is a change.
    site = roles["site"].withColumn("national_site_identifier", F.col("site_description")).withColumn("site_description", F.lit(None).cast("string"))
    moved = documents.changed_sites(stored, documents.site_fingerprints(roles.with_roles(site=site)))
    assert 4 in {r["site_id"] for r in moved.collect()}
    twice = roles["sample_feature"].union(roles["sample_feature"])
    assert documents.changed_sites(stored, documents.site_fingerprints(roles.with_roles(sample_feature=twice))).count() > 0
    assert documents.changed_sites(stored, documents.site_fingerprints(roles)).collect() == []


def test_data_groups_count(roles, spark, tmp_path):
    store = Store(str(tmp_path / "store"), "site_id", buckets=3)
    make = lambda t, ids: data_groups(t, ids)
    documents.refresh_documents(roles, store, paths=["datasets"], data_groups=make, slices=1)
    measured = roles["measured_value"].withColumn("measured_value", F.lit("77"))
    done = documents.refresh_documents(roles.with_roles(measured_value=measured), store, paths=["datasets"], data_groups=make, slices=1)
    assert {r["state"] for r in done.collect()} == {"changed"}
    texts = store.read(spark, "documents").select(F.to_json("data_groups")).collect()
    assert any('"data":"77"' in (r[0] or "") for r in texts)


def test_a_failed_commit_leaves_the_old_state(spark, tmp_path):
    store = Store(str(tmp_path / "store"), "id", buckets=4)
    frame = spark.createDataFrame([(k, f"v{k}") for k in range(20)], "id long, v string")
    store.commit({"documents": frame}, frame.select("id"))
    broken = frame.where("id < 3").withColumn("v", F.when(F.col("id") == 2, F.raise_error(F.lit("lost"))).otherwise(F.lit("new")))
    with pytest.raises(Exception, match="lost"):
        store.commit({"documents": broken}, broken.select("id"))
    with pytest.raises(ValueError, match="not among the keys"):
        store.commit({"documents": frame}, frame.where("id = 1").select("id"))
    assert store.version(spark) == 1
    assert rows(store.read(spark, "documents")) == rows(frame)
    store.commit({"documents": frame.where("id < 3").withColumn("v", F.lit("new"))}, frame.where("id < 4").select("id"))
    assert {r["id"]: r["v"] for r in store.read(spark, "documents").collect()} == {k: "new" if k < 3 else f"v{k}" for k in range(20) if k != 3}
    # All of a bucket may go.
    store.commit({"documents": frame.where("false")}, frame.select("id"))
    assert store.read(spark, "documents") is None


def test_lists_that_follow_from_other_rows_are_not_built_for_fingerprints(roles):
    def kinds(paths):
        plan = documents.site_fingerprints(roles, paths=paths)._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("AS kind#")

    # The whole document holds every row that its lookups are made of; lookups alone are built.
    assert kinds(None) == 0
    assert kinds(["lookup_tables"]) > 0 and kinds(["lookup_tables", "sample_groups", "datasets"]) > 0


def test_the_unit_of_a_method_is_part_of_its_sites_lookups(roles):
    before = {r["site_id"]: r["fingerprint"] for r in documents.site_fingerprints(roles).collect()}
    table = "analysis_method" if "analysis_method" in roles else "method"
    unit = F.when(F.col("method_id") == 3, F.lit(77).cast("long")).otherwise(F.col("unit_id"))
    later = roles.with_roles(**{table: roles[table].withColumn("unit_id", unit)})
    after = {r["site_id"]: r["fingerprint"] for r in documents.site_fingerprints(later).collect()}
    lookups = [{(r["site_id"], r["kind"], r["id"]) for r in documents.site_lookups(t).collect()} for t in (roles, later)]
    changed = {site for site, _, _ in lookups[0] ^ lookups[1]}
    assert changed and changed <= {s for s in before if before[s] != after[s]}
