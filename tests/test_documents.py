"""Data groups, nested documents, extracts and sinks."""

import json
import re

import pytest
from pyspark.sql import functions as F

from cairn.operators import datagroups, documents
from cairn.operators.facts import joined
from cairn.sources import sinks
from tests.fixtures import ROWS, by, rows


def plain(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def test_abundance_groups(roles):
    got = by(datagroups.abundance_details(roles), "abundance_id")
    assert [x["level_id"] for x in got[1]["levels"]] == [1, 2]
    assert got[2]["levels"] is None
    values = by(datagroups.abundance_values(roles, [1]), "analysis_entity_id", "value_double")
    assert json.loads(values["1", 4.0]["data"])["taxon_id"] == 20
    assert values["1", 4.0]["key"] == "100"
    assert len(values) == 5
    lookups = rows(datagroups.abundance_lookups(roles))
    assert lookups == [
        (1, "abundance_element", 1, "head"), (1, "abundance_element", 2, "wing"),
        (1, "modification_type", 5, "charred"), (2, "abundance_element", 1, "head"),
        (2, "modification_type", 6, "wet"), (4, "abundance_element", 1, "head"),
    ]


def test_dating_groups(roles):
    got = plain(datagroups.dating_values(roles, method_ids=[151, 50]))
    lab = {r["key"]: r["value_double"] or r["value_string"] for r in got if r["method_id"] == 151}
    # The smaller laboratory record of entity 6 wins.
    assert lab == {
        "geochron_id": 5.0, "dating_lab_id": "77b", "lab_number": "Ua-1", "age": 2000.0,
        "error_older": 30.0, "error_younger": 40.0,
    }
    relative = {r["key"] for r in got if r["method_id"] == 50}
    assert "c14_age_older" in relative and "lab_number" not in relative
    assert {r["value_type"] for r in got} == {"complex"}


def test_age_values_keep_present_ones(roles):
    got = plain(datagroups.entity_age_values(roles, method_ids=None))
    keys = {(r["analysis_entity_id"], r["key"]) for r in got}
    assert keys == {
        ("1", "age"), ("1", "age_range"), ("1", "chronology_id"), ("1", "dating_specifier"),
        ("3", "age_older"), ("3", "age_younger"), ("4", "age_older"), ("4", "age_younger"),
        ("5", "chronology_id"), ("6", "age_younger"), ("8", "age"),
    }


def test_group_headers(roles):
    ages = datagroups.entity_age_values(roles, method_ids=None)
    heads = by(datagroups.group_headers(roles, ages), "site_id", "data_group_id")
    assert heads[4, "1004"]["analysis_entity_id"] == "8"
    assert heads[1, "1000"]["analysis_entity_id"] is None
    assert heads[1, "1000"]["first_biblio_id"] == 70
    assert heads[4, "1004"]["biblio_count"] == 0


def test_measured_values(roles):
    got = {(r["data"], r["value_double"], r["value_string"]) for r in plain(datagroups.measured_values(roles))}
    assert got == {("12", 12.0, None), (" 7.5 mg", 7.5, None), ("<3", None, "<3")}
    assert rows(datagroups.entity_prep_methods(roles)) == [(1, 400), (1, 401), (5, 400)]


def test_isotopes_need_methods(roles):
    assert datagroups.isotopes(roles).count() == 0
    one = plain(datagroups.isotopes(roles, method_ids=[30]))[0]
    assert one["value_string"] == "-21.5"
    assert json.loads(one["data"])["unit_name"] == "per mil"


def test_ceramics_keep_empty_samples(roles):
    got = {(r["physical_sample_id"], r["key"]) for r in plain(datagroups.ceramics(roles))}
    # Only site 2 has ceramics; its sample 104 has none of its own.
    assert got == {(103, "Colour"), (103, "Ware"), (104, None)}
    chosen = datagroups.data_groups(roles, method_ids=[172], families={"ceramic": {}})
    assert [(r["key"], r["method_id"]) for r in plain(chosen)] == [("Ware", 172)]


def test_isotopes_join_the_united_groups(roles):
    rows_ = plain(datagroups.data_groups(roles, families={"isotope": {"method_ids": [30]}}))
    assert {r["type"] for r in rows_} == {"isotope"}


def test_ranged_values(roles):
    got = by(datagroups.adna_values(roles, method_ids=[60, 3]).where("key <> 'Key'"), "key", "value_string")
    assert got["Germination", "12"]["value_type"] == "complex"
    assert json.loads(got["Germination", "12"]["data"])["low_value"] == 1200
    assert got["Germination", "12"]["method_id"] == 10
    assert got["Felling", "y"]["value_type"] == "complex"
    keyed = plain(datagroups.dendro_values(roles, method_ids=[3]).where("key = 'Key'"))
    assert {r["value_type"] for r in keyed} == {"simple"}  # a zero bound is absent
    assert datagroups.dendro_values(roles).count() == 0  # no site uses method 10


def test_dating_family_defaults(roles):
    # 151 is a laboratory method; 14 stands for the others, which take relative dates.
    renamed = roles["dataset"].withColumn("method_id", F.when(F.col("method_id") == 50, 14).otherwise(F.col("method_id")).cast("long"))
    later = roles.with_roles(dataset=renamed)
    kinds = {r["method_id"]: r["keys"] for r in datagroups.dating_values(later).groupBy("method_id").agg(F.collect_set("key").alias("keys")).collect()}
    assert "lab_number" in kinds[151] and "relative_date_id" in kinds[14] and set(kinds) == {14, 151}
    ages = {r["method_id"] for r in datagroups.entity_age_values(later).collect()}
    assert ages and ages <= {14, 151}
    # Method 50 is no method of the family, but its group is.
    assert {r["site_id"] for r in datagroups.gate(roles, "dating").collect()} == {
        r["site_id"] for r in documents.path_table(roles, "datasets").where("method_id IN (50, 151)").collect()
    }


def test_a_family_from_outside(roles):
    def heights(t, site_ids=None, unit="m"):
        rows = datagroups.measured_values(t, site_ids)
        return rows.withColumns({"type": F.lit("heights"), "value_string": F.lit(unit)})

    added = datagroups.register_family(datagroups.Family("heights", heights, methods=(30,)))
    try:
        assert ("heights", 1) in rows(datagroups.family_sites(roles))
        assert rows(datagroups.gate(roles, "heights")) == [(1,)]
        assert "heights" in {r["type"] for r in plain(datagroups.data_groups(roles))}
        chosen = datagroups.data_groups(roles, families={"heights": {"unit": "cm"}}, gated=True)
        assert {r["value_string"] for r in plain(chosen)} == {"cm"}
        with pytest.raises(ValueError, match="already"):
            datagroups.register_family(added)
    finally:
        datagroups.remove_family("heights")
    for bad in (datagroups.Family("", heights), datagroups.Family("x", None), datagroups.Family("x", heights, methods=("3",))):
        with pytest.raises((ValueError, TypeError)):
            datagroups.register_family(bad)
    datagroups.register_family(datagroups.Family("short", lambda t, site_ids: t["site"]))
    try:
        with pytest.raises(TypeError, match="lacks"):
            datagroups.data_groups(roles, families={"short": {}})
    finally:
        datagroups.remove_family("short")
    with pytest.raises(ValueError, match="unknown family"):
        datagroups.data_groups(roles, families={"nothing": {}})


def test_family_gate_and_union(roles):
    assert rows(datagroups.family_sites(roles)) == [
        ("abundance", 1), ("abundance", 2), ("abundance", 4), ("ceramic", 2), ("dating", 2),
        ("measured_values", 1),
    ]
    united = datagroups.data_groups(roles, method_ids=[3])
    assert {r["type"] for r in plain(united)} == {"abundance"}
    kinds = rows(datagroups.dendro_sites(roles).groupBy("kind").count())
    assert kinds == [("date", 5), ("measurement", 14)]
    named = by(datagroups.with_sample_names(roles, united.where("value_double = 100")), "sample_name")
    assert set(named) == {"s103"}
    assert documents.data_groups_extract(united, [1], [8]).count() == 0


def test_documents_keep_empty_parents(roles):
    docs = by(documents.site_documents(roles, slices=1), "site_id")
    assert len(docs) == 5
    assert docs[3]["sample_groups"] == [] and docs[3]["datasets"] == []
    groups = {g["sample_group_id"]: g for g in docs[2]["sample_groups"]}
    assert groups[13]["physical_samples"] == []
    samples = {s["physical_sample_id"]: s for s in groups[12]["physical_samples"]}
    assert samples[104]["horizons"] == [] and samples[104]["features"][0]["feature_type_id"] == 7
    assert groups[12]["dataset_ids"] == [1000, 1002, 1003, 1007]
    first = {d["dataset_id"]: d for d in docs[1]["datasets"]}[1000]
    assert [e["analysis_entity_id"] for e in first["analysis_entities"]] == [1, 3, 4]
    assert first["analysis_entities"][0]["prep_methods"] == [400, 401]
    assert {x["location_name"] for x in docs[1]["location"]} == {"Norway", "Parish"}
    assert docs[5]["location"][0]["location_name"] is None
    assert {d["parts"] for d in docs.values()} == {1}


@pytest.mark.parametrize("slices", [2, 7, 40])
def test_slices_hold_every_child_once(spark, roles, tmp_path, slices):
    path = str(tmp_path / "documents")
    documents.site_documents(roles, slices=slices).write.parquet(path)
    docs = spark.read.parquet(path)
    parts = docs.groupBy("site_id").agg(F.max("parts").alias("parts"), F.max("part").alias("last"))
    assert by(parts, "site_id")[1]["parts"] == slices
    assert parts.where("last >= parts").count() == 0
    entities = documents.entity_rows_of(docs)
    assert sorted(r.analysis_entity_id for r in entities.collect()) == [r[0] for r in ROWS["analysis_entity"]]
    samples = documents.sample_rows_of(docs)
    assert sorted(r.physical_sample_id for r in samples.collect()) == [r[0] for r in ROWS["physical_sample"]]
    features = documents.child_rows_of(docs, "sample_groups.physical_samples.features")
    assert rows(features.select("physical_sample_id", "feature_id")) == sorted((r[0], r[1]) for r in ROWS["sample_feature"])
    # Cutting by method reaches entities in every slice.
    cut = documents.entity_rows_of(sinks.export_sites(docs, [3]))
    assert sorted(r.analysis_entity_id for r in cut.collect()) == [1, 3, 4, 5, 12]


def test_rows_of_documents_do_not_depend_on_slices(roles):
    found = []
    for slices in (1, 3, 20):
        docs = documents.site_documents(roles, slices=slices)
        data = datagroups.abundance_values(roles)
        some = documents.site_documents(roles, paths=["datasets"], data_groups=data, slices=slices)
        cut = sinks.export_sites(some, [8])
        values = documents.child_rows_of(cut, "data_groups").select("site_id", "data_group_id", F.explode("values.key"))
        taxa = documents.taxon_documents(roles, slices=slices)
        found.append(
            [
                rows(frame)
                for frame in (
                    documents.site_rows_of(docs), documents.group_rows_of(docs), documents.sample_rows_of(docs),
                    documents.dataset_rows_of(docs), documents.entity_rows_of(docs), documents.dataset_rows_of(cut), values,
                    documents.child_rows_of(docs, "location"), documents.child_rows_of(docs, "sample_groups.dataset_ids"),
                    documents.child_rows_of(taxa, "common_names", "taxon_id"),
                )
            ]
        )
    assert found[0] == found[1] == found[2]
    assert all(found[0])


def test_export_cuts_datasets_and_groups(roles):
    data = datagroups.abundance_values(roles)
    docs = documents.site_documents(roles, [1], paths=["datasets"], data_groups=data, slices=1)
    nothing = sinks.export_sites(docs).first()
    assert nothing.datasets == [] and nothing.data_groups == []
    some = sinks.export_sites(docs, [8]).first()
    assert [d.dataset_id for d in some.datasets] == [1001]
    assert [g.data_group_id for g in some.data_groups] == ["1001"]
    assert "sample_groups" not in docs.columns


def test_lookups(roles):
    got = rows(documents.site_lookups(roles, [1]))
    assert got == [
        (1, "contact", 90), (1, "dimension", 1), (1, "dimension", 2), (1, "horizon", 5),
        (1, "method", 201), (1, "method", 202), (1, "method", 3), (1, "method", 30),
        (1, "method", 300), (1, "method", 8), (1, "prep_method", 400), (1, "prep_method", 401),
        (1, "unit", 1), (1, "unit", 2),
    ]


def test_lookups_read_a_table_of_sample_children_once(roles):
    # A filter marks every read of the table in the plan.
    marked = roles.with_roles(sample_coordinate=roles["sample_coordinate"].where("coordinate_method_id <> 987654"))
    found = documents.site_lookups(marked)
    assert rows(found) == rows(documents.site_lookups(roles))
    assert found._jdf.queryExecution().analyzed().toString().count("987654") == 1


def test_fullest_reference_wins(roles):
    got = by(documents.site_biblio_lookup(roles), "site_id", "biblio_id")
    assert got[1, 70]["authors"] == "X"
    assert got[2, 71]["title"] == "T71"  # a tie goes to the site's own record
    assert got[4, 70]["year"] == "1980"
    assert got[1, 72]["title"] is None


def test_taxon_documents(roles):
    docs = by(documents.taxon_documents(roles, slices=1), "taxon_id")
    assert docs[20]["order_name"] == "Coleoptera"
    assert [x["common_name"] for x in docs[20]["common_names"]] == ["black one", "svart"]
    systems = {s["ecocode_system_id"]: s["groups"] for s in docs[20]["ecocodes"]}
    assert [c["name"] for c in systems[2][0]["codes"]] == ["Wet", "Wetland"]
    assert set(systems) == {2, 3}
    assert docs[24]["ecocodes"] is None and docs[24]["common_names"] == []
    split = documents.taxon_documents(roles, slices=9)
    assert split.where("taxon_id = 20").count() > 1
    assert split.select(F.sum(F.size("common_names"))).first()[0] == 3


def test_extracts(spark, roles):
    got = by(documents.datasets_extract(roles, [1], [30]), "analysis_entity_id", "measured_value")
    assert set(got) == {(10, 12.0), (10, None), (11, 7.5)}
    covered = spark.createDataFrame([(1, 1006)], "site_id long, dataset_id long")
    assert documents.datasets_extract(roles, [1], [30], covered).count() == 0
    sample = rows(documents.sample_datasets(roles, [100]).select("dataset_id", "analysis_entity_id"))
    assert sample == [(1000, 1), (1001, 2), (1006, 10)]
    assert documents.sample_group_datasets(roles, [2]).count() == 4
    assert documents.analysis_values(roles).where("class_name = 'Felling'").count() == 2


@pytest.mark.parametrize("slices", [1, 5])
def test_sink_keeps_the_other_documents(spark, roles, tmp_path, slices):
    docs = documents.site_documents(roles, slices=slices)
    first, second = str(tmp_path / "first"), str(tmp_path / "second")
    sinks.save_documents(docs, first, "site_id", buckets=3)
    changed = docs.where("site_id = 2").withColumn("site_name", F.when(F.col("site_name").isNotNull(), F.lit("New")))
    sinks.save_documents(changed, second, "site_id", stored=first, buckets=3)
    before, after = (documents.site_rows_of(spark.read.parquet(p).drop("bucket")) for p in (first, second))
    old, new = by(before, "site_id"), by(after, "site_id")
    assert len(old) == len(new) == 5 and new[2]["site_name"] == "New"
    assert {k: v for k, v in old.items() if k != 2} == {k: v for k, v in new.items() if k != 2}
    assert {**old[2], "site_name": "New"} == new[2]
    with pytest.raises(Exception, match="exist"):
        sinks.save_documents(changed, first, "site_id", buckets=3)
    assert sinks.site_headers(roles).columns == list(sinks.HEADER_COLUMNS)


def test_lookup_tables_describe_every_code(roles):
    from cairn.operators.lookups import site_lookup_tables

    found = {(r["site_id"], r["kind"], r["id"]): r for r in plain(site_lookup_tables(roles))}
    assert len(found) == site_lookup_tables(roles).count()
    assert {(k[0], k[1], k[2]) for k in found} >= {tuple(r) for r in documents.site_lookups(roles).collect()}
    method = found[1, "method", 3]
    assert method["name"] == "Insect count" and '"method_group_id":5' in method["attributes"]
    assert {k[1] for k in found} >= {"method", "biblio", "taxon", "abundance_element", "modification_type", "domain", "value_class", "isotope_measurement"}
    some = {(r["site_id"], r["kind"], r["id"]) for r in plain(site_lookup_tables(roles, [2]))}
    assert some == {k for k in found if k[0] == 2}


def test_other_records_of_unknown_types_stay(spark, roles):
    records = spark.createDataFrame([(1, 3, "a"), (1, 99, "b"), (2, None, "c")], "site_id long, record_type_id long, description string")
    got = joined(roles.with_roles(site_other_record=records), "site_other_record")
    assert {(r["description"], r["record_type_name"]) for r in got.collect()} == {("a", "Age"), ("b", None), ("c", None)}


@pytest.mark.parametrize("paths", [["sample_groups.descriptions"], ["datasets.contacts"], ["sample_groups.notes", "datasets.contacts"]])
def test_nested_rows_do_not_move_again(spark, roles, paths):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = documents.site_documents(roles, paths=paths, slices=3)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    # One exchange for the sites' own rows and one for each other branch, by site and part; none above them.
    moved = re.findall(r"hashpartitioning\(site_id#\d+L?(, part#\d+|, \d)?, \d+\), (\w+)", plan)
    assert [(bool(part), why) for part, why in moved] == [(True, "REPARTITION_BY_COL")] * (1 + len(paths))


def test_fingerprints_add_up_by_group_before_the_site(roles):
    whole = documents.site_fingerprints(roles)
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner, (sample_group_id") <= 12
    of = {r["site_id"]: r["fingerprint"] for r in whole.collect()}
    some = sorted(of)[:2]
    assert {r["site_id"]: r["fingerprint"] for r in documents.site_fingerprints(roles, some).collect()} == {s: of[s] for s in some}
    # A group that goes to another site changes both.
    group = roles["sample_group"]
    first = group.agg(F.min("sample_group_id")).first()[0]
    source = group.where(F.col("sample_group_id") == first).first()["site_id"]
    target = next(s for s in of if s != source)
    place = F.when(F.col("sample_group_id") == first, F.lit(target)).otherwise(F.col("site_id")).cast(group.schema["site_id"].dataType)
    moved = documents.site_fingerprints(roles.with_roles(sample_group=group.withColumn("site_id", place)))
    assert {r["site_id"] for r in moved.collect() if of.get(r["site_id"]) != r["fingerprint"]} == {source, target}


def test_all_levels_of_nesting_use_one_sort(roles):
    plan = documents.site_documents(roles, slices=3)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" in plan and "ObjectHashAggregate" not in plan
    # The rows of groups and datasets are sorted down to their innermost key.
    assert len(re.findall(r"Sort \[site_id#\d+L? ASC NULLS FIRST, part#\d+ ASC NULLS FIRST, \w+#", plan)) >= 2


def test_entities_go_to_their_site_with_their_methods(roles):
    prep = roles["prep_method"].union(roles["prep_method"])
    sites = documents.site_documents(roles.with_roles(prep_method=prep), paths=["datasets.analysis_entities.prep_methods"], slices=3)
    assert rows(documents.entity_rows_of(sites)) == rows(
        documents.entity_rows_of(documents.site_documents(roles, paths=["datasets.analysis_entities.prep_methods"], slices=3))
    )
    build = documents._Build(roles, None, None, 3, None)
    moved = documents._dataset_branch(build).where("analysis_entity_id IS NOT NULL")
    assert moved.count() == moved.select("analysis_entity_id").distinct().count() == roles["analysis_entity"].count()


def test_branches_meet_as_they_are_sorted(roles):
    plan = documents.site_documents(roles, slices=3)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Sort \[site_id#\d+L? ASC NULLS FIRST, part#", plan)) == 3


def test_groups_without_a_known_site_stay(roles):
    group = roles["sample_group"]
    first, second = sorted(r[0] for r in group.select("sample_group_id").collect())[:2]
    place = F.when(F.col("sample_group_id") == second, F.lit(999).cast("long")).when(F.col("sample_group_id") != first, F.col("site_id"))
    moved = roles.with_roles(sample_group=group.withColumn("site_id", place))
    for slices in (1, 3):
        docs = documents.site_documents(moved, slices=slices).cache()
        homes = documents.child_rows_of(docs, "sample_groups").where("is_home").select("site_id", "sample_group_id")
        want = moved["sample_group"].select("site_id", "sample_group_id")
        assert sorted(map(tuple, homes.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
        assert docs.groupBy("site_id", "part").count().where("count > 1").count() == 0
        assert docs.where(f"part < 0 OR part >= {slices}").count() == 0
        lists = [f.name for f in docs.schema.fields if f.dataType.typeName() == "array"]
        assert docs.where("part > 0").where(" AND ".join(f"size({c}) = 0" for c in lists)).count() == 0
        docs.unpersist()
