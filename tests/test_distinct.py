"""Stored sets of ids against distinct counts."""

import random

import pytest

from cairn.functions.distinct import id_sets, merge_sets, set_sizes, store_sets, stored_sets
from cairn.operators import summaries
from tests.fixtures import rows


def test_merged_parts_equal_distinct_counts(spark, tmp_path):
    rng = random.Random(1)
    made = [(rng.randrange(4), rng.randrange(3), rng.choice([None, rng.randrange(-100, 100), rng.randrange(200_000), 2**60 + rng.randrange(9)])) for _ in range(900)]
    for load, part in enumerate((made[:500], made[300:700], made[650:])):
        store_sets(id_sets(spark.createDataFrame(part, "a int, b int, id long"), ["a", "b"], "id"), str(tmp_path / "sets"), str(load))
    sets = stored_sets(spark, str(tmp_path / "sets"))
    for keys in (["a", "b"], ["a"], ["b"]):
        at = [{"a": 0, "b": 1}[k] for k in keys]
        want = {}
        for row in made:
            if row[2] is not None:
                want.setdefault(tuple(row[k] for k in at), set()).add(row[2])
        assert {tuple(r[k] for k in keys): r["n"] for r in set_sizes(sets, keys, "n").collect()} == {k: len(v) for k, v in want.items()}
    assert merge_sets(sets, ["a"]).count() <= sets.count()
    with pytest.raises(Exception, match="already exists"):
        store_sets(sets.select("a", "bucket", "bitmap"), str(tmp_path / "sets"), "0")


def test_summaries_of_sets(roles):
    assert rows(summaries.dataset_summaries(roles, sets=summaries.dataset_site_sets(roles))) == rows(summaries.dataset_summaries(roles))
    sets = summaries.method_sample_sets(roles, [1, 2]).union(summaries.method_sample_sets(roles, [2, 4]))
    assert rows(summaries.domain_sample_summary(roles, sets=sets)) == rows(summaries.domain_sample_summary(roles, [1, 2, 4]))


def test_sets_of_scattered_ids_stay_small(spark):
    ids = spark.range(2_000).selectExpr("id % 500 as a", "id * 1000003 as id")
    sets = id_sets(ids, ["a"], "id")
    assert sets.count() == 2_000 and dict(sets.dtypes)["bitmap"] == "bigint"
    assert {r["n"] for r in set_sizes(sets, ["a"], "n").collect()} == {4}
    assert id_sets(spark.range(-64, 64), [], "id").count() == 2
