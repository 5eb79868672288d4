"""Searches from stored indexes against scans."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cairn.functions.text import fold_tokens, query_terms
from cairn.operators import search as find
from cairn.operators.textindex import bucket_of, gram_sets, index_names, index_texts, postings
from tests.fixtures import rows

QUERIES = [
    "alpha farm", '"north farm" a', '"a b a"', "a -b", '-"b c" a', "ÄLPHA é", "-a", '"a a" b', "日本 й", '"o\'b"', "nothing",
]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(4)
    words = ["a", "b", "c", "á", "álpha", "NORTH", "farm", "o'b", "日本", "й", "ø", "é"]
    made = [(rng.randrange(30), rng.choice([1, 5, 10]), rng.choice([" ", ", ", "-"]).join(rng.choices(words, k=rng.randrange(12)))) for _ in range(300)]
    return spark.createDataFrame([*made, *made[:20], (99, 5, None), (None, 2, "a b")], "site_id long, weight int, text string")


def test_free_text_equals_a_scan(spark, roles, texts, tmp_path):
    index = index_texts(texts, str(tmp_path / "texts"), buckets=16, spread=2)
    for query in QUERIES:
        assert rows(find.free_text(roles, query, texts=texts, index=index)) == rows(find.free_text(roles, query, texts=texts)), query
    whole = index_texts(find.site_texts(roles), str(tmp_path / "sites"), buckets=8)
    for query in ("álpha farm", '"north alpha"'):
        assert rows(find.free_text(roles, query, index=whole)) == rows(find.free_text(roles, query))


def test_postings_are_gathered_without_a_shuffle_of_tokens(spark, texts):
    found = postings(texts)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    wanted = {}
    for (site, weight, text), copies in Counter(map(tuple, texts.where("text IS NOT NULL").collect())).items():
        for at, token in enumerate(fold_tokens(text)):
            wanted.setdefault((site, weight, text, copies, token), []).append(at)
    named = {(r["weight"], r["field"]): r["text"] for r in texts.select("weight", "text", F.xxhash64("weight", "text").alias("field")).collect()}
    assert {(r["site_id"], r["weight"], named[r["weight"], r["field"]], r["copies"], r["token"]): r["positions"] for r in found.collect()} == wanted


def test_only_the_buckets_of_the_words_are_read(spark, texts, tmp_path):
    index = index_texts(texts, str(tmp_path / "texts"), buckets=64)
    scan = index.rows(spark, ["alpha", "b"])
    assert {r["bucket"] for r in scan.select("bucket").distinct().collect()} == {bucket_of("alpha", 64), bucket_of("b", 64)}
    files = {r[0] for r in scan.select(F.input_file_name()).distinct().collect()}
    assert files and all(f"bucket={bucket_of('alpha', 64)}/" in f or f"bucket={bucket_of('b', 64)}/" in f for f in files)
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and re.search(r"PushedFilters: \[[^\]]*In\(token", plan)
    with pytest.raises(Exception, match="already exists"):
        index_texts(texts, str(tmp_path / "texts"))


@pytest.mark.parametrize("category", ["sites", "sample_groups", "datasets", "methods"])
def test_search_equals_a_scan(spark, roles, tmp_path, category):
    index = index_names(find.searchable_names(roles), str(tmp_path / "names"), buckets=16)
    for query, domain in (("alpha", ""), ("farm alpha", ""), ("al%rm", ""), ("core north", ""), ("insects", "palaeoentomology"), ("b_ta", ""), ("count or alpha", "")):
        assert rows(find.search(roles, category, query, domain=domain, index=index)) == rows(find.search(roles, category, query, domain=domain)), query


def test_sets_of_trigrams():
    assert gram_sets("abcd", []) == [{"abc", "bcd"}]
    assert gram_sets("abc%DEF\\%g", query_terms("north -farm")) == [{"abc", "def", "ef%", "f%g"}, {"nor", "ort", "rth"}]
    assert gram_sets("ab", query_terms("abc")) is None and gram_sets("abc", query_terms("ab")) is None


def test_folding(spark):
    assert fold_tokens("Łódź, éÉ ΆΡΗΣ йод") == ["lodz", "ee", "αρης", "иод"]
    assert fold_tokens(" -_!") == []


def test_hits_are_computed_once(spark, roles):
    for page in (1, 3):
        found = find.search(roles, "sites", "alpha", page=page, limit=1, heap_rows=1)
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert "ReusedExchange" in plan
        assert "Window" not in plan or "_part" in plan
