"""Near-duplicates against exact sets of all pairs."""

import random

import numpy as np
import pytest

from cairn.llm.components import components
from cairn.llm.neardup import NearDup, keep_first, least_matches, near_duplicates
from tests.llm.data import SCHEMA, awkward, clashing, empty, prose, rows


def brute(texts: dict[int, str | None], words: int, percent: int = 80) -> dict[int, int]:
    sets = {}
    for i, text in texts.items():
        own = (text or "").lower().split()
        sets[i] = {tuple(own[k : k + words]) for k in range(max(1, len(own) - words + 1))} if own else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def edited(text: str, share: float, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join(f"e{rng.randrange(9999)}" if rng.random() < share else w for w in text.split())


@pytest.fixture(scope="module")
def texts():
    found, at = {}, 0
    for family in range(6):
        base = prose(100 + family, 120 + 60 * family, 3000)
        for copy in range(25):
            found[at] = edited(base, 0.001 * (copy % 9) * (family + 1) / 2, at)
            at += 1
    for chain in range(12):  # each near the next, the ends far apart
        found[at] = " ".join(f"c{k}" for k in range(chain * 9, chain * 9 + 100))
        at += 1
    for other in range(40):
        found[at] = prose(900 + other, 50, 3000)
        at += 1
    found[at], found[at + 1], found[at + 2] = "Two words", "two  WORDS", ""
    return found


@pytest.mark.parametrize("words", [4, 5])
def test_components_are_exact(spark, texts, words):
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in texts.items()], SCHEMA)
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs, NearDup(words=words, block=16)).collect()}
    assert got == brute(texts, words)


def test_awkward_rows(spark):
    got = rows(near_duplicates(awkward(spark)).select("doc_id", "component_id", "kept"))
    assert (1, 1, True) in got and (2, 2, True) in got and (4, 4, True) in got
    assert (6, 6, True) in got and (7, 6, False) in got
    assert got.count((8, 8, True)) == 2 and got.count((None, None, True)) == 2
    assert rows(near_duplicates(clashing(awkward(spark))).select("doc_id", "component_id", "kept")) == got
    assert near_duplicates(empty(spark)).collect() == []


def test_keep_first(spark):
    docs = clashing(awkward(spark))
    kept = keep_first(docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect())
    assert ids == [(False, i) for i in (1, 2, 3, 4, 5, 6, 8, 9, 10)] + [(True, 0)] * 2
    assert keep_first(empty(spark)).collect() == []


def test_keep_first_loses_no_text(spark):
    a, b = prose(11, 60), prose(12, 60)
    near = a.rsplit(" ", 1)[0]
    docs = spark.createDataFrame([(3, a), (5, a), (5, b)], "doc_id long, text string")
    assert {tuple(r) for r in keep_first(docs).collect()} == {(3, a), (5, b)}
    docs = spark.createDataFrame([(5, a), (5, near), (6, near), (7, ""), (7, ""), (None, a), (5, a)], "doc_id long, text string")
    kept = [tuple(r) for r in keep_first(docs).collect()]
    assert len(kept) == 4 and sorted(kept, key=repr)[1:] == [(7, ""), (7, ""), (None, a)]
    assert sum(r in ((5, a), (5, near)) for r in kept) == 1


@pytest.mark.parametrize("seed", range(2))
def test_keep_first_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    bases = [prose(100 + k, 40, 5_000) for k in range(12)]
    rows_ = []
    for k in range(60):
        words = rng.choice(bases).split()
        if rng.random() < 0.5:
            words[-1] = rng.choice(["changed", "other"])
        rows_.append((rng.randrange(25), " ".join(words)))
    texts = sorted(set(rows_))
    sets = {r: {tuple(r[1].split()[i : i + 5]) for i in range(len(r[1].split()) - 4)} for r in texts}
    root = {r: r for r in texts}

    def find(r):
        while root[r] != r:
            r = root[r]
        return r

    for r in texts:
        for q in texts:
            if 100 * len(sets[r] & sets[q]) >= 80 * len(sets[r] | sets[q]):
                root[find(r)] = find(q)
    kept = [tuple(r) for r in keep_first(spark.createDataFrame(rows_, "doc_id long, text string")).collect()]
    groups = {}
    for r in texts:
        groups.setdefault(find(r), []).append(r)
    assert len(kept) == len(groups) == len({find(r) for r in kept})
    assert all(r[0] == min(groups[find(r)])[0] for r in kept)


def test_pruning_keeps_what_may_reach_the_threshold():
    how = NearDup()
    limits = least_matches(how)
    rng = np.random.default_rng(1)
    drawn = rng.random((20_000, how.values)) < 0.8
    alive = np.ones(len(drawn), bool)
    for k, limit in enumerate(limits):
        alive &= drawn[:, : (k + 1) * how.batch].sum(axis=1) >= limit
    assert alive.mean() > 0.999
    assert (rng.random((2_000, how.values)) < 0.5).sum(axis=1).max() < limits[-1]


def test_components_of_long_chains(spark):
    edges = [(k + 1, k) for k in range(60)] + [(100, 70), (100, 71)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "hi long, lo long")).collect()}
    assert found == {k: 0 for k in range(1, 61)} | {100: 70, 71: 70}
    assert components(spark.createDataFrame([], "hi long, lo long")).collect() == []


def test_components_have_few_tasks_whatever_the_partitions(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(30)], "hi long, lo long").repartition(64)
    found = components(edges)
    assert found.rdd.getNumPartitions() == 1
    assert {r["root"] for r in found.collect()} == {0}


def test_texts_of_one_id_are_classes_of_their_own(spark):
    one, other = prose(1, 60, 5_000), prose(2, 60, 5_000)
    docs = spark.createDataFrame([(5, one), (5, other), (6, one), (7, other), (7, prose(3, 60, 5_000))], "doc_id long, text string")
    assert {tuple(r) for r in keep_first(docs).collect()} == {(5, one), (5, other), (7, prose(3, 60, 5_000))}
    found = {(r["doc_id"], r["component_id"]) for r in near_duplicates(docs).collect()}
    assert found == {(5, 5), (6, 5), (7, 5), (7, 7)}
