"""Ranked search against every score in full, in plain Python and in SQL."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from cairn.llm.oracles import ORACLES
from cairn.llm.ranked import Places, Ranking, block_index, search, search_block, terms, units_of, weigh
from tests.llm.data import SCHEMA, awkward, awkward_rows, clashing, empty

ITEMS = "item_id long, text string"
SMALL = Ranking(block_docs=7, block_postings=60, primed_pairs=2)


def plain_terms(text):
    found = re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text or "")
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in found]


def plain(docs, items, best=20):
    split = [(doc, plain_terms(text)) for doc, text in docs]
    split = [(doc, t, Counter(t)) for doc, t in split if t]
    n, total = len(split), sum(len(t) for _, t, _ in split)
    df = Counter(term for _, _, c in split for term in c)
    out = []
    asked = {}
    for item, text in sorted(set(items), key=repr):
        asked.setdefault(item, Counter()).update(plain_terms(text))
    for item, wanted in asked.items():
        scores = []
        for doc, found, counts in split:
            m = 75 + 25 * len(found) * n // total
            score = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * counts[t] // (1000 * counts[t] + 12 * m)) for t, k in wanted.items() if counts[t])
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, k + 1, doc, -score) for k, (score, _, _, doc) in enumerate(sorted(scores, key=lambda s: s[:3])[:best])]
    return sorted(out, key=repr)


def got(spark, docs, items, how=Ranking()):
    found = search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS), how)
    return sorted((tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def by_sql(docs, items):
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    db.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    return sorted(db.sql(ORACLES["op13_pair_bound_maxscore"]).fetchall(), key=repr)


def corpus(seed, n=150):
    rng = random.Random(seed)
    words = [f"W{k}" if k % 3 else f"wé{k}" for k in range(60)]
    text = lambda longest: rng.choice([" ", "-", "\n"]).join(words[min(59, int(rng.expovariate(0.08)))] for _ in range(rng.randrange(1, longest)))
    docs = [(k, text(40)) for k in range(n)]
    docs += [(n + k, docs[k][1]) for k in range(40)]  # equal scores
    items = [(k, text(12)) for k in range(15)] + [(3, "w1 W1 wé30"), (99, "unknownword"), (100, "w1")]
    return docs, items


@pytest.mark.parametrize("seed", range(2))
def test_equals_all_scores_and_sql(spark, seed):
    docs, items = corpus(seed)
    want = plain(docs, items)
    assert got(spark, docs, items) == want
    assert got(spark, docs, items, SMALL) == want
    assert got(spark, docs, items, Ranking(group_terms=30)) == want
    assert by_sql(docs, items) == want


def test_awkward_rows(spark):
    items = [(None, "one x"), (1, None), (2, ""), (3, "ONE password"), (3, "ONE password"), (4, "w1x0 " * 1000), (5, "É é ſ İ 😀")]
    want = plain([r[:2] for r in awkward_rows()], items)
    frame = spark.createDataFrame(items, ITEMS)
    rows = lambda found: sorted((tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").collect()), key=repr)
    assert rows(search(awkward(spark), frame)) == want
    assert rows(search(clashing(awkward(spark)), clashing(frame.selectExpr("*", "0 as doc_id")))) == want
    assert rows(search(empty(spark), frame)) == []
    assert rows(search(awkward(spark), spark.createDataFrame([], ITEMS))) == []
    assert SCHEMA.startswith("doc_id")


def test_terms():
    text = "".join(map(chr, range(256))) + " Ünï-Code 世界 a b"
    assert [t.decode() for t in terms(text)] == plain_terms(text)


def test_pairs_tighten_the_bound_and_skip_documents():
    """Two terms that never meet: as a pair they cannot pass the threshold, apart their bounds could."""
    lengths = np.full(100, 10)
    ids = np.concatenate([np.zeros(50, dtype=np.int64), np.ones(50, dtype=np.int64), [2]])
    rows = np.concatenate([np.arange(50), np.arange(50, 100), [7]])
    weights = weigh(100, np.array([50, 50, 1]))
    lists, joint = block_index(lengths, ids, rows, np.ones(len(ids), dtype=np.int64), (100, 1000, weights), np.array([[0, 1], [1, 2]]))
    assert [(a, b, len(both), top) for a, b, both, top in joint][0] == (0, 1, 0, 0)
    tops = {t: (o, v, int(v.max())) for t, (o, v) in lists.items()}
    alone = units_of({0: 1, 1: 1}, tops, {})
    paired = units_of({0: 1, 1: 1}, tops, {0: [(1, 0)]})
    assert sum(top for top, _ in alone) == 2 * sum(top for top, _ in paired)
    places = Places(1)
    search_block({0: 1, 1: 1, 2: 1}, list(range(100)), tops, {0: [(1, 0)]}, {}, places, 0)
    assert places.rows[0][1] == 7


def test_bounds_hold_for_every_document():
    rng = np.random.default_rng(3)
    for _ in range(20):
        n, kinds = 50, 8
        held = rng.random((n, kinds)) < 0.3
        rows, ids = np.nonzero(held)
        tfs = rng.integers(1, 6, len(rows))
        weights = weigh(n, held.sum(axis=0))
        pairs = np.array([(a, b) for a in range(kinds) for b in range(a + 1, kinds)])
        lists, joint = block_index(rng.integers(5, 50, n), ids, rows, tfs, (n, 1000, weights), pairs)
        tops = {t: (o, v, int(v.max())) for t, (o, v) in lists.items()}
        by_first = {}
        meeting = {(a, b): top for a, b, _, top in joint}
        for a, b in pairs.tolist():
            by_first.setdefault(a, []).append((b, meeting.get((a, b), 0)))
        wanted = {t: int(rng.integers(1, 4)) for t in range(kinds)}
        for bound, unit in units_of(wanted, tops, by_first):
            scores = np.zeros(n, dtype=np.int64)
            for t in unit:
                scores[tops[t][0]] += wanted[t] * tops[t][1]
            assert scores.max() <= bound
