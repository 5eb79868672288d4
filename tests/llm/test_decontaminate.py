"""Decontamination against plain BM25 and overlap on every passage."""

import numpy as np
import pytest

from cairn.llm import decontaminate as d
from cairn.llm.textblocks import Hasher
from tests.llm.data import SCHEMA, awkward, clashing, empty, prose

ITEMS = [(k, prose(500 + k, 15 + 3 * k, 300) + ". " + prose(700 + k, 8 + k, 300) + ".") for k in range(12)]


def items(spark):
    return spark.createDataFrame([*ITEMS, (90, None), (91, ""), (None, "alpha beta gamma delta"), ITEMS[0]], "item_id long, text string")


def docs(spark):
    held = [(k, f"{prose(k, 150, 300)} {ITEMS[k % 12][1]} {prose(50 + k, 90, 300)}", None, None, None) for k in range(24)]
    clean = [(100 + k, prose(1000 + k, 300, 300), "en", "a", 1) for k in range(40)]
    part = [(200, f"{prose(7, 60)} {ITEMS[3][1].split('. ')[0]} {prose(8, 60)}", "en", "a", 1)]  # the question only
    upper = [(201, f"{prose(7, 60)} {ITEMS[5][1].upper()} {prose(8, 60)}", "en", "a", 1)]
    return spark.createDataFrame(held + clean + part + upper, SCHEMA)


@pytest.mark.parametrize("shard", [20_000, 4])
def test_finds_what_is_held_and_nothing_else(spark, shard):
    found = d.contaminated(docs(spark), items(spark), d.Decontamination(shard=shard))
    got = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    assert got == {(k, k % 12) for k in range(24)} | {(201, 5)}


def test_decontaminate_keeps_rows_and_columns(spark):
    frame = clashing(docs(spark))
    left = d.decontaminate(frame, items(spark))
    assert left.columns == frame.columns
    assert sorted(r["doc_id"] for r in left.collect()) == [*range(100, 140), 200]


def test_awkward_rows(spark):
    frame = awkward(spark)
    assert d.contaminated(frame, items(spark)).collect() == []
    assert d.decontaminate(frame, items(spark)).count() == frame.count()
    assert d.contaminated(empty(spark), items(spark)).collect() == []
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.contaminated(docs(spark), none).collect() == [] and d.decontaminate(frame, none).count() == frame.count()
    whole = spark.createDataFrame([(1, awkward(spark).where("doc_id = 5").first()["text"])], "item_id long, text string")
    assert [(r[0], r[1]) for r in d.contaminated(frame, whole).collect()] == [(5, 1)]  # an item of 60,000 words


def test_wand_equals_scores_of_all_items():
    hasher, how = Hasher(), d.Decontamination()
    texts = [t for _, t in ITEMS]
    own = [np.unique(d.digests(t, hasher)) for t in texts]
    df = {}
    for terms in own:
        for t in terms.tolist():
            df[t] = df.get(t, 0) + 1
    index = d.build_index([{"item_id": k, "text": t, "terms": [{"term": x, "df": df[x]} for x in own[k].tolist()]} for k, t in enumerate(texts)], 12, 30.0, how)
    weight = {}
    for t in range(len(index.terms)):
        for row in range(index.ranges[t], index.ranges[t + 1]):
            for at in range(index.first[row], index.first[row + 1]):
                weight[t, int(index.places[at])] = float(index.weights[at])
    for seed in range(60):
        query = index.find(d.digests(prose(seed, 90, 300) + " " + texts[seed % 12][:60], hasher))[1]
        query = np.unique(query)
        plain = {i: sum(weight.get((t, i), 0.0) for t in query.tolist()) for i in range(12)}
        for least in (0.05, 0.2, 0.4):
            got = {i: s for b in range(index.blocks) for i, s in d.wand(index, query, b, least)}
            assert got == pytest.approx({i: s for i, s in plain.items() if s >= least - 1e-9})


def test_question_and_answer():
    assert d.question_and_answer("What is it? It is a cat.") == ("What is it?", " It is a cat.")
    assert d.question_and_answer("a b c d") == ("a b", "c d")
    assert d.question_and_answer("word") == ("word", "word")
    question, answer = d.question_and_answer("One two three four. Five six seven eight. Nine.")
    assert len(answer.split()) >= 3 and len(question.split()) >= 3
