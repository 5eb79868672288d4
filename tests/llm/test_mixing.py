"""Mixing: targets against the sharing rule played out, positions against the integrated schedule."""

import random

import pytest

from cairn.llm.mixing import Mixing, mix, mixture, position, targets
from tests.llm.data import SCHEMA, awkward, clashing, empty, prose


def shared(sizes: list[int], weights: list[int], most: int = 3) -> list[float]:
    """Share by weight, stop at the cap, share the excess again until none is above."""
    found, left, open_ = [0.0] * len(sizes), float(sum(sizes)), set(range(len(sizes)))
    while open_ and left > 1e-9:
        total = sum(weights[k] for k in open_)
        over = [k for k in open_ if left * weights[k] / total >= most * sizes[k]]
        if not over:
            for k in open_:
                found[k] = left * weights[k] / total
            break
        for k in over:
            found[k] = float(most * sizes[k])
        left = sum(sizes) - sum(found[k] for k in range(len(sizes)) if k not in open_ or k in over)
        open_ -= set(over)
    return found


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 1, 10, 1000, 50_000]) for _ in range(9)]
    names = [f"s{k}" for k in range(8)] + [None]
    frame = spark.createDataFrame([(f"={n}" if n else "", n, s) for n, s in zip(names, sizes, strict=True)], "key string, source string, source_size long")
    got = {r["source"]: r["target"] for r in targets(frame, Mixing()).collect()}
    want = shared(sizes, [(5, 2, 1)[k % 3] for k in range(9)])
    assert [got[n] for n in names] == pytest.approx(want)


def test_taken_words_reach_the_targets(spark):
    rng = random.Random(5)
    docs = spark.createDataFrame([(k, prose(k, rng.randrange(0, 90)), "en", rng.choice(["a", "b", "b", "b", None]), 1) for k in range(400)], SCHEMA)
    got = mix(docs).collect()
    assert len(got) == 400
    by = {}
    for r in got:
        words, target, size = by.get(r["source_size"], (0, 0, 0))
        by[r["source_size"]] = (words + r["taken"], r["target"], size + r["size"])
        assert 0 <= r["taken"] <= 3 * r["size"] and (len(r["positions"]) > 0) == (r["taken"] > 0)
        assert r["positions"] == sorted(r["positions"]) and all(0 <= p <= 1 for p in r["positions"])
    for source_size, (words, target, size) in by.items():
        assert size == source_size and abs(words - target) <= 1
    first = [r["positions"][0] for r in got if r["positions"]]
    assert first == sorted(first)
    assert sorted(map(repr, got)) == sorted(map(repr, mix(docs.repartition(7)).collect()))


@pytest.mark.parametrize("schedule", Mixing().schedules + (((0.0, 0.0), (0.5, 2.0), (1.0, 0.0)),))
def test_position_inverts_the_demand(spark, schedule):
    def demand(t):
        steps = 4000
        weight = lambda x: next(w0 + (w1 - w0) * (x - t0) / (t1 - t0) for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False) if x <= t1)
        mids = [(k + 0.5) / steps for k in range(steps)]
        return sum(weight(x) for x in mids if x < t) / sum(weight(x) for x in mids)

    from pyspark.sql import functions as F

    shares = [0.0, 0.01, 0.2, 0.3125, 0.5, 0.77, 0.999]
    got = spark.createDataFrame([(s,) for s in shares], "s double").select(position(F.col("s"), schedule)).collect()
    for share, (at,) in zip(shares, got, strict=True):
        assert demand(at) == pytest.approx(share, abs=2e-3)


def test_awkward_rows(spark):
    docs = clashing(awkward(spark))
    got = mix(docs).collect()
    assert len(got) == docs.count() and sum(r["taken"] for r in got if not r["size"]) == 0
    left = mixture(docs)
    assert left.columns == [*docs.columns, "taken_", "positions_"] and left.count() == sum(r["taken"] > 0 for r in got)
    assert mix(empty(spark)).collect() == [] and mixture(empty(spark)).collect() == []
