"""Importance resampling: weights against a plain count, draws against weights, held-out accuracy on planted texts."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import resample as m
from cairn.llm.resample import Resampling, keep_sample, kth_largest, resample
from cairn.llm.textblocks import Hasher
from tests.llm.data import SCHEMA, awkward, clashing, empty, prose

LABELS = "doc_id long, quality int, toxic int"


def planted(spark, n=3000):
    rng = random.Random(2)
    rows, labels, bad = [], [], set()
    for k in range(n):
        words = prose(k, rng.randrange(60, 200), 300).split()
        kind = k % 10
        if kind == 0:
            for _ in range(8):
                words[rng.randrange(len(words))] = "vile" + rng.choice(["ness", "ly", "st"])
        if kind == 1:
            words = [w + "***" for w in words]
        if kind < 2:
            bad.add(k)
        rows.append((k, " ".join(words), "en", "a", 1))
        if k // 10 % 5 < 2:
            labels.append((k, int(kind != 1), int(kind == 0)))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS), bad, {r[0] for r in labels}


def test_planted_texts(spark):
    docs, labels, bad, known = planted(spark)
    kept = {r["doc_id"] for r in resample(docs, labels).collect()}
    unseen = set(range(3000)) - known
    assert len(kept & bad & unseen) <= 0.02 * len(bad & unseen)
    assert len((unseen - bad) - kept) <= 0.02 * len(unseen - bad)
    assert {r["doc_id"] for r in keep_sample(docs, labels).collect()} == kept
    assert {r["doc_id"] for r in resample(docs.repartition(5), labels).collect()} == kept


def test_noise_draws_by_weight(spark):
    """At a high temperature the draw is close to even, so texts of both kinds are drawn."""
    docs, labels, bad, _ = planted(spark)
    kept = {r["doc_id"] for r in resample(docs, labels, Resampling(temperature=50.0)).collect()}
    assert 0.1 < len(kept & bad) / len(kept) < 0.3


def test_kth_largest(spark):
    rng = random.Random(4)
    values = [rng.choice([5, -(1 << 40), rng.randrange(-(1 << 45), 1 << 45), rng.randrange(9)]) for _ in range(500)]
    frame = spark.createDataFrame([(v,) for v in values] + [(None,)], "v long")
    for k in (1, 2, 17, 250, 500):
        assert kth_largest(frame, "v", k) == sorted(values, reverse=True)[k - 1]
    assert kth_largest(frame, "v", 9999) == min(values) and kth_largest(frame, "v", 0) is None
    assert kth_largest(frame.where("false"), "v", 3) is None


def test_awkward_rows(spark):
    docs = clashing(awkward(spark))
    labels = spark.createDataFrame([(6, 1, 0), (8, 1, 0), (8, 1, 0), (5, 0, 0), (None, 1, 0), (7, None, 0), (999, 1, 1)], LABELS)
    kept = resample(docs, labels)
    assert kept.columns == ["doc_id", "log_weight", "sample_key"] and 0 < kept.count() <= docs.count()
    left = keep_sample(docs, labels)
    assert left.columns == docs.columns and left.count() == kept.count()
    none = spark.createDataFrame([], LABELS)
    assert keep_sample(docs, none).count() == docs.count()
    assert resample(empty(spark), labels).collect() == [] and keep_sample(empty(spark), none).collect() == []


def plain_ngrams(text, plain, lower):
    """(kind, cell) of every n-gram, one word at a time."""
    mask = (1 << 64) - 1

    def digest(hasher, word):
        return int(hasher.words(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))[0])

    def cell(kind, value):
        return kind, int(m.mixed(np.array([(value + kind) & mask], np.uint64))[0]) >> (64 - m.BITS)

    words = [w for w in (text or "").encode().split()]
    whole = [digest(lower, w) for w in words]
    found = [cell(0, d) for d in whole]
    for w in words:
        found += [cell(1, digest(lower, w[:4])), cell(2, digest(lower, w[:5])), cell(3, digest(plain, w[-3:]))]
    return found + [cell(4, (a * 3 + b) & mask) for a, b in zip(whole, whole[1:])]


def test_weights_equal_plain_ones(spark):
    rows = [(k, prose(k, 5 + k % 30, 40) + (" FOULword" * (k % 7 == 0)), "en", "a", 1) for k in range(120)]
    rows += [(500, None, None, None, None), (501, "", None, None, None), (502, "one", None, None, None)]
    docs, how = spark.createDataFrame(rows, SCHEMA), Resampling(z=1.5, prior=3.0, temperature=0.5)
    target = np.array([k for k in range(120) if k % 7 and k % 2])
    got = m.weighted(docs, m.log_ratios(*m.counts(docs, target, "doc_id", "text"), how.z), how, "text", "log_weight").collect()

    plain, lower = Hasher(lower=False), Hasher()
    grams = {r[0]: plain_ngrams(r[1], plain, lower) for r in rows}
    raw = Counter(g for found in grams.values() for g in found)
    good = Counter(g for k in target.tolist() for g in grams[k])
    sums = [[sum(n for g, n in c.items() if g[0] == kind) for kind in range(m.KINDS)] for c in (raw, good)]

    def ratio(g):
        n = good[g]
        return min(0.0, math.log((n + how.z * math.sqrt(n) + how.z**2 / 2 + 0.5) / (raw[g] * sums[1][g[0]] / sums[0][g[0]])))

    for row in got:
        want = sum(map(ratio, grams[row["doc_id"]])) / (len((row["text"] or "").split()) + how.prior) / how.temperature
        assert row["log_weight"] == pytest.approx(want, abs=1e-9)
    assert len({r["log_weight"] for r in got}) > 20


def test_a_word_counts_as_a_whole(spark):
    """Words alike in their first five and last three bytes are still told apart."""
    rows = [(k, prose(k, 40, 100) + (" fineXXXXword" if k % 4 else " fineXYYYword"), "en", "a", 1) for k in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA)
    target = np.array([k for k in range(400) if k % 4])
    ratios = m.log_ratios(*m.counts(docs, target, "doc_id", "text"), 2.0)
    asked = spark.createDataFrame([(1, "fineXXXXword", "", "", 1), (2, "fineXYYYword", "", "", 1)], SCHEMA)
    weight = {r["doc_id"]: r["log_weight"] for r in m.weighted(asked, ratios, Resampling(), "text", "log_weight").collect()}
    assert weight[1] == 0 and weight[2] < -10


def test_draws_follow_the_weights(spark):
    """The first and the first two of five texts, in 20,000 draws, come as often as drawing without replacement says."""
    logs = [0.0, -0.3, -1.0, -2.0, -4.0]
    draws = spark.range(20_000 * 5).select("id", (F.col("id") % 5).alias("text"), F.floor(F.col("id") / 5).alias("draw"))
    draws = draws.withColumn("log_weight", F.element_at(F.array(*map(F.lit, logs)), (F.col("text") + 1).cast("int")))
    keyed = draws.withColumn("key", m._key("log_weight", "id", Resampling()))
    ordered = keyed.groupBy("draw").agg(F.expr("reverse(array_sort(collect_list(struct(key, text)))).text").alias("top"))
    pairs = Counter({(r["a"], r["b"]): r["count"] for r in ordered.groupBy(F.col("top")[0].alias("a"), F.col("top")[1].alias("b")).count().collect()})
    share = [math.exp(x) for x in logs]
    for a in range(5):
        first = share[a] / sum(share)
        assert abs(sum(pairs[a, b] for b in range(5)) / 20_000 - first) < 4 * math.sqrt(first / 20_000) + 1e-3
        for b in set(range(5)) - {a}:
            both = first * share[b] / (sum(share) - share[a])
            assert abs(pairs[a, b] / 20_000 - both) < 4 * math.sqrt(both / 20_000) + 1e-3
