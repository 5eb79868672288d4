"""Quality rules: counts against plain code, verdicts against a numpy estimate, planted junk."""

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from cairn.llm import outliers as o
from tests.llm.data import SCHEMA, awkward, clashing, empty, prose


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    runs = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {k + d for k in range(len(words) - 2) if runs[tuple(words[k : k + 3])] > 1 for d in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def odd_texts():
    rng = random.Random(3)
    found = ["a a a a a", "a b c a b c", "x y\nx y\n\n \nx y", "# * $|<>", "  lead\ttail  ", "a\x0bb\x0cc\rd", "é b ü", "a b c d a b", None, ""]
    found += [" ".join(rng.choice("ab") for _ in range(rng.randrange(30))) for _ in range(60)]
    found += ["\n".join(prose(k, 12, 3) for k in range(20)), prose(1, 9_000, 30)]
    return found


def test_statistics(spark):
    texts = odd_texts()
    frame = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    for got in o.statistics(frame, "text", F.col("k")).collect():
        assert tuple(got)[1:] == plain(texts[got["k"]]), texts[got["k"]]


def corpus(spark):
    rng = random.Random(9)
    rows = []
    for k in range(900):
        text = prose(k, int(60 * np.exp(rng.gauss(0.8, 0.6))) + 50, 5000)
        if k % 30 == 0:
            text = " ".join(w + rng.choice(["###", "%%%", "$$$"]) for w in text.split())
        if k % 30 == 1:
            words = text.split()
            text = " ".join("".join(words[j : j + 3]) for j in range(0, 3 * 60, 3)) if len(words) >= 180 else text.replace(" ", "~~~~~~~~ ")
        rows.append((k, text, "en", "ab"[k % 2], 1))
    return spark.createDataFrame(rows, SCHEMA)


def test_planted_junk_goes_and_the_rest_stays(spark):
    got = {r["doc_id"]: r["kept"] for r in o.outliers(corpus(spark)).collect()}
    junk = {k for k in got if k % 30 in (0, 1)}
    assert not any(got[k] for k in junk)
    assert sum(not got[k] for k in got if k not in junk) <= 2


def repeating(k, words, lines):
    """200 words in lines of three; ``words`` of them in repeated runs, ``lines`` repeated lines."""
    rng = random.Random(k)
    fresh = [f"w{rng.randrange(5000)}x{rng.randrange(3)}" for _ in range(600)]
    body = [fresh[3 * j : 3 * j + 3] for j in range(66)]
    for j in range(lines):
        body[2 * j + 1] = list(body[2 * j])
    text = [" ".join(line) for line in body]
    run = " ".join(fresh[300:303])
    return "\n".join(text) if lines else " ".join(text[: 66 - words // 3] + [f"{run} {fresh[400 + j]}" for j in range(words // 3)])


def test_each_statistic_rejects_alone_just_under_the_base_limits(spark):
    """Where no other text repeats anything or has symbols; the least that a text can have of each is kept."""
    rng = random.Random(5)
    planted = {
        1000: repeating(1, 99, 0), 1001: repeating(2, 0, 16), 1002: repeating(3, 60, 0), 1003: repeating(4, 0, 8),
        1004: " ".join(w + "$" * (j % 11 == 0) for j, w in enumerate(prose(6, 200, 5000).split())),
    }
    slight = {1100: prose(7, 200, 5000) + "$", 1101: repeating(8, 0, 1), 1102: repeating(9, 6, 0)}
    rows = [(k, prose(k, int(60 * np.exp(rng.gauss(0.8, 0.6))) + 50, 5000), "en", "a", 1) for k in range(400)]
    rows += [(k, text, "en", "a", 1) for k, text in {**planted, **slight}.items()]
    got = {r["doc_id"]: r for r in o.outliers(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not any(got[k]["base_failed"] for k in [*planted, *slight])
    assert [k for k in planted if got[k]["kept"]] == []
    assert [k for k in slight if not got[k]["kept"]] == []


def vectors(rows):
    n = np.array([r["n_words"] for r in rows], float)
    x = np.stack(
        [np.log(n), np.log1p(np.array([r["word_chars"] for r in rows]) / n), np.log1p(100 * np.array([r["n_symbols"] for r in rows]) / n),
         np.sqrt(np.array([r["n_dup_lines"] for r in rows]) / n), np.sqrt(np.array([r["n_repeat_words"] for r in rows]) / n)], axis=1)
    return np.floor(x * 512 + 0.5) / 512


def square_distances(x, center, cov):
    return np.einsum("ij,jk,ik->i", x - center, np.linalg.inv(cov), x - center)


def bins_of(x, center, cov):
    return np.floor(16 * np.log2(1 + square_distances(x, center, cov)))


def estimated(x, how):
    """Center, covariance and scale by four starts and concentration steps on arrays, and the determinants of the starts."""
    floors = np.diag(np.square(how.floors))

    def step(center, cov):
        b = bins_of(x, center, cov)
        inside = np.array([(b < v).sum() < how.part * len(b) for v in b])
        return x[inside].mean(axis=0), np.cov(x[inside].T, bias=True) + floors

    q = np.percentile(x, [25, 50, 75], axis=0)
    d = np.sqrt(((q[2] - q[0]) / 1.349) ** 2 + np.square(how.floors))
    z = (x - q[1]) / d
    length = np.sqrt((z**2).sum(axis=1))
    whole = lambda v: np.sign(v) * np.floor(np.abs(v) * 512 + 0.5) / 512

    def related(v):
        c = np.cov(v.T, bias=True)
        s = np.sqrt(np.diag(c))
        both = np.outer(s, s)
        r = np.divide(c, both, out=np.zeros_like(c), where=both > 0)
        np.fill_diagonal(r, 1)
        return r * np.outer(d, d) + floors

    tried = [
        (q[1], np.diag(d**2)),
        (x.mean(axis=0), np.cov(x.T, bias=True) + floors),
        (q[1], related(whole(np.tanh(z)))),
        (q[1], related(whole(z / np.where(length > 0, length, 1)[:, None]))),
    ]
    for _ in range(how.trials):
        tried = [step(*t) for t in tried]
    determinants = [np.linalg.slogdet(c)[1] for _, c in tried]
    best = tried[int(np.argmin(np.round(determinants, 9)))]
    for _ in range(how.steps):
        best = step(*best)
    b = bins_of(x, *best)
    middle = max(v for v in b if 2 * (b < v).sum() <= len(b))
    return *best, max(1.0, (2 ** ((middle + 0.5) / 16) - 1) / o.MEDIAN), determinants


def test_estimate_equals_numpy(spark):
    """Starts, choice, concentration steps and the pull towards the language, played out on arrays."""
    how = o.Robust()
    rows = [r for r in o.outliers(corpus(spark), how).collect() if not r["base_failed"]]
    group = [r for r in rows if r["doc_id"] % 2 == 0]
    wide, own, n = estimated(vectors(rows), how), estimated(vectors(group), how), len(group)
    # The only language is all rows, so only the source is drawn.
    drawn = [n / (n + p) * a + p / (n + p) * b for p, a, b in zip((how.pull / 5, how.pull, how.pull), own, wide, strict=False)]
    want = square_distances(vectors(group), drawn[0], drawn[1]) / drawn[2]
    np.testing.assert_allclose([r["distance"] for r in group], want, rtol=1e-6, atol=1e-9)


def skewed(spark):
    """Lengths and symbols that go together in most texts, and a tight group off the line that a diagonal start takes in."""
    rng = random.Random(21)
    rows = []
    for k in range(400):
        n = int(np.exp(rng.gauss(5.5, 0.8))) + 60
        share = min(0.9, 0.02 * (n / 200) ** 1.5) if k % 4 else 0.9
        n = n if k % 4 else 70
        rows.append((k, " ".join(w + "$" * (rng.random() < share) for w in prose(k, n, 5000).split()), "en", "a", 1))
    return spark.createDataFrame(rows, SCHEMA)


def test_the_smallest_determinant_wins(spark):
    how = o.Robust()
    rows = [r for r in o.outliers(skewed(spark), how).collect() if not r["base_failed"]]
    center, cov, scale, determinants = estimated(vectors(rows), how)
    assert max(determinants) - min(determinants) > 0.01  # the starts do differ
    want = square_distances(vectors(rows), center, cov) / scale
    np.testing.assert_allclose([r["distance"] for r in rows], want, rtol=1e-6, atol=1e-9)


def test_very_long_words_do_not_overflow(spark):
    """Means of 100,000 characters a word: squares of raw means, summed as longs, would pass 2^63."""
    rows = spark.range(4_000).select(
        F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit("a").alias("source"), F.lit(60).cast("long").alias("n_words"), (F.lit(6_000_000_000) + F.col("id")).alias("word_chars"),
        *(F.lit(0).cast("long").alias(c) for c in ("n_symbols", "n_dup_lines", "n_repeat_words")),
    )
    judged = rows.select(*o._vector(), F.lit("all").alias("group"))
    how = o.Robust()
    found = o._concentrated(o._binned(judged, o._starts(judged, o._middles(judged, how), how)), how).collect()
    assert len(found) == 4 and all(abs(r["m1"] - np.log(100_000_000)) < 0.01 for r in found)
    text = " ".join("x" * 100_000 for _ in range(51))
    assert len(o.outliers(spark.createDataFrame([(k, f"{text} {k}", "en", "a", 1) for k in range(3)], SCHEMA)).collect()) == 3


def test_small_sources_are_judged_by_themselves_without_a_jump(spark):
    """A text like those of a big source stands out in a small one, and a row more moves no distance by much."""

    def rows(small):
        found = [(k, prose(k, 300, 5000), "en", "big", 1) for k in range(250)]
        wide = [(1000 + k, prose(k, 300, 5000).replace(" ", " long", 200), "en", "small", 1) for k in range(small)]
        return [*found, *wide, (5000, prose(7777, 300, 5000), "en", "small", 1), (5001, None, "en", None, 1), (5002, prose(3, 300, 5000), "en", None, 1)]

    def judged(small, **how):
        frame = o.outliers(spark.createDataFrame(rows(small), SCHEMA), o.Robust(**how))
        return {r["doc_id"]: r for r in frame.collect()}

    some = judged(60)
    assert not some[5000]["kept"]
    assert all(some[1000 + k]["kept"] for k in range(60))
    assert some[5002]["kept"] and not some[5001]["kept"]
    before, after = judged(198), judged(199)
    for k in (5000, 1000, 1100):
        assert abs(before[k]["distance"] - after[k]["distance"]) <= 0.1 * after[k]["distance"] + 0.1
    joined = judged(60, groups_to_send=0)
    assert all(joined[k]["distance"] == some[k]["distance"] for k in some)


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = o.outliers(clashing(docs)).drop("distance").collect()
    assert len(got) == docs.count()
    assert all(r["base_failed"] and not r["kept"] for r in got if r["n_words"] < 50)
    assert sorted(map(repr, got)) == sorted(map(repr, o.outliers(docs).drop("distance").collect()))
    assert o.outliers(empty(spark)).collect() == []
