"""Language model: base scores against plain counts, normalisation, and gain on held-out texts."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from cairn.llm import scoring as m
from cairn.llm.textblocks import Hasher
from tests.llm.data import SCHEMA, awkward, clashing, empty, prose


def tokens(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), "\n"]


def held(i):
    return zlib.crc32(str("" if i is None else i).encode()) % 7 == 2


def two_languages(n=300):
    """Texts that keep to one of two word lists with orders of their own."""
    rng, rows = random.Random(1), []
    for k in range(n):
        word, out = 0, []
        for _ in range(rng.randrange(30, 120)):
            word = (word * 3 + rng.randrange(1, 4)) % 150
            out.append(f"{'AB'[k % 2]}w{word}")
        rows.append((k, " ".join(out), "en", "a", 1))
    return rows


def check(spark, rows, how):
    docs = spark.createDataFrame(rows, SCHEMA)
    counts = Counter(t for i, text, *_ in rows if not held(i) for t in tokens(text))
    total, distinct = sum(counts.values()), len(counts)
    want = sorted(
        (repr(i), held(i), len(t), sum(counts[x] > 0 for x in t), total, round(sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in t), 6))
        for i, t in ((i, tokens(text)) for i, text, *_ in rows)
    )
    got = m.score(docs, how).collect()
    assert sorted((repr(r[0]), r[1], r[2], r[3], r[4], round(r[5], 6)) for r in got) == want
    return got


def test_scores(spark):
    for how in (m.Bilinear(), m.Bilinear(table=20)):  # with and without the join of rare words
        got = check(spark, two_languages(), how)
        new = [r for r in got if r["held_out"]]
        gain = sum(r["score"] - r["base_score"] for r in new) / sum(r["n_tokens"] for r in new)
        assert gain > 0.3, gain


def test_probabilities_sum_to_one():
    how = m.Bilinear()
    rng = np.random.default_rng(1)
    model = m.first_model(rng.integers(0, 1000, m.CLASSES).astype(float), how)
    model["out"] += rng.normal(0, 1, model["out"].shape)
    table = m.log_probabilities(model).reshape(-1, m.CLASSES)
    np.testing.assert_allclose((10.0 ** table[rng.integers(0, len(table), 200)]).sum(axis=1), 1, rtol=1e-4)


def test_training_nears_the_counted_distribution():
    how = m.Bilinear(size=8, batch=512)
    rng = np.random.default_rng(3)
    keys, counts = [], []
    for one in range(10):
        p = rng.dirichlet(np.ones(10) * 0.3) * 10_000
        for word in range(10):
            keys.append(one << 8 | word)
            counts.append(p[word] + 1)
    keys, counts = np.array(keys), np.array(counts)
    unigrams = np.bincount(keys & 255, counts, m.CLASSES)
    model, noise = m.first_model(unigrams, how), (unigrams + 0.5) / (unigrams + 0.5).sum()

    def loss(model):
        return -(counts * m.log_probabilities(model)[keys]).sum() / counts.sum()

    before = loss(model)
    for turn in range(300):
        model = m.train(model, keys, counts, noise, how, turn)
    best = -sum(counts[k] * np.log10(counts[k] / counts[(keys >> 8) == (keys[k] >> 8)].sum()) for k in range(100)) / counts.sum()
    assert loss(model) < before - 0.7 * (before - best)


def test_table_finds_all(spark):
    rng = np.random.default_rng(2)
    digests = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2))
    table = m.Table(digests.copy(), np.arange(len(digests)))
    asked = np.concatenate([digests[::7], digests[::5] + np.uint64(1)])
    want = np.concatenate([np.arange(len(digests))[::7], np.full(len(digests[::5]), -1)])
    assert (table.find(asked) == want).all()
    assert (m.Table(digests[:0], np.arange(0)).find(asked) == -1).all()


def test_awkward_rows(spark):
    rows = [tuple(r) for r in awkward(spark).collect()]
    got = check(spark, rows, m.Bilinear())
    again = m.score(clashing(awkward(spark))).collect()
    assert sorted(repr(r[:5]) for r in got) == sorted(repr(r[:5]) for r in again)
    assert m.score(empty(spark)).collect() == []
    only_held = spark.createDataFrame([(i, prose(i, 9), None, None, None) for i in range(60) if held(i)], SCHEMA)
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 and r["score"] < 0 for r in m.score(only_held).collect())


def trained(spark, rows, how):
    texts = spark.createDataFrame([(r[1] or "",) for r in rows if not held(r[0])], "text string")
    return m.learn(texts, how)


def plain_scores(rows, learned, how):
    """log10 probability of every text word by word, every softmax written out over all its members."""
    known, counts = learned.known, {r["digest"]: (r["bin"], r["n"]) for r in learned.counts.collect()}
    hasher = Hasher()

    def word_of(text):
        data = np.frombuffer(text.encode(), np.uint8)
        block = m.Block(None, data, np.array([0, len(data)]), np.array([0]), np.array([len(data)]), np.array([0, 1]))
        return int(hasher.words(data, block.starts, block.ends).view(np.int64)[0]), int(m.bins_of(block, hasher, how.bins)[0])

    ordered = sorted((-n, d) for d, (b, n) in counts.items() if b >= 0)
    names = {d: k + 1 for k, (_, d) in enumerate(ordered[: how.words])}
    alone = {d: m.CLASSES + k for k, (_, d) in enumerate(ordered[how.words :][: how.contexts])}
    own = sorted((counts[d][0], d) for n, d in ordered[how.words :][: how.vectors] if -n >= how.least)
    place = {}
    for b, d in own:
        place[d] = sum(counts[x][0] == b for x in place) + 1
    rest = {b: 1 + sum(n + 1 for d, (c, n) in counts.items() if c == b and d not in names and d not in place) for b in range(how.bins)}
    members = {b: [rest[b]] + [counts[d][1] + 1 for c, d in own if c == b] for b in range(how.bins)}
    found = []
    for _, text, *_ in rows:
        two = one = ahead = 0
        total = 0.0
        for token in tokens(text):
            if token == "\n":
                of, b, digest = 0, None, None
            else:
                digest, b = word_of(token)
                of = names.get(digest, b + 1 + how.words)
            context = learned.classes["far"][two] + learned.classes["near"][one]
            scores = learned.classes["out"] @ context + learned.classes["bias"]
            total += scores[of] - np.logaddexp.reduce(scores)
            if of > how.words:
                at = known.first[b]
                vectors = learned.inner.words[at : at + len(members[b])].astype(float)
                inside = vectors @ learned.inner.contexts[b, ahead].astype(float) + np.log(members[b])
                row = place.get(digest, 0)
                total += inside[row] - np.logaddexp.reduce(inside)
                if not row:
                    total += math.log((counts.get(digest, (b, 0))[1] + 1) / rest[b])
            two, one, ahead = one, of, alone.get(digest, of)
        found.append(total / math.log(10))
    return found


def test_scores_equal_plain_ones(spark):
    how = m.Bilinear(words=10, contexts=8, vectors=60, least=4, passes=3)
    rows = two_languages(60) + [(900 + k, t, None, None, None) for k, t in enumerate(["", None, "new words only", "Aw1 never Aw2 seen Bw7", "aw1 AW1"])]
    learned = trained(spark, rows, how)
    assert np.abs(learned.inner.words).max() > 0.05
    want = plain_scores(rows, learned, how)
    for how_ in (how, m.Bilinear(words=10, contexts=8, vectors=60, least=4, passes=3, table=100)):
        got = {r["doc_id"]: r["score"] for r in m.score(spark.createDataFrame(rows, SCHEMA), how_).collect()}
        np.testing.assert_allclose([got[r[0]] for r in rows], want, rtol=1e-3, atol=1e-2)


def test_rare_words_of_one_bin_are_told_apart(spark):
    """'rareone' follows 'left' and 'bareone' follows 'right'; both end alike, so they share a bin and its shares."""
    rng, rows = random.Random(3), []
    for k in range(400):
        words = prose(k, 40, 300).split()
        at = rng.randrange(39)
        words[at : at + 2] = ["left", "rareone"] if k % 2 else ["right", "bareone"]
        rows.append((k, " ".join(words), "en", "a", 1))
    asked = ["right bareone left rareone", "right rareone left bareone"]
    asked_ids = [i for i in range(1000, 2000) if held(i)][:2]
    rows += [(i, t, "en", "a", 1) for i, t in zip(asked_ids, asked, strict=True)]
    got = {r["doc_id"]: r["score"] for r in m.score(spark.createDataFrame(rows, SCHEMA), m.Bilinear(words=20)).collect()}
    assert got[asked_ids[0]] > got[asked_ids[1]] + 1


def test_words_with_vectors_grow_with_the_texts(spark):
    how = m.Bilinear()
    sizes = []
    for n in (50, 200, 800):
        rows = [(k, prose(k, 100, n), "en", "a", 1) for k in range(2 * n)]
        known = trained(spark, rows, how).known
        sizes.append(len(known.weights) - how.bins)
        assert (np.diff(known.first) >= 1).all() and (known.weights >= 1).all()
    assert sizes[0] == 150 - how.words and sizes[1] >= 450 and sizes[2] >= 2200, sizes


def test_a_bin_is_trained_towards_its_pairs():
    """Contrastive training of one bin nears the pairs' shares, and the normaliser is that of all rows."""
    how, rng = m.Bilinear(contexts=4, passes=60, batch=64), np.random.default_rng(5)
    shares = rng.dirichlet(np.ones(12) * 0.3, 6) * 5000
    rows, ahead = (x.ravel() for x in np.meshgrid(np.arange(12), np.arange(6)))
    counts = shares.ravel().round() + 1
    weights = np.bincount(rows, counts) + 1
    words, contexts = m.train_bin(rows, ahead, counts, weights, how, 1)
    scores = contexts.astype(float) @ words.T.astype(float) + np.log(weights)
    norms = m.normalisers(words, contexts, weights)
    np.testing.assert_allclose(norms, np.logaddexp.reduce(scores, axis=1), rtol=1e-6)
    logs = (scores - norms[:, None])[ahead, rows]
    given = (counts * logs).sum() / counts.sum()
    alone = (counts * np.log(weights / weights.sum())[rows]).sum() / counts.sum()
    best = (counts * np.log(counts / np.bincount(ahead, counts)[ahead])).sum() / counts.sum()
    assert given > alone + 0.7 * (best - alone), (alone, given, best)


def test_counting_holds_few_keys():
    taken = []

    def values(block):
        taken.append(len(taken))
        return np.arange(100_000, dtype=np.uint64) + np.uint64(100_000 * len(taken)), np.zeros(100_000, np.int8)

    batches = (pa.RecordBatch.from_arrays([pa.array(["a"])], ["text"]) for _ in range(12))
    counted = m._counted(batches, values, ("key", "also", "n"))
    first = next(counted).num_rows
    assert len(taken) <= 6
    assert first + sum(b.num_rows for b in counted) == 1_200_000 and len(taken) == 12


def test_a_task_holds_little(spark):
    """The bytes of a vocabulary and of the powers for digests."""
    known = m.vocabulary(m.count_words(spark.range(5000).selectExpr("concat('w', id) AS text"), m.Bilinear()), m.Bilinear())
    held = (known.frequent.digests, known.frequent.values, known.frequent.starts, known.n, known.classes, known.contexts, known.rows)
    assert len(known.n) == 5001 and sum(a.nbytes for a in held) <= 50 * len(known.n)
    hasher = Hasher(size=m.BLOCK)
    assert hasher.up.nbytes + hasher.down.nbytes <= 8 << 20
    whole = np.frombuffer(b"one Two " + b"x" * 300, np.uint8)
    starts, ends = np.array([0, 4, 8]), np.array([3, 7, 308])
    assert (Hasher(size=4).words(whole, starts, ends) == hasher.words(whole, starts, ends)).all()
