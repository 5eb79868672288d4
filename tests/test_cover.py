"""Cover density against a plain search over all runs of a text."""

import random
import re

import pytest

from cairn.functions.text import cover_density, matches, query_terms


def plain(text, query):
    alternatives = query_terms(query)
    tokens = re.findall(r"[^\W_]+", text.lower())
    named = {t for terms in alternatives for term in terms for t in term.tokens}
    entries = [(pos, token) for pos, token in enumerate(tokens) if token in named]

    def holds(run, term):
        width = len(term.tokens)
        for k in range(len(run) - width + 1):
            part = run[k : k + width]
            if tuple(t for _, t in part) == term.tokens and part[-1][0] - part[0][0] == width - 1:
                return True
        return False

    def satisfied(run):
        return bool(run) and any(all(holds(run, term) is term.wanted for term in terms) for terms in alternatives)

    total, start = 0.0, 0
    while True:
        end = next((e for e in range(start, len(entries)) if satisfied(entries[start : e + 1])), None)
        if end is None:
            return total
        begin = max(b for b in range(start, end + 1) if satisfied(entries[b : end + 1]))
        total += 1 / (1 + entries[end][0] - entries[begin][0] - (end - begin))
        start = begin + 1


QUERIES = [
    "a", "a b", "b a c", "a b c d", '"a b"', '"a b" c', '"a b a" b', '"a a"', "a or b", "a b or c", '"a b" or c d', "a_b c",
    "a -b", "a or c -b", '-"a b" c', 'a b -c or d -"b a"', "-a", "a a", "x y",
]


@pytest.mark.parametrize("seed", range(2))
def test_equals_plain_search(spark, seed):
    rng = random.Random(seed)
    texts = ["", "a", "b a", "A-b  a_c!", "é a b"]
    texts += [" ".join(rng.choice("aabbccdxyz") for _ in range(rng.randrange(1, 25))) for _ in range(60)]
    frame = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string").coalesce(1)
    found = frame.select("text", *(cover_density(frame["text"], query_terms(q)).alias(f"q{k}") for k, q in enumerate(QUERIES))).collect()
    for row in found:
        for k, query in enumerate(QUERIES):
            assert row[f"q{k}"] == pytest.approx(plain(row["text"] or "", query)), (row["text"], query)


def test_a_match_has_a_cover(spark):
    frame = spark.createDataFrame([("b x a",), ("a b",), ("c",), ("",)], "text string")
    for query in ("a b", '"a b"', "c or a b"):
        terms = query_terms(query)
        for row in frame.select(matches(frame["text"], terms).alias("m"), cover_density(frame["text"], terms).alias("d")).collect():
            assert row["m"] == (row["d"] > 0)
