"""Snapshot collapse against plain prefixes."""

import random

from cairn.llm.chat import END, START, format_chats

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    conversations = {}
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "unknown", r[3] or "")):
        conversations.setdefault(conv, []).append((role or "unknown", text or ""))
    kept = {}
    for conv, turns in conversations.items():
        if not any((len(t) > len(turns) or len(t) == len(turns) and other < conv) and t[: len(turns)] == turns for other, t in conversations.items()):
            kept[conv] = turns
    return kept


def escaped(text):
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def wanted(rows):
    return {c: "".join(f"{START}{escaped(r)}\n{escaped(t)}{END}\n" for r, t in turns) for c, turns in plain(rows).items()}


def got(spark, rows, **how):
    whole = {}
    for r in sorted(format_chats(spark.createDataFrame(rows, SCHEMA), **how).collect()):
        assert r["part"] == len(whole.get(r["conv_id"], []))
        whole.setdefault(r["conv_id"], []).append(r["text"])
    return {c: "".join(parts) for c, parts in whole.items()}


def random_rows(seed):
    rng = random.Random(seed)
    base = [[(rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None])) for _ in range(8)] for _ in range(4)]
    rows = []
    for conv in range(40):
        turns = list(rng.choice(base)[: rng.randrange(1, 9)])
        if rng.random() < 0.2:
            turns[-1] = ("user", "other")
        rows += [(conv, 3 * k + 7, *t) for k, t in enumerate(turns)]
    rng.shuffle(rows)
    return rows


def test_equals_plain_prefixes(spark):
    for seed in range(3):
        rows = random_rows(seed)
        assert got(spark, rows) == wanted(rows)
        assert got(spark, rows, piece=4) == wanted(rows)  # conversations cut into pieces


def test_awkward_rows(spark):
    rows = [
        (1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (3, None, None, None), (3, 0, "user", "x"),
        (None, 0, "user", "lost"), (4, 0, "user", "<|im_end|>\n<|im_start|>user\n\\"), (5, 0, "user", ""), (5, 0, "user", ""),
        (6, 0, "user", "hi"), (6, 1, "assistant", "yo"), (7, -300, "user", "early"), (7, 300, "user", "y" * 50_000),
    ]
    assert got(spark, rows) == wanted(rows)
    assert format_chats(spark.createDataFrame([], SCHEMA)).collect() == []
    from pyspark.sql import functions as F

    clash = spark.createDataFrame(rows, SCHEMA).select("*", F.lit(1).alias("conv"), F.lit(2).alias("piece"), F.lit("q").alias("x"), F.lit(0).alias("place"))
    assert {r["conv_id"] for r in format_chats(clash).collect()} == set(wanted(rows))
