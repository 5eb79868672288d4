"""Benchmark decontamination: a BM25 index of test items, searched by every training passage.

The items (few) are the indexed side and the passages (many) the queries. A passage is a window of two
segments of a text, a segment as long as the longest item, so every item that a text holds lies whole
in some passage. A BM25 score is given as a share of the score that the item reaches with itself.

1. Posting lists are cut at the same items into blocks, and each block keeps its largest weight. A passage's
   terms bound its score in every block; blocks that cannot reach ``score`` are skipped for all passages of
   a batch at once.
2. In the blocks left, WAND moves cursors over the passage's posting lists by pivots and returns every item
   at ``score`` or more.
3. A hit counts if enough runs of words of the item's question and of its answer stand in the passage.
   The answer is the item's last sentences, a third of its words at least.

Items are taken in shards of at most ``shard`` items; only one shard's index is sent to the executors at
a time, so its size is bounded whatever the benchmark's. Document frequencies cover all items.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.jobs import cut, send, sent, text_column
from cairn.llm.textblocks import Block, Hasher, blocks, window_digests, word_bounds


@dataclass(frozen=True)
class Decontamination:
    """Least share of an item's own score, least share of the word runs of question and of answer, words a
    run, BM25's k1 and b, items an index shard, items a block."""

    score: float = 0.5
    overlap: float = 0.5
    run: int = 5
    k1: float = 1.2
    b: float = 0.75
    shard: int = 20_000
    block: int = 4


@dataclass
class Index:
    """One shard: sorted term digests, their postings by item, the blocks of each posting list (in rows
    ``ranges[t]`` to ``ranges[t + 1]``: block, largest weight, first posting), and each item's word runs."""

    terms: np.ndarray
    places: np.ndarray
    weights: np.ndarray
    ranges: np.ndarray
    block: np.ndarray
    most: np.ndarray
    first: np.ndarray
    blocks: int
    items: list[int]
    parts: list[tuple[tuple[int, np.ndarray], tuple[int, np.ndarray]]]
    segment: int
    seen: np.ndarray = field(default_factory=lambda: np.zeros(1 << 20, bool))

    def __post_init__(self) -> None:
        self.seen[(self.terms & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words that are terms, and their terms."""
        at = np.flatnonzero(self.seen[(words & np.uint64((1 << 20) - 1)).astype(np.int64)])
        term = np.searchsorted(self.terms, words[at])
        term[term == len(self.terms)] = 0
        right = self.terms[term] == words[at]
        return at[right], term[right]


def digests(text: str | None, hasher: Hasher) -> np.ndarray:
    data = np.frombuffer((text or "").encode(), np.uint8)
    starts, ends = word_bounds(data, np.array([0, len(data)])) if len(data) else (np.empty(0, np.int64),) * 2
    return hasher.words(data, starts, ends)


def question_and_answer(text: str) -> tuple[str, str]:
    """The answer is the shortest run of last sentences with a third of the words, or the later half of
    an item that has no such sentences; one word is both parts."""
    size = len(text.split())
    for end in reversed([m.end() for m in re.finditer(r"[.!?…。](?=\s)", text.rstrip())]):
        answer = len(text[end:].split())
        if 3 * answer >= size:
            if 3 * answer <= 2 * size:
                return text[:end], text[end:]
            break
    words = text.split()
    half = (len(words) + 1) // 2
    return " ".join(words[:half]), " ".join(words[half:]) or text


def _runs(text: str, run: int, hasher: Hasher) -> tuple[int, np.ndarray]:
    words = digests(text, hasher)
    n = min(run, len(words))
    return n, np.unique(window_digests(words, n)) if n else np.empty(0, np.uint64)


def build_index(rows: list, count: int, mean: float, how: Decontamination) -> Index:
    """From one shard's rows (item_id, text, terms of term and document frequency)."""
    hasher = Hasher()
    postings: dict[int, list[tuple[int, float]]] = {}
    items, parts, longest = [], [], 1
    for row in rows:
        words = digests(row["text"], hasher)
        if not len(words):
            continue
        idf = {t["term"] & 0xFFFFFFFFFFFFFFFF: np.log(1 + (count - t["df"] + 0.5) / (t["df"] + 0.5)) for t in row["terms"]}
        own, times = np.unique(words, return_counts=True)
        norm = how.k1 * (1 - how.b + how.b * len(words) / mean)
        weights = np.array([idf[int(t)] for t in own]) * times * (how.k1 + 1) / (times + norm)
        place = len(items)
        for t, w in zip(own.tolist(), (weights / weights.sum()).tolist(), strict=True):
            postings.setdefault(t, []).append((place, w))
        items.append(row["item_id"])
        question, answer = question_and_answer(row["text"])
        parts.append((_runs(question, how.run, hasher), _runs(answer, how.run, hasher)))
        longest = max(longest, len(words))
    terms = np.array(sorted(postings), np.uint64)
    counts = [len(postings[t]) for t in terms.tolist()]
    term = np.repeat(np.arange(len(terms)), counts)
    places = np.array([p for t in terms.tolist() for p, _ in postings[t]], np.int64)
    weights = np.array([w for t in terms.tolist() for _, w in postings[t]])
    block = places // how.block
    new = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (block[1:] != block[:-1]))) if len(term) else np.empty(0, np.int64)
    ranges = np.searchsorted(term[new], np.arange(len(terms) + 1))
    most = np.maximum.reduceat(weights, new) if len(new) else weights
    return Index(terms, places, weights, ranges, block[new], most, np.append(new, len(term)), -(-len(items) // how.block), items, parts, max(longest, 32))


def wand(index: Index, query: np.ndarray, block: int, least: float) -> list[tuple[int, float]]:
    """Every (item place, score) of one block at ``least`` or more, by WAND over the query's posting lists."""
    cursors = []  # current item, place in the list, end of the list, the list's largest weight in this block
    for term in query.tolist():
        from_, to = int(index.ranges[term]), int(index.ranges[term + 1])
        row = from_ + int(np.searchsorted(index.block[from_:to], block))
        if row < to and index.block[row] == block:
            at = int(index.first[row])
            cursors.append([int(index.places[at]), at, int(index.first[row + 1]), float(index.most[row])])
    found, slack = [], least - 1e-9
    while True:
        cursors = sorted(c for c in cursors if c[1] < c[2])
        bound, pivot = 0.0, None
        for c in cursors:
            bound += c[3]
            if bound >= slack:
                pivot = c[0]
                break
        if pivot is None:
            return found
        if cursors[0][0] == pivot:
            score = sum(float(index.weights[c[1]]) for c in cursors if c[0] == pivot)
            if score >= slack:
                found.append((pivot, score))
            pivot += 1
        for c in cursors:
            if c[0] < pivot:
                c[1] += int(np.searchsorted(index.places[c[1] : c[2]], pivot))
                c[0] = int(index.places[c[1]]) if c[1] < c[2] else pivot


def open_blocks(index: Index, segment: np.ndarray, term: np.ndarray, many: int, alone: np.ndarray, least: float) -> Iterator[tuple[int, int]]:
    """(first segment of a passage, block) where the block's bound reaches ``least``. ``segment`` is sorted."""
    step = max(1, (1 << 21) // max(1, index.blocks))
    for from_ in range(0, many, step):
        to = min(from_ + step, many)
        a, b = np.searchsorted(segment, [from_, to + 1])
        own, rows = segment[a:b] - from_, index.ranges[term[a:b]]
        times = index.ranges[term[a:b] + 1] - rows
        at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(rows, times)
        keys = np.repeat(own, times) * index.blocks + index.block[at]
        sums = np.bincount(keys, index.most[at], (to - from_ + 1) * index.blocks).reshape(-1, index.blocks)
        bounds = sums[:-1] + np.where(alone[from_:to, None], 0.0, sums[1:])
        for s, block in np.argwhere(bounds >= least - 1e-9).tolist():
            yield from_ + s, block


def _overlap(part: tuple[int, np.ndarray], words: np.ndarray, known: dict[int, np.ndarray]) -> float:
    n, wanted = part
    if not n:
        return 0.0
    if n not in known:
        known[n] = window_digests(words, n)
    return float(np.isin(wanted, known[n]).mean())


def hits(block: Block, index: Index, hasher: Hasher, how: Decontamination) -> Iterator[tuple[int, int, float, float, float]]:
    """(row, item place, score, question's share, answer's share) of the block's verified hits, the best of each item."""
    words = hasher.words(block.data, block.starts, block.ends)
    if not len(words) or not len(index.terms):
        return
    at, term = index.find(words)
    lengths = np.diff(block.first)
    many = -(-lengths // index.segment)  # segments of each text
    base = np.concatenate([[0], np.cumsum(many)])
    row_of_word = np.searchsorted(block.first, at, "right") - 1
    segment = base[row_of_word] + (at - block.first[row_of_word]) // index.segment
    keys = np.unique(segment * len(index.terms) + term)
    segment, term = np.divmod(keys, len(index.terms))
    row_of_segment = np.repeat(np.arange(len(block)), many)
    alone = np.append(row_of_segment[1:] != row_of_segment[:-1], True)
    edges = np.searchsorted(segment, np.arange(base[-1] + 2))
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    for s, part in open_blocks(index, segment, term, int(base[-1]), alone, how.score):
        row = int(row_of_segment[s])
        query = np.unique(term[edges[s] : edges[s + (1 if alone[s] else 2)]])
        found = wand(index, query, part, how.score)
        if not found:
            continue
        from_ = int(block.first[row]) + (s - int(base[row])) * index.segment
        passage, known = words[from_ : min(from_ + 2 * index.segment, int(block.first[row + 1]))], {}
        for item, score in found:
            question, answer = (_overlap(wanted, passage, known) for wanted in index.parts[item])
            if question >= how.overlap and answer >= how.overlap:
                best[row, item] = max(best.get((row, item), (0.0, 0.0, 0.0)), (score, question, answer))
    for (row, item), values in best.items():
        yield row, item, *values


def shards(items: DataFrame, how: Decontamination, id: str, text: str) -> Iterator[Index]:
    """The indexes of the shards, one after another."""

    def terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            found = [digests(t, hasher) for t in batch.column("text").to_pylist()]
            terms = pa.array([np.unique(f).view(np.int64) for f in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, terms, pa.array([len(f) for f in found], pa.int64())], ["item_id", "text", "own", "size"])

    rows = items.select(F.col(id).cast("long").alias("item_id"), text_column(text).alias("text")).distinct()
    rows = rows.mapInArrow(terms_of, "item_id long, text string, own array<long>, size long").where("size > 0")
    rows = cut(rows.withColumn("item", F.xxhash64("item_id", "text")))
    count, mean = rows.agg(F.count("*"), F.avg("size")).first()
    if not count:
        return
    each = rows.select("item", F.explode("own").alias("term"))
    frequency = each.groupBy("term").agg(F.count("*").alias("df"))
    terms = each.join(frequency, "term").groupBy("item").agg(F.collect_list(F.struct("term", "df")).alias("terms"))
    full = cut(rows.select("item", "item_id", "text").join(terms, "item"))
    parts = -(-count // how.shard)
    for part in range(parts):
        own = full.where(F.pmod(F.col("item"), F.lit(parts)) == part).collect()
        if own:
            own.sort(key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"]))
            yield build_index(own, count, mean, how)


FOUND = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def contaminated(docs: DataFrame, items: DataFrame, how: Decontamination = Decontamination(), id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) for each document and item it holds.

    Null and empty texts hold nothing; an item without words is held by nothing. Repeated items count
    once, repeated documents each give their rows. Letters A-Z match in either case. Only the two
    columns of either table are read. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id).cast("long").alias("id"), text_column(text).alias("text"))
    result = spark.createDataFrame([], FOUND)
    for index in shards(items, how, item_id, item_text):
        shared = send(spark, index)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            hasher, index = Hasher(), sent(shared)
            for block in blocks(batches):
                rows = list(hits(block, index, hasher, how))
                if rows:
                    ids = block.rows.column("id").to_pylist()
                    columns = [[ids[r[0]] for r in rows], [index.items[r[1]] for r in rows], *([r[k] for r in rows] for k in (2, 3, 4))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), *[pa.float64()] * 3), strict=True)], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        result = result.union(texts.mapInArrow(search, FOUND))
    return result


def decontaminate(docs: DataFrame, items: DataFrame, how: Decontamination = Decontamination(), text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns unchanged; rows pass through without a shuffle."""
    for index in shards(items, how, item_id, item_text):
        shared = send(docs.sparkSession, index)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            hasher, index = Hasher(), sent(shared)
            for block in blocks(batches, text):
                held = {r[0] for r in hits(block, index, hasher, how)}
                yield block.rows.filter(pa.array([k not in held for k in range(len(block))])) if held else block.rows

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
