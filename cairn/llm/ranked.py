"""Ranked lexical search: every document against every item, by MaxScore with bounds of term pairs.

Terms are maximal runs of ASCII letters, digits and all characters beyond ASCII; A-Z count as a-z. A document scores
``w * ((10^9 tf) div (1000 tf + 12 m))`` for each of an item's terms, repeats included, in whole numbers, so the order of sums is
of no account. ``w`` falls with the share of documents that hold the term, ``m`` grows with a document's length.

1. Documents are split into terms once; a row keeps its length and the counts of those terms that items ask for.
   Counts of documents and terms are sums over all of them.
2. An index of blocks (at most ``block_docs`` documents and about ``block_postings`` postings each) is written: for every term of a block its
   documents and impacts with their maximum, and for pairs of terms the list of documents that hold both with
   the maximum of their joint impact. Pairs are those that stand side by side in an item whose terms are ordered by ``w``,
   so that both have about the same weight.
3. A block answers all items. The bounds of two paired terms combine: no document can get more from both than the larger of the joint maximum and
   either maximum, far less than their sum where they seldom meet. An item's pairs are picked without overlap, most saved first, other
   terms stay alone. First the lists of the best pairs are scored, which raises the threshold early. Then units (pairs and
   single terms) are sorted by bound; those at the low end, whose bounds together stay below the threshold, cannot bring a new
   document in. Documents of the other units are candidates; the low units are looked up for candidates only, and a
   candidate goes as soon as its score and the bounds left fall below the threshold. The threshold is the
   score of an item's last place so far in the task, so later blocks skip more.
4. Each task gives at most ``best`` rows an item; Spark ranks these per item, cutting to ``best`` before its shuffle as well.

Items are read in groups of at most about ``group_terms`` distinct (item, term) rows, which bounds what is sent to the tasks; every group
reads the documents once more. Nothing else grows with the data outside the tasks: a task holds one block.

Rows without terms (null or empty text) count nowhere and are never found. Document ids are whole numbers; equal scores go by ascending id, null last.
Repeated document rows are documents of their own. Rows of one item id are one item with the terms of all its distinct texts;
an item without terms, or with no document above 0, gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.jobs import cut

#: ASCII letters (small), digits and all bytes beyond ASCII stay; the rest parts terms.
TABLE = bytes(c if chr(c).isdigit() and c < 128 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


@dataclass(frozen=True)
class Ranking:
    best: int = 20
    block_docs: int = 16_384
    block_postings: int = 2_000_000
    primed_pairs: int = 4
    group_terms: int = 200_000


def terms(text: str) -> list[bytes]:
    return text.encode().translate(TABLE).split()


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(key, term, n) for key, text in zip(*(c.to_pylist() for c in batch.columns)) for term, n in Counter(terms(text)).items()]
        yield pa.record_batch(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64())],
            names=["key", "term", "n"],
        )


def _counter(vocabulary: dict[bytes, int]):
    """Rows (doc, n, terms, tfs) of documents with a term; only the vocabulary's terms are listed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = vocabulary.keys()
        for batch in batches:
            docs, lengths, ids, tfs = [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = terms(text)
                if not found:
                    continue
                counts = Counter(found)
                held = sorted((vocabulary[t], counts[t]) for t in counts.keys() & wanted)
                docs.append(doc)
                lengths.append(len(found))
                ids.append([t for t, _ in held])
                tfs.append([n for _, n in held])
            yield pa.record_batch(
                [pa.array(docs, pa.int64()), pa.array(lengths, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))],
                names=["doc", "n", "terms", "tfs"],
            )

    return count


def weigh(documents: int, frequencies: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in frequencies], dtype=np.int64)


def flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, row of each value) of a list column."""
    sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, dtype=np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lists)), sizes)


def block_index(lengths: np.ndarray, ids: np.ndarray, rows: np.ndarray, tfs: np.ndarray, numbers: tuple, pairs: np.ndarray):
    """{term: (its ordinals, impacts)} and [(a, b, ordinals of both, joint maximum)] of a block."""
    documents, tokens, weights = numbers
    m = 75 + (25 * lengths * documents) // tokens
    impacts = weights[ids] * ((1_000_000_000 * tfs) // (1000 * tfs + 12 * m[rows]))
    order = np.argsort(ids, kind="stable")
    ids, rows, impacts = ids[order], rows[order], impacts[order]
    cuts = np.flatnonzero(np.diff(ids)) + 1
    starts = np.concatenate([[0], cuts]) if len(ids) else np.zeros(0, dtype=np.int64)
    ends = np.append(starts[1:], len(ids))
    lists = {int(ids[s]): (rows[s:e], impacts[s:e]) for s, e in zip(starts, ends)}
    joint = []
    for a, b in pairs:
        first, second = lists.get(int(a)), lists.get(int(b))
        if first is None or second is None:
            continue
        both, i, j = np.intersect1d(first[0], second[0], assume_unique=True, return_indices=True)
        # A pair that never meets is listed as well: its joint maximum of 0 tightens the bound most.
        joint.append((int(a), int(b), both, int((first[1][i] + second[1][j]).max(initial=0))))
    return lists, joint


INDEX = "block long, a int, b int, ordinals array<int>, values array<long>, top long"


def _indexer(numbers: tuple, pairs: np.ndarray, block_docs: int, block_postings: int):
    """Rows of the index, a block's together: its documents (a = b = -1), its terms (b = -1), its pairs."""

    def rows_of(number: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        column = lambda name: table.column(name).chunk(0)
        lengths = column("n").to_numpy()
        ids, rows = flat(column("terms"))
        tfs = column("tfs").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        lists, joint = block_index(lengths, ids, rows, tfs, numbers, pairs)
        docs = column("doc").to_pylist()
        out = [(-1, -1, list(range(len(docs))), docs, 0)]
        out += [(t, -1, o.astype(np.int32), v, int(v.max())) for t, (o, v) in lists.items()]
        out += [(a, b, o.astype(np.int32), [], top) for a, b, o, top in joint]
        return pa.record_batch([
            pa.array([number] * len(out), pa.int64()), pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int32()),
            pa.array([o[2] for o in out], pa.list_(pa.int32())), pa.array([o[3] for o in out], pa.list_(pa.int64())), pa.array([o[4] for o in out], pa.int64()),
        ], names=["block", "a", "b", "ordinals", "values", "top"])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, docs, postings = 0, [], 0, 0
        for batch in batches:
            at = 0
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            while at < batch.num_rows:
                room = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), block_postings - postings, "right")))
                taken = min(room, block_docs - docs, batch.num_rows - at)
                held.append(batch.slice(at, taken))
                docs, postings, at = docs + taken, postings + int(sizes[at : at + taken].sum()), at + taken
                if docs >= block_docs or postings >= block_postings:
                    yield rows_of(number, held)
                    number, held, docs, postings = number + 1, [], 0, 0
        if docs:
            yield rows_of(number, held)

    return index


class Places:
    """The best (score, document) of an item so far."""

    def __init__(self, best: int):
        self.best, self.rows = best, []

    @property
    def threshold(self) -> int:
        return self.rows[-1][0] if len(self.rows) == self.best else 1

    def add(self, scores: np.ndarray, docs: list) -> None:
        self.rows += zip(scores.tolist(), docs)
        self.rows.sort(key=lambda r: (-r[0], r[1] is None, r[1] or 0))
        del self.rows[self.best :]


def units_of(wanted: dict[int, int], lists: dict, joint: dict[int, list]) -> list[tuple[int, tuple[int, ...]]]:
    """(bound, terms) of an item in a block, lowest bound first; disjoint pairs whose joint bound saves most, then single terms."""
    bound = {t: n * lists[t][2] for t, n in wanted.items() if t in lists}
    saved = []
    for a in bound:
        for b, both in joint.get(a, ()):
            if b in bound:
                least = min(wanted[a], wanted[b])
                # Of both terms ``least`` times the joint impact, and what one is asked for beyond that.
                together = least * both + (wanted[a] - least) * lists[a][2] + (wanted[b] - least) * lists[b][2]
                top = max(bound[a], bound[b], together)
                if top < bound[a] + bound[b]:
                    saved.append((bound[a] + bound[b] - top, a, b, top))
    units, left = [], dict(bound)
    for _, a, b, top in sorted(saved, reverse=True):
        if a in left and b in left:
            del left[a], left[b]
            units.append((top, (a, b)))
    return sorted(units + [(top, (t,)) for t, top in left.items()])


def scores_of(ordinals: np.ndarray, wanted: dict[int, int], lists: dict) -> np.ndarray:
    """The whole scores of some documents, by looking them up in every list."""
    found = np.zeros(len(ordinals), dtype=np.int64)
    for t, n in wanted.items():
        if t in lists:
            found += n * looked_up(ordinals, *lists[t][:2])
    return found


def looked_up(ordinals: np.ndarray, held: np.ndarray, impacts: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(held, ordinals), len(held) - 1)
    return np.where(held[at] == ordinals, impacts[at], 0)


def search_block(wanted: dict[int, int], docs: list, lists: dict, joint: dict[int, list], meets: dict, places: Places, primed: int) -> None:
    """Adds a block's best documents for one item to its places."""
    units = units_of(wanted, lists, joint)
    if not units or sum(top for top, _ in units) < places.threshold:
        return
    done = np.zeros(0, dtype=np.int32)
    best = [meets[p] for _, p in reversed(units) if len(p) == 2 and len(meets.get(p, ()))][:primed]
    if best:
        done = np.unique(np.concatenate(best))
        scores = scores_of(done, wanted, lists)
        fit = scores >= places.threshold
        places.add(scores[fit], [docs[k] for k in done[fit]])
    bounds = np.cumsum([top for top, _ in units])
    low = int(np.searchsorted(bounds, places.threshold, "left"))  # units whose bounds together stay below it
    scores = np.zeros(len(docs), dtype=np.int64)
    for _, unit in units[low:]:
        for t in unit:
            scores[lists[t][0]] += wanted[t] * lists[t][1]
    scores[done] = 0
    rest = int(bounds[low - 1]) if low else 0
    candidates = np.flatnonzero(scores >= max(1, places.threshold - rest))
    found = scores[candidates]
    for k in range(low - 1, -1, -1):
        if not len(candidates):
            return
        for t in units[k][1]:
            found = found + wanted[t] * looked_up(candidates, *lists[t][:2])
        rest -= units[k][0]
        stay = found + rest >= places.threshold
        candidates, found = candidates[stay], found[stay]
    stay = found >= places.threshold
    places.add(found[stay], [docs[k] for k in candidates[stay]])


def _searcher(keys: list[str], asked: list[dict[int, int]], best: int, primed: int):
    """Rows (key, doc, score): each item's best documents among the blocks of a task."""

    def blocks(batches):
        number, held = None, []
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for start, end in zip(cuts, cuts[1:]):
                if start == end:
                    continue
                if held and numbers[start] != number:
                    yield pa.Table.from_batches(held)
                    held = []
                number = numbers[start]
                held.append(batch.slice(start, end - start))
        if held:
            yield pa.Table.from_batches(held)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = [Places(best) for _ in asked]
        for table in blocks(batches):
            docs, lists, joint, meets = [], {}, {}, {}
            for batch in table.to_batches():
                _, firsts, seconds, ordinals, values, tops = batch.columns
                for k, (a, b, top) in enumerate(zip(firsts.to_pylist(), seconds.to_pylist(), tops.to_pylist())):
                    if a < 0:
                        docs = values[k].values.to_pylist()
                    elif b < 0:
                        lists[a] = (ordinals[k].values.to_numpy(), values[k].values.to_numpy(), top)
                    else:
                        joint.setdefault(a, []).append((b, top))
                        meets[a, b] = ordinals[k].values.to_numpy()
            for wanted, found in zip(asked, places):
                search_block(wanted, docs, lists, joint, meets, found, primed)
        rows = [(key, doc, score) for key, found in zip(keys, places) for score, doc in found.rows]
        yield pa.record_batch(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())],
            names=["key", "doc", "score"],
        )

    return search


def _group(docs: DataFrame, rows: list, how: Ranking) -> DataFrame | None:
    """(key, rank, doc, score) of one group of items, as (key, term, n) rows."""
    vocabulary = {t: k for k, t in enumerate(sorted({bytes(r["term"]) for r in rows}))}
    by_item: dict[str, dict[int, int]] = {}
    for r in rows:
        by_item.setdefault(r["key"], {})[vocabulary[bytes(r["term"])]] = r["n"]
    keys, asked = list(by_item), list(by_item.values())
    counted = cut(docs.mapInArrow(_counter(vocabulary), "doc long, n long, terms array<int>, tfs array<int>"))
    total = counted.agg(F.count("*").alias("documents"), F.sum("n").alias("tokens")).first()
    if not total["documents"]:
        return None
    frequencies = np.zeros(len(vocabulary), dtype=np.int64)
    for r in counted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():  # at most the vocabulary
        frequencies[r["t"]] = r["df"]
    weights = weigh(total["documents"], frequencies)
    pairs = set()
    for wanted in asked:
        inorder = sorted(wanted, key=lambda t: (int(weights[t]), t))
        # Both ways round of a pair are one.
        pairs.update((min(a, b), max(a, b)) for a, b in zip(inorder, inorder[1:]))
    numbers = (total["documents"], total["tokens"], weights)
    index = _indexer(numbers, np.array(sorted(pairs), dtype=np.int64).reshape(-1, 2), how.block_docs, how.block_postings)
    found = cut(counted.mapInArrow(index, INDEX)).mapInArrow(_searcher(keys, asked, how.best, how.primed_pairs), "key string, doc long, score long")
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= how.best)


def keyed(column: str):
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def search(docs: DataFrame, items: DataFrame, how: Ranking = Ranking(), doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item, rank, doc, score): the ``best`` documents with a score above 0 for every item."""
    documents = docs.select(F.col(doc).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    named = items.select(F.col(item).alias("id"), keyed(item).alias("key"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    asked = named.select("key", "text").distinct().mapInArrow(_item_terms, "key string, term binary, n long")
    asked = cut(asked.groupBy("key", "term").agg(F.sum("n").alias("n")))
    groups = -(-asked.count() // how.group_terms)
    found = None
    for k in range(groups):
        rows = asked.where(F.pmod(F.xxhash64("key"), F.lit(groups)) == k).collect()
        ranked = _group(documents, rows, how) if rows else None
        if ranked is not None:
            found = ranked if found is None else found.unionAll(ranked)
    if found is None:
        found = documents.sparkSession.createDataFrame([], "key string, rank int, doc long, score long")
    ids = named.groupBy("key").agg(F.first("id").alias("id")).withColumnRenamed("key", "of")
    return found.join(ids, F.col("key") == F.col("of")).select(F.col("id").alias(item), F.col("rank"), F.col("doc").alias(doc), "score")
