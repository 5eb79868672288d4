"""Quality by importance resampling: documents are drawn by the ratio of two n-gram models.

Both models are bags of hashed n-grams: one of the target (texts labelled good and not toxic), one of all raw
texts. The n-grams of a text are its words, whole and in lower case, the pairs of neighbouring words, and for each
word its first four and first five bytes in lower case and its last three bytes as written. Each of the five kinds is
hashed to 18 bits, so the tables have 5 * 262,144 cells whatever the corpus.

An n-gram's log ratio is an upper confidence bound (``z`` standard errors of its target count) truncated at
zero: a rare n-gram that the labelled sample happens to miss, or one common in good texts, says nothing. (On half of
the labels of a test corpus, with 2^20 cells a kind, at the cut that loses 0.1 % of good texts, the plain two-sided ratio of words and pairs
kept 95 % of the toxic ones, a ratio bounded on both sides 1.5 %, this one 0.6 %: good n-grams outweigh the few others.) A
text's log weight is the sum over its n-grams, divided by its words plus ``prior`` and by ``temperature``. Gumbel
noise, fixed by the document's id, is added, and the top k keys are the sample: drawing without replacement
by weight.

Target texts are one half of the good labelled ones, at most ``sample`` (the first by a hash of their id); raw
counts cover all texts. The other half of the labels sets k: the number of texts whose weight reaches the value
that parts good from other labelled texts with the fewest errors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.jobs import cut, folded
from cairn.llm.textblocks import Block, Hasher, blocks, mixed

BITS = 18
CELLS = 1 << BITS
KINDS = 5


@dataclass(frozen=True)
class Resampling:
    sample: int = 200_000
    z: float = 2.0
    prior: float = 20.0
    temperature: float = 0.002
    seed: int = 7


def ngrams(block: Block, plain: Hasher, lower: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Row and cell of every n-gram of a block."""
    starts, ends = block.starts, block.ends
    row = np.repeat(np.arange(len(block)), np.diff(block.first))
    words = lower.words(block.data, starts, ends)
    pair = np.flatnonzero(row[1:] == row[:-1])
    found = [
        words,
        lower.words(block.data, starts, np.minimum(ends, starts + 4)),
        lower.words(block.data, starts, np.minimum(ends, starts + 5)),
        plain.words(block.data, np.maximum(starts, ends - 3), ends),
        words[pair] * np.uint64(3) + words[pair + 1],
    ]
    cells = [(mixed(f + np.uint64(k)) >> np.uint64(64 - BITS)).astype(np.int64) + k * CELLS for k, f in enumerate(found)]
    return np.concatenate([row, row, row, row, row[pair]]), np.concatenate(cells)


def _added(table: pa.Table) -> pa.Table:
    def total(column: str) -> pa.Array:
        sums = np.zeros(CELLS, np.int64)
        for value in table.column(column):
            sums += np.frombuffer(value.as_buffer(), np.int64)
        return pa.array([sums.tobytes()], pa.binary())

    return pa.table({"kind": table.column("kind").slice(0, 1), "part": table.column("part").slice(0, 1), "raw": total("raw"), "target": total("target")})


def counted(docs: DataFrame, target: np.ndarray, id: str, text: str) -> DataFrame:
    """A row (kind, part, raw, target) for each kind of n-gram: counts of every cell over all texts, and over those whose id is in ``target`` (sorted).

    Each task sums its own texts; four sums of a kind (17 MB) at a time are added on the executors until one is left.
    """
    shared = docs.sparkSession.sparkContext.broadcast(target)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, lower, target = Hasher(lower=False), Hasher(), shared.value
        raw, own = np.zeros(KINDS * CELLS, np.int64), np.zeros(KINDS * CELLS, np.int64)
        for block in blocks(batches):
            row, cell = ngrams(block, plain, lower)
            raw += np.bincount(cell, minlength=len(raw))
            hit = np.isin(block.rows.column("id").fill_null(-1).to_numpy(), target) & block.rows.column("id").is_valid().to_numpy(zero_copy_only=False)
            own += np.bincount(cell[hit[row]], minlength=len(own))
        part = TaskContext.get().partitionId()
        for kind in range(KINDS):
            cells = slice(kind * CELLS, (kind + 1) * CELLS)
            columns = [pa.array([kind], pa.int32()), pa.array([part], pa.int64()), pa.array([raw[cells].tobytes()], pa.binary()), pa.array([own[cells].tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["kind", "part", "raw", "target"])

    texts = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    shape = "kind int, part long, raw binary, target binary"
    return folded(texts.mapInArrow(count, shape), ("kind",), _added, shape, texts.rdd.getNumPartitions(), 4)


def counts(docs: DataFrame, target: np.ndarray, id: str, text: str) -> tuple[np.ndarray, np.ndarray]:
    """The two counts of :func:`counted` as arrays of the driver."""
    total = sorted(counted(docs, target, id, text).collect(), key=lambda r: r["kind"])
    if not total:
        return np.zeros(KINDS * CELLS, np.int64), np.zeros(KINDS * CELLS, np.int64)
    return tuple(np.concatenate([np.frombuffer(r[c], np.int64) for r in total]) for c in ("raw", "target"))


def log_ratios(raw: np.ndarray, target: np.ndarray, z: float) -> np.ndarray:
    """Upper bound of log(target share / raw share) of each cell, zero at most."""
    found = []
    for own, good in zip(raw.reshape(-1, CELLS), target.reshape(-1, CELLS), strict=True):
        expected = own * (good.sum() / max(1, own.sum()))
        bound = (good + z * np.sqrt(good) + z * z / 2 + 0.5) / np.maximum(expected, 1e-9)
        found.append(np.minimum(0.0, np.log(bound)) if good.sum() else np.zeros(CELLS))
    return np.concatenate(found)


def known(docs: DataFrame, labels: DataFrame, id: str) -> DataFrame:
    """(id, good, tried) of the labelled rows in ``docs``: whether all their labels are good, and the half they are in."""
    flags = labels.where(F.col(id).isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    flags = flags.groupBy(F.col(id).cast("long").alias("id")).agg(F.min(F.expr("quality = 1 and toxic = 0")).alias("good"))
    flags = flags.join(docs.select(F.col(id).cast("long").alias("id")).distinct(), "id", "left_semi")
    return cut(flags.withColumn("tried", F.expr("pmod(xxhash64(id, 13), 2) = 1")))


def fit(docs: DataFrame, flags: DataFrame, how: Resampling, id: str, text: str) -> np.ndarray:
    """The log ratio of every cell. Without good labelled rows all are zero."""
    ids = flags.where("good and not tried").orderBy(F.xxhash64("id"), "id").limit(how.sample).select("id").toArrow().column("id").to_numpy()

    def ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, raw, own in zip(*(batch.column(c) for c in ("kind", "raw", "target")), strict=True):
                found = log_ratios(np.frombuffer(raw.as_buffer(), np.int64), np.frombuffer(own.as_buffer(), np.int64), how.z)
                yield pa.RecordBatch.from_arrays([pa.array([kind.as_py()], pa.int32()), pa.array([found.tobytes()], pa.binary())], ["kind", "ratios"])

    # Counts stay on the executors; the driver gets the ratios only (10 MB).
    found = sorted(counted(docs, np.sort(ids), id, text).mapInArrow(ratios, "kind int, ratios binary").collect())
    return np.concatenate([np.frombuffer(r["ratios"]) for r in found]) if found else np.zeros(KINDS * CELLS)


def draw_size(scored: DataFrame, flags: DataFrame, id: str) -> int:
    """How many texts reach the weight that best parts the labelled rows kept for this; all, if none parts them."""
    at = F.greatest(F.floor(F.col("log_weight") * 16), F.lit(-32_768)).cast("int")
    tried = flags.where("tried").withColumnRenamed("id", "known")
    bins = scored.join(tried, F.col(id) == F.col("known")).groupBy(at.alias("bin"))
    rows = sorted(bins.agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).collect())
    # The errors of a cut below each bin: good rows lost below it, others kept from it on.
    lost, kept = 0, sum(r["bad"] for r in rows)
    best, cuts = kept, [-32_768]
    for k, row in enumerate(rows):
        lost, kept = lost + row["good"], kept - row["bad"]
        above = rows[k + 1]["bin"] if k + 1 < len(rows) else row["bin"] + 1
        if lost + kept < best:
            best, cuts = lost + kept, []
        if lost + kept == best:
            cuts += [row["bin"] + 1, above]
    middle = cuts[0] if cuts[0] == -32_768 else (cuts[0] + cuts[1]) // 2
    return scored.where(at >= middle).count()


def weighted(docs: DataFrame, ratios: np.ndarray | Broadcast, how: Resampling, text: str, column: str) -> DataFrame:
    """``docs`` with the log weight of each text in ``column``. Ratios used more than once are better broadcast by the caller."""
    shared = ratios if isinstance(ratios, Broadcast) else docs.sparkSession.sparkContext.broadcast(ratios)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, lower, ratios = Hasher(lower=False), Hasher(), shared.value
        for block in blocks(batches, text):
            row, cell = ngrams(block, plain, lower)
            sums = np.bincount(row, ratios[cell], len(block))
            found = sums / (np.diff(block.first) + how.prior) / how.temperature
            yield pa.RecordBatch.from_arrays([*block.rows.columns, pa.array(found)], [*block.rows.schema.names, column])

    schema = docs.select("*", F.lit(0.0).alias(column)).schema
    return docs.mapInArrow(score, schema)


def _key(weight: str, id: str, how: Resampling) -> Column:
    """Log weight plus Gumbel noise, in steps of 2^-20."""
    uniform = (F.pmod(F.xxhash64(F.col(id), F.lit(how.seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return F.round((F.col(weight) - F.log(-F.log(uniform))) * F.lit(float(1 << 20))).cast("long")


def kth_largest(values: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest long of a column, by narrowing histograms of at most 65,536 bins; null counts as none."""
    low, high, n = values.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n or k <= 0:
        return None
    k = min(k, n)
    while low < high:
        width = -(-(high - low + 1) // 65_536)
        bins = values.where(F.col(column).between(low, high)).groupBy(F.expr(f"({column} - {low}L) div {width}L").alias("bin")).count()
        for bin_, count in sorted(bins.collect(), reverse=True):
            if count >= k:
                low, high = low + bin_ * width, min(high, low + (bin_ + 1) * width - 1)
                break
            k -= count
    return low


def resample(docs: DataFrame, labels: DataFrame, how: Resampling = Resampling(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, log_weight, sample_key) of the documents drawn.

    A null or wordless text has weight one. Rows that share an id and a text share their fate; all rows that
    tie with the k-th key are drawn. Null ids share one noise value. Extra columns are not read. No labels:
    every row is drawn. An empty table gives an empty result.
    """
    texts = docs.select(id, text)
    flags = known(texts, labels, id)
    ratios = docs.sparkSession.sparkContext.broadcast(fit(texts, flags, how, id, text))
    scored = cut(weighted(texts, ratios, how, text, "log_weight").select(id, "log_weight", _key("log_weight", id, how).alias("sample_key")))
    least = kth_largest(scored, "sample_key", draw_size(scored, flags, id))
    return scored if least is None else scored.where(F.col("sample_key") >= F.lit(least))


def keep_sample(docs: DataFrame, labels: DataFrame, how: Resampling = Resampling(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """The drawn rows of ``docs``, all columns unchanged; the texts are read once more and not shuffled."""
    texts = docs.select(id, text)
    flags = known(texts, labels, id)
    ratios = docs.sparkSession.sparkContext.broadcast(fit(texts, flags, how, id, text))
    scored = cut(weighted(texts, ratios, how, text, "log_weight").select(id, "log_weight", _key("log_weight", id, how).alias("sample_key")))
    least = kth_largest(scored, "sample_key", draw_size(scored, flags, id))
    if least is None:
        return docs
    column = "log_weight"
    while column in docs.columns:
        column += "_"
    return weighted(docs, ratios, how, text, column).where(_key(column, id, how) >= F.lit(least)).drop(column)
