"""Scoring texts by a log-bilinear language model.

A token is predicted in two steps, both log-bilinear and both normalised. First its class from the classes of the two
before it: the class's score is the product of its vector with the sum of one vector for each place before, plus a
bias. A class is one of the ``words`` most frequent words, the end of a text, or one of the rest bins that other words
fall into by their last three bytes. Then the word among its bin's: a word has a vector of its own, and its score
is the product with the bin's vector of the token before, plus the log of its add-one count. As contexts of this
step the ``contexts`` next frequent words stand for themselves and others for their class.

Words with vectors are all that occur ``least`` times, so they grow with the corpus, up to the ``vectors`` most
frequent (the model travels to the tasks, 64 bytes a word). The others of a bin share one vector and part its
probability by their add-one counts, with one unit for words never seen.

1. Words of the training texts are counted by 64-bit digests.
2. Class trigrams and pairs (context, word) of the training texts are counted in one pass and one shuffle; there are
   at most 256 ** 3 and ``vectors`` times 512 of them, whatever the corpus.
3. The vectors of the classes are trained by noise-contrastive estimation on all counted trigrams: each task takes
   gradient steps over its share, in batches with common noise classes, and the tasks' results are averaged,
   ``rounds`` times. The bins do not depend on each other, so each is trained in the same way by one task, on its
   counted pairs with noise words of the bin, and is normalised there by matrix products.
4. Texts are scored in one pass. One batched matrix product gives the normalised log-probabilities of every class
   after every pair. Counts of at most ``table`` frequent words travel to the tasks; the others are joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.jobs import cut, folded, send, sent, text_column
from cairn.llm.resample import kth_largest
from cairn.llm.textblocks import Block, Hasher, blocks, mixed

CLASSES = 256
# Every token of a block has some 300 bytes of arrays, beside the model that each task holds.
BLOCK = 1 << 19
END = np.uint64(0xE17D0FE17D0FE17D)


@dataclass(frozen=True)
class Bilinear:
    words: int = 128
    size: int = 24
    rounds: int = 3
    noise: int = 64
    ratio: float = 16.0
    step: float = 0.15
    batch: int = 4096
    least_batch: int = 64
    batches: int = 200
    tasks: int = 16
    table: int = 1 << 19
    contexts: int = 256
    vectors: int = 1 << 17
    least: int = 5
    width: int = 16
    passes: int = 2
    pace: float = 0.3
    seed: int = 5

    def __post_init__(self) -> None:
        if not (0 < self.words < CLASSES - 1 and 0 <= self.contexts <= CLASSES and self.vectors <= 1 << 18):
            raise ValueError("a pair's key has room for 512 contexts and 2^18 words of a bin")

    @property
    def bins(self) -> int:
        return CLASSES - 1 - self.words


@dataclass
class Table:
    """Sorted digests with values, found by their leading bits."""

    digests: np.ndarray
    values: np.ndarray
    bits: int = 0
    starts: np.ndarray | None = None

    def __post_init__(self) -> None:
        order = np.argsort(self.digests)
        self.digests, self.values = self.digests[order], self.values[order]
        self.bits = max(1, int(len(self.digests)).bit_length() + 1)
        heads = (self.digests >> np.uint64(64 - self.bits)).astype(np.int64)
        self.starts = np.searchsorted(heads, np.arange((1 << self.bits) + 1)).astype(np.int32)

    def find(self, digests: np.ndarray) -> np.ndarray:
        """The value of each digest, -1 where there is none."""
        found = np.full(len(digests), -1, np.int64)
        if not len(self.digests):
            return found
        heads = (digests >> np.uint64(64 - self.bits)).astype(np.int64)
        at, stop = self.starts[heads], self.starts[heads + 1]
        left = np.flatnonzero(at < stop)
        while len(left):
            here = at[left]
            hit = self.digests[here] == digests[left]
            found[left[hit]] = self.values[here[hit]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < stop[left]]
        return found


def bins_of(block: Block, hasher: Hasher, bins: int) -> np.ndarray:
    ends = hasher.words(block.data, np.maximum(block.starts, block.ends - 3), block.ends)
    return (mixed(ends + np.uint64(3)) % np.uint64(bins)).astype(np.int64)


def with_ends(block: Block, words: np.ndarray, end) -> np.ndarray:
    """Values of the words of each text with ``end`` after its last."""
    return np.insert(words, block.first[1:], end)


def _pooled(chunks: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their first companions, and the sums of their counts."""
    keys, also, counts = (np.concatenate([c[k] for c in chunks]) for k in range(3))
    own, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    return own, also[first], np.bincount(inverse, counts, len(own)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch], values, names: tuple[str, str, str]) -> Iterator[pa.RecordBatch]:
    """Counts of ``values(block)`` (keys, companions), pooled while a task's distinct keys fit 2^18."""
    chunks: list[tuple[np.ndarray, ...]] = []
    held = 0

    def rows() -> Iterator[pa.RecordBatch]:
        keys, also, counts = _pooled(chunks)
        for at in range(0, len(keys), 1 << 16):
            part = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(keys[part].view(np.int64)), pa.array(also[part]), pa.array(counts[part])], list(names))

    for block in blocks(batches, limit=BLOCK):
        keys, also = values(block)
        own, first, counts = np.unique(keys, return_index=True, return_counts=True)
        chunks.append((own, also[first], counts))
        held += len(own)
        if held > 1 << 19:
            chunks[:] = [_pooled(chunks)]
            held = len(chunks[0][0])
            if held > 1 << 18:
                yield from rows()
                chunks.clear()
                held = 0
    if chunks:
        yield from rows()


@dataclass
class Tokens:
    """Every token of a block, ends included: digest, count in the table (-1 if not there), class, context as which
    the next token sees it, its bin and row there (row 0 for words without a vector; both -1 for classes)."""

    digests: np.ndarray
    n: np.ndarray
    classes: np.ndarray
    contexts: np.ndarray
    bins: np.ndarray
    rows: np.ndarray


@dataclass
class Vocabulary:
    """Corpus counts for the tasks.

    ``frequent`` leads to places in ``n``, ``classes``, ``contexts`` and ``rows``. Bin b has the rows from
    ``first[b]`` to ``first[b + 1]`` of ``weights``; the first of them stands for its words without a vector.
    """

    frequent: Table
    n: np.ndarray
    classes: np.ndarray
    contexts: np.ndarray
    rows: np.ndarray
    first: np.ndarray
    weights: np.ndarray
    tokens: int
    distinct: int

    def read(self, block: Block, hasher: Hasher, how: Bilinear) -> Tokens:
        digests = with_ends(block, hasher.words(block.data, block.starts, block.ends), END)
        bins = with_ends(block, bins_of(block, hasher, how.bins), -1)
        at = self.frequent.find(digests)
        here = at >= 0
        classes = np.where(bins < 0, 0, bins + 1 + how.words)
        contexts, n, rows = classes.copy(), np.full(len(at), -1), np.where(bins < 0, -1, 0)
        for found, known in ((classes, self.classes), (contexts, self.contexts), (n, self.n), (rows, self.rows)):
            found[here] = known[at[here]]
        return Tokens(digests, n, classes, contexts, np.where(rows < 0, -1, bins), rows)


def count_words(training: DataFrame, how: Bilinear) -> DataFrame:
    """(digest, bin, n) of the words of the training texts; the end token has bin -1."""

    def values(hasher: Hasher):
        return lambda block: (
            with_ends(block, hasher.words(block.data, block.starts, block.ends), END),
            with_ends(block, bins_of(block, hasher, how.bins), -1),
        )

    found = training.mapInArrow(lambda b: _counted(b, values(Hasher(size=BLOCK)), ("digest", "bin", "n")), "digest long, bin long, n long")
    return cut(found.groupBy("digest").agg(F.min("bin").alias("bin"), F.sum("n").alias("n")))


def vocabulary(counts: DataFrame, how: Bilinear) -> Vocabulary:
    tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least = kth_largest(counts, "n", how.table)
    # Strictly above the count of the word in that place there are fewer words than the table holds.
    rows = counts.where((F.col("n") > F.lit(least)) | (F.col("bin") < 0)) if distinct > how.table else counts
    rows = rows.toArrow()
    digests, bins, n = (rows.column(c).to_numpy() for c in ("digest", "bin", "n"))
    words = np.flatnonzero(bins >= 0)
    words = words[np.lexsort((digests[words], -n[words]))]
    top, own = words[: how.words], words[how.words :][: how.vectors]
    own = own[n[own] >= how.least]
    own = own[np.lexsort((digests[own], bins[own]))]
    tokens_of, words_of = np.zeros(how.bins, np.int64), np.zeros(how.bins, np.int64)
    for row in counts.where("bin >= 0").groupBy("bin").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        tokens_of[row["bin"]], words_of[row["bin"]] = row["n"], row["v"]
    for gone in (top, own):
        np.subtract.at(tokens_of, bins[gone], n[gone])
        np.subtract.at(words_of, bins[gone], 1)
    many = np.bincount(bins[own], minlength=how.bins)
    first = np.concatenate([[0], np.cumsum(many + 1)])
    place = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many) + 1
    weights = np.empty(first[-1])
    weights[first[:-1]] = tokens_of + words_of + 1
    weights[first[bins[own]] + place] = n[own] + 1
    classes = np.where(bins < 0, 0, bins + 1 + how.words)
    classes[top] = np.arange(1, len(top) + 1)
    contexts = classes.copy()
    alone = words[how.words :][: how.contexts]
    contexts[alone] = CLASSES + np.arange(len(alone))
    in_bin = np.where(bins < 0, -1, 0)
    in_bin[top] = -1
    in_bin[own] = place
    table = Table(digests.astype(np.int64).view(np.uint64).copy(), np.arange(len(digests), dtype=np.int32))
    narrow = (classes.astype(np.int16), contexts.astype(np.int16), in_bin.astype(np.int32))
    return Vocabulary(table, n.copy(), *narrow, first, weights, int(tokens or 0), int(distinct))


PAIR = 1 << 40


def count_grams(training: DataFrame, shared, how: Bilinear) -> DataFrame:
    """(key, n): counts of class trigrams and of pairs.

    A trigram's key is two classes before and the class itself, a byte each. A pair's is :data:`PAIR`, the bin, the
    word's row in it (19 bits) and the context before (9 bits).
    """

    def values(hasher: Hasher, known: Vocabulary):
        def of(block: Block):
            tokens = known.read(block, hasher, how)
            in_bin = np.flatnonzero(tokens.rows >= 0)
            pairs = PAIR | (tokens.bins[in_bin] << 28) | (tokens.rows[in_bin] << 9) | before(block, tokens.contexts)[in_bin]
            keys = np.concatenate([trigrams(block, tokens.classes), pairs])
            return keys.astype(np.uint64), np.zeros(len(keys), np.int8)

        return of

    found = training.mapInArrow(lambda b: _counted(b, values(Hasher(size=BLOCK), sent(shared)), ("key", "zero", "n")), "key long, zero byte, n long")
    return cut(found.groupBy("key").agg(F.sum("n").alias("n")))


def before(block: Block, contexts: np.ndarray) -> np.ndarray:
    """The context before each token; 0 before the first of a text."""
    found = np.zeros_like(contexts)
    found[1:] = contexts[:-1]
    found[block.first[:-1] + np.arange(len(block))] = 0
    return found


def trigrams(block: Block, classes: np.ndarray) -> np.ndarray:
    """Key of every token. Every text ends with class 0, which also stands before its first token, twice."""
    one, two = np.zeros_like(classes), np.zeros_like(classes)
    one[1:] = classes[:-1]
    two[2:] = classes[:-2]
    begins = block.first[:-1] + np.arange(len(block))  # place of each text's first token
    after = begins + 1
    two[after[after < len(classes)]] = 0
    two[begins] = 0
    one[begins] = 0
    return (two << 16) | (one << 8) | classes


Model = dict[str, np.ndarray]


def first_model(unigrams: np.ndarray, how: Bilinear) -> Model:
    rng = np.random.default_rng(how.seed)
    start = lambda: rng.normal(0, 0.1, (CLASSES, how.size))
    bias = np.log((unigrams + 0.5) / (unigrams + 0.5).sum())
    return {"far": start(), "near": start(), "out": start(), "bias": bias}


def train(model: Model, keys: np.ndarray, counts: np.ndarray, noise: np.ndarray, how: Bilinear, seed: int) -> Model:
    """One pass of noise-contrastive steps (Adagrad) over weighted trigrams; ``noise`` is the classes' distribution.

    A pass has at least ``batches`` steps, unless batches would be smaller than ``least_batch``.
    """
    model = {k: v.copy() for k, v in model.items()}
    sums = {k: np.full(v.shape, 1e-3) for k, v in model.items()}
    rng = np.random.default_rng([how.seed, seed])
    lift = np.log(how.ratio * noise)
    order = rng.permutation(len(keys))
    size = min(how.batch, max(how.least_batch, len(order) // how.batches))

    def update(name: str, rows: np.ndarray, gradient: np.ndarray) -> None:
        total = np.zeros_like(model[name])
        np.add.at(total, rows, gradient)
        hit = np.unique(rows)
        sums[name][hit] += total[hit] ** 2
        model[name][hit] += how.step * total[hit] / np.sqrt(sums[name][hit])

    for at in range(0, len(order), size):
        part = order[at : at + size]
        key, weight = keys[part], counts[part] / counts[part].sum()
        two, one, word = key >> 16, (key >> 8) & 255, key & 255
        drawn = rng.choice(CLASSES, how.noise, p=noise)
        context = model["far"][two] + model["near"][one]
        right = (context * model["out"][word]).sum(axis=1) + model["bias"][word] - lift[word]
        wrong = context @ model["out"][drawn].T + model["bias"][drawn] - lift[drawn]
        pull = weight / (1 + np.exp(np.clip(right, -30, 30)))
        push = weight[:, None] * (how.ratio / how.noise) / (1 + np.exp(np.clip(-wrong, -30, 30)))
        for_context = pull[:, None] * model["out"][word] - push @ model["out"][drawn]
        for_out = np.concatenate([pull[:, None] * context, -(push.T @ context)])
        for_bias = np.concatenate([pull, -push.sum(axis=0)])
        rows = np.concatenate([word, drawn])
        update("far", two, for_context)
        update("near", one, for_context)
        update("out", rows, for_out)
        update("bias", rows, for_bias)
    return model


def packed(model: Model) -> bytes:
    return np.concatenate([model[k].ravel() for k in ("far", "near", "out", "bias")]).tobytes()


def unpacked(data: bytes, how: Bilinear) -> Model:
    values, wide = np.frombuffer(data), CLASSES * how.size
    parts = [values[k * wide : (k + 1) * wide].reshape(CLASSES, how.size) for k in range(3)]
    return {"far": parts[0], "near": parts[1], "out": parts[2], "bias": values[3 * wide :]}


def fit(counts: DataFrame, unigrams: np.ndarray, how: Bilinear) -> Model:
    """Rounds of local passes and averages weighted by tokens."""
    model = first_model(unigrams, how)
    noise = (unigrams + 0.5) / (unigrams + 0.5).sum()
    # The table has a fixed most of rows, so a fixed number of tasks will do; fewer tasks make better averages.
    counts = counts.coalesce(how.tasks)
    spark, parts = counts.sparkSession, counts.rdd.getNumPartitions()
    shape = "part long, weight double, model binary"

    def merge(table: pa.Table) -> pa.Table:
        weights = table.column("weight").to_numpy()
        values = sum(np.frombuffer(m) * w for m, w in zip(table.column("model").to_pylist(), weights, strict=True))
        total = float(weights.sum())
        return pa.table({"part": table.column("part").slice(0, 1), "weight": pa.array([total]), "model": pa.array([(values / total).tobytes()], pa.binary())})

    for turn in range(how.rounds):
        shared = spark.sparkContext.broadcast(model)

        def local(batches: Iterator[pa.RecordBatch], turn=turn, shared=shared) -> Iterator[pa.RecordBatch]:
            held = [b for b in batches if b.num_rows]
            if held:
                found = pa.Table.from_batches(held).sort_by("key")
                part = TaskContext.get().partitionId()
                keys, n = found.column("key").to_numpy(), found.column("n").to_numpy().astype(float)
                fresh = train(shared.value, keys, n, noise, how, turn * 1_000_003 + part)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([float(n.sum())]), pa.array([packed(fresh)], pa.binary())], ["part", "weight", "model"])

        rows = folded(counts.mapInArrow(local, shape), (), merge, shape, parts).collect()
        if not rows:
            break
        model = unpacked(rows[0]["model"], how)
    return model


def log_probabilities(model: Model) -> np.ndarray:
    """log10 of every class after every pair of classes, by key."""
    table = np.empty((CLASSES * CLASSES, CLASSES), np.float32)
    out, bias = model["out"].T.astype(np.float32), model["bias"].astype(np.float32)
    for two in range(CLASSES):
        scores = (model["far"][two] + model["near"]).astype(np.float32) @ out + bias
        scores -= scores.max(axis=1, keepdims=True)
        scores -= np.log(np.exp(scores).sum(axis=1, keepdims=True))
        table[two * CLASSES : (two + 1) * CLASSES] = scores * np.float32(1 / np.log(10))
    return table.ravel()


@dataclass
class Inner:
    """The words' vectors by row of ``Vocabulary.weights``, and by bin and context the vectors and the log of the sum
    of all scores' exponentials."""

    words: np.ndarray
    contexts: np.ndarray
    norms: np.ndarray

    def scores(self, tokens: Tokens, ahead: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 of each token's share of its bin, less log10 of its add-one count; 0 for classes."""
        found = np.zeros(len(ahead))
        at = np.flatnonzero(tokens.rows >= 0)
        bins, ahead = tokens.bins[at], ahead[at]
        products = np.einsum("ij,ij->i", self.words[first[bins] + tokens.rows[at]], self.contexts[bins, ahead])
        found[at] = (products - self.norms[bins, ahead]) / np.log(10)
        return found


def train_bin(rows: np.ndarray, ahead: np.ndarray, counts: np.ndarray, weights: np.ndarray, how: Bilinear, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of a bin's rows and contexts: noise-contrastive steps (Adagrad) over its weighted pairs.

    The noise is the rows' share of ``weights``, so a word's score against the noise is its product alone. All word vectors
    begin at zero, which is the share itself, and a word with few tokens stays near it.
    """
    rng = np.random.default_rng([how.seed, seed])
    words = np.zeros((len(weights), how.width), np.float32)
    contexts = rng.normal(0, 0.3, (CLASSES + how.contexts, how.width)).astype(np.float32)
    sums = {id(words): np.ones_like(words), id(contexts): np.ones_like(contexts)}
    heights = np.cumsum(weights / weights.sum())
    lift, counts = np.float32(np.log(how.ratio)), counts.astype(np.float32)
    size = min(how.batch, max(how.least_batch, len(rows) // how.batches))

    def update(vectors: np.ndarray, at: np.ndarray, gradient: np.ndarray) -> None:
        hit, inverse = np.unique(at, return_inverse=True)
        total = np.zeros((len(hit), how.width), np.float32)
        np.add.at(total, inverse, gradient)
        sums[id(vectors)][hit] += total**2
        vectors[hit] += np.float32(how.pace) * total / np.sqrt(sums[id(vectors)][hit])

    for _ in range(how.passes):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), size):
            part = order[at : at + size]
            row, one, weight = rows[part], ahead[part], counts[part]
            drawn = np.minimum(np.searchsorted(heights, rng.random(how.noise)), len(weights) - 1)
            context, noise = contexts[one], words[drawn]
            right = np.einsum("ij,ij->i", context, words[row]) - lift
            wrong = context @ noise.T - lift
            pull = weight / (1 + np.exp(np.clip(right, -30, 30)))
            push = weight[:, None] * np.float32(how.ratio / how.noise) / (1 + np.exp(np.clip(-wrong, -30, 30)))
            for_context = pull[:, None] * words[row] - push @ noise
            for_words = np.concatenate([pull[:, None] * context, -(push.T @ context)])
            update(words, np.concatenate([row, drawn]), for_words)
            update(contexts, one, for_context)
    return words, contexts


def normalisers(words: np.ndarray, contexts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """log of the sum over rows of weight times exp(product), by context; 4,096 rows at a time."""
    total = np.full(len(contexts), -np.inf)
    for at in range(0, len(words), 4096):
        scores = (contexts @ words[at : at + 4096].T).astype(float) + np.log(weights[at : at + 4096])
        top = scores.max(axis=1)
        total = np.logaddexp(total, top + np.log(np.exp(scores - top[:, None]).sum(axis=1)))
    return total


def fit_bins(pairs: DataFrame, shared, known: Vocabulary, how: Bilinear) -> Inner:
    """One task trains one bin. A bin without pairs keeps its add-one shares."""

    def local(table: pa.Table) -> pa.Table:
        known, table = sent(shared), table.sort_by("key")
        keys, n = table.column("key").to_numpy(), table.column("n").to_numpy()
        own = int(keys[0] >> 28) & 255
        weights = known.weights[known.first[own] : known.first[own + 1]]
        words, contexts = train_bin((keys >> 9) & ((1 << 19) - 1), keys & 511, n, weights, how, own)
        found = [words.tobytes(), contexts.tobytes(), normalisers(words, contexts, weights).tobytes()]
        return pa.table({"bin": pa.array([own], pa.int64()), **{name: pa.array([x], pa.binary()) for name, x in zip(("words", "contexts", "norms"), found, strict=True)}})

    many = CLASSES + how.contexts
    sums = np.add.reduceat(known.weights, known.first[:-1])
    inner = Inner(
        np.zeros((len(known.weights), how.width), np.float32),
        np.zeros((how.bins, many, how.width), np.float32),
        np.repeat(np.log(sums)[:, None], many, axis=1),
    )
    by_bin = pairs.groupBy(F.expr("shiftright(key, 28) & 255").alias("bin"))
    for row in by_bin.applyInArrow(local, "bin long, words binary, contexts binary, norms binary").collect():
        own = row["bin"]
        inner.words[known.first[own] : known.first[own + 1]] = np.frombuffer(row["words"], np.float32).reshape(-1, how.width)
        inner.contexts[own] = np.frombuffer(row["contexts"], np.float32).reshape(many, how.width)
        inner.norms[own] = np.frombuffer(row["norms"])
    return inner


@dataclass
class Learned:
    """What the training texts give: counts of all words, the vocabulary, and the vectors of classes and words."""

    counts: DataFrame
    known: Vocabulary
    classes: Model
    inner: Inner


def learn(training: DataFrame, how: Bilinear = Bilinear()) -> Learned:
    """Train on every row of ``training``, a table with the one column ``text`` without nulls."""
    counts = count_words(training, how)
    known = vocabulary(counts, how)
    shared = send(training.sparkSession, known)
    grams = count_grams(training, shared, how)
    threes = grams.where(F.col("key") < F.lit(PAIR))
    unigrams = np.zeros(CLASSES)
    for row in threes.groupBy((F.col("key") % CLASSES).cast("int").alias("class")).agg(F.sum("n").alias("n")).collect():
        unigrams[row["class"]] = row["n"]
    classes = fit(threes, unigrams, how)
    return Learned(counts, known, classes, fit_bins(grams.where(F.col("key") >= F.lit(PAIR)), shared, known, how))


SCORED = "id {0}, row long, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<long>, times array<int>"


def score(docs: DataFrame, how: Bilinear = Bilinear(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    A text trains unless crc32 of its id as text leaves 2 when divided by 7 (a null id counts as empty text, which
    leaves 0). A null or wordless text is its end alone. Repeated rows are scored and, if they train, counted each.
    Without training texts all probabilities are even and no token is known. Other columns are not read. An empty
    table gives an empty result.
    """
    kind = docs.schema[id].dataType.simpleString()
    held = F.crc32(F.coalesce(F.col(id).cast("string"), F.lit(""))) % 7 == 2
    texts = docs.select(F.col(id).alias("id"), text_column(text).alias("text"), held.alias("held_out"))
    spark = docs.sparkSession
    learned = learn(texts.where("not held_out").select("text"), how)
    counts, known = learned.counts, learned.known
    shared = send(spark, (known, learned.classes, learned.inner))
    whole = np.log10(known.tokens + known.distinct + 1)

    def pass_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, (known, model, inner) = Hasher(size=BLOCK), sent(shared)
        table = log_probabilities(model)
        row = TaskContext.get().partitionId() << 33
        for block in blocks(batches, limit=BLOCK):
            tokens = known.read(block, hasher, how)
            of = np.repeat(np.arange(len(block)), np.diff(block.first) + 1)
            here = tokens.n >= 0
            logs = np.where(here, np.log10(np.maximum(tokens.n, 0) + 1.0), 0.0)
            scores = table[trigrams(block, tokens.classes)].astype(float)
            scores += inner.scores(tokens, before(block, tokens.contexts), known.first) + np.where(tokens.rows >= 0, logs, 0.0)
            rare, times = [], []
            open_ = np.flatnonzero(~here)
            edges = np.searchsorted(of[open_], np.arange(len(block) + 1))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                own, many = np.unique(tokens.digests[open_[a:b]], return_counts=True)
                rare.append(own.view(np.int64))
                times.append(many.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    block.rows.column("id"),
                    pa.array(np.arange(row, row + len(block))),
                    block.rows.column("held_out"),
                    pa.array(np.diff(block.first) + 1),
                    pa.array(np.bincount(of[here], minlength=len(block))),
                    pa.array(np.bincount(of, logs - whole, len(block))),
                    pa.array(np.bincount(of, scores, len(block))),
                    pa.array(rare, pa.list_(pa.int64())),
                    pa.array(times, pa.list_(pa.int32())),
                ],
                ["id", "row", "held_out", "n_tokens", "n_known", "base", "score", "rare", "times"],
            )
            row += len(block)

    scored = cut(texts.mapInArrow(pass_over, SCORED.format(kind)))
    each = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("e")).select("row", F.col("e.rare").alias("digest"), F.col("e.times").alias("times"))
    # Words of the frequent table never stand in ``rare``; unseen words find no count and add nothing.
    found = each.join(counts.select("digest", "n"), "digest")
    found = found.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more"), F.sum("times").alias("seen"))
    more = F.coalesce("more", F.lit(0.0))
    return scored.drop("rare", "times").join(found, "row", "left").select(
        F.col("id").alias(id),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"),
        F.lit(known.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )
