"""Near-duplicate documents: banded MinHash candidates, sequential Bayesian pruning, exact verification.

1. One pass turns every whole text into its set of word shingles, the set's digest and a signature.
   Documents with equal sets form a class; only the class's least row goes on.
2. Bands of the signatures put classes into buckets. Every class of a bucket is compared with the
   bucket's least one, never with all others.
3. A comparison reads the two signatures in batches. After each batch the posterior of the
   similarity (uniform prior, binomial matches) says how likely ``threshold`` still is; below ``miss``
   the pair is dropped. Survivors are verified on their full sets.
4. Verified links form components. Where a bucket holds classes outside its largest component, these
   outsiders (and only these) are compared with the rest of the bucket, block against block, by the
   same pruning and verification. A pair is looked at in the first band it shares only, pairs already
   in one component not at all, and no pair leaves a task but a verified link.

Full sets are made once, of classes that share a bucket. A bitmap of fixed size, sent to the tasks, spares
most other texts that work; what it lets through by chance is dropped by a join.

A pair is missed only if no band agrees (5e-6 at the threshold with the defaults) or if the pruning
is wrong (``miss``). Shingles are compared by 64-bit digests.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.components import components
from cairn.llm.jobs import cut, text_column
from cairn.llm.textblocks import Hasher, blocks, shingles


@dataclass(frozen=True)
class NearDup:
    """Parameters: words a shingle, similarity in percent, bands of ``rows`` values, values a comparison
    batch, the pruning's miss probability, classes a block of step 4, bits of the bitmap."""

    words: int = 5
    percent: int = 80
    bands: int = 40
    rows: int = 6
    batch: int = 40
    miss: float = 1e-5
    block: int = 512
    bitmap: int = 1 << 24
    seed: int = 11

    @property
    def values(self) -> int:
        return self.bands * self.rows


SKETCH = "id long, x long, y long, n_shingles long, digest binary, signature binary"


def sketch(batches: Iterator[pa.RecordBatch], how: NearDup) -> Iterator[pa.RecordBatch]:
    """Set size, set digest and signature (16 bits a value) of each text."""
    factors = np.random.default_rng(how.seed).integers(0, 1 << 63, how.values, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    hasher = Hasher()
    for block in blocks(batches):
        sizes, digests, signatures = [], [], []
        for found in shingles(hasher.words(block.data, block.starts, block.ends), block.first, how.words):
            sizes.append(len(found))
            if not len(found):
                digests.append(None)
                signatures.append(None)
                continue
            least = np.full(how.values, np.uint64(0xFFFFFFFFFFFFFFFF))
            for at in range(0, len(found), 4096):
                np.minimum(least, np.multiply.outer(factors, found[at : at + 4096]).min(axis=1), out=least)
            signatures.append(((least ^ (least >> np.uint64(32))) & np.uint64(0xFFFF)).astype("<u2").tobytes())
            odd = found * np.uint64(0xD6E8FEB86659FD93)
            odd ^= odd >> np.uint64(32)
            digests.append(np.array([len(found), np.bitwise_xor.reduce(odd), odd.sum(), (odd * found).sum()], "<u8").tobytes())
        yield pa.RecordBatch.from_arrays(
            [*(block.rows.column(c) for c in ("id", "x", "y")), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())],
            ["id", "x", "y", "n_shingles", "digest", "signature"],
        )


def least_matches(how: NearDup) -> list[int]:
    """For each batch, the matches so far below which the posterior of reaching the threshold is under ``miss``."""
    t, found = how.percent / 100, []
    for seen in range(how.batch, how.values + 1, how.batch):
        below, m = 0.0, 0
        while True:
            below += comb(seen + 1, m) * t**m * (1 - t) ** (seen + 1 - m)
            if below >= how.miss:
                break
            m += 1
        found.append(m)
    return found


def _matrix(column: pa.Array, how: NearDup) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), how.values)


def plausible(batches: Iterator[pa.RecordBatch], how: NearDup) -> Iterator[pa.RecordBatch]:
    """Keep the pairs (lo, hi, signature_lo, signature_hi) whose signatures let them reach the threshold."""
    limits = least_matches(how)
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            a, b = _matrix(part.column("signature_lo"), how), _matrix(part.column("signature_hi"), how)
            alive = np.arange(part.num_rows)
            matches = np.zeros(part.num_rows, np.int64)
            for k, limit in enumerate(limits):
                cols = slice(k * how.batch, (k + 1) * how.batch)
                matches[alive] += (a[alive, cols] == b[alive, cols]).sum(axis=1)
                alive = alive[matches[alive] >= limit]
            yield pa.RecordBatch.from_arrays([part.column("lo").take(pa.array(alive)), part.column("hi").take(pa.array(alive))], ["lo", "hi"])


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the threshold."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    common = int((b[at] == a).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def linked_blocks(left: pa.Table, right: pa.Table, how: NearDup) -> pa.Table:
    """Verified links between a block of a bucket's outsiders and a block of its members."""
    links: list[tuple[int, int]] = []
    if left.num_rows and right.num_rows:
        limits = least_matches(how)
        band = left.column("band")[0].as_py()
        a, b = (_matrix(t.column("signature").combine_chunks(), how) for t in (left, right))
        sets = [[np.asarray(x.values) for x in t.column("found").combine_chunks()] for t in (left, right)]
        (ia, ib), (ca, cb), (ra, rb) = ([t.column(c).to_numpy() for t in (left, right)] for c in ("id", "center", "root"))
        also = right.column("outside").to_numpy(zero_copy_only=False)
        for row in range(len(ia)):
            # The bucket's center has met all; two outsiders meet once.
            alive = np.flatnonzero((rb != ra[row]) & (ib != cb) & (ia[row] != ca[row]) & ~(also & (ib < ia[row])))
            matches = np.zeros(len(ib), np.int64)
            for k, limit in enumerate(limits):
                cols = slice(k * how.batch, (k + 1) * how.batch)
                matches[alive] += (b[alive, cols] == a[row, cols]).sum(axis=1)
                alive = alive[matches[alive] >= limit]
            if not len(alive):
                continue
            shared = (b[alive] == a[row]).reshape(len(alive), how.bands, how.rows).all(axis=2).argmax(axis=1)
            alive = alive[shared == band]
            reached: set[int] = set()
            for other in alive[np.argsort(-matches[alive], kind="stable")].tolist():
                if rb[other] not in reached and _linked(sets[0][row], sets[1][other], how.percent):
                    reached.add(rb[other])
                    links.append((min(ia[row], ib[other]), max(ia[row], ib[other])))
    return pa.table({"lo": pa.array([x[0] for x in links], pa.int64()), "hi": pa.array([x[1] for x in links], pa.int64())})


def _sets_of(ids: DataFrame, texts: DataFrame, how: NearDup) -> DataFrame:
    """(id, found) with the full sets of the texts whose id is in ``ids``."""
    place = F.pmod(F.xxhash64("id"), F.lit(how.bitmap))
    words = ids.select((place / 32).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(id), {how.bitmap}) % 32 as int))").alias("bit"))
    words = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bitmap = np.zeros(how.bitmap // 32, np.uint32)
    bitmap[words.column("word").to_numpy()] = words.column("bits").to_numpy().astype(np.uint32)
    shared = texts.sparkSession.sparkContext.broadcast(bitmap)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, bitmap = Hasher(), shared.value
        for batch in batches:
            at = batch.column("place").to_numpy()
            batch = batch.filter(pa.array((bitmap[at // 32] >> (at % 32).astype(np.uint32)) & np.uint32(1) == 1))
            for block in blocks(iter([batch])):
                found = [np.sort(s.view(np.int64)) for s in shingles(hasher.words(block.data, block.starts, block.ends), block.first, how.words)]
                yield pa.RecordBatch.from_arrays([block.rows.column("id"), pa.array(found, pa.list_(pa.int64()))], ["id", "found"])

    return texts.withColumn("place", place).mapInArrow(sets, "id long, found array<long>").join(ids, "id", "left_semi")


def _star_links(buckets: DataFrame, signatures: DataFrame, sets: DataFrame, how: NearDup) -> DataFrame:
    """Verified links of each bucket's least class with the others."""
    stars = buckets.where("id <> center").select(F.col("center").alias("lo"), F.col("id").alias("hi")).distinct()
    pairs = (
        stars.join(signatures.select(F.col("id").alias("lo"), F.col("signature").alias("signature_lo")), "lo")
        .join(signatures.select(F.col("id").alias("hi"), F.col("signature").alias("signature_hi")), "hi")
        .mapInArrow(lambda b: plausible(b, how), "lo long, hi long")
    )
    both = (
        cut(pairs)
        .join(sets.select(F.col("id").alias("lo"), F.col("found").alias("a")), "lo")
        .join(sets.select(F.col("id").alias("hi"), F.col("found").alias("b")), "hi")
        .withColumn("common", F.size(F.array_intersect("a", "b")))
    )
    return both.where(F.lit(100) * F.col("common") >= F.lit(how.percent) * (F.size("a") + F.size("b") - F.col("common"))).select("lo", "hi")


def _outsider_links(buckets: DataFrame, roots: DataFrame, signatures: DataFrame, sets: DataFrame, how: NearDup) -> DataFrame:
    """Verified links between classes that share a bucket but, so far, no component."""
    placed = buckets.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    sizes = placed.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    main = sizes.groupBy("bucket").agg(F.sum("n").alias("size"), F.count("*").alias("roots"), F.max_by("root", F.struct("n", "root")).alias("main"))
    # A bucket of two needs no second look: its only pair has been compared.
    mixed = main.where("roots > 1 and size > 2").select("bucket", "main", F.ceil(F.col("size") / how.block).cast("int").alias("parts"))
    rows = placed.join(mixed, "bucket").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).withColumn("outside", F.expr("root <> main"))
    rows = cut(rows.select("bucket", "band", "part", "parts", "id", "center", "root", "outside"))
    known = signatures.join(sets, "id")
    keys, columns = ("bucket", "part", "own"), ("band", "id", "center", "root", "outside")
    outsiders = rows.where("outside").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    outsiders = outsiders.select("bucket", F.col("other").cast("long").alias("part"), F.col("part").alias("own"), *columns)
    # Members go to a task for each part that outsiders come from.
    members = rows.join(outsiders.select("bucket", "own").distinct(), "bucket").select(*(F.col(c).alias(c) for c in (*keys, *columns)))
    outsiders, members = (
        side.join(known.select(*(F.col(c).alias(c) for c in ("id", "signature", "found"))), "id") for side in (outsiders, members)
    )
    return outsiders.groupBy(*keys).cogroup(members.groupBy(*keys)).applyInArrow(lambda _, a, b: linked_blocks(a, b, how), "lo long, hi long")


def keyed_texts(docs: DataFrame, id: str, text: str, *more: Column) -> DataFrame:
    """(id, text, x, y): x and y are a digest of the text as it stands, which tells rows of one id apart."""
    whole = text_column(text)
    return docs.select(F.col(id).cast("long").alias("id"), whole.alias("text"), F.xxhash64(whole).alias("x"), F.xxhash64(F.lit(7), whole).alias("y"), *more)


def row_roots(docs: DataFrame, how: NearDup = NearDup(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, x, y, n_shingles, root, least) of every row: its component and the least id in it; both null without words or an id.

    A class goes by a hash of its least row's id and text, as several texts may share an id.
    """
    texts = keyed_texts(docs, id, text)
    base = cut(texts.mapInArrow(lambda b: sketch(b, how), SKETCH))
    classes = base.where("digest is not null and id is not null").groupBy("digest").agg(F.min(F.struct("id", "x", "y")).alias("row"), F.first("signature").alias("signature"))
    classes = cut(classes.select("digest", "row.id", F.xxhash64("row.id", "row.x", "row.y").alias("class"), "signature"))
    signatures = classes.select(F.col("class").alias("id"), "signature")
    width = 2 * how.rows
    bands = signatures.select("id", "signature", F.explode(F.sequence(F.lit(0), F.lit(how.bands - 1))).alias("band"))
    bands = bands.select("id", "band", F.expr(f"xxhash64(band, substring(signature, band * {width} + 1, {width}))").alias("bucket"))
    shared = bands.groupBy("bucket").agg(F.min("id").alias("center"), F.count("*").alias("n")).where("n > 1").drop("n")
    buckets = cut(bands.join(shared, "bucket").select("bucket", "band", "id", "center"))
    in_buckets = buckets.select("id").distinct()
    named = texts.where("id is not null").select(F.xxhash64("id", "x", "y").alias("id"), "text")
    sets = cut(_sets_of(in_buckets, named, how).dropDuplicates(["id"]))
    signatures = cut(signatures.join(in_buckets, "id", "left_semi"))
    links = _star_links(buckets, signatures, sets, how)
    roots = components(links.select("hi", "lo"))
    more = _outsider_links(buckets, roots, signatures, sets, how)
    roots = components(roots.select(F.col("node").alias("hi"), F.col("root").alias("lo")).union(more.select("hi", "lo")))
    of_class = classes.join(roots, F.col("class") == F.col("node"), "left").select("digest", "id", F.coalesce("root", "class").alias("root"))
    least = of_class.groupBy("root").agg(F.min("id").alias("least"))
    of_class = of_class.drop("id").join(least, "root")
    return base.select("id", "x", "y", "n_shingles", "digest").join(of_class, "digest", "left").select(
        "id", "x", "y", "n_shingles", *(F.when(F.col("id").isNotNull(), F.col(c)).alias(c) for c in ("root", "least"))
    )


def near_duplicates(docs: DataFrame, how: NearDup = NearDup(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row of ``docs``.

    ``component_id`` is the least id that links reach, ``kept`` says whether it is the row's own.
    A null or wordless text has no shingles and links with nothing. A text of fewer words than a
    shingle is one shingle. Rows with a null id are kept alone, with a null component. Rows that
    share an id share a component if their texts do; of such rows all carry the same verdict.
    Other columns are not read. An empty table gives an empty result.
    """
    return row_roots(docs, how, id, text).select(
        F.col("id").alias(id),
        "n_shingles",
        F.coalesce("least", "id").alias("component_id"),
        F.coalesce(F.coalesce("least", "id") == F.col("id"), F.lit(True)).alias("kept"),
    )


def keep_first(docs: DataFrame, how: NearDup = NearDup(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component of ``docs``, all columns unchanged: that of the least id, then of the least digest of the text.

    Verdicts are by id and text, as one id may come with several texts. Of rows equal in both one stays; if other
    columns tell them apart, any one. Rows without words or with a null id all stay.
    """
    found = cut(row_roots(docs, how, id, text).where("root is not null").groupBy("id", "x", "y", "root").agg(F.count("*").alias("n")))
    first = found.groupBy("root").agg(F.min(F.struct("id", "x", "y")).alias("first"))
    firsts = first.select(F.col("first.id").alias("of"), F.col("first.x").alias("x1"), F.col("first.y").alias("y1"))
    gone = found.join(firsts, F.expr("id = of and x = x1 and y = y1"), "left_anti").select(*(F.col(c).alias(f"{c}0") for c in ("id", "x", "y")))
    rows = keyed_texts(docs, id, text, F.struct(*docs.columns).alias("row")).drop("text")
    left = rows.join(gone, F.expr("id = id0 and x = x0 and y = y0"), "left_anti")
    again = found.where("n > 1").join(firsts, F.expr("id = of and x = x1 and y = y1"), "left_semi").select(*(F.col(c).alias(f"{c}0") for c in ("id", "x", "y")))
    if again.isEmpty():
        return left.select("row.*")
    same = F.expr("id = id0 and x = x0 and y = y0")
    once = left.join(again, same, "left_anti").select("row.*")
    return once.union(left.join(again, same, "left_semi").dropDuplicates(["id", "x", "y"]).select("row.*"))
