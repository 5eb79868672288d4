"""Stored inverted indexes: weighted texts by token and position, names by trigram.

An index is a folder of Parquet files, one directory per bucket of the token
(trigram), each sorted by token. A query reads the buckets of its own tokens
only, and within them the row groups whose range of tokens fits. Tokens are
placed by CRC-32, which the driver can work out without a job.

A frequent token may hold a third of all postings, so a bucket is written by
``spread`` tasks, dealt by site; each writes files of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.text import Term, fold_text, free_terms, token_list

#: The columns of a text index and of a name index.
POSTINGS = "token string, site_id bigint, weight int, field bigint, copies bigint, positions array<int>"
GRAMS = "token string, category string, item bigint"


@dataclass(frozen=True)
class StoredIndex:
    """Where an index lies and into how many buckets its tokens are dealt."""

    path: str
    buckets: int

    def rows(self, spark: SparkSession, tokens: Sequence[str]) -> DataFrame:
        """The rows of some tokens; only their buckets are listed and read."""
        buckets = sorted({bucket_of(token, self.buckets) for token in tokens})
        return spark.read.parquet(self.path).where(F.col("bucket").isin(buckets) & F.col("token").isin(list(tokens)))


def bucket_of(token: str, buckets: int) -> int:
    return zlib.crc32(token.encode()) % buckets


def write_index(rows: DataFrame, path: str, buckets: int, owner: str, spread: int = 8) -> StoredIndex:
    """Write index rows to a new folder; an existing one is an error."""
    placed = rows.withColumn("bucket", (F.crc32(F.col("token").cast("binary")) % buckets).cast("int"))
    dealt = placed.repartition(F.col("bucket"), F.pmod(F.xxhash64(owner), F.lit(spread)))
    # The bucket comes first in the order, as the writer wants it.
    dealt.sortWithinPartitions("bucket", "token", owner).write.mode("error").partitionBy("bucket").parquet(path)
    return StoredIndex(path, buckets)


def _places(tokens: Column) -> Column:
    """Per distinct token of a list, the token and its positions. One sort of the list; its runs are cut apart."""
    placed = F.array_sort(F.transform(tokens, lambda w, k: F.struct(w.alias("token"), k.alias("at"))))

    def runs(rows: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(rows) - 1),
            lambda k: (k == 0) | (F.get(rows, k)["token"] != F.get(rows, F.greatest(k - 1, F.lit(0)))["token"]),
        )

        def cut(edges: Column) -> Column:
            return F.transform(
                edges,
                lambda a, n: F.struct(
                    F.get(rows, a)["token"].alias("token"),
                    F.slice(rows, a + 1, F.coalesce(F.get(edges, n + 1), F.size(rows)) - a)["at"].alias("positions"),
                ),
            )

        return F.when(F.size(rows) > 0, F.get(F.transform(F.array(starts), cut), 0))

    # A list of one is a name for the sorted list, which is used several times.
    return F.get(F.transform(F.array(placed), runs), 0)


def postings(texts: DataFrame) -> DataFrame:
    """One row per (token, text) of (site_id, weight, text): the positions of the token.

    Equal texts of a site and weight are one field with a number of copies. A text
    is one row, so its tokens are gathered within it and no token is shuffled here.
    """
    fields = texts.groupBy("site_id", F.col("weight").cast("int").alias("weight"), "text").agg(F.count(F.lit(1)).alias("copies"))
    listed = fields.select(
        "site_id", "weight", F.xxhash64("weight", "text").alias("field"), "copies", token_list(fold_text(F.col("text"))).alias("tokens")
    )
    each = listed.select("site_id", "weight", "field", "copies", F.explode(_places(F.col("tokens"))).alias("e"))
    return each.select("e.token", "site_id", "weight", "field", "copies", "e.positions")


def index_texts(texts: DataFrame, path: str, buckets: int = 256, spread: int = 8) -> StoredIndex:
    """Store the postings of (site_id, weight, text)."""
    return write_index(postings(texts), path, buckets, "site_id", spread)


def _phrase_holds(words: Sequence[str]) -> Column:
    """Over the rows of one field: whether the words stand one after the other."""

    def starts(k: int) -> Column:
        """Where the phrase would begin, by the positions of its word k; one row a field has them."""
        return F.max(F.when(F.col("token") == words[k], F.transform("positions", lambda p: p - F.lit(k))))

    both = reduce(F.array_intersect, map(starts, range(len(words))))
    return F.coalesce(F.size(both) > 0, F.lit(False))


def indexed_scores(spark: SparkSession, index: StoredIndex, query: str) -> DataFrame:
    """(site_id, score) of the sites that a free-text query finds, from their postings alone."""
    words, phrases, unwanted = free_terms(query)
    every = sorted({*words, *(w for p in (*phrases, *unwanted) for w in p)})
    if not words:
        return spark.createDataFrame([], "site_id bigint, score bigint")
    rows = index.rows(spark, every)
    hits = F.when(F.col("token").isin(words), F.size("positions") * F.col("weight") * F.col("copies")).otherwise(0)
    flags = {f"has{k}": p for k, p in enumerate(phrases)} | {f"not{k}": p for k, p in enumerate(unwanted)}
    if any(len(p) > 1 for p in flags.values()):
        # Words of a phrase must meet in one field.
        rows = rows.groupBy("site_id", "field", "weight").agg(F.sum(hits).alias("hits"), *(_phrase_holds(p).alias(f) for f, p in flags.items()))
    else:
        rows = rows.select("site_id", hits.alias("hits"), *((F.col("token") == p[0]).alias(f) for f, p in flags.items()))
    sites = rows.groupBy("site_id").agg(F.sum("hits").cast("bigint").alias("score"), *(F.bool_or(f).alias(f) for f in flags))
    wanted = " AND ".join(["score > 0", *(f if f.startswith("has") else f"NOT {f}" for f in flags)])
    return sites.where(wanted).select("site_id", "score")


# --- names by trigram ------------------------------------------------------------------


def grams_of(text: str) -> set[str]:
    lowered = text.lower()
    return {lowered[k : k + 3] for k in range(len(lowered) - 2)}


def name_grams(names: DataFrame) -> DataFrame:
    """Distinct (token, category, item) of (category, item, text): the trigrams of every name."""
    lowered = F.lower("text")
    starts = F.sequence(F.lit(1), F.length(lowered) - 2)
    grams = F.array_distinct(F.transform(starts, lambda k: F.substring(lowered, k, F.lit(3))))
    return names.where(F.length(lowered) > 2).select(F.explode(grams).alias("token"), "category", "item").distinct()


def index_names(names: DataFrame, path: str, buckets: int = 64, spread: int = 8) -> StoredIndex:
    """Store the trigrams of (category, item, text)."""
    return write_index(name_grams(names), path, buckets, "item", spread)


def gram_sets(pattern: str, alternatives: list[list[Term]]) -> list[set[str]] | None:
    """Sets of trigrams; a name that a search can find holds all trigrams of one of the sets.

    None if some way to match has no trigram, so that the index cannot help. The
    first set stands for a hit inside the name: parts of the pattern between
    wildcards. Each other one stands for an alternative of the query: its wanted words.
    """
    parts, at, part = [], 0, ""
    while at < len(pattern):
        c = pattern[at]
        if c == "\\" and at + 1 < len(pattern):
            at += 1
            part += pattern[at]
        elif c in "%_":
            parts.append(part)
            part = ""
        else:
            part += c
        at += 1
    sets = [set().union(*(grams_of(p) for p in (*parts, part)))]
    for terms in alternatives:
        sets.append(set().union(*(grams_of(token) for term in terms if term.wanted for token in term.tokens)))
    return sets if all(sets) else None


def candidates(spark: SparkSession, index: StoredIndex, category: str, sets: list[set[str]]) -> DataFrame:
    """Items of a category that hold all trigrams of one of the sets."""
    rows = index.rows(spark, sorted(set().union(*sets))).where(F.col("category") == category)
    counts = rows.groupBy("item").agg(*(F.count(F.when(F.col("token").isin(list(s)), 1)).alias(f"n{k}") for k, s in enumerate(sets)))
    full = " OR ".join(f"n{k} = {len(s)}" for k, s in enumerate(sets))
    return counts.where(full).select("item")
