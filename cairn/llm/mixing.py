"""Mixing sources to target weights along a curriculum.

Every source gets a target of words: its weight's share of all words, at most ``most`` times its own words, the
excess shared again by weight. Words of a source are taken from an endless repetition of its documents in an order
fixed by a hash of their ids, so a document is taken whole, several times, or in part where the target ends.

Along training (0 to 1) a source's weight changes by a schedule of straight pieces. The schedule's integral is
the source's cumulative demand; a document taken after a share f of its source's target stands at the position
where the demand reaches f. Documents are range-sorted by position.

Running sums need no source in one task: documents are summed in 4,096 ordered slices of the hash, slices are
summed in order within their source, and only then documents within their slice.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.jobs import cut

WORDS = r"[^\x20\x09-\x0D]+"
#: Points (position, weight) of a schedule; straight between them.
Schedule = Sequence[tuple[float, float]]


@dataclass(frozen=True)
class Mixing:
    """Weights by the sources' order, repeated; one schedule for each weight; and the most passes over a source."""

    weights: tuple[int, ...] = (5, 2, 1)
    schedules: tuple[Schedule, ...] = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.75), (1.0, 2.0)))
    most: int = 3
    seed: int = 1


def _pieces(schedule: Schedule) -> list[tuple[float, float, float, float, float]]:
    """(start, length, weight at start, at end, demand before) of each piece, demand running from 0 to 1."""
    raw = [(t0, t1 - t0, w0, w1) for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False) if t1 > t0]
    total = sum(h * (w0 + w1) / 2 for _, h, w0, w1 in raw)
    pieces, before = [], 0.0
    for start, h, w0, w1 in raw:
        pieces.append((start, h, w0 / total, w1 / total, before))
        before += h * (w0 + w1) / 2 / total
    return pieces


def position(share: Column, schedule: Schedule) -> Column:
    """Where the schedule's demand reaches ``share``: the root of a quadratic in the piece that holds it."""
    found = None
    for start, h, w0, w1, before in _pieces(schedule):
        rest = F.greatest(share - F.lit(before), F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * (w1 - w0) / h) * rest, F.lit(0.0)))
        here = F.when(rest == 0, F.lit(start)).otherwise(F.lit(start) + F.least(F.lit(2.0) * rest / (F.lit(w0) + root), F.lit(h)))
        found = here if found is None else F.when(share >= F.lit(before), here).otherwise(found)
    return found


def _sized(docs: DataFrame, how: Mixing, id: str, text: str, source: str, row: Column) -> DataFrame:
    return docs.select(
        row.alias("row"),
        F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")).alias("key"),
        F.col(source).alias("source"),
        F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORDS)).cast("long").alias("size"),
        F.md5(F.concat(F.coalesce(F.col(id).cast("string"), F.lit("")), F.lit(f":{how.seed}"))).alias("order"),
    ).withColumn("slice", F.substring("order", 1, 3))


def targets(sizes: DataFrame, how: Mixing) -> DataFrame:
    """(key, source, source_size, place, target) from (key, source, source_size): one row a source, so this is small.

    Sources are capped in the order of cap by weight; the first that needs no cap sets the level of the rest.
    """
    many = len(how.weights)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy("level", "rank")
    rest = by_level.rowsBetween(0, Window.unboundedFollowing)
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = reduce(lambda found, k: F.when(F.col("place") == k, F.lit(how.weights[k])).otherwise(found), range(many), F.lit(0))
    ranked = sizes.withColumn("rank", F.row_number().over(by_name)).withColumn("place", F.pmod(F.col("rank") - 1, F.lit(many)).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * how.most).withColumn("level", F.col("cap") / F.col("weight"))
    ranked = ranked.withColumn("total", F.sum("source_size").over(everything))
    ranked = ranked.withColumn("free", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("share", F.sum("weight").over(rest))
    ranked = ranked.withColumn("lambda", (F.col("total") - F.col("free")) / F.col("share")).withColumn("capped", F.expr("`lambda` >= level"))
    first = F.min(F.when(~F.col("capped"), F.struct("level", "rank", "lambda"))).over(everything)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(first["lambda"] * F.col("weight"))
    return ranked.select("key", "source", "source_size", "place", target.alias("target"))


def _mixed(docs: DataFrame, how: Mixing, id: str, text: str, source: str, row: Column) -> DataFrame:
    """(row, size, source_size, target, taken, positions)."""
    plain = cut(_sized(docs, how, id, text, source, F.lit(None)).groupBy("key", "source", "slice").agg(F.sum("size").alias("words")))
    sources = targets(plain.groupBy("key", "source").agg(F.sum("words").alias("source_size")), how)
    earlier = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = plain.select("key", "slice", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("start"))
    slices = cut(slices.join(sources.drop("source"), "key").withColumn("quota", F.round("target").cast("long")))
    inside = Window.partitionBy("key", "slice").orderBy("order", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = _sized(docs, how, id, text, source, row).withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(slices, ["key", "slice"]).withColumn("at", F.col("start") + F.col("before"))
    whole = F.expr("if(source_size = 0, 0, quota div source_size)")
    part = F.least(F.greatest(F.col("quota") - whole * F.col("source_size") - F.col("at"), F.lit(0)), F.col("size"))
    placed = placed.withColumn("taken", whole * F.col("size") + part).withColumn("times", F.when(F.col("size") > 0, whole + (part > 0).cast("long")).otherwise(0))

    def positions(k: int) -> Column:
        share = lambda e: (F.col("at") + e * F.col("source_size")) / F.col("quota")
        return F.transform(F.sequence(F.lit(0), F.col("times") - 1), lambda e: position(share(e), how.schedules[k]))

    found = reduce(lambda rest, k: F.when(F.col("place") == k, positions(k)).otherwise(rest), range(len(how.weights)), F.lit(None))
    return placed.select(
        "row", "size", "source_size", "target", "taken", F.when(F.col("times") > 0, found).otherwise(F.array().cast("array<double>")).alias("positions")
    )


def mix(docs: DataFrame, how: Mixing = Mixing(), id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(id, size, source_size, target, taken, positions) of every document, range-sorted by first position.

    ``positions`` has one entry for each time the document is taken, the last of them perhaps in part; documents
    that are not taken come last. A null or wordless text has size 0 and is never taken. A null source is a source
    of its own, after all others. Equal ids stand together, the shorter text first; equal rows get equal numbers up to
    the last one's part. Other columns are not read. An empty table gives an empty result.
    """
    found = _mixed(docs, how, id, text, source, F.col(id)).withColumnRenamed("row", id)
    return found.orderBy(F.try_element_at("positions", F.lit(1)).asc_nulls_last(), id)


def mixture(docs: DataFrame, how: Mixing = Mixing(), id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents that the mix takes, with ``taken`` and ``positions``, range-sorted by first position.

    All columns of ``docs`` stay; an added name that clashes with one of them gets a trailing underscore.
    """
    found = _mixed(docs, how, id, text, source, F.struct(*docs.columns)).where("taken > 0")
    names = {}
    for name in ("taken", "positions"):
        names[name] = name
        while names[name] in docs.columns:
            names[name] += "_"
    ordered = found.orderBy(F.element_at("positions", 1), F.col(f"row.{id}"))
    return ordered.select("row.*", *(F.col(name).alias(own) for name, own in names.items()))
