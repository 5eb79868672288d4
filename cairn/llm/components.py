"""Connected components by star contraction, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.jobs import cut


#: Edges a task, at most about so many: a pass over few edges has few tasks and files, whatever the number of shuffle partitions.
EDGES = 20_000


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Every neighbour above a node moves to the least of the node and its neighbours."""
    both = edges.select(F.col("hi").alias("node"), F.col("lo").alias("other")).union(edges.select("lo", "hi"))
    least = both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("root"))
    moved = both.join(least, "node").where("other > node and other <> root").select(F.col("other").alias("hi"), F.col("root").alias("lo"))
    return moved.coalesce(tasks).distinct().coalesce(tasks)


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    """A node and its lower neighbours move to the least of these."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("root"))
    moved = edges.join(least, "hi").where("lo <> root").select(F.col("lo").alias("hi"), F.col("root").alias("lo"))
    return moved.union(least.select("hi", F.col("root").alias("lo"))).coalesce(tasks).distinct().coalesce(tasks)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (hi, lo; hi > lo) that is not the least of its component.

    Every pass shortens all paths; it ends when a pass changes no edge. A node with very many
    neighbours costs no more than its edges: they are joined and aggregated, never gathered.
    """
    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(hi, lo))")).first())

    edges = cut(edges.select("hi", "lo").distinct())
    seen = state(edges)
    while True:
        # A pass makes at most one edge of an edge's either end.
        tasks = seen[0] // EDGES + 1
        edges = cut(_small_star(_large_star(edges.coalesce(tasks), tasks), tasks))
        now = state(edges)
        if now == seen:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        seen = now
