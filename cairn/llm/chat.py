"""Chat formatting: logged conversations that only begin a longer one are dropped, the rest are rendered.

A conversation is its rows in the order of turn (null first), role and text. Each row's digest covers its place,
role and text; the running xor of these is the digest of the prefix that ends there (two of 64 bits, with
different seeds). A conversation whose whole digest is another's proper-prefix digest of that length is an
earlier snapshot of it and goes; of equal conversations the one of the least id stays.

A conversation is never gathered as a whole: its rows are handled in pieces of ``piece`` turn numbers, pieces are
summed up in order, and the rendered text comes in parts of one piece each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.jobs import cut

START, END = "<|im_start|>", "<|im_end|>"


def rendered(role: Column, text: Column) -> Column:
    """One turn. ``<|`` inside is written ``<\\|`` and a backslash twice, so the markers stay the only ones."""
    plain = lambda c: F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))
    return F.concat(F.lit(START), plain(role), F.lit("\n"), plain(text), F.lit(END + "\n"))


def _placed(turns: DataFrame, piece: int, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, piece, place, role, text, x, y): places from 0; x and y digest the prefix up to and with the row."""
    frame = turns.where(F.col(conversation).isNotNull()).select(
        F.col(conversation).alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit("unknown")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    frame = frame.withColumn("piece", F.coalesce(F.floor(F.col("turn") / piece), F.lit(-(1 << 62))))
    inside = Window.partitionBy("conv", "piece").orderBy("turn", "role", "text")
    frame = frame.withColumn("inside", F.row_number().over(inside) - 1)
    sizes = frame.groupBy("conv", "piece").agg(F.count("*").alias("size"))
    earlier = Window.partitionBy("conv").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("conv", "piece", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("start"))
    frame = frame.join(starts, ["conv", "piece"]).withColumn("place", F.col("start") + F.col("inside"))
    frame = frame.withColumn("x0", F.xxhash64("place", "role", "text")).withColumn("y0", F.xxhash64(F.lit(7), "text", "role", "place"))
    upto = Window.partitionBy("conv", "piece").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    frame = frame.withColumn("x1", F.bit_xor("x0").over(upto)).withColumn("y1", F.bit_xor("y0").over(upto))
    frame = cut(frame.select("conv", "piece", "place", "role", "text", "x0", "y0", "x1", "y1"))
    sums = frame.groupBy("conv", "piece").agg(F.bit_xor("x0").alias("x2"), F.bit_xor("y0").alias("y2"))
    before = sums.select("conv", "piece", *(F.coalesce(F.bit_xor(c).over(earlier), F.lit(0)).alias(c) for c in ("x2", "y2")))
    return frame.join(before, ["conv", "piece"]).select(
        "conv", "piece", "place", "role", "text", F.col("x1").bitwiseXOR(F.col("x2")).alias("x"), F.col("y1").bitwiseXOR(F.col("y2")).alias("y")
    )


def maximal(placed: DataFrame) -> DataFrame:
    """(conv, n_turns) of the conversations that are no prefix of a longer one, one of each group of equals."""
    prefixes = placed.select("conv", "place", "x", "y")
    whole = prefixes.groupBy("conv").agg(F.max(F.struct("place", "x", "y")).alias("last")).select("conv", "last.*")
    first = whole.groupBy("place", "x", "y").agg(F.min("conv").alias("conv"))
    inner = prefixes.join(whole.select("conv", F.col("place").alias("end")), "conv").where("place < end").select("place", "x", "y").distinct()
    return first.join(inner, ["place", "x", "y"], "left_anti").select("conv", (F.col("place") + 1).alias("n_turns"))


def format_chats(turns: DataFrame, piece: int = 256, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conversation, n_turns, part, text): the maximal conversations, rendered; parts in order make the whole.

    A null role is ``unknown``, a null text is empty, rows of a null conversation are left out. Rows that tie in
    turn, role and text are equal, so their order is of no account. Other columns are not read. An empty table
    gives an empty result.
    """
    placed = cut(_placed(turns, piece, conversation, turn, role, text))
    rows = placed.join(maximal(placed).select(F.col("conv").alias("kept"), "n_turns"), F.col("conv") == F.col("kept"))
    line = F.struct("place", rendered(F.col("role"), F.col("text")).alias("text"))
    parts = rows.groupBy("conv", "piece", "n_turns").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    order = Window.partitionBy("conv").orderBy("piece")
    return parts.select(
        F.col("conv").alias(conversation),
        "n_turns",
        (F.row_number().over(order) - 1).cast("long").alias("part"),
        F.array_join(F.transform("lines", lambda x: x["text"]), "").alias("text"),
    )
