"""Chat formatting with collapse of cumulative snapshots.

A logged conversation is often stored again after every turn; each snapshot is a prefix
of the next. Every turn gets a rolling hash of the conversation up to it: the exclusive or
of position-salted turn hashes, 128 bits in two halves, so a running aggregate makes it
whatever the length. A conversation whose whole hash is the prefix hash of a longer one
goes (an anti-join on length and hash), and of equal conversations the smallest id stays.
What is left is rendered in parts of at most ``PART_TURNS`` turns, in order; their texts
joined by nothing give the conversation.

Turns are ordered by ``turn`` (nulls last), then by role and text; their places count from
one, so gaps do not matter and repeated rows are repeated turns. Null roles and texts are
different from empty ones; they are rendered as empty. Rows whose id is null are one
conversation. A conversation of very many turns is numbered in blocks of turns, so no task
has to take it whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postsift.session import cut_lineage

BLOCK_TURNS = 1024
PART_TURNS = 1024
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def numbered(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
             text: str = "text") -> DataFrame:
    """(conv, place, role, text, block): turns in order, places from one."""
    df = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"),
                      F.col(text).alias("text"))
    low = F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(1 << 62)).cast("long")
    df = df.withColumn("block", low)
    within = Window.partitionBy("conv", "block").orderBy(
        F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    df = df.withColumn("in", F.row_number().over(within))
    sizes = df.groupBy("conv", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("conv").alias("_c"), F.col("block").alias("_b"), F.coalesce(
        F.sum("n").over(before), F.lit(0)).alias("offset"))
    return df.join(offsets, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b"))).select(
        "conv", (F.col("offset") + F.col("in")).alias("place"), "role", "text", "block")


def prefixes(placed: DataFrame) -> DataFrame:
    """(conv, place, a, b): the rolling hash of each conversation up to each place."""
    parts = [F.col("place"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    one, two = F.xxhash64(*parts), F.xxhash64(F.lit("second half"), *parts)
    df = placed.select("conv", "block", "place", one.alias("ha"), two.alias("hb"))
    within = Window.partitionBy("conv", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    df = df.select("conv", "block", "place", F.bit_xor("ha").over(within).alias("ia"),
                   F.bit_xor("hb").over(within).alias("ib"))
    # What earlier blocks contribute: their last running values, one short row a block.
    ends = df.groupBy("conv", "block").agg(F.max(F.struct("place", "ia", "ib")).alias("e"))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        F.col("conv").alias("_c"), F.col("block").alias("_b"),
        F.coalesce(F.bit_xor("e.ia").over(before), F.lit(0)).alias("ca"),
        F.coalesce(F.bit_xor("e.ib").over(before), F.lit(0)).alias("cb"))
    met = df.join(carried, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b")))
    return met.select("conv", "place", F.col("ia").bitwiseXOR(F.col("ca")).alias("a"),
                      F.col("ib").bitwiseXOR(F.col("cb")).alias("b"))


def maximal(placed: DataFrame) -> DataFrame:
    """(conv, turns): conversations that no longer one continues, one of each equal kind."""
    rolled = cut_lineage(prefixes(placed))
    last = rolled.groupBy("conv").agg(F.max(F.struct("place", "a", "b")).alias("e")).select(
        "conv", "e.place", "e.a", "e.b")
    # One row for each kind of conversation, smallest id first; null counts as the last id.
    kinds = last.groupBy("place", "a", "b").agg(
        F.min("conv").alias("conv"))
    longer = rolled.join(last.select(F.col("conv").alias("_c"), F.col("place").alias("size")),
                         F.col("conv").eqNullSafe(F.col("_c"))).where("place < size")
    inner = longer.select("place", "a", "b").distinct()
    return kinds.join(inner, ["place", "a", "b"], "left_anti").select(
        "conv", F.col("place").alias("turns"))


def rendered(role: Column, text: Column) -> Column:
    empty = F.lit("")
    return F.concat(F.lit(OPEN), F.coalesce(role, empty), F.lit("\n"), F.coalesce(text, empty),
                    F.lit(CLOSE + "\n"))


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text") -> DataFrame:
    """(conv, part, n_turns, chat) of the maximal conversations."""
    placed = numbered(turns, conv, turn, role, text)
    kept = maximal(placed).select(F.col("conv").alias("_c"))
    df = placed.join(kept, F.col("conv").eqNullSafe(F.col("_c")), "left_semi")
    part = F.floor((F.col("place") - 1) / PART_TURNS).cast("long")
    lines = F.array_sort(F.collect_list(F.struct("place", rendered(F.col("role"), F.col("text")).alias("t"))))
    return df.groupBy("conv", part.alias("part")).agg(
        F.count("*").alias("n_turns"),
        F.array_join(F.transform(lines, lambda x: x["t"]), "").alias("chat")).withColumnRenamed("conv", conv)
