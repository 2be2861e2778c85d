"""What the operators share: words, tables, row packing and connected components.

Operators keep an input row whole in one struct column ``row`` beside the columns they
add, so an input column may have any name; ``select("row.*")`` gives the input back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postsift.session import cut_lineage

SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
WORD = NOT_SPACE + "+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame) -> Column:
    """The whole input row as one struct."""
    return F.struct(*[F.col(f"`{name}`") for name in df.columns])


def words_of(text: Column) -> Column:
    """Words of a text that is not null, in order."""
    return F.array_remove(F.split(text, SPACE), "")


def run_hashes(df: DataFrame, hashes: str, length: int, name: str) -> DataFrame:
    """Adds array ``name``: one hash for every ``length`` consecutive hashes of ``hashes``.

    Runs of one, two, four ... elements are hashed from two runs half as long, so a run
    of any length costs a logarithmic number of steps. Too short an array gives none.
    """
    step, whole, covered, made = hashes, None, 0, []

    def joined(left: str, right: str, shift: int) -> Column:
        return F.zip_with(left, F.slice(right, shift + 1, F.size(right)), lambda x, y: F.xxhash64(x, y))

    size = 1
    while True:
        if length & size:
            if whole is None:
                whole, covered = step, size
            else:
                made.append(unique_name(f"_r{covered + size}", df.columns))
                df = df.withColumn(made[-1], joined(whole, step, covered))
                whole, covered = made[-1], covered + size
        if covered == length:
            break
        made.append(unique_name(f"_d{2 * size}", df.columns))
        df = df.withColumn(made[-1], joined(step, step, size))
        step, size = made[-1], 2 * size
    count = F.greatest(F.size(hashes) - (length - 1), F.lit(0))
    return df.withColumn(name, F.slice(whole, 1, count)).drop(*made)


def unique_name(base: str, taken: list[str]) -> str:
    while base in taken:
        base += "_"
    return base


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from every node of ``edges`` (a, b).

    Nodes are longs. Each round links every node to the smallest one around it, first
    from the larger neighbours and then from all of them; the number of rounds grows
    with the logarithm of the longest path. A hub is one row per neighbour, grouped with
    map-side combine, and the join back on it is left to adaptive skew splitting. Rounds
    are cut by reliable checkpoints. Nodes whose edges are all loops are absent.
    """
    edges = cut_lineage(edges.where("a <> b")
                        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                        .distinct())
    known = None
    while True:
        # Large star: larger neighbours of a node move to the smallest around it.
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = (around.where("b > a").join(low, "a")
                 .select(F.col("b").alias("a"), F.col("low").alias("b")))
        large = large.where("a <> b").distinct()
        # Small star: the node and its smaller neighbours move to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = (large.join(least, "a").where("b <> low")
                 .select(F.col("b").alias("a"), F.col("low").alias("b"))
                 .unionByName(least.select("a", F.col("low").alias("b"))).distinct())
        edges = cut_lineage(small)
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == known:
            return edges.groupBy("a").agg(F.min("b").alias("root")).select(
                F.col("a").alias("node"), "root").unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        known = state
