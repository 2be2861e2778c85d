"""Mixing sources to target weights, by drawing blocks.

The words of every source are laid end to end and cut into blocks of fixed length. A mix
is a sequence of slots, one block each, dealt over output shards: every shard draws how
many of its slots each source gets from a multinomial of the targets; the k-th slot of a
source, counted over all shards, reads the block at place k of a pseudorandom permutation
of the source's blocks, one permutation for each pass over the source. Slots and blocks
meet in a join on (source, block).

The draws of all shards together miss the targets by about the square root of the number
of slots. So a source stops at the number of slots of its target, and its surplus slots,
numbered, go to the sources that are short. The short block at a source's end comes last
in each pass and the last slot of a source is cut to the words that are left; so every
source takes exactly its rounded target, and no word is taken more often than the number
of passes, rounded up.

Null sources are one source, the last. Rows of size 0 (or null) take part in nothing and
appear in no slot. Repeated rows are separate rows. An empty table gives an empty mix.
Results depend on the rows and the seed only, not on partitions; rows that tie on
``order`` may swap places.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postsift.llm.common import SPACE, WORD, packed
from postsift.session import broadcast_if_small, cut_lineage, stored

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
BLOCK_WORDS = 1024
SHARD_SLOTS = 256
SEED = 20240229
ROWS_A_BUCKET = 2000
# Primes above any number of blocks: each is prime to every block count below it.
PRIMES = (1099511627791, 1099511627803, 1099511627831, 1099511627873, 1099511627891,
          1099511627917, 1099511627933, 1099511627953)


def count_words(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE,
            cap: float = CAP) -> DataFrame:
    """Adds ``number`` (order by code point, null last), ``weight`` and ``target``.

    ``sources`` has one row a source: (source, source_size). The target is the lesser of
    the cap and the weight times one water level. Sources are met in the order in which
    they reach their cap: the level is that of the first that has room for its part, which
    is the highest among those that have.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    wave = F.array(*[F.lit(float(w)) for w in weights])
    df = sources.withColumn("number", F.row_number().over(by_name).cast("long"))
    df = df.withColumn("weight", F.get(wave, ((F.col("number") - 1) % len(weights)).cast("int")))
    df = df.withColumn("_cap", F.col("source_size") * float(cap)).withColumn(
        "_full", F.col("_cap") / F.col("weight"))
    before = Window.orderBy("_full", "number").rowsBetween(Window.unboundedPreceding, -1)
    from_here = Window.orderBy("_full", "number").rowsBetween(0, Window.unboundedFollowing)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = (F.sum("source_size").over(every) * float(share)
            - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
    df = df.withColumn("_level", rest / F.sum("weight").over(from_here))
    level = F.max(F.when(F.col("_level") <= F.col("_full"), F.col("_level"))).over(every)
    return df.withColumn("target", F.coalesce(
        F.least(F.col("_cap"), level * F.col("weight")), F.col("_cap"))).drop(
        "_cap", "_full", "_level")


def place(docs: DataFrame, source: str, size: str, order: list[str], **goal) -> tuple[DataFrame, DataFrame]:
    """Rows on the word axes of their sources, and the sources with their targets.

    Rows: ``row``, ``number``, ``size``, ``start``. The axis of a source runs over hash
    buckets of its rows, so that the running sums of a source that holds most rows are
    spread over many tasks; the sums of the buckets are one short row each.
    """
    buckets = max(1, math.ceil(docs.count() / ROWS_A_BUCKET))
    df = docs.select(
        packed(docs).alias("row"), F.col(source).alias("source"),
        F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("size"),
        F.pmod(F.xxhash64(*order), F.lit(buckets)).alias("bucket"))
    sums = cut_lineage(df.groupBy("source", "bucket").agg(F.sum("size").alias("words")))
    sources = cut_lineage(targets(
        sums.groupBy("source").agg(F.sum("words").alias("source_size")), **goal))
    behind = (Window.partitionBy("source").orderBy("bucket")
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("source", "bucket", F.coalesce(
        F.sum("words").over(behind), F.lit(0)).alias("offset"))
    offsets = offsets.join(broadcast_if_small(sources.select(
        F.col("source").alias("_s"), "number")), F.col("source").eqNullSafe(F.col("_s"))).select(
        F.col("source").alias("_s"), F.col("bucket").alias("_b"), "offset", "number")
    met = df.join(offsets, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b")))
    within = (Window.partitionBy("number", "bucket")
              .orderBy(*[F.col(f"row.{c}") for c in order], "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = met.withColumn("start", F.col("offset") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    return placed.select("row", "number", "size", "start"), sources


def draw_slots(sources: DataFrame, block_words: int = BLOCK_WORDS,
               shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """The mix: (shard, slot, number, block, words), ``words`` from the block's start."""
    spark, size = sources.sparkSession, F.lit(block_words)
    plan = sources.select("number", "source_size", F.round("target").cast("long").alias("goal"))
    passes = F.floor(F.col("goal") / F.col("source_size"))
    plan = plan.where("goal > 0").select(
        "number", "source_size", "goal",
        F.ceil(F.col("source_size") / size).alias("blocks"),
        F.floor(F.col("source_size") / size).alias("whole"), passes.alias("passes"),
        (F.col("goal") - passes * F.col("source_size")).alias("rest"))
    plan = plan.withColumn("slots", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / size))
    before = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    total = plan.agg(F.sum("slots")).first()[0] or 0
    plan = plan.withColumn("low", F.coalesce(F.sum("slots").over(before), F.lit(0)) / F.lit(float(max(total, 1))))
    plan = cut_lineage(plan.withColumn("high", F.coalesce(
        F.lead("low").over(Window.orderBy("number")), F.lit(1.0))))

    # One categorical draw a slot makes the shard's multinomial counts. A guide table of
    # equal cells of [0, 1) turns the search of the source into a join on the cell.
    cells = 4096
    last = F.least(F.floor(F.col("high") * cells), F.lit(cells - 1))
    guide = plan.select("number", "low", "high", F.explode(
        F.sequence(F.floor(F.col("low") * cells), last)).alias("cell"))
    chance = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("slot")), 11)
              / F.lit(float(1 << 53)))
    slots = spark.range(total).select(
        F.col("id").alias("slot"), F.floor(F.col("id") / shard_slots).alias("shard"),
        chance.alias("u"))
    drawn = (slots.withColumn("cell", F.floor(F.col("u") * cells))
             .join(broadcast_if_small(guide), "cell")
             .where("u >= low AND u < high").select("shard", "slot", "number"))
    drawn = cut_lineage(drawn)

    # The place of a slot among those of its source: counts by shard, summed over shards.
    counts = drawn.groupBy("number", "shard").agg(F.count("*").alias("n"))
    earlier = counts.select("number", "shard", F.coalesce(F.sum("n").over(
        Window.partitionBy("number").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("number", "shard").orderBy("slot")
    ranked = drawn.join(earlier, ["number", "shard"]).select(
        "shard", "slot", "number", (F.col("earlier") + F.row_number().over(inside) - 1).alias("k"))

    # Surplus slots, numbered, fill up the sources that are short.
    have = counts.groupBy("number").agg(F.sum("n").alias("have"))
    state = plan.join(have, "number", "left").fillna(0, ["have"])
    over = F.greatest(F.col("have") - F.col("slots"), F.lit(0))
    short = F.greatest(F.col("slots") - F.col("have"), F.lit(0))
    state = cut_lineage(state.withColumn("over_from", F.coalesce(F.sum(over).over(before), F.lit(0)))
                        .withColumn("short_from", F.coalesce(F.sum(short).over(before), F.lit(0))))
    filled = state.where("slots > have").select(
        F.col("number").alias("to"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - F.col("have") - 1)).alias("i"),
        "have", "short_from").select("to", (F.col("have") + F.col("i")).alias("to_k"),
                                     (F.col("short_from") + F.col("i")).alias("free"))
    small = broadcast_if_small(state)
    ranked = ranked.join(small.select("number", "slots", "over_from"), "number").withColumn(
        "free", F.when(F.col("k") >= F.col("slots"), F.col("over_from") + F.col("k") - F.col("slots")))
    kept = ranked.where("free IS NULL").select("shard", "slot", "number", "k")
    moved = ranked.where("free IS NOT NULL").join(filled, "free").select(
        "shard", "slot", F.col("to").alias("number"), F.col("to_k").alias("k"))

    df = kept.unionByName(moved).join(small.select(
        "number", "source_size", "blocks", "whole", "passes", "rest"), "number")
    df = df.withColumn("pass", F.floor(F.col("k") / F.col("blocks"))).withColumn(
        "at", F.col("k") - F.col("pass") * F.col("blocks"))
    wide = "decimal(20,0)"
    prime = F.get(F.array(*[F.lit(p) for p in PRIMES]), F.pmod(F.xxhash64(
        F.lit(seed), F.col("number"), F.col("pass")), F.lit(len(PRIMES))).cast("int"))
    shift = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("number"), F.col("pass")), F.col("whole"))
    step = (F.pmod(prime, F.col("whole")).cast(wide) * F.col("at").cast(wide)
            + shift.cast(wide))
    block = F.when(F.col("at") < F.col("whole"), F.pmod(step, F.col("whole").cast(wide)).cast("long")
                   ).otherwise(F.col("whole"))
    length = F.least(size, F.col("source_size") - F.col("block") * size)
    left = F.when(F.col("pass") < F.col("passes"), length).otherwise(
        F.col("rest") - F.col("at") * size)
    return df.withColumn("block", block).select(
        "shard", "slot", "number", "block", F.least(length, left).cast("long").alias("words"))


def pieces_of(placed: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each block that a row reaches into: ``first`` and ``last`` are the
    row's words in that block (from 0, ``last`` excluded), ``offset`` their place there."""
    size = F.lit(block_words)
    df = placed.where("size > 0").select("*", F.explode(F.sequence(
        F.floor(F.col("start") / size),
        F.floor((F.col("start") + F.col("size") - 1) / size))).alias("block"))
    begin = F.col("block") * size
    first = F.greatest(begin - F.col("start"), F.lit(0))
    return df.withColumn("first", first).withColumn(
        "last", F.least(F.col("size"), begin + size - F.col("start"))).withColumn(
        "offset", F.col("start") + F.col("first") - begin)


def mix(docs: DataFrame, source: str = "source", size: str = "size", order: tuple = ("doc_id",),
        block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED,
        **goal) -> DataFrame:
    """(shard, slot, offset, row, first, last): the parts of rows that fill each slot.

    ``docs`` has its number of words in ``size``. Reading a slot's parts by ``offset``
    gives its block of text.
    """
    placed, sources = place(docs, source, size, list(order), **goal)
    slots = draw_slots(sources, block_words, shard_slots, seed)
    met = pieces_of(placed, block_words).join(slots, ["number", "block"]).where("offset < words")
    return met.select("shard", "slot", "offset", "row", "first", F.least(
        F.col("last"), F.col("first") + F.col("words") - F.col("offset")).alias("last"))


def mix_documents(docs: DataFrame, text: str = "text", source: str = "source",
                  order: tuple = ("doc_id", "text"), **options) -> DataFrame:
    """The mix as documents: one row for each part of a document in a slot.

    A part that holds all words of a document keeps its text as it is; another is the
    text from its first word to its last, with the white space between them.
    Length columns are left to the caller.

    Slots are resolved on row numbers, sizes and hashes. Rows are stored once with their
    number; a text moves once, to the short list of its parts, and is split once there.
    """
    names = docs.columns
    numbered = stored(docs.select(packed(docs).alias("row"), F.monotonically_increasing_id().alias("line")))
    body = F.col(f"row.`{text}`")
    by = [c for c in order if c != text]
    narrow = cut_lineage(numbered.select(
        "line", F.col(f"row.`{source}`").alias("source"), F.xxhash64(body).alias("mark"),
        count_words(body).alias("size"), *[F.col(f"row.`{c}`").alias(f"by{i}") for i, c in enumerate(by)]))
    parts = mix(narrow, order=(*[f"by{i}" for i in range(len(by))], "mark"), **options).groupBy(
        F.col("row.line").alias("line"), F.col("row.size").alias("size")).agg(
        F.collect_list(F.struct("first", "last")).alias("parts"))

    def part(runs, at):
        said = F.array_join(F.slice(runs, (at["first"] + 1).cast("int"), (at["last"] - at["first"]).cast("int")), "")
        return F.regexp_replace(said, "^" + SPACE, "")

    whole = lambda at: (at["first"] == 0) & (at["last"] == F.col("size"))
    runs = F.when(F.exists("parts", lambda at: ~whole(at)),
                  F.regexp_extract_all(body, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)))
    # The runs are one element of an array, so they are made once and not for each part.
    texts = F.transform(F.array(runs), lambda one: F.transform(
        "parts", lambda at: F.when(whole(at), body).otherwise(part(one, at))))[0]
    met = numbered.join(parts, "line").select("row", F.explode(texts).alias("said"))
    return met.select(*[(F.col("said") if n == text else F.col(f"row.`{n}`")).alias(n) for n in names])


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
           **options) -> DataFrame:
    """For each row: ``size``, ``source_size``, ``target`` and the words ``taken``.

    Only sizes and keys are kept from the texts, in one narrow checkpoint; its row number
    tells equal rows apart.
    """
    sized = cut_lineage(docs.select(
        F.monotonically_increasing_id().alias("line"), F.col(key).alias("key"),
        F.col(source).alias("source"), F.xxhash64(text).alias("mark"),
        count_words(F.col(text)).alias("size")))
    block_words = options.get("block_words", BLOCK_WORDS)
    placed, sources = place(sized, "source", "size", ["key", "mark"])
    slots = draw_slots(sources, **options)
    met = pieces_of(placed, block_words).join(slots, ["number", "block"]).where("offset < words")
    taken = met.groupBy(F.col("row.line").alias("line")).agg(F.sum(F.least(
        F.col("last") - F.col("first"), F.col("words") - F.col("offset"))).alias("taken"))
    goals = broadcast_if_small(sources.select(F.col("source").alias("_s"), "source_size", "target"))
    return (sized.join(taken, "line", "left")
            .join(goals, F.col("source").eqNullSafe(F.col("_s")))
            .select(F.col("key").alias(key), "size", "source_size", "target",
                    F.coalesce("taken", F.lit(0)).cast("long").alias("taken")))
