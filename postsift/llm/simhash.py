"""SimHash near-duplicates by a self-join of the binary trie of fingerprints.

A document's fingerprint takes the majority, bit by bit, of the hashes of its word
shingles. Two fingerprints link when at most three of 64 bits differ. Links are found by
walking pairs of trie nodes together: a pair carries the bits by which its two prefixes
differ, steps to the pairs of its children, and is dropped as soon as the bits exceed the
budget.

For the cluster the trie is cut into tasks. Of four blocks of 16 bits at least one is
equal in any linked pair, so each fingerprint enters four tries, each time with another
block in front, and only subtries below one whole front block are joined, each in one
task. A subtrie of too many fingerprints is first walked some levels as rows of a table:
its fingerprints go to the node pairs they take part in, four bits at a time, until the
pairs are small. Inside a task all node pairs of a level are handled as arrays.

Equal fingerprints are one node, however many documents have them. A task reports a
spanning forest of the links it finds, not all of them, so a group of n fingerprints
gives fewer than n edges; no link between components is lost by that.

Null text is an empty one; texts without words have fingerprint zero and link as any
other. A component's id is its smallest key; keys that are null do not count for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postsift.llm.common import components, packed
from postsift.session import cut_lineage, ship_package

BUDGET = 3
SHINGLE = 3
SEED = 42
BLOCK_BITS = 16
STEP_BITS = 4
# A subtrie, or pair of nodes, of more fingerprints is taken apart before it is a task.
TASK_FINGERPRINTS = 20_000
PAIRS_AT_ONCE = 1 << 20
HASHES_AT_ONCE = 1 << 15


def text_fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint of one text; the words are of its lower-cased bytes."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    size = min(shingle, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[:len(words) - size + 1].tolist(), ends[size - 1:].tolist())
    counts = np.zeros(64, np.int64)
    total = len(words) - size + 1
    hashes = np.fromiter((xxh64_intdigest(line[a:b], SEED) for a, b in spans), np.uint64, total)
    for at in range(0, total, HASHES_AT_ONCE):
        part = hashes[at:at + HASHES_AT_ONCE].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > total, bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    @F.arrow_udf("long")
    def of(texts):
        import pyarrow as pa
        return pa.array([text_fingerprint(t.as_py(), shingle) for t in texts], pa.int64())

    return of(text)


def _tasks(prints: DataFrame, limit: int, budget: int) -> DataFrame:
    """Members of node pairs: (turn, depth, left, right, side, differ, code).

    ``code`` is the fingerprint with block ``turn`` in front; ``left`` <= ``right`` are the
    two prefixes of ``depth`` bits and ``differ`` the bits by which they differ.
    """
    code = F.col("fp")
    turned = [code] + [F.shiftleft(code, BLOCK_BITS * k).bitwiseOR(
        F.shiftrightunsigned(code, 64 - BLOCK_BITS * k)) for k in range(1, 64 // BLOCK_BITS)]
    rows = prints.select(F.posexplode(F.array(*turned)).alias("turn", "code"))
    front = F.shiftrightunsigned("code", 64 - BLOCK_BITS)
    rows = rows.select("turn", F.lit(BLOCK_BITS).alias("depth"), front.alias("left"),
                       front.alias("right"), F.lit(0).alias("side"), F.lit(0).alias("differ"), "code")
    node = ["turn", "depth", "left", "right"]
    done = None
    while True:
        sizes = rows.groupBy(*node).agg(
            F.count("*").alias("members"), F.min("side").alias("low"), F.max("side").alias("high"))
        large = cut_lineage(sizes.where((F.col("members") > limit) & (F.col("depth") < 64)))
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        small = rows.join(large.select(*node), node, "left_anti")
        done = small if done is None else done.unionByName(small)
        # A node of one side only has nothing to meet.
        met = rows.join(large.where("left = right OR low < high").select(*node), node)
        child = F.expr(f"shiftrightunsigned(code, {64 - STEP_BITS} - depth) & {(1 << STEP_BITS) - 1}")
        pairs = F.explode(F.array(*[F.lit(m).cast("long") for m in range(1 << STEP_BITS)]))
        met = met.withColumn("child", child).withColumn("mask", pairs).withColumn(
            "now", F.col("differ") + F.bit_count("mask")).where(F.col("now") <= budget)
        other = F.col("child").bitwiseXOR(F.col("mask"))
        same = F.col("left") == F.col("right")
        # Inside one node the lower child is the left side; across two, sides stay.
        flip = F.when(same, F.col("child") > other).otherwise(F.col("side") == 1)
        first, second = F.when(flip, other).otherwise(F.col("child")), F.when(
            flip, F.col("child")).otherwise(other)
        shifted = lambda name: F.shiftleft(name, STEP_BITS)
        rows = cut_lineage(met.select(
            "turn", (F.col("depth") + STEP_BITS).alias("depth"),
            shifted("left").bitwiseOR(first).alias("left"),
            shifted("right").bitwiseOR(second).alias("right"),
            flip.cast("int").alias("side"), F.col("now").alias("differ"), "code"))


class _Forest:
    """Labels of array places; equal labels are linked."""

    def __init__(self, size: int):
        import numpy as np
        self.np, self.label = np, np.arange(size)

    def link(self, a, b) -> None:
        np = self.np
        while True:
            la, lb = self.label[a], self.label[b]
            apart = la != lb
            if not apart.any():
                return
            a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
            np.minimum.at(self.label, np.maximum(la, lb), np.minimum(la, lb))
            while True:
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up


def walk(code, bounds, bits, differ, budget: int = BUDGET):
    """Labels of linked places: node pairs walked down level by level.

    ``code`` holds the members of all pairs, sorted within each node; ``bounds`` are
    (left from, left to, right from, right to) of each pair, ``bits`` the bits still below
    it. A pair of a node with itself has equal bounds on both sides.
    """
    import numpy as np

    forest = _Forest(len(code))
    waiting = [np.concatenate([bounds, bits[:, None], differ[:, None]], axis=1).astype(np.int64)]
    level = waiting[0]
    for bit in range(int(bits.max(initial=0)), -1, -1):
        here = level[level[:, 4] == bit]
        later = level[level[:, 4] < bit]
        sizes = (here[:, 1] - here[:, 0]) * (here[:, 3] - here[:, 2])
        few = (sizes <= 64) | (bit == 0)
        _compare(code, here[few], budget, forest)
        here = here[~few]
        if not len(here):
            level = later
            continue
        # What is left of the budget covers all bits below: everything links.
        full = here[:, 5] + bit <= budget
        for a0, a1, b0, b1, *_ in here[full]:
            forest.link(np.arange(a0, a1), np.full(a1 - a0, a0))
            forest.link(np.arange(b0, b1), np.full(b1 - b0, a0))
        here = here[~full]
        ones = np.concatenate(([0], np.cumsum((code >> np.uint64(bit - 1)) & np.uint64(1)))).astype(np.int64)
        a0, a1, b0, b1, _, d = here.T
        am = a1 - (ones[a1] - ones[a0])
        bm = b1 - (ones[b1] - ones[b0])
        down = np.full(len(here), bit - 1)
        own = (a0 == b0) & (a1 == b1)
        cases = [(a0, am, b0, bm, down, d), (am, a1, bm, b1, down, d), (a0, am, bm, b1, down, d + 1)]
        made = [np.stack(c, axis=1) for c in cases]
        made.append(np.stack((am, a1, b0, bm, down, d + 1), axis=1)[~own])
        level = np.concatenate([later, *made])
        level = level[(level[:, 0] < level[:, 1]) & (level[:, 2] < level[:, 3]) & (level[:, 5] <= budget)]
    return forest.label


def _compare(code, pairs, budget: int, forest: _Forest) -> None:
    """All members of small pairs of nodes against each other, in bounded slices."""
    import numpy as np
    if not len(pairs):
        return
    a0, a1, b0, b1 = pairs[:, 0], pairs[:, 1], pairs[:, 2], pairs[:, 3]
    wide, sizes = b1 - b0, (a1 - a0) * (b1 - b0)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(pairs):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + PAIRS_AT_ONCE, "right")))
        which = np.repeat(np.arange(at, to), sizes[at:to])
        step = np.arange(len(which)) - np.repeat(ends[at:to] - sizes[at:to] - base, sizes[at:to])
        i, j = a0[which] + step // wide[which], b0[which] + step % wide[which]
        near = (np.bitwise_count(code[i] ^ code[j]) <= budget) & (i != j)
        forest.link(i[near], j[near])
        at = to


def _forest_of(batch, budget: int):
    """Edges of a batch of whole node pairs, sorted by pair, side and code."""
    import numpy as np
    get = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
    code = get("code").astype(np.int64).view(np.uint64)
    turn, side = get("turn").astype(np.int64), get("side")
    keys = np.stack([turn, get("depth").astype(np.int64), get("left"), get("right")], axis=1)
    fresh = np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1)))
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(code))
    rights = np.concatenate(([0], np.cumsum(side))).astype(np.int64)
    middle = last - (rights[last] - rights[first])
    own = keys[first, 2] == keys[first, 3]
    bounds = np.stack([first, np.where(own, last, middle), np.where(own, first, middle), last], axis=1)
    label = walk(code, bounds, 64 - keys[first, 1], get("differ")[first].astype(np.int64), budget)
    moved = np.flatnonzero(label != np.arange(len(code)))

    def back(places):
        shift = (16 * turn[places]).astype(np.uint64)
        value = code[places]
        rest = (np.uint64(64) - shift) & np.uint64(63)
        return np.where(shift == 0, value, (value >> shift) | (value << rest)).view(np.int64)

    return back(moved), back(label[moved])


def links(prints: DataFrame, budget: int = BUDGET, limit: int = TASK_FINGERPRINTS) -> DataFrame:
    """Edges (a, b) that span the components of ``prints`` (distinct ``fp``)."""
    if budget >= 64 // BLOCK_BITS:
        raise ValueError("a budget of four bits or more needs shorter blocks")
    ship_package(prints.sparkSession)
    node = ["turn", "depth", "left", "right"]
    tasks = _tasks(prints, limit, budget).repartition(*node).sortWithinPartitions(*node, "side", "code")

    def join(batches):
        import pyarrow as pa
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        kept = None
        for batch in _whole_groups(batches, node):
            a, b = _forest_of(batch, budget)
            kept = True
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)
        if kept is None:
            yield pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, schema=schema)

    return tasks.mapInArrow(join, "a long, b long")


def _whole_groups(batches, keys: list[str]):
    """Batches regrouped so that none ends inside a group of equal keys."""
    import pyarrow as pa
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
        held = table.to_batches()[0]
        at = held.num_rows - 1
        last = tuple(held.column(k)[at].as_py() for k in keys)
        while at and tuple(held.column(k)[at - 1].as_py() for k in keys) == last:
            at -= 1
        if at:
            yield held.slice(0, at)
            held = held.slice(at)
    if held is not None:
        yield held


def classes(prints: DataFrame, key: str = "key", fp: str = "fp", **options) -> DataFrame:
    """(fp, component): the smallest ``key`` among all documents linked with it.

    ``prints`` has one row for each document.
    """
    nodes = cut_lineage(prints.groupBy(F.col(fp).alias("fp")).agg(F.min(key).alias("low")))
    roots = components(cut_lineage(links(nodes.select("fp"), **options)))
    grouped = nodes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = grouped.groupBy("root").agg(F.min("low").alias("component"))
    return grouped.join(lows, "root").select("fp", "component")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text",
                    shingle: int = SHINGLE, **options) -> DataFrame:
    """For each row: its key, ``fp`` (signed) and ``component``."""
    ship_package(docs.sparkSession)
    prints = cut_lineage(docs.select(F.col(key).alias("key"), fingerprint(F.col(text), shingle).alias("fp")))
    found = classes(prints, **options).withColumnRenamed("fp", "_fp")
    return prints.join(found, F.col("fp") == F.col("_fp")).select(
        F.col("key").alias(key), "fp", "component")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text",
             shingle: int = SHINGLE, **options) -> DataFrame:
    """One row of each component: that of the smallest key, then the smallest text hash.

    Verdicts are made on keys and hashes; texts move once, to meet their verdict.
    """
    ship_package(docs.sparkSession)
    mark = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    prints = cut_lineage(docs.select(
        F.col(key).alias("key"), mark.alias("mark"), fingerprint(F.col(text), shingle).alias("fp")))
    named = prints.join(classes(prints, **options).withColumnRenamed("fp", "_fp"), F.col("fp") == F.col("_fp"))
    # Components of null keys alone are told apart by their fingerprints.
    first = named.groupBy("component", F.when(F.col("component").isNull(), F.col("fp")).alias("_alone")).agg(
        F.min(F.struct(F.col("key").isNull().alias("none"), "key", "mark")).alias("one"))
    chosen = first.select(F.col("one.key").alias("_key"), F.col("one.mark").alias("_mark")).distinct()
    met = docs.select(packed(docs).alias("row"), mark.alias("mark")).join(
        chosen, F.col(f"row.{key}").eqNullSafe(F.col("_key")) & (F.col("mark") == F.col("_mark")))
    turn = F.row_number().over(Window.partitionBy("_key", "_mark").orderBy(F.lit(1)))
    return met.withColumn("turn", turn).where("turn = 1").select("row.*")
