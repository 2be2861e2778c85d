"""Passages that repeat across documents, by compact windows.

Every document is a sequence of hashes of five-word shingles. Under a hash function, the
Cartesian tree of the sequence splits all its subsequences into compact windows: those
between ``low`` and ``high`` that hold position ``at`` have their minimum there and share
one signature. Only windows that can hold a passage of ``PASSAGE_WORDS`` words are kept,
about two for every passage length of text. Under each of ``FUNCTIONS`` functions, windows
whose signature another document has survive; where surviving windows of at least
``ENOUGH`` functions meet, a stretch is a candidate. One of four functions is enough: two
passages whose sets of shingles have a Jaccard similarity of 0.8 agree on one in 99.8% of
cases, at 0.67 (each shares 0.8 of its shingles) in 98.8%.

Candidates, and as much text as one passage before and after them, are verified shingle by
shingle. A window counts that is at least as long as a passage of 50 words and of whose
shingles other candidate documents have ``SIMILARITY`` or more, wherever the others lie. A
passage is all that overlapping windows of this kind cover.

Documents with equal texts are one while windows are compared, and come back as one
passage each over their whole text. Null text is an empty one; texts shorter than a
passage have none. Words are lower-cased (A-Z) and parted by white space; signatures and
shingles are 64-bit hashes. Rows with equal keys are one document; null keys take no part,
as a result names documents by key.

Windows and shingles move once, to where their hash is, and what others have too moves on to
its document. A passage that a third of all documents
have is a row of each of them in the task of its hash, of which only the smallest and the
largest document are asked for. No pairs of documents are formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postsift.session import broadcast_if_small, cut_lineage, ship_package

SHINGLE = 5
PASSAGE_WORDS = 50
FUNCTIONS = 4
ENOUGH = 1
SIMILARITY = .8
# Texts whose windows are cut together, as arrays.
CHUNK_BYTES = 1 << 20
_BASE = 0x5851F42D4C957F2D
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _mixed(values):
    """Finaliser that spreads 64-bit values (wrapping arithmetic)."""
    import numpy as np
    x = values + np.uint64(_MIX[0])
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[2])
    return x ^ (x >> np.uint64(31))


_powers: dict[int, tuple] = {}


def _power_table(size: int):
    """Powers of an odd number and of its inverse (wrapping arithmetic)."""
    import numpy as np
    size = max(size, 2 * CHUNK_BYTES)
    if size not in _powers:
        _powers.clear()
        _powers[size] = tuple(np.concatenate((
            [np.uint64(1)], np.full(size, base, np.uint64))).cumprod(dtype=np.uint64)
            for base in (_BASE, pow(_BASE, -1, 1 << 64)))
    return _powers[size]


def word_hashes(texts):
    """A hash for every word of several texts, and the place where each text's words begin.

    Words are numbers in base ``_BASE``, read off running sums over all bytes at once.
    """
    import numpy as np
    data = np.frombuffer(b"\n".join(texts).lower(), np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(space.astype(np.int8), prepend=1, append=1)
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    power, inverse = _power_table(len(data))
    sums = np.concatenate(([np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:len(data)])))
    values = (sums[end] - sums[begin]) * inverse[begin]
    hashes = _mixed(values ^ (end - begin).astype(np.uint64))
    at = np.cumsum([0] + [len(t) + 1 for t in texts])
    return hashes, np.searchsorted(begin, at)


def shingled(texts):
    """Shingle hashes of several texts end to end, and the place where each text begins.

    Every word has a place; where no shingle of five words of its text begins, it is 0.
    """
    import numpy as np
    h, starts = word_hashes(texts)
    n = max(0, len(h) - SHINGLE + 1)
    out = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        out = _mixed(out ^ h[k:k + n])
    out = np.concatenate((out | np.uint64(1), np.zeros(len(h) - n, np.uint64)))
    for k in range(1, SHINGLE):
        last = starts[1:] - k
        out[last[last >= starts[:-1]]] = 0
    return out, starts


def _chunks(keys, texts):
    """Keys and texts (bytes) in groups of bounded size; a text is never cut."""
    held, size = ([], []), 0
    for key, text in zip(keys, texts):
        held[0].append(key)
        held[1].append(text)
        size += len(text)
        if size >= CHUNK_BYTES:
            yield held
            held, size = ([], []), 0
    if held[0]:
        yield held


def compact_windows(values, width: int, longest: int | None = None):
    """(low, at, high) of all compact windows of at least ``width`` positions.

    Zeros part sequences: no window holds one. ``longest`` bounds the sequences between
    them. ``at`` is the first of equal minima. Values are ranked by their high bits and
    then by place, so the minimum of every run tells its own place, and minima over runs
    of doubling length give every node of the Cartesian tree its reach.
    """
    import numpy as np
    n = len(values)
    most = n if longest is None else min(n, longest)
    if most < width:
        return (np.zeros(0, np.int64),) * 3
    bits = np.uint64(max(1, int(n - 1).bit_length()))
    place = np.arange(n, dtype=np.uint64)
    mask = (np.uint64(1) << bits) - np.uint64(1)
    # The lowest bit above the place keeps values apart from zeros.
    rank = np.where(values == 0, place, (values & ~mask) | (np.uint64(1) << bits) | place)
    runs = [rank]
    while 1 << len(runs) <= most:
        half, last = 1 << (len(runs) - 1), runs[-1]
        runs.append(np.minimum(last[:-half], last[half:]))
    k = width.bit_length() - 1
    least = np.minimum(runs[k][:n - width + 1], runs[k][width - (1 << k):n - (1 << k) + 1])
    fresh = np.concatenate(([True], least[1:] != least[:-1]))
    at = (least[fresh] & mask).astype(np.int64)
    at = at[values[at] != 0]
    low, high, value = at.copy(), at + 1, rank[at]
    for k in range(len(runs) - 1, -1, -1):
        size, run = 1 << k, runs[k]
        to = low - size
        low = np.where((to >= 0) & (run[np.maximum(to, 0)] > value), to, low)
        go = (high + size <= n) & (run[np.minimum(high, n - size)] > value)
        high = np.where(go, high + size, high)
    return low, at, high - 1


def _windows(docs: DataFrame, words: int) -> DataFrame:
    """(signature, doc, low, high) of the compact windows of all documents (key, text)."""
    width = words - SHINGLE + 1

    def cut(batches):
        import numpy as np
        import pyarrow as pa
        schema = pa.schema([("signature", pa.int64()), ("doc", pa.int64()), ("low", pa.int32()), ("high", pa.int32())])
        for batch in batches:
            bodies = (t.as_buffer().to_pybytes() for t in batch.column("text"))
            for keys, texts in _chunks(batch.column("key").to_pylist(), bodies):
                hashes, starts = shingled(texts)
                longest = int(np.diff(starts).max())
                for f in range(FUNCTIONS):
                    values = _mixed(hashes ^ np.uint64(f * _MIX[0] & (1 << 64) - 1))
                    # The function is part of the signature, and no value is 0.
                    values = (values & ~np.uint64(2 * FUNCTIONS - 1)) | np.uint64(FUNCTIONS + f)
                    values[hashes == 0] = 0
                    low, at, high = compact_windows(values, width, longest)
                    doc = np.searchsorted(starts, at, "right") - 1
                    begin = starts[doc]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(values[at].view(np.int64)), pa.array(np.array(keys, np.int64)[doc]),
                        pa.array((low - begin).astype(np.int32)), pa.array((high - begin).astype(np.int32))], schema=schema)

    return docs.select("key", "text").mapInArrow(cut, "signature long, doc long, low int, high int")


def _in_several(df: DataFrame, by: str) -> DataFrame:
    """Rows whose ``by`` more than one ``doc`` has, with the smallest such ``a``; they move once."""
    along = Window.partitionBy(by)
    return df.withColumn("a", F.min("doc").over(along)).withColumn("b", F.max("doc").over(along)).where("a < b").drop("b")


def _islands(df: DataFrame, by: list[str], low: Column, high: Column) -> DataFrame:
    """Intervals of each group numbered by island: those that touch are one."""
    order = Window.partitionBy(*by).orderBy("low", "high")
    reach = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("low", low).withColumn("high", high)
    fresh = F.coalesce((F.col("low") > reach + 1), F.lit(True)).cast("int")
    return df.withColumn("_fresh", fresh).withColumn("island", F.sum("_fresh").over(
        order.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")


def candidates(docs: DataFrame, words: int = PASSAGE_WORDS, enough: int = ENOUGH) -> DataFrame:
    """(doc, low, high): stretches of shingles that windows of enough functions cover."""
    met = _in_several(_windows(docs, words), "signature").select(
        "doc", F.col("signature").bitwiseAND(F.lit(FUNCTIONS - 1)).alias("f"), "low", "high")
    met = cut_lineage(met)
    merged = _islands(met, ["doc", "f"], F.col("low"), F.col("high")).groupBy("doc", "f", "island").agg(
        F.min("low").alias("low"), F.max("high").alias("high"))
    steps = merged.select("doc", F.explode(F.array(
        F.struct(F.col("low").alias("at"), F.lit(1).alias("step")),
        F.struct((F.col("high") + 1).alias("at"), F.lit(-1).alias("step")))).alias("s"))
    steps = steps.groupBy("doc", "s.at").agg(F.sum("s.step").alias("step"))
    along = Window.partitionBy("doc").orderBy("at")
    depth = steps.select("doc", "at", F.sum("step").over(
        along.rowsBetween(Window.unboundedPreceding, 0)).alias("depth"), F.lead("at").over(along).alias("next"))
    deep = depth.where(F.col("depth") >= enough).select("doc", F.col("at").alias("low"), (F.col("next") - 1).alias("high"))
    width = words - SHINGLE + 1
    return _islands(deep, ["doc"], F.col("low"), F.col("high")).groupBy("doc", "island").agg(
        F.min("low").alias("low"), F.max("high").alias("high")).where(
        F.col("high") - F.col("low") + 1 >= width).select("doc", "low", "high")


def covered(low, high, width: int, similarity: float):
    """(first, last): the runs of shared shingles that each passage begins and ends with.

    Runs lie in order and do not touch. A window from run i to run j counts if it has
    ``width`` positions or more and at least ``similarity`` of them are in runs: with
    ``gain`` up to its ends, if what it has gained by its end is not less than at its start.
    """
    import numpy as np
    held = np.concatenate(([0], np.cumsum(high - low + 1)))
    # Rounded, as sums of a fraction differ in their last digits.
    start = np.round(held[:-1] - similarity * low, 6)
    gain = np.round(held[1:] - similarity * (high + 1), 6)
    best = np.maximum.accumulate(gain[::-1])
    last = len(low) - 1 - np.searchsorted(best, start, "left")
    first = np.flatnonzero(high[last] - low + 1 >= width)
    last = last[first]
    if not len(first):
        return first, last
    reach = np.maximum.accumulate(last)
    fresh = np.flatnonzero(np.concatenate(([True], first[1:] > reach[:-1])))
    return first[fresh], reach[np.append(fresh[1:], len(first)) - 1]


def verified(docs: DataFrame, stretches: DataFrame, words: int = PASSAGE_WORDS,
             similarity: float = SIMILARITY) -> DataFrame:
    """(doc, start, end, n_shared, first): word spans (``end`` excluded) of true passages."""
    width = words - SHINGLE + 1
    spans = broadcast_if_small(cut_lineage(stretches.groupBy(F.col("doc").alias("key")).agg(
        F.collect_list(F.struct("low", "high")).alias("spans"))))
    asked = docs.join(spans, "key")

    def cut(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            made = []
            for key, text, parts in zip(batch.column("key").to_pylist(), batch.column("text"),
                                        batch.column("spans").to_pylist()):
                hashes = shingled([text.as_buffer().to_pybytes()])[0].view(np.int64)
                asked = hashes != 0
                steps = np.zeros(len(hashes) + 1, np.int64)
                for part in parts:
                    steps[max(0, part["low"] - width)] += 1
                    steps[min(len(hashes), part["high"] + 1 + width)] -= 1
                at = np.flatnonzero(asked & (np.cumsum(steps)[:-1] > 0))
                made.append((np.full(len(at), key), at, hashes[at]))
            cols = [np.concatenate(c) for c in zip(*made)] if made else [np.zeros(0, np.int64)] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(c.astype(np.int64)) for c in cols], names=["doc", "at", "h"])

    shingles = asked.select("key", "text", "spans").mapInArrow(cut, "doc long, at long, h long")
    shared = cut_lineage(_in_several(shingles, "h").select("doc", "at", "a"))

    # One row is left of each run of shingles; the runs of a document are looked at together.
    strict = _islands(shared, ["doc"], F.col("at"), F.col("at")).groupBy("doc", "island").agg(
        F.min("at").alias("low"), F.max("at").alias("high"), F.count("*").alias("n_shared"),
        F.sum((F.col("a") == F.col("doc")).cast("long")).alias("own")).drop("island")
    strict = cut_lineage(strict)
    runs = strict.groupBy("doc").agg(F.array_sort(F.collect_list(
        F.struct("low", "high", "n_shared", "own"))).alias("runs"))

    def decide(batches):
        import numpy as np
        import pyarrow as pa
        names = ["doc", "low", "high", "n_shared", "own"]
        for batch in batches:
            made = [[np.zeros(0, np.int64)] * len(names)]
            for doc, held in zip(batch.column("doc").to_pylist(), batch.column("runs")):
                low, high, n_shared, own = (
                    held.values.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in names[1:])
                first, last = covered(low, high, width, similarity)
                sums = [np.concatenate(([0], np.cumsum(x))) for x in (n_shared, own)]
                made.append([np.full(len(first), doc), low[first], high[last], *(x[last + 1] - x[first] for x in sums)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*made)], names=names)

    found = runs.mapInArrow(decide, "doc long, low long, high long, n_shared long, own long")
    return found.select(
        "doc", F.col("low").alias("start"), (F.col("high") + SHINGLE).alias("end"), "n_shared",
        (2 * F.col("own") > F.col("n_shared")).alias("first"))


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text",
                      words: int = PASSAGE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(key, start, end, n_shared, first): passages of at least ``words`` words that other
    documents have too, as word spans; ``first`` where this document has most of it first,
    by key."""
    ship_package(docs.sparkSession)
    base = docs.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    same = cut_lineage(base.select("key", F.xxhash64("text").alias("mark")))
    kinds = same.groupBy("mark").agg(F.min("key").alias("one"), F.max("key").alias("last")).where("one < last")
    twins = broadcast_if_small(cut_lineage(same.join(kinds, "mark").select("key", "one").distinct()))
    count = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    copies = cut_lineage(base.join(twins, "key").select("key", count.alias("n"), "one").where(
        F.col("n") >= words).distinct())
    others = copies.where("key <> one").select("key")
    single = base.join(broadcast_if_small(others), "key", "left_anti")
    found = verified(single, candidates(single, words), words, similarity)
    whole = copies.select(
        F.col("key").alias("doc"), F.lit(0).cast("long").alias("start"), F.col("n").cast("long").alias("end"),
        (F.col("n") - SHINGLE + 1).cast("long").alias("n_shared"), (F.col("key") == F.col("one")).alias("first"))
    # What a copied document also shares with others lies inside its whole text.
    found = found.join(copies.select(F.col("key").alias("doc")), "doc", "left_anti")
    return found.unionByName(whole).select(
        F.col("doc").alias(key), "start", "end", "n_shared", "first")
