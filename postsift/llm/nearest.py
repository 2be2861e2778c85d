"""Exact top-k search by inner product, with a pivot table for elimination.

Vectors are whole numbers, so scores are exact. A pivot table keeps every vector's distance
to some pivots (the origin and vectors far from each other, taken from a bounded sample;
they steer the search and never the result). By the triangle inequality the largest
difference of two vectors' distances to one pivot is a lower bound of their distance, and
with both norms an upper bound of their inner product. Candidates are evaluated in the order
of that bound, some queries at once, as long as one can reach a query's worst score kept.

Equal vectors are one candidate with its ``k + 1`` smallest keys, and one query, so a vector
that a third of all rows share costs no more than any other. Candidates are packed, by
nearest pivot and distance to it, into blocks of at most ``BLOCK`` rows. A query first
takes the worst of its best scores in the block it lies in as its threshold. Queries of one
pivot form groups of at most about ``QUERIES``; a group meets only blocks whose bound reaches
the lowest threshold of the group, each such pair as one task group of bounded size, and
emits only what reaches the query's own threshold. Distances are doubles, so bounds are
widened by more than their rounding; scores are whole numbers throughout.

Vectors that are null or hold null or non-finite components take no part. Missing
components of shorter vectors count as zero, so an empty vector scores 0. A row is no
candidate of its own; other rows with the same key or vector are. Equal scores go by ascending key, null keys
last; a row with a null key is a candidate and no query. Every repeated query row gets its list. Components beyond the range
of a long take its end, and so do scores. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postsift.session import ship_package, stored

PIVOTS = 24
SAMPLE = 4096
BLOCK = 2048
QUERIES = 256
FIRST_CHUNK = 128
AT_ONCE = 64
# Sums of products below this are exact in doubles.
EXACT = 2.0 ** 53
LONGEST = 2 ** 63 - 1

PACKED = ("nos array<long>, vectors array<array<long>>, distances array<array<double>>, norms array<double>, "
          "low array<double>, high array<double>, top_norm double")


def whole_vector(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, null for a vector that takes no part."""
    parts = vector.cast("array<double>")
    fine = F.forall(parts, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    return F.when(fine, F.transform(parts, lambda x: F.floor(F.lit(float(scale)) * x)))


def _matrix(lists, kind):
    """Rows of an Arrow list column as a matrix, short ones filled with zeros."""
    import numpy as np
    lists = lists.combine_chunks() if hasattr(lists, "combine_chunks") else lists
    lengths = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, int)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    wide = int(lengths.max(initial=0))
    if (lengths == wide).all():
        return values.reshape(len(lists), wide).astype(kind)
    out = np.zeros((len(lists), wide), kind)
    out[np.repeat(np.arange(len(lists)), lengths), np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def _same_width(a, b):
    import numpy as np
    wide = max(a.shape[1], b.shape[1])
    return [np.pad(x, ((0, 0), (0, wide - x.shape[1]))) if x.shape[1] < wide else x for x in (a, b)]


def fits_doubles(queries, candidates) -> bool:
    """Whether all sums of products stay exact in doubles."""
    import numpy as np
    reach = lambda x: float(np.abs(x.astype(np.float64)).max(initial=0))
    return reach(queries) * reach(candidates) * max(1, queries.shape[1]) < EXACT


def scores(queries, candidates):
    """Inner products of whole vectors, exact, at the ends of a long where they pass them."""
    import numpy as np
    queries, candidates = _same_width(queries, candidates)
    if fits_doubles(queries, candidates):
        return (queries.astype(np.float64) @ candidates.astype(np.float64).T).astype(np.int64)
    exact = queries.astype(object) @ candidates.astype(object).T
    return np.clip(exact, -LONGEST - 1, LONGEST).astype(np.int64)


def choose_pivots(sample, count: int = PIVOTS):
    """The origin and vectors of the sample, each farthest from those before it."""
    import numpy as np
    sample = sample.astype(np.float64)
    pivots = [np.zeros(sample.shape[1])]
    away = np.sqrt((sample ** 2).sum(axis=1))
    while len(pivots) < count and away.max(initial=0) > 0:
        pivots.append(sample[int(away.argmax())])
        away = np.minimum(away, np.sqrt(((sample - pivots[-1]) ** 2).sum(axis=1)))
    return np.stack(pivots)


def distances(vectors, pivots):
    """Distances of all vectors to all pivots, from differences, so that none cancels."""
    import numpy as np
    vectors, pivots = _same_width(vectors.astype(np.float64), pivots)
    with np.errstate(over="ignore"):
        return np.stack([np.sqrt(((vectors - p) ** 2).sum(axis=1)) for p in pivots], axis=1)


def kth_scores(found, copies, k: int):
    """For each row of scores the ``k``-th best with copies counted, the least long where fewer are there."""
    import numpy as np
    if not found.shape[1]:
        return np.full(len(found), -LONGEST - 1)
    order = np.argsort(-found, axis=1, kind="stable")
    enough = np.cumsum(copies[order], axis=1) >= k
    at = order[np.arange(len(found)), enough.argmax(axis=1)]
    return np.where(enough.any(axis=1), found[np.arange(len(found)), at], -LONGEST - 1)


def best_of(at, to, score, copies, k: int, worst):
    """What reaches each query's ``k``-th best score so far, to which ``worst`` is raised in place."""
    import numpy as np
    order = np.lexsort((-score, at))
    at, to, score = at[order], to[order], score[order]
    sums = np.cumsum(copies[to])
    first = np.searchsorted(at, np.arange(len(worst)))
    before = np.concatenate(([0], sums))[first]
    # The place where a query's copies reach k, if that is still its own.
    place = np.searchsorted(sums, before + k)
    enough = np.flatnonzero(place < np.append(first[1:], len(at)))
    worst[enough] = np.maximum(worst[enough], score[place[enough]])
    fine = score >= worst[at]
    return [at[fine], to[fine], score[fine]]


def search(q, q_far, q_norm, floor, c, c_far, c_norm, copies, k: int, at_once: int = AT_ONCE):
    """(query places, candidate places, scores) that may be among the ``k`` best of each query.

    ``floor`` holds a score that each query's result reaches; candidates of an equal score stay.
    Queries go on together: in the order of the best bound that any of them has.
    """
    import numpy as np
    found = [[np.zeros(0, np.int64)] * 3]
    if not len(c) or not len(q):
        return found[0]
    q, c = _same_width(q, c)
    exact = fits_doubles(q, c)
    if exact:
        q, c = q.astype(np.float64), c.astype(np.float64)
    for start in range(0, len(q), at_once):
        here = slice(start, start + at_once)
        low = np.zeros((len(q[here]), len(c)))
        gap = np.empty_like(low)
        for p in range(q_far.shape[1]):
            np.subtract(q_far[here, p, None], c_far[None, :, p], out=gap)
            np.maximum(low, np.abs(gap, out=gap), out=low)
        with np.errstate(all="ignore"):
            low = np.maximum(low - 1e-9 * (q_far[here].max() + c_far.max()) - 1e-6, 0)
            bound = (q_norm[here, None] + c_norm[None, :] - low ** 2) / 2
            bound += 1 + 1e-9 * (q_norm[here, None] + c_norm[None, :])
        bound[np.isnan(bound)] = np.inf
        worst = floor[here].copy()
        reach = (bound - worst[:, None]).max(axis=0)
        able = np.flatnonzero((bound >= worst[:, None]).any(axis=0))
        able = able[np.argsort(-reach[able], kind="stable")]
        kept, done, step = [np.zeros(0, np.int64)] * 3, 0, FIRST_CHUNK
        while done < len(able):
            some = able[done:done + step]
            done, step = done + step, 4 * step
            live = np.flatnonzero((bound[:, some] >= worst[:, None]).any(axis=1))
            if not len(live):
                continue
            got = q[start + live] @ c[some].T if exact else scores(q[start + live], c[some])
            row, column = np.nonzero(got >= worst[live, None])
            kept = [np.concatenate(x) for x in zip(kept, (live[row], some[column], got[row, column].astype(np.int64)))]
            kept = best_of(*kept, copies, k, worst)
        found.append((start + kept[0], kept[1], kept[2]))
    return [np.concatenate(x) for x in zip(*found)]


def _distinct(rows: DataFrame, k: int) -> DataFrame:
    """(no, vector, asked, copies): distinct vectors with their ``k + 1`` smallest keys."""
    order = Window.partitionBy("vector").orderBy(F.asc_nulls_last("key"))
    few = rows.select("vector", "key").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    copies = few.groupBy("vector").agg(F.array_sort(F.collect_list(
        F.struct(F.col("key").isNull().alias("none"), F.col("key").alias("id")))).alias("copies"))
    asked = rows.where("asked").select("vector").distinct().withColumn("asked", F.lit(True))
    return stored(copies.join(asked, "vector", "left").select(
        F.monotonically_increasing_id().alias("no"), "vector", F.coalesce("asked", F.lit(False)).alias("asked"), "copies"))


def _placed(vectors: DataFrame, pivots) -> DataFrame:
    """Adds distances to the pivots, the squared norm, the nearest pivot and how near it is."""
    def place(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            far = distances(_matrix(batch.column("vector"), np.int64), pivots)
            cell = far.argmin(axis=1) if len(far) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(list(far), pa.list_(pa.float64())), pa.array(far[:, 0] ** 2),
                 pa.array(cell, pa.int32()), pa.array(far[np.arange(len(far)), cell], pa.float64())],
                names=[*batch.schema.names, "far", "norm", "cell", "near"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema)
    return vectors.mapInArrow(place, f"{kinds}, far array<double>, norm double, cell int, near double")


def _pack(table) -> list:
    """The columns of PACKED, as Arrow arrays of one row."""
    import numpy as np
    import pyarrow as pa
    far = _matrix(table.column("far"), np.float64)
    norms = table.column("norm").to_numpy()
    longs, doubles = pa.list_(pa.int64()), pa.list_(pa.float64())
    made = [(table.column("no").to_pylist(), longs), (table.column("vector").to_pylist(), pa.list_(longs)),
            (far.tolist(), pa.list_(doubles)), (norms.tolist(), doubles), (far.min(axis=0).tolist(), doubles),
            (far.max(axis=0).tolist(), doubles), (float(norms.max()), pa.float64())]
    return [pa.array([value], kind) for value, kind in made]


def _blocks(placed: DataFrame, total: int, k: int, block: int) -> DataFrame:
    """Packed blocks of neighbouring vectors; ``asked`` lists (no, threshold) of the queries in them.

    Blocks are runs of ``block`` vectors in the order of pivot and distance, whatever the
    number of partitions: places inside a partition and the sizes of those before it.
    """
    from pyspark import TaskContext

    def number(batches):
        import numpy as np
        import pyarrow as pa
        at, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            places = np.arange(at, at + batch.num_rows)
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column("no"), pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(places)],
                names=["no", "part", "at"])

    def pack(table):
        import numpy as np
        import pyarrow as pa
        c = _matrix(table.column("vector"), np.int64)
        copies = np.array([len(x) for x in table.column("copies").to_pylist()])
        nos, asked = table.column("no").to_numpy(), np.flatnonzero(table.column("asked").to_numpy())
        floors = [kth_scores(scores(c[asked[s:s + AT_ONCE]], c), copies, k + 1) for s in range(0, len(asked), AT_ONCE)]
        pairs = zip(nos[asked].tolist(), np.concatenate(floors).tolist() if floors else [])
        kind = pa.list_(pa.struct([("no", pa.int64()), ("floor", pa.int64())]))
        return pa.table(
            [table.column("block").slice(0, 1), *_pack(table),
             pa.array([table.column("copies").to_pylist()], pa.list_(table.schema.field("copies").type)),
             pa.array([[{"no": n, "floor": f} for n, f in pairs]], kind)],
            names=["block", "nos", "vectors", "distances", "norms", "low", "high", "top_norm", "copies", "asked"])

    parts = max(1, -(-total // block))
    spread = placed.select("no", "cell", "near").repartitionByRange(parts, "cell", "near", "no")
    numbered = stored(spread.sortWithinPartitions("cell", "near", "no").mapInArrow(number, "no long, part int, at long"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one short row a partition
    offsets = numbered.groupBy("part").agg(F.count("*").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    places = numbered.join(offsets, "part").select("no", F.floor((F.col("offset") + F.col("at")) / block).alias("block"))
    return stored(placed.join(places, "no").groupBy("block").applyInArrow(
        pack, f"block long, {PACKED}, copies array<array<struct<none: boolean, id: bigint>>>, "
              "asked array<struct<no: bigint, floor: bigint>>"))


def _groups(placed: DataFrame, blocks: DataFrame, size: int) -> DataFrame:
    """Queries of one pivot in packed groups, with their thresholds."""
    floors = blocks.select(F.inline("asked"))
    queries = placed.where("asked").select("no", "vector", "far", "norm", "cell").join(floors, "no")
    counts = {r.cell: r.n for r in queries.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # one row a pivot
    if not counts:
        split = F.lit(1)
    else:
        split = F.element_at(F.create_map(*[F.lit(x) for c, n in counts.items() for x in (c, -(-n // size))]), F.col("cell"))

    def pack(table):
        import pyarrow as pa
        floor = table.column("floor").to_pylist()
        return pa.table([*_pack(table), pa.array([floor], pa.list_(pa.int64())), pa.array([min(floor)], pa.int64())],
                        names=["nos", "vectors", "distances", "norms", "low", "high", "top_norm", "floors", "least"])

    packed = queries.groupBy("cell", F.pmod(F.xxhash64("no"), split).alias("turn")).applyInArrow(
        pack, f"{PACKED}, floors array<long>, least long")
    return stored(packed.withColumn("group", F.monotonically_increasing_id()))


def _meetings(groups: DataFrame, blocks: DataFrame) -> DataFrame:
    """(group, block) whose bound reaches the least threshold of the group."""
    last = blocks.agg(F.max("block")).first()[0]
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last or 0).cast("long")))
    hull = lambda side: [F.col("low").alias(f"{side}_low"), F.col("high").alias(f"{side}_high"),
                         F.col("top_norm").alias(f"{side}_norm")]
    met = groups.select("group", "least", *hull("g"), every.alias("block")).join(
        blocks.select("block", *hull("b")), "block")
    apart = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)
    gaps = F.zip_with(apart("g_low", "b_high"), apart("b_low", "g_high"), lambda x, y: F.greatest(x, y))
    widest = F.greatest(F.array_max("g_high"), F.array_max("b_high"))
    gap = F.greatest(F.array_max(gaps) - 2e-9 * widest - 1e-6, F.lit(0.0))
    bound = (F.col("g_norm") + F.col("b_norm")) * (1 + 2e-9) / 2 + 1 - gap * gap / 2
    return met.where(F.isnan(bound) | (bound >= F.col("least"))).select("group", "block")


def top_k(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 20, scale: int = 64,
          k: int = 20, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """(query, rank, key, score): the ``k`` best candidates of every row whose key ``every`` divides.

    ``query`` is the key of the query row; columns are named query_id, rank, ``key``, score.
    """
    import numpy as np

    spark = vectors.sparkSession
    ship_package(spark)
    rows = vectors.select(F.col(key).alias("key"), whole_vector(F.col(vector), scale).alias("vector"))
    rows = rows.where("vector IS NOT NULL").withColumn("asked", F.coalesce(F.col("key") % every == 0, F.lit(False)))
    distinct = _distinct(rows, k)
    sample = distinct.select("vector").orderBy(F.xxhash64("vector")).limit(SAMPLE).toArrow()
    pivots = choose_pivots(_matrix(sample.column("vector"), np.int64))
    placed = stored(_placed(distinct, pivots))
    blocks = _blocks(placed, placed.count(), k, block)
    groups = _groups(placed, blocks, queries)
    meetings = stored(_meetings(groups, blocks))

    def meet(group, blocks):
        import pyarrow as pa
        schema = pa.schema([("query", pa.int64()), ("no", pa.int64()), ("score", pa.int64()),
                            ("copies", pa.list_(pa.struct([("none", pa.bool_()), ("id", pa.int64())])))])
        out = [schema.empty_table()]
        for g in range(group.num_rows):
            for b in range(blocks.num_rows):
                get = lambda t, at, name, kind: _matrix(t.column(name).combine_chunks()[at].values, kind)
                one = lambda t, at, name: t.column(name).combine_chunks()[at].values
                copies = one(blocks, b, "copies")
                many = np.diff(copies.offsets.to_numpy())
                q, c, score = search(
                    get(group, g, "vectors", np.int64), get(group, g, "distances", np.float64),
                    one(group, g, "norms").to_numpy(), one(group, g, "floors").to_numpy(),
                    get(blocks, b, "vectors", np.int64), get(blocks, b, "distances", np.float64),
                    one(blocks, b, "norms").to_numpy(), many, k + 1)
                columns = [one(group, g, "nos").take(pa.array(q)), one(blocks, b, "nos").take(pa.array(c)),
                           pa.array(score, pa.int64()), copies.take(pa.array(c))]
                out.append(pa.table([x.cast(f.type) for x, f in zip(columns, schema)], schema=schema))
        return pa.concat_tables(out)

    left = meetings.join(groups.drop("low", "high", "top_norm", "least"), "group")
    right = meetings.toDF("to_group", "to_block").join(
        blocks.drop("low", "high", "top_norm", "asked"), F.col("to_block") == F.col("block"))
    found = left.groupBy("group", "block").cogroup(right.groupBy("to_group", "to_block")).applyInArrow(
        meet, "query long, no long, score long, copies array<struct<none: boolean, id: bigint>>")
    # The best vectors of a query, then their keys, one more than asked for: the row itself goes.
    order = Window.partitionBy("query").orderBy(
        F.desc("score"), F.col("copies")[0]["none"], F.col("copies")[0]["id"], "no")
    best = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    entry = F.transform("copies", lambda x: F.struct((-F.col("score")).alias("less"), x["none"].alias("none"),
                                                     x["id"].alias("id"), F.col("no").alias("no"), F.col("score").alias("score")))
    entries = best.groupBy("query").agg(F.array_sort(F.flatten(F.collect_list(entry))).alias("entries"))
    own = rows.where("asked").select(F.col("key").alias("query_id"), "vector").join(
        distinct.where("asked").select(F.col("no").alias("query"), "vector"), "vector").select("query_id", "query")
    listed = own.join(entries, "query")
    mine = F.array_position(F.transform("entries", lambda e: (e["no"] == F.col("query")) & e["id"].eqNullSafe(F.col("query_id"))), True)
    rest = F.filter("entries", lambda e, i: i + 1 != F.col("mine"))
    return listed.withColumn("mine", mine).select(
        "query_id", F.posexplode(F.slice(rest, 1, k)).alias("at", "one")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("one.id").alias(key), F.col("one.score").alias("score"))
