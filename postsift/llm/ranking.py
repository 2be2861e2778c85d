"""Ranked lexical search over a K2-treap of the term-document grid.

A cell of the grid holds the impact of a term on a document. Documents are dealt into
shards of some thousands of columns, whatever their keys; a task builds the treap of one
shard: a compressed quadtree whose nodes keep four bits for their children, the place of
the first of them, and the largest impact below. Children are found by counting bits.

For an item all its terms descend together: a range of documents carries, for each term,
the quadtree node that holds the term's row in these columns. The sum of the nodes' maxima
bounds the score of every document of the range. The ranges of highest bound are split
first, many at a time as arrays; a range of one document has its exact score for a bound.
The search of a shard ends when no range left can reach the worst kept score, or an equal
one at a smaller key. Nothing is cut off before: the result is exact.

Impacts need corpus statistics, so documents are read once into postings of the terms that
items ask for (stored in the shared folder), counted, and then searched. Terms are looked
up by tasks where their number is measured to be small; past that they meet the documents'
terms in a join. Items go to tasks in blocks.

Null texts have no terms. Every row of either table counts for itself, also repeated ones;
items without a found term give no row. Equal scores go by ascending key, null keys last.
Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postsift.session import ship_package, stored

SHARD = 8192
ITEMS = 1024
RANGES_AT_ONCE = 128
# Asked terms up to this number and size are sent to tasks as a dictionary.
LOOKUP_TERMS = 100_000
LOOKUP_BYTES = 16 << 20
# Letters, digits and every byte of a code point past ASCII; A-Z become a-z.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
              for b in range(256))


def text_terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TABLE).split()


class Treap:
    """Quadtree of cells (row, column, value), all values above zero and cells distinct."""

    def __init__(self, rows, columns, values):
        import numpy as np
        self.height = max(1, int(max(rows.max(initial=0), columns.max(initial=0))).bit_length())
        code = np.zeros(len(rows), np.int64)
        for bit in range(self.height):
            code |= ((rows >> bit & 1) << (2 * bit + 1)) | ((columns >> bit & 1) << (2 * bit))
        order = np.argsort(code, kind="stable")
        code, best = code[order], values[order]
        below, masks, firsts, bests = None, [], [], []
        for _ in range(self.height + 1):
            if below is None:
                masks.append(np.zeros(len(code), np.uint8))
                firsts.append(np.zeros(len(code), np.int64))
            else:
                starts = np.flatnonzero(np.concatenate(([True], code[1:] >> 2 != code[:-1] >> 2)))
                masks.append(np.bitwise_or.reduceat(np.left_shift(1, code & 3).astype(np.uint8), starts))
                firsts.append(starts)
                best, code = np.maximum.reduceat(best, starts), code[starts] >> 2
            bests.append(best)
            below = code
        # Levels from the root down, children by their place in the whole array.
        offset = 1
        for k in range(self.height, 0, -1):
            firsts[k] = firsts[k] + offset
            offset += len(firsts[k - 1])
        self.mask, self.first, self.best = (np.concatenate(x[::-1]) for x in (masks, firsts, bests))
        bits = np.array([[m >> q & 1 for q in range(4)] for m in range(16)])
        self.rank = np.concatenate([np.zeros((16, 1), int), np.cumsum(bits, axis=1)[:, :3]], axis=1)

    def children(self, nodes, quarter):
        """Places of the children in ``quarter`` of each node, -1 where there is none."""
        import numpy as np
        mask = self.mask[nodes]
        there = (nodes >= 0) & (mask >> quarter & 1 > 0)
        return np.where(there, self.first[nodes] + self.rank[mask, quarter], -1)

    def top(self, rows, k: int, at_once: int = RANGES_AT_ONCE):
        """(columns, sums) of the ``k`` columns of largest sum above zero over ``rows``."""
        import numpy as np
        best = np.append(self.best, 0)  # place -1: nothing there
        nodes = np.zeros((1, len(rows)), np.int64)
        start, level = np.zeros(1, np.int64), np.zeros(1, np.int64)
        bound = best[nodes].sum(axis=1)
        found_at, found = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while len(bound):
            order = np.lexsort((start, -bound))
            if len(found) == k:
                able = (bound > found[-1]) | ((bound == found[-1]) & (start < found_at[-1]))
                order = order[able[order]]
            now, later = order[:at_once], order[at_once:]
            depth = self.height - 1 - level[now]
            row_bit = rows[None, :] >> depth[:, None] & 1
            parts = [(nodes[later], start[later], level[later], bound[later])]
            for half in (0, 1):
                child = self.children(nodes[now], (2 * row_bit + half).astype(np.int64))
                parts.append((child, start[now] + (half << depth), level[now] + 1, best[child].sum(axis=1)))
            nodes, start, level, bound = (np.concatenate(x) for x in zip(*parts))
            done = (level == self.height) & (bound > 0)
            if done.any():
                found_at, found = np.concatenate([found_at, start[done]]), np.concatenate([found, bound[done]])
                order = np.lexsort((found_at, -found))[:k]
                found_at, found = found_at[order], found[order]
            open_ = (level < self.height) & (bound > 0)
            nodes, start, level, bound = nodes[open_], start[open_], level[open_], bound[open_]
        return found_at, found


def _asked(items: DataFrame, key: str, text: str) -> DataFrame:
    """(item, key, terms): items with their distinct terms, numbered and stored."""
    @F.arrow_udf("array<string>")
    def terms(texts):
        import pyarrow as pa
        return pa.array([sorted({t.decode() for t in text_terms(x.as_py())}) for x in texts], pa.list_(pa.string()))

    return stored(items.select(F.monotonically_increasing_id().alias("item"), F.col(key).alias("key"),
                               terms(F.col(text)).alias("terms")))


def _postings(docs: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """(doc, key, n, ids, counts): terms of ``terms`` (term, id) in every document that has any term at all."""
    known = None
    count, size = terms.agg(F.count("*"), F.sum(F.octet_length("term"))).first()
    if count <= LOOKUP_TERMS and (size or 0) <= LOOKUP_BYTES:
        known = {r.term.encode(): r.id for r in terms.toLocalIterator()}

    def read(batches):
        import pyarrow as pa
        from collections import Counter
        for batch in batches:
            sizes, ids, counts = [], [], []
            for one in batch.column(1):
                bag = Counter(text_terms(one.as_py()))
                sizes.append(bag.total())
                if known is None:
                    ids.append([t.decode() for t in bag])
                    counts.append(list(bag.values()))
                else:
                    met = [(known[t], c) for t, c in bag.items() if t in known]
                    ids.append([t for t, _ in met])
                    counts.append([c for _, c in met])
            kind = pa.string() if known is None else pa.int64()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.list_(kind)),
                 pa.array(counts, pa.list_(pa.int64()))], names=["key", "n", "ids", "counts"])

    found = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        read, f"key long, n long, ids array<{'string' if known is None else 'long'}>, counts array<long>")
    found = found.where("n > 0").withColumn("doc", F.monotonically_increasing_id())
    if known is not None:
        return stored(found)
    found = stored(found)
    met = found.select("doc", F.inline(F.arrays_zip("ids", "counts"))).join(
        terms, F.col("ids") == F.col("term")).groupBy("doc").agg(F.collect_list(F.struct("id", "counts")).alias("met"))
    return stored(found.drop("ids", "counts").join(met, "doc", "left").select(
        "doc", "key", "n", F.coalesce("met.id", F.array().cast("array<long>")).alias("ids"),
        F.coalesce("met.counts", F.array().cast("array<long>")).alias("counts")))


def _search(postings, items, total: int, length: int, k: int):
    """Best documents of one shard for a block of items, as a table."""
    import numpy as np
    import pyarrow as pa

    def flat(table, name):
        column = table.column(name).combine_chunks()
        lengths = np.diff(column.offsets.to_numpy())
        return column.flatten().to_numpy(zero_copy_only=False), lengths

    schema = pa.schema([("item", pa.int64()), ("item_key", pa.int64()), ("key", pa.int64()), ("doc", pa.int64()),
                        ("score", pa.int64())])
    out = [[], [], [], [], []]
    postings = postings.sort_by([("key", "ascending"), ("doc", "ascending")])  # nulls last
    ids, lengths = flat(postings, "ids")
    asked, per_item = flat(items, "ids")
    weights, _ = flat(items, "weights")
    # Rows go by weight, so neighbouring rows have maxima of a kind.
    terms, first = np.unique(asked, return_index=True)
    weight = weights[first]
    row_of = np.empty(len(terms), np.int64)
    row_of[np.argsort(-weight, kind="stable")] = np.arange(len(terms))
    place = np.searchsorted(terms, ids)
    place[place == len(terms)] = 0
    met = terms[place] == ids if len(terms) else np.zeros(len(ids), bool)
    columns = np.repeat(np.arange(len(lengths)), lengths)[met]
    place, counts = place[met], flat(postings, "counts")[0][met]
    scale = 10 + 90 * postings.column("n").to_numpy() * total // max(length, 1)
    value = weight[place] * (1_000_000_000 * counts // (1000 * counts + 8 * scale[columns]))
    some = value > 0
    if some.any():
        treap = Treap(row_of[place[some]], columns[some], value[some])
        keys, docs = postings.column("key").to_pylist(), postings.column("doc").to_pylist()
        names, numbers = items.column("key").to_pylist(), items.column("item").to_pylist()
        ends = np.cumsum(per_item)
        for i, (number, name) in enumerate(zip(numbers, names)):
            rows = row_of[np.searchsorted(terms, asked[ends[i] - per_item[i]:ends[i]])]
            for column, score in zip(*(x.tolist() for x in treap.top(rows, k))):
                for values, one in zip(out, (number, name, keys[column], docs[column], score)):
                    values.append(one)
    return pa.table([pa.array(x, f.type) for x, f in zip(out, schema)], schema=schema)


def ranked(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
           item_text: str = "text", k: int = 10, shard: int = SHARD, block: int = ITEMS) -> DataFrame:
    """(item, rank, key, score): the ``k`` best documents of every item by summed impacts.

    Columns carry the names given for the keys.
    """
    spark = docs.sparkSession
    ship_package(spark)
    asked = _asked(items, item, item_text)
    terms = stored(asked.select(F.explode("terms").alias("term")).distinct().withColumn(
        "id", F.monotonically_increasing_id()))
    postings = _postings(docs, key, text, terms)
    total, length = postings.agg(F.count("*"), F.sum("n")).first()
    many = asked.count()
    shards, blocks = max(1, -(-total // shard)), max(1, -(-many // block))
    # Documents that hold a term, and from them its weight.
    holds = postings.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.ln(F.lit(2.0 * total + 2) / (2 * F.col("df") + 1)))
    weighed = asked.select("item", "key", F.explode("terms").alias("term")).join(terms, "term").join(
        holds.select("id", weight.alias("weight")), "id")
    listed = stored(weighed.groupBy("item", "key").agg(F.collect_list(F.struct("id", "weight")).alias("w")).select(
        "item", "key", F.col("w.id").alias("ids"), F.col("w.weight").alias("weights")))
    deal = lambda name, parts: F.pmod(F.xxhash64(name), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = postings.withColumn("shard", deal("doc", shards)).withColumn("block", every(blocks))
    right = listed.withColumn("block", deal("item", blocks)).withColumn("shard", every(shards))

    def search(postings, items):
        return _search(postings, items, total, length, k)

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(
        search, "item long, item_key long, key long, doc long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("key"), "doc")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        F.col("item_key").alias(item), "rank", F.col("key").alias(key), "score")
