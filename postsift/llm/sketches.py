"""Document fingerprints: threshold-scaled sketches of shingle hashes.

A sketch keeps every hash of a five-word shingle that lies below a fixed fraction
(1 / ``SCALE``) of the hash range. The same hashes are kept in every document, so the
sketch of a union is the union of the sketches, and the share of a short document that
lies in a very long one can be read from both, however unequal they are.

A text of fewer than five words is one shingle. A sketch may be empty: for a text without
words, or by chance for a short one; then likeness rests on whole texts alone, 1 when they
have the same words and 0 otherwise. Null text is an empty one. The fingerprint string
holds the number of distinct shingles, a hash of all words and the sketch, so equal texts
have equal fingerprints.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postsift.llm.common import run_hashes, unique_name, words_of

SCALE = 8
SHINGLE = 5
BUCKET_ROWS = 2000
MOST_BUCKETS = 50_000


def sketch(df: DataFrame, text: str, name: str, scale: int = SCALE, shingle: int = SHINGLE) -> DataFrame:
    """Adds ``name``: struct of ``whole`` (hash of all words), ``n`` (distinct shingles) and
    ``kept`` (sorted hashes below the threshold)."""
    hashes, runs = (unique_name(x, df.columns) for x in ("_hashes", "_runs"))
    words = words_of(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    df = df.withColumn(hashes, F.transform(words, lambda w: F.xxhash64(w)))
    df = run_hashes(df, hashes, shingle, runs)
    few = (F.size(hashes) > 0) & (F.size(hashes) < shingle)
    df = df.withColumn(runs, F.array_distinct(F.when(few, F.array(F.xxhash64(hashes))).otherwise(F.col(runs))))
    # Hashes are signed: the lowest part of the range begins at the smallest long.
    below = -(1 << 63) + (1 << 64) // scale
    return df.withColumn(name, F.struct(
        F.xxhash64(hashes).alias("whole"), F.size(runs).alias("n"),
        F.sort_array(F.filter(runs, lambda h: h < F.lit(below))).alias("kept"))).drop(hashes, runs)


def as_text(sketch_: Column) -> Column:
    """Fingerprint string: words hash, shingle count and kept hashes in hex."""
    return F.concat(
        F.lower(F.lpad(F.hex(sketch_["whole"]), 16, "0")), F.lit(":"), sketch_["n"].cast("string"),
        F.lit(":"), F.array_join(F.transform(
            sketch_["kept"], lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), ","))


def merged(a: Column, b: Column) -> Column:
    """Kept hashes of the two documents together."""
    return F.sort_array(F.array_union(a["kept"], b["kept"]))


def containment(part: Column, whole: Column) -> Column:
    """Estimated share of the first document's shingles found in the second; null when
    nothing was kept of the first."""
    return (F.size(F.array_intersect(part["kept"], whole["kept"]))
            / F.nullif(F.size(part["kept"]), F.lit(0)))


def likeness(a: Column, b: Column) -> Column:
    """Containment of the smaller sketch in the larger, 0 to 1."""
    small = F.least(F.size(a["kept"]), F.size(b["kept"]))
    same = (a["whole"] == b["whole"]) & (a["n"] == b["n"])
    return F.when(same, 1.0).when(small == 0, 0.0).otherwise(
        F.size(F.array_intersect(a["kept"], b["kept"])) / small)


def with_next(df: DataFrame, key: str, value: str, tie: str, name: str) -> DataFrame:
    """Adds ``name``: column ``value`` of the following row in ascending ``key`` order, the
    first row following the last.

    Rows are dealt to buckets of neighbouring keys by equal steps of the key range, each
    sorted on its own. The first row of a bucket is also sent to the bucket before it,
    which gives every last row its follower. Bucket heads are at most MOST_BUCKETS short
    rows, so they are broadcast; rows move once. Null keys come last, rows with equal keys
    in the order of a hash of ``tie``.
    """
    low, high, count = df.agg(F.min(key), F.max(key), F.count("*")).first()
    if low is None:
        low = high = 0
    buckets = max(1, min(MOST_BUCKETS, math.ceil(count / BUCKET_ROWS)))
    width = max(1, math.ceil((high - low + 1) / buckets))
    home = F.coalesce(F.floor((F.col(key) - F.lit(low)) / F.lit(width)), F.lit(buckets))
    marked = df.withColumn("_home", home).withColumn("_mark", F.xxhash64(tie))
    heads = marked.groupBy("_home").agg(F.min(F.struct(
        F.col(key).alias("key"), F.col("_mark").alias("mark"))).alias("head"))
    before = F.lag("_home").over(Window.orderBy("_home"))
    last = F.max("_home").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("head", F.coalesce(before, last).alias("_to"))
    met = marked.join(F.broadcast(heads), F.col(key).eqNullSafe(F.col("head.key"))
                      & (F.col("_mark") == F.col("head.mark")), "left")
    at = F.when(F.col("_to").isNull(), F.array("_home")).otherwise(F.array("_home", "_to"))
    rows = met.select(*df.columns, "_mark", F.posexplode(at).alias("_guest", "_bucket"))
    order = Window.partitionBy("_bucket").orderBy("_guest", F.col(key).asc_nulls_last(), "_mark")
    rows = rows.withColumn(name, F.lead(value).over(order))
    return rows.where("_guest = 0").drop("_mark", "_guest", "_bucket")


def edited(text: Column, following: Column) -> Column:
    """The text with its last quarter (code points) replaced by the start of another."""
    size = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - size),
                    F.substring(following, F.lit(1), size))


def compare_with_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document against its edited text and against the next document."""
    df = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    df = sketch(df, "body", "own").select("key", "body", F.struct("body", "own").alias("this"))
    # A single row is its own follower.
    df = with_next(df, "key", "this", "body", "next").withColumn("next", F.coalesce("next", "this"))
    df = df.select(
        "key", F.col("this.own").alias("own"), F.col("next.own").alias("next_own"),
        edited(F.col("this.body"), F.col("next.body")).alias("made"),
        F.length("this.body").cast("long").alias("n_chars"))
    df = sketch(df, "made", "changed")
    return df.select(
        F.col("key").alias(key), "n_chars", F.sha2("made", 256).alias("edited_sha256"),
        as_text(F.col("own")).alias("fingerprint"), as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own")).alias("near_next"))
