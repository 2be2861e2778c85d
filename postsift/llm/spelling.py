"""Spelling variants of words by permuterm rotations.

A word is closed by a terminator, and all rotations of the closed word are made. The
rotation that ends with the word's i-th character starts with everything else, so words
that differ in that character alone share its prefix, and a word without the character
has that prefix as a whole rotation of its own. Sorted rotations thus hold all words one
replacement, insertion or deletion apart in one range of a prefix; ranges are scanned and
neighbours emitted. The terminator keeps the place of the edit, so a pair of words one
replacement apart meets in one range only; an inserted character counts at the first of
a run of equal ones, so such a pair meets once as well.

Ranges are small by nature: they hold one word for each character of the alphabet, and one
whole rotation. Words are counted where texts are read, a bounded number at a time, so a
frequent word is one row for each full bag of a task. Roots are found by pointer doubling;
a form has several times the occurrences of its word, so chains are short and end.

Null texts have no words; a null key counts as an empty string in the damage's hash. Repeated
rows count repeatedly. Ties between forms go to the smallest word in code-point order. Other
columns are not read, so their names do not matter. A vocabulary must not repeat a word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsift.session import cut_lineage, ship_package, stored

RUN = rb"(?:[a-z]|\xc3[\x80-\xbf])+"
MIN_LENGTH = 6
MIN_COUNT = 5
RATIO = 5
DAMAGE = 199
TERMINATOR = "$"
# Words that a task holds before it passes their counts on.
BAG = 200_000
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def text_words(key, text: str | None, damage: int | None = None) -> dict[bytes, int]:
    """Occurrences of the lower-cased letter runs of a text, damaged where asked for.

    With ``damage`` a run loses one code point where that number divides the crc32 of
    ``<key>:<run>``.
    """
    import re
    from collections import Counter
    from zlib import crc32

    runs = Counter(re.findall(RUN, (text or "").encode().translate(LOWER)))
    if damage is None:
        return runs
    start = crc32(f"{'' if key is None else key}:".encode())
    hit = [(run, h) for run in runs if (h := crc32(run, start)) % damage == 0]
    # All are taken out first: what one becomes may be another, which is damaged only as it stood.
    taken = [(run.decode(), h, runs.pop(run)) for run, h in hit]
    for whole, h, n in taken:
        at = h % len(whole)
        runs[(whole[:at] + whole[at + 1:]).encode()] += n
    return runs


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", damage: int | None = None,
               min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): words of enough code points and occurrences over all texts."""
    ship_package(docs.sparkSession)

    def count(batches):
        import pyarrow as pa
        from collections import Counter

        def full():
            words = [(w.decode(), n) for w, n in bag.items()]
            words = [(w, n) for w, n in words if len(w) >= min_length]
            return pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in words], pa.string()), pa.array([n for _, n in words], pa.int64())],
                names=["word", "n"])

        bag = Counter()
        for batch in batches:
            for one, body in zip(batch.column(0), batch.column(1)):
                bag.update(text_words(one.as_py(), body.as_py(), damage))
                if len(bag) > BAG:
                    yield full()
                    bag = Counter()
        yield full()

    counted = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def rotations(words: DataFrame) -> DataFrame:
    """(prefix, tail, first, word, n): ranges that each word belongs to.

    ``tail`` is the character that the rotation adds to ``prefix``, null where the prefix is
    a whole rotation; ``first`` tells that the character before it in the word is another.
    """
    marked = F.concat("word", F.lit(TERMINATOR))
    whole = words.select("word", "n", marked.alias("m")).withColumn(
        "at", F.explode(F.sequence(F.lit(1), F.length("m"))))
    char = F.substr("m", F.col("at"), F.lit(1))
    start = F.concat(F.substr("m", F.col("at") + 1), F.substr("m", F.lit(1), F.col("at") - 1))
    before = F.substr("m", F.col("at") - 1, F.lit(1))
    return whole.select(
        "word", "n",
        F.inline(F.array(
            F.struct(start.alias("prefix"), char.alias("tail"),
                     ((F.col("at") == 1) | (char != before)).alias("first")),
            F.struct(F.concat(start, char).alias("prefix"), F.lit(None).cast("string").alias("tail"),
                     F.lit(True).alias("first"))))
    ).where(F.col("tail").isNull() | (F.col("tail") != TERMINATOR))


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): every ordered pair of words one code point apart.

    ``words`` holds (word, n), each word once and without the terminator.
    """
    member = F.struct("tail", "word", "n", "first")
    ranges = rotations(words).groupBy("prefix").agg(F.array_sort(F.collect_list(member)).alias("range"))
    scanned = ranges.where(F.size("range") > 1).select("range", F.explode("range").alias("a"))
    pairs = scanned.select("a", F.explode("range").alias("b"))
    replaced = F.col("a.tail") != F.col("b.tail")
    longer = F.col("a.tail").isNotNull() & F.col("a.first") & F.col("b.tail").isNull()
    shorter = F.col("b.tail").isNotNull() & F.col("b.first") & F.col("a.tail").isNull()
    return pairs.where(F.coalesce(replaced, F.lit(False)) | longer | shorter).select(
        F.col("a.word").alias("word"), F.col("a.n").alias("n"),
        F.col("b.word").alias("near"), F.col("b.n").alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of the chain of forms of every word of ``forms`` (word, form)."""
    known = cut_lineage(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        further = known.select(F.col("word").alias("root"), F.col("root").alias("top"))
        known = cut_lineage(known.join(further, "root", "left").select(
            "word", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")))
        if known.where("moved").isEmpty():
            return known.select("word", "root")
        known = known.drop("moved")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of ``words`` (word, n).

    The form is the near word of most occurrences where those are ``ratio`` times the word's.
    """
    words = stored(words)
    near = neighbours(words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    strong: Column = -F.col("best.less") >= ratio * F.col("n")
    judged = cut_lineage(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n")))
    return judged.join(roots(judged), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
