"""Quality rules as weak supervision.

Every rule looks at a few counts of a document and votes "good" (1), "bad" (-1) or
abstains (0). How often each rule is right on good and on bad documents is not known in
advance: expectation-maximisation estimates it, with the share of bad documents, from how
the rules agree over the whole corpus. A document is kept when its posterior probability
of being good reaches ``threshold``; no single rule is a veto, except the base rule.

Null text counts as a text without words. A document without words, or with fewer than
20, fails the base rule and is never kept. Repeated rows are judged alike. An empty table
gives an empty result and a model of the starting values.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsift.session import cut_lineage
from postsift.llm.common import NOT_SPACE, packed, run_hashes, words_of

WINDOW = 8
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "n_lines", "n_upper", "n_letters", "n_marks", "n_distinct"]


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row`` and the MEASURES of its text.

    ``n_repeat_words`` counts the words inside windows of eight that occur more than
    once: windows are compared by a 64-bit hash; only for a text whose hashes are not all
    different are they sorted with their positions, so a text costs n log n at worst.
    """
    df = docs.select(packed(docs).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(NOT_SPACE))
    df = df.select(
        "row", words_of(F.col("_t")).alias("_w"), lines.alias("_l"),
        F.length(F.regexp_replace("_t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("_t", r"[^!?]+", "")).cast("long").alias("n_marks"),
        F.length(F.regexp_replace("_t", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace("_t", r"[^\p{L}]+", "")).cast("long").alias("n_letters"))
    df = df.select(
        "row", "n_symbols", "n_marks", "n_upper", "n_letters",
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.size("_w").cast("long").alias("n_words"), F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("_w")).cast("long").alias("n_distinct"),
        F.transform("_w", lambda x: F.xxhash64(x)).alias("_h"))
    df = run_hashes(df, "_h", WINDOW, "_v")
    df = df.withColumn("_s", F.when(
        F.size(F.array_distinct("_v")) < F.size("_v"),
        F.sort_array(F.transform("_v", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))

    def again(x: Column, i: Column) -> Column:
        before, after = F.get("_s", i - 1)["h"], F.get("_s", i + 1)["h"]
        return F.coalesce(x["h"] == before, F.lit(False)) | F.coalesce(x["h"] == after, F.lit(False))

    df = df.withColumn("_p", F.when(F.col("_s").isNotNull(), F.sort_array(
        F.transform(F.filter("_s", again), lambda x: x["i"]))))
    covered = F.aggregate(
        "_p", F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda a, p: F.struct(p.alias("last"),
                              (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")))["n"]
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).select(
        "row", *MEASURES)


def base_failed() -> Column:
    return ((F.col("n_words") < 20)
            | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def _band(value: Column, good: tuple[float, float], bad: tuple[float | None, float | None]) -> Column:
    """Good inside ``good``; bad below or above ``bad``; abstains elsewhere and on null."""
    low, high = bad
    outside = F.lit(False)
    if low is not None:
        outside = outside | (value < low)
    if high is not None:
        outside = outside | (value > high)
    return F.coalesce(F.when(outside, -1).when(value.between(*good), 1), F.lit(0))


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.nullif(F.col(whole), F.lit(0))




def rules() -> dict[str, Column]:
    """Votes by name. Several rules see each kind of damage, from different sides: it is
    their agreement that tells a rule's accuracy."""
    return {
        "symbols": _band(_share("n_symbols", "word_chars"), (0, .02), (None, .08)),
        "letters": _band(_share("n_letters", "word_chars"), (.95, 1), (.88, None)),
        "repetition": _band(_share("n_repeat_words", "n_words"), (0, .05), (None, .25)),
        "vocabulary": F.when(F.col("n_words") <= 400, _band(
            _share("n_distinct", "n_words"), (.4, 1), (.2, None))).otherwise(0),
        "lines": F.when(F.col("n_lines") >= 4, _band(
            _share("n_dup_lines", "n_lines"), (0, .1), (None, .4))).otherwise(0),
        "capitals": _band(_share("n_upper", "n_letters"), (0, .15), (None, .5)),
        "marks": _band(_share("n_marks", "n_words"), (0, .1), (None, .5)),
        "word_length": _band(_share("word_chars", "n_words"), (3, 10), (2, 15)),
    }


@dataclass(frozen=True)
class Model:
    """Share of bad documents, and by rule the probability of a bad vote on each kind."""

    bad: float
    on_bad: dict[str, float]
    on_good: dict[str, float]

    def posterior_good(self) -> Column:
        """Naive Bayes over the rules that voted; an abstention says nothing."""
        odds = F.lit(math.log((1 - self.bad) / self.bad))
        for name, vote in self.on_bad.items():
            other = self.on_good[name]
            odds = odds + (F.when(F.col(f"votes.{name}") == -1, math.log(other / vote))
                           .when(F.col(f"votes.{name}") == 1, math.log((1 - other) / (1 - vote)))
                           .otherwise(0.0))
        return 1 / (1 + F.exp(-odds))


def start() -> Model:
    names = list(rules())
    return Model(.1, dict.fromkeys(names, .3), dict.fromkeys(names, .01))


def with_votes(measured: DataFrame) -> DataFrame:
    return measured.withColumn("votes", F.struct(*[
        vote.cast("int").alias(name) for name, vote in rules().items()]))


def fit(voted: DataFrame, rounds: int = 12, prior: float = .01) -> Model:
    """Expectation-maximisation over the vote patterns of all documents.

    Documents with the same votes are one row with a count: at most 3 to the number of
    rules rows, whatever the corpus. Each round is one aggregation over them. ``prior``
    weighs the starting values as if that share of the corpus had shown them, so that a
    rule that never votes keeps its start.
    """
    names = list(rules())
    patterns = cut_lineage(voted.groupBy("votes").agg(F.count("*").cast("double").alias("n")).coalesce(1))
    first = model = start()
    for _ in range(rounds):
        post = patterns.withColumn("good", model.posterior_good())
        bad, good = F.col("n") * (1 - F.col("good")), F.col("n") * F.col("good")
        sums = [F.sum("n").alias("n"), F.sum(bad).alias("bad")]
        for name in names:
            vote = F.col(f"votes.{name}")
            for kind, weight in (("b", bad), ("g", good)):
                sums += [F.sum(F.when(vote == -1, weight).otherwise(0.0)).alias(f"{kind}_{name}"),
                         F.sum(F.when(vote != 0, weight).otherwise(0.0)).alias(f"{kind}n_{name}")]
        got = post.agg(*sums).first()
        if not got["n"]:
            return model
        extra = got["n"] * prior

        def rate(kind: str, name: str, base: float) -> float:
            p = (got[f"{kind}_{name}"] + extra * base) / (got[f"{kind}n_{name}"] + extra)
            return min(max(p, 1e-4), 1 - 1e-4)

        model = Model(min(max((got["bad"] + extra * first.bad) / (got["n"] + extra), 1e-3), .9),
                      {n: rate("b", n, first.on_bad[n]) for n in names},
                      {n: rate("g", n, first.on_good[n]) for n in names})
    return model


def judge(voted: DataFrame, model: Model, threshold: float = .5) -> DataFrame:
    """Adds ``base_failed``, ``posterior`` (of being good) and ``kept``."""
    return (voted.withColumn("base_failed", base_failed())
            .withColumn("posterior", model.posterior_good())
            .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold)))


def keep_good(docs: DataFrame, text: str = "text", threshold: float = .5) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``.

    The corpus is measured twice, for the model and for the verdicts, so that no text is
    written in between.
    """
    model = fit(with_votes(measure(docs, text)))
    judged = judge(with_votes(measure(docs, text)), model, threshold)
    # A filter would be pushed below the counts and make each of them once for every use.
    return judged.select(F.explode(F.when(F.col("kept"), F.array("row"))).alias("row")).select("row.*")
