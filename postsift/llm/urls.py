"""URL filters: rules, and boosted trees on lexical features for URLs that no rule fits.

A rule names a host and the start of a path; it fits the host and its subdomains, and the
longest fitting rule decides. All other URLs are scored by gradient-boosted trees on
length, depth, digit ratio, entropy, parameter counts and the statistics of the host's
suffix (how many labelled URLs it has, and how many of them are bad). The trees learn from
labelled URLs; of those about ``SAMPLE_ROWS``, picked by a hash of the URL, are used to
fit them, while the suffix statistics count all.

A null URL, or one without "://", has an empty host and path. Where labels are absent or
all alike nothing can be learned: URLs without a rule are then allowed. Ties of equally
long rules go to the earlier one. Repeated rows are judged alike.
"""

from __future__ import annotations

import string

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsift.llm.common import packed
from postsift.session import broadcast_if_small, cut_lineage

# Action, host, start of the path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
SAMPLE_ROWS = 20_000
TREES, DEPTH, SEED = 10, 3, 7
SMOOTHING = 20.0
FEATURES = ["length", "path_length", "depth", "labels", "digits", "hyphens", "entropy",
            "parameters", "query_length", "suffix_known", "suffix_bad"]


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    whole = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(whole, pattern, 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(whole, pattern, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its action; both null where none does."""
    rule = action = None
    for act, name, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule = F.when(fits, name + start) if rule is None else rule.when(fits, name + start)
        action = F.when(fits, act) if action is None else action.when(fits, act)
    if rule is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return rule, action


def entropy(text: Column) -> Column:
    """Bits a character of a text."""
    chars, size = F.split(text, ""), F.length(text)
    seen = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / size)
    return F.when(size > 0, F.aggregate(seen, F.lit(0.0), lambda a, p: a - p * F.log2(p))).otherwise(0.0)


def described(pages: DataFrame, url: str = "url") -> DataFrame:
    """``row``, ``host``, ``path``, ``suffix`` (last two host labels) and the features that
    the URL alone gives."""
    host, path = parts(F.col(f"`{url}`"))
    df = pages.select(packed(pages).alias("row"), F.coalesce(F.col(f"`{url}`"), F.lit("")).alias("_u"),
                      host.alias("host"), path.alias("path"))
    count = lambda text, pattern: F.length(F.regexp_replace(text, pattern, "")).cast("double")
    query = F.regexp_extract("_u", r"(?s)\?([^#]*)", 1)
    size = F.length("_u").cast("double")
    return df.select(
        "row", "host", "path", F.substring_index("host", ".", -2).alias("suffix"),
        size.alias("length"), F.length("path").cast("double").alias("path_length"),
        count("path", "[^/]").alias("depth"), count("host", r"[^.]").alias("labels"),
        F.coalesce(count("_u", "[^0-9]") / F.nullif(size, F.lit(0.0)), F.lit(0.0)).alias("digits"),
        count("_u", "[^-]").alias("hyphens"), entropy(F.col("_u")).alias("entropy"),
        count(query, "[^=]").alias("parameters"), F.length(query).cast("double").alias("query_length"))


def suffix_statistics(labelled: DataFrame) -> DataFrame:
    """(suffix, suffix_known, suffix_bad): log count of labelled URLs, smoothed bad share."""
    sums = labelled.groupBy("suffix").agg(F.count("*").cast("double").alias("n"),
                                          F.sum("bad").cast("double").alias("b"))
    mean = sums.agg(F.sum("b") / F.nullif(F.sum("n"), F.lit(0.0))).first()[0] or 0.0
    return sums.select("suffix", F.log1p("n").alias("suffix_known"),
                       ((F.col("b") + SMOOTHING * mean) / (F.col("n") + SMOOTHING)).alias("suffix_bad"))


def _with_suffix(df: DataFrame, statistics: DataFrame) -> DataFrame:
    met = df.join(broadcast_if_small(statistics), "suffix", "left")
    return met.fillna(0.0, ["suffix_known", "suffix_bad"])


def _vectors(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(df)


def fit(labelled: DataFrame, statistics: DataFrame, rows: int = SAMPLE_ROWS):
    """Trees from rows with ``bad`` (0 or 1); None where there are not both kinds."""
    kinds = {r["bad"]: r["n"] for r in labelled.groupBy("bad").agg(F.count("*").alias("n")).collect()}
    if len(kinds) < 2:
        return None
    share = min(1.0, rows / sum(kinds.values()))
    picked = F.pmod(F.xxhash64(F.lit(SEED), "row"), F.lit(1 << 20)) < int(share * (1 << 20))
    sample = cut_lineage(_with_suffix(labelled.where(picked), statistics).select(
        F.col("bad").cast("double").alias("label"), *FEATURES).coalesce(4))
    if sample.select("label").distinct().count() < 2:
        return None
    return GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED).fit(_vectors(sample))


def labelled_urls(pages: DataFrame, labels: DataFrame, url: str = "url") -> DataFrame:
    """Described URLs with ``bad``: the document that the number in the path names has a
    quality label of 0. Of several labels of a document the lowest counts."""
    df = described(pages, url)
    number = F.expr(r"try_cast(regexp_extract(path, '/([0-9]+)(?:[./]|$)', 1) AS bigint)")
    known = labels.where("quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return df.withColumn("_doc", number).join(known, F.col("_doc") == F.col("doc_id")).withColumn(
        "bad", (F.col("quality") == 0).cast("int")).drop("_doc", "doc_id", "quality")


def judge(pages: DataFrame, labelled: DataFrame, url: str = "url", rules=RULES,
          threshold: float = .5) -> DataFrame:
    """``row``, ``host``, ``path``, ``rule``, ``score`` (probability of bad; null where
    nothing was learned) and ``verdict``."""
    labelled = cut_lineage(labelled.withColumn("row", F.xxhash64("row")))
    statistics = cut_lineage(suffix_statistics(labelled))
    model = fit(labelled, statistics)
    df = _with_suffix(described(pages, url), statistics)
    if model is None:
        df = df.withColumn("score", F.lit(None).cast("double"))
    else:
        df = model.transform(_vectors(df)).withColumn("score", vector_to_array("probability")[1])
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    learned = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return df.select("row", "host", "path", rule.alias("rule"), "score",
                     F.coalesce(action, learned).alias("verdict"))
