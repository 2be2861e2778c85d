"""Which searches would take a listing, for many searches at once.

The chain of rules as Columns is evaluated per pair of listing and search; here every text
is read once, whatever the number of searches, and only the pairs that pass leave the scan.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsift.functions import rules
from postsift.functions.keyword_index import COLUMNS, KeywordIndex
from postsift.functions.text import age_hours, text
from postsift.session import fits_broadcast, ship_package
from postsift.sources.profiles import expand_platforms, match_profiles

_indexes: dict[str, KeywordIndex] = {}


def _index(key: str, searches: list[dict]) -> KeywordIndex:
    """One index per worker process; that of the latest table of searches is kept."""
    if key not in _indexes:
        _indexes.clear()
        _indexes[key] = KeywordIndex(searches)
    return _indexes[key]


def _searches(profiles: DataFrame) -> DataFrame:
    """One row per enabled search: its lists in lower case and the sources it scans."""
    lists = [name for pair in COLUMNS.values() for name in pair]
    low = [F.transform(F.col("filters")[n], F.lower).alias(n) for n in lists]
    codes = expand_platforms(profiles).groupBy("profile_ord").agg(
        F.collect_set("platform_code").alias("platform_codes"))
    return profiles.select("profile_ord", *low, F.col("filters.max_age_hours").alias("max_age_hours")).join(
        codes, "profile_ord")


def routes(listings: DataFrame, profiles: DataFrame, as_of: Column, keep: list[str]) -> DataFrame:
    """``keep`` columns of a listing and ``profile_ord``, a row for each search that takes it.

    The searches go to the executors when they are measured to fit; beyond that listings
    and searches are joined on the source and the chain is evaluated for each pair. Rows of
    listings that occur twice stay apart; null texts are empty, an unknown source has no search.
    """
    spark = listings.sparkSession
    table = _searches(profiles)
    if not fits_broadcast(table):
        pairs = match_profiles(listings, profiles.withColumn("platforms", F.array_distinct("platforms")))
        return pairs.where(rules.first_reason(F.col("filters"), as_of).isNull()).select(*keep, "profile_ord")
    ship_package(spark)
    searches = [row.asDict() for row in table.orderBy("profile_ord").collect()]
    key, shared = uuid.uuid4().hex, spark.sparkContext.broadcast(searches)

    @F.arrow_udf("array<bigint>")
    def taken(code, age, company, title, location, description):
        import numpy as np
        import pyarrow as pa
        index = _index(key, shared.value)
        names = list(COLUMNS)
        found = [index.passing(c, a, dict(zip(names, row))) for c, a, *row in zip(*[
            column.to_pylist() for column in (code, age, company, title, location, description)])]
        offsets = np.zeros(len(found) + 1, np.int32)
        np.cumsum([len(f) for f in found], out=offsets[1:])
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(
            np.concatenate([np.empty(0, np.int64), *found])))

    age = age_hours(F.col("post_date"), F.col("post_text"), as_of).cast("double")
    texts = [F.lower(text(F.col(name))) for name in COLUMNS]
    return listings.select(*keep, F.explode(taken("platform_code", age, *texts)).alias("profile_ord"))
