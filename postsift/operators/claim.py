"""Order-dependent row selection without sorting a whole group in one task.

Arrival order is explicit data: ``arrival`` packs profile, source and position into
one DECIMAL(38,0). Keep-first and keep-last are ``min_by`` / ``max_by`` aggregations, so map
tasks reduce each key to one row before the shuffle and a key holding a third of all
rows costs no more than any other.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_ARRIVAL = "decimal(38,0)"


def arrival_key(profile_ord: Column, platform_ord: Column, seq: Column) -> Column:
    """Profile, then source, then position; a BIGINT position always fits below 10**19."""
    return (profile_ord.cast("decimal(14,0)") * F.lit(Decimal(10**23))
            + platform_ord.cast("decimal(4,0)") * F.lit(Decimal(10**19))
            + seq.cast("decimal(19,0)")).cast(_ARRIVAL)


def _row_of(df: DataFrame, keys: list[str]) -> Column:
    return F.struct(*[c for c in df.columns if c not in keys])


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The earliest row of every key."""
    return (df.groupBy(*keys).agg(F.min_by(_row_of(df, keys), order).alias("row"))
            .select(*keys, "row.*"))


def keep_last_at_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The latest row of every key, standing where the key first appeared."""
    return (df.groupBy(*keys)
            .agg(F.max_by(_row_of(df, keys), order).alias("row"), F.min(order).alias("first"))
            .select(*keys, "row.*", "first").drop(order)
            .withColumnRenamed("first", order))


def unseen(listings: DataFrame, state_ids: DataFrame) -> DataFrame:
    """Listings whose id is not in state; adaptive execution picks the join."""
    return listings.join(state_ids.select(F.col("job_id").alias("id")), "id", "left_anti")


def seen(listings: DataFrame, state_ids: DataFrame) -> DataFrame:
    return listings.join(state_ids.select(F.col("job_id").alias("id")), "id", "left_semi")


def first_claims(scanned: DataFrame, state_ids: DataFrame) -> DataFrame:
    """The first scanned row of every unseen id.

    Reducing to one row per id first leaves the anti join nothing skewed to move, and
    both steps use the same partitioning on the id.
    """
    return unseen(keep_first(scanned, ["id"], "arrival"), state_ids)


def page_cutoff(cards: DataFrame, pages: DataFrame, scan_keys: list[str]) -> DataFrame:
    """Cards of the pages before the first empty or missing one of each scan.

    ``pages`` has one row per fetched page: ``page`` from 0, its card count ``cards``
    and the scan's ``max_pages``, null for no limit. A page that failed has no row.
    """
    order = Window.partitionBy(*scan_keys).orderBy("page")
    pages = pages.withColumn("_place", F.dense_rank().over(order) - 1)
    stop = pages.groupBy(*scan_keys).agg(
        F.coalesce(F.min(F.when((F.col("cards") == 0) | (F.col("page") > F.col("_place")),
                                F.col("_place"))),
                   F.lit(2**31 - 1)).alias("stop"),
        F.coalesce(F.max("max_pages"), F.lit(2**31 - 1)).alias("max_pages"))
    return (cards.join(stop, scan_keys)
            .filter((F.col("page") < F.col("stop")) & (F.col("page") < F.col("max_pages")))
            .drop("stop", "max_pages"))

