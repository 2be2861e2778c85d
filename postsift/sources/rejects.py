"""Landed responses and listings that a cycle cannot use, with the reason.

A reject is counted and kept beside the results; it never stops the rest of its batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsift.schema import JSON_SOURCES
from postsift.sources.profiles import expand_platforms
from postsift.sources.registry import SOURCES

EMPTY_BODY, UNKNOWN_SOURCE, BAD_JSON = "EMPTY_BODY", "UNKNOWN_SOURCE", "BAD_JSON"
LOST_SEARCH, SOURCE_FAILED, BATCH_FAILED = "LOST_SEARCH", "SOURCE_FAILED", "BATCH_FAILED"
# Characters of a body or an error that are kept for a look.
SHOWN = 500


def payload_reason() -> Column:
    """Why a landed response cannot be read; null where it can."""
    code, body = F.col("platform_code"), F.col("body")
    return (F.when(~F.coalesce(F.rlike(body, F.lit(r"\S")), F.lit(False)), EMPTY_BODY)
            .when(~F.coalesce(code.isin(sorted(SOURCES)), F.lit(False)), UNKNOWN_SOURCE)
            .when(code.isin(JSON_SOURCES) & F.try_parse_json(body).isNull(), BAD_JSON))


def reject_rows(payloads: DataFrame, reason: Column, detail: Column) -> DataFrame:
    """(payload_seq, platform_code, search_name, reason, detail) of the rows that have a reason."""
    return payloads.select("payload_seq", "platform_code", "search_name", reason.alias("reason"),
                           F.substring(detail, 1, SHOWN).alias("detail")).where("reason IS NOT NULL")


def payload_rejects(payloads: DataFrame) -> DataFrame:
    return reject_rows(payloads, payload_reason(), F.col("body"))


def lost_searches(listings: DataFrame, profiles: DataFrame) -> DataFrame:
    """Listings that name a search which no longer exists, is disabled or left their source."""
    owners = expand_platforms(profiles).select(
        F.col("search_name").alias("_name"), F.col("platform_code").alias("_code")).distinct()
    lost = listings.where("matched_search_name IS NOT NULL").join(
        owners, (F.col("matched_search_name") == F.col("_name")) & (F.col("platform_code") == F.col("_code")), "left_anti")
    return lost.select(F.col("seq").cast("long").alias("payload_seq"), "platform_code",
                       F.col("matched_search_name").alias("search_name"), F.lit(LOST_SEARCH).alias("reason"),
                       F.col("id").alias("detail"))


def reject_counts(rejects: DataFrame) -> DataFrame:
    return rejects.groupBy("platform_code", "reason").agg(F.count("*").alias("rejects"))
