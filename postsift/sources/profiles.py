"""Search profiles: config text to the PROFILE table, with defaults applied.

A config document holds ``settings`` and ``searches``. Parsing a config file is
driver work on one small file; the defaults themselves are Column expressions, so
a table of config documents goes through the same code.
"""

from __future__ import annotations

import json
import os
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postsift.functions.rules import words
from postsift.functions.text import filled, text
from postsift.schema import (
    DEFAULT_COLOR_HEX,
    DEFAULT_PLATFORMS,
    KEYWORD_FIELDS,
    PLATFORM_NAMES,
    RAW_PROFILE,
    Settings,
)
from postsift.session import broadcast_if_small


def _or_default(c: Column, default: str) -> Column:
    return F.coalesce(c, F.lit(default))


def with_defaults(raw: DataFrame) -> DataFrame:
    """``(profile_ord, search STRUCT)`` to one PROFILE row per search.

    Missing lists become empty, and an empty platform list becomes the default one.
    """
    s = F.col("search")
    none = words([])
    platforms = F.coalesce(s["platforms"], none)
    filters = F.struct(
        *[F.coalesce(s["filters"][name], none).alias(name) for name in KEYWORD_FIELDS],
        s["filters"]["max_age_hours"].alias("max_age_hours"),
        s["filters"]["min_salary"].alias("min_salary"))
    numbered = F.concat(F.lit("Search #"), (F.col("profile_ord") + 1).cast("string"))
    return raw.select(
        F.col("profile_ord").cast("int").alias("profile_ord"),
        F.coalesce(s["name"], numbered).alias("search_name"),
        F.coalesce(s["enabled"], F.lit(True)).alias("enabled"),
        filled(s["webhook_url"]).alias("webhook_url"),
        filled(s["role_id_to_mention"]).alias("role_id_to_mention"),
        _or_default(s["embed_color"], DEFAULT_COLOR_HEX).alias("embed_color"),
        text(s["keywords"]).alias("keywords"),
        _or_default(s["location"], "Remote").alias("profile_location"),
        _or_default(s["date_posted"], "past_24h").alias("date_posted"),
        _or_default(s["sort_by"], "recent").alias("sort_by"),
        F.coalesce(s["workplace_types"], none).alias("workplace_types"),
        F.coalesce(s["experience_levels"], none).alias("experience_levels"),
        F.coalesce(s["job_types"], none).alias("job_types"),
        filters.alias("filters"),
        s["max_pages"].alias("max_pages"),
        F.when(F.size(platforms) > 0, platforms)
        .otherwise(words(DEFAULT_PLATFORMS)).alias("platforms"),
    )


def profiles_from_json(documents: DataFrame, order: str, json_column: str) -> DataFrame:
    """A table of config documents, one search each, to PROFILE rows."""
    parsed = F.from_json(F.col(json_column), RAW_PROFILE)
    return with_defaults(documents.select(F.col(order).alias("profile_ord"),
                                          parsed.alias("search")))


def profiles_from_searches(spark: SparkSession, searches: list[dict]) -> DataFrame:
    # Literals of one row, so that the optimizer sees the whole table and no Python runs.
    bodies = F.array(*[F.lit(json.dumps(search)) for search in searches])
    table = spark.range(1, numPartitions=1).select(
        F.posexplode(bodies.cast("array<string>")).alias("ord", "body"))
    return profiles_from_json(table, "ord", "body")


def _settings(raw: dict) -> Settings:
    def listed(key: str):
        return tuple(raw[key]) if raw.get(key) else None

    base = Settings()
    return replace(
        base,
        default_route=os.getenv("DISCORD_WEBHOOK_URL") or raw.get("discord_webhook_url", ""),
        check_interval_minutes=int(raw.get("check_interval_minutes", base.check_interval_minutes)),
        request_delay_seconds=float(raw.get("request_delay_seconds", base.request_delay_seconds)),
        max_pages_per_search=int(raw.get("max_pages_per_search", base.max_pages_per_search)),
        fetch_job_details=bool(raw.get("fetch_job_details", base.fetch_job_details)),
        database_path=raw.get("database_path", base.database_path),
        log_level=raw.get("log_level", base.log_level),
        junior_filter_enabled=bool(raw.get("junior_filter_enabled", True)),
        junior_filter_strict=bool(raw.get("junior_filter_strict", False)),
        junior_include_keywords=listed("junior_include_keywords"),
        junior_title_exclude_keywords=listed("junior_title_exclude_keywords"),
        junior_description_exclude_keywords=listed("junior_description_exclude_keywords"),
    )


def load_config(spark: SparkSession, path: str) -> tuple[Settings, DataFrame]:
    """Settings and PROFILE table of a config file, YAML or JSON."""
    with open(path, encoding="utf-8") as handle:
        body = handle.read()
    if path.endswith(".json"):
        raw = json.loads(body) or {}
    else:
        try:
            import yaml
        except ImportError as error:
            raise RuntimeError("YAML configs need the yaml package; JSON needs none") from error
        raw = yaml.safe_load(body) or {}
    profiles = profiles_from_searches(spark, raw.get("searches") or [])
    return _settings(raw.get("settings") or {}), profiles


def expand_platforms(profiles: DataFrame) -> DataFrame:
    """One row per enabled profile and listed source, unknown codes skipped."""
    codes = F.array(*[F.lit(code) for code in PLATFORM_NAMES])
    return (profiles.filter("enabled")
            .select("*", F.posexplode("platforms").alias("platform_ord", "platform_code"))
            .filter(F.array_contains(codes, F.col("platform_code")))
            .drop("platforms"))


def match_profiles(listings: DataFrame, profiles: DataFrame) -> DataFrame:
    """Every listing beside every enabled profile that scans its source.

    An equality join on the source code. Profiles come from a config, so they are
    broadcast after a count; beyond the limit the join shuffles instead.
    """
    return listings.join(broadcast_if_small(expand_platforms(profiles)), "platform_code")


def first_scans(profiles: DataFrame) -> DataFrame:
    """For each source, the one profile that reaches it first.

    A landed row has one source, so whatever profile scans that source first is the
    only one able to claim the row: later profiles find it already seen.
    """
    return (expand_platforms(profiles)
            .groupBy("platform_code")
            .agg(F.min_by(F.struct("*"), F.struct("profile_ord", "platform_ord")).alias("p"))
            .select("p.*"))


def effective_pages(profiles: DataFrame, settings: Settings) -> DataFrame:
    """Page count of a profile, the global one standing in for a missing value."""
    return profiles.withColumn(
        "pages", F.coalesce("max_pages", F.lit(settings.max_pages_per_search)))


def company_list(documents: DataFrame, json_column: str) -> DataFrame:
    """Company-board lists ``{"greenhouse": [..], "lever": [..]}`` to ``(ats, slug)`` rows.

    Slugs are trimmed and blanks dropped; a corrupt document gives no rows.
    """
    boards = F.from_json(F.col(json_column), "greenhouse array<string>, lever array<string>")
    listed = F.create_map(F.lit("greenhouse"), boards["greenhouse"],
                          F.lit("lever"), boards["lever"])
    return (documents.select("*", F.explode(listed).alias("ats", "slugs"))
            .select("*", F.posexplode("slugs").alias("pos", "raw_slug"))
            .withColumn("slug", F.regexp_replace("raw_slug", r"(?U)^\s+|\s+$", ""))
            .filter("slug <> ''")
            .drop(json_column, "slugs", "raw_slug"))
