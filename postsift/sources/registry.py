"""Source registry: a code names a transform from landed payloads to listings."""

from __future__ import annotations

import logging
from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsift.functions import text as tx
from postsift.schema import (
    CARDS_PER_PAGE,
    EXPERIENCE_CODES,
    JOB_TYPE_CODES,
    LISTING,
    PLATFORM_ICONS,
    PLATFORM_NAMES,
    RECENT_SORTS,
    WORKPLACE_CODES,
)

Source = Callable[[DataFrame, DataFrame], DataFrame]
SOURCES: dict[str, Source] = {}
log = logging.getLogger("postsift")


def register_source(code: str, transform: Source) -> None:
    """Add or replace the extractor of a source code."""
    SOURCES[code] = transform


def as_listing(df: DataFrame, code: str, **columns: Column | str) -> DataFrame:
    """Project to LISTING: given columns, source defaults, nulls for the rest."""
    given = {"platform": F.lit(PLATFORM_NAMES[code]), "platform_icon": F.lit(PLATFORM_ICONS[code]),
             "platform_code": F.lit(code), **columns}
    return df.select(*[
        (given[f.name] if isinstance(given.get(f.name), Column)
         else F.col(given[f.name]) if f.name in given
         else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in LISTING.fields])


def union_sources(landed: dict[str, DataFrame], profiles: DataFrame) -> DataFrame:
    """Extract every landed source and concatenate; unknown codes are skipped.

    A source whose payloads do not have the columns it needs contributes nothing and
    does not stop the others.
    """
    parts = [landed_nothing(profiles)]
    for code, payloads in landed.items():
        if code in SOURCES:
            try:
                parts.append(SOURCES[code](payloads, profiles))
            except AnalysisException as error:
                log.warning("source %s skipped: %s", code, error)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def landed_nothing(profiles: DataFrame) -> DataFrame:
    return profiles.sparkSession.createDataFrame([], LISTING)


def search_urls(profiles: DataFrame, page: int = 0) -> DataFrame:
    """Query texts of every profile, one column per searchable source."""
    keywords, location = F.col("keywords"), F.col("profile_location")
    bare = tx.strip(F.replace(keywords, F.lit('"'), F.lit("")))
    roles = F.coalesce(tx.filled(bare), F.lit('"qa tester" OR "helpdesk" OR "it support"'))
    site_query = F.concat(
        F.lit('(site:*.ro/careers OR site:*.ro/jobs OR site:*.ro/cariera) "Bucuresti" '
              '("junior" OR "internship" OR "entry level") ('), roles, F.lit(")"))

    def parameter(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"&{name}="), tx.form_encode(value)), F.lit(""))

    linkedin = F.concat(
        F.lit("https://www.linkedin.com/jobs-guest/jobs/api/seeMoreJobPostings/search?keywords="),
        tx.form_encode(keywords),
        parameter("location", location),
        F.lit(f"&start={page * CARDS_PER_PAGE}"),
        parameter("f_TPR", tx.date_window_code(F.col("date_posted"))),
        parameter("sortBy", F.when(F.col("sort_by").isin(RECENT_SORTS), F.lit("DD"))),
        parameter("f_WT", tx.code_lookup(F.col("workplace_types"), WORKPLACE_CODES)),
        parameter("f_E", tx.code_lookup(F.col("experience_levels"), EXPERIENCE_CODES)),
        parameter("f_JT", tx.code_lookup(F.col("job_types"), JOB_TYPE_CODES)))
    in_city = tx.names_bucharest(location)
    ejobs = F.concat(F.lit("https://www.ejobs.ro/locuri-de-munca/"),
                     F.when(in_city, F.lit("bucuresti/")).otherwise(F.lit("")),
                     tx.path_encode(tx.first_term(keywords)), F.lit("/"))
    bestjobs = F.concat(F.lit("https://www.bestjobs.eu/ro/locuri-de-munca?keyword="),
                        tx.form_encode(tx.first_term(keywords, lower=True)),
                        F.when(in_city, F.lit("&location=bucuresti")).otherwise(F.lit("")))
    return profiles.withColumns({"site_query": site_query, "linkedin_url": linkedin,
                                 "ejobs_url": ejobs, "bestjobs_url": bestjobs})
