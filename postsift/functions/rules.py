"""The ordered rule chain and the global junior filter, as Column expressions.

Every rule yields a reason struct ``(code, arg)`` when it rejects and null when it
passes, so the first failing rule is simply the first non-null one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postsift.functions.text import age_hours, bind, filled, first_keyword, text
from postsift.schema import (
    ALL_STATUSES,
    JUNIOR_DESCRIPTION_EXCLUDE,
    JUNIOR_INCLUDE,
    JUNIOR_TITLE_EXCLUDE,
    LOCATION_HINTS,
    ROUTE_PLACEHOLDER,
    Settings,
)

PASS = "PASS"
REASON_CODES = [
    "COMPANY_EXCLUDED", "COMPANY_NOT_INCLUDED", "TITLE_EXCLUDED", "TITLE_NOT_INCLUDED",
    "LOCATION_EXCLUDED", "LOCATION_NOT_INCLUDED", "TOO_OLD",
    "DESCRIPTION_EXCLUDED", "DESCRIPTION_NOT_INCLUDED",
]


def words(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def reason(code: str, arg: Column) -> Column:
    return F.struct(F.lit(code).alias("code"), arg.cast("string").alias("arg"))


def excluded(code: str, haystack: Column, keywords: Column) -> Column:
    """Reject when any keyword occurs, naming the first one."""
    return bind(first_keyword(haystack, keywords),
                lambda hit: F.when(hit.isNotNull(), reason(code, hit)))


def not_included(code: str, haystack: Column, keywords: Column) -> Column:
    """Reject when the list has entries and none occurs."""
    active = F.size(F.coalesce(keywords, words([]))) > 0
    return F.when(active & first_keyword(haystack, keywords).isNull(),
                  reason(code, F.lit(None)))


def too_old(age: Column, limit: Column) -> Column:
    """An unknown age and a missing limit both pass."""
    return F.when(age > limit, reason("TOO_OLD", F.call_function("format_number", age, F.lit("0.0"))))


def rule_reasons(filters: Column, as_of: Column) -> list[Column]:
    """The nine rules in evaluation order over the listing columns."""
    title, company, location = F.col("title"), F.col("company"), F.col("location")
    description = F.col("description")
    has_text = filled(description).isNotNull()
    age = age_hours(F.col("post_date"), F.col("post_text"), as_of)
    return [
        excluded("COMPANY_EXCLUDED", company, filters["companies_exclude"]),
        not_included("COMPANY_NOT_INCLUDED", company, filters["companies_include"]),
        excluded("TITLE_EXCLUDED", title, filters["title_must_exclude"]),
        not_included("TITLE_NOT_INCLUDED", title, filters["title_must_include"]),
        excluded("LOCATION_EXCLUDED", location, filters["location_must_exclude"]),
        not_included("LOCATION_NOT_INCLUDED", location, filters["location_must_include"]),
        too_old(age, filters["max_age_hours"]),
        F.when(has_text, excluded(
            "DESCRIPTION_EXCLUDED", description, filters["description_must_exclude"])),
        F.when(has_text, not_included(
            "DESCRIPTION_NOT_INCLUDED", description, filters["description_must_include"])),
    ]


def first_reason(filters: Column, as_of: Column) -> Column:
    """First failing rule as ``(code, arg)``; null when every rule passes.

    ``coalesce`` stops at the first rejection, so the cheap rules on short
    columns run before the ones that read the description.
    """
    return F.coalesce(*rule_reasons(filters, as_of))


def reason_text(code: Column, arg: Column) -> Column:
    """Readable form of a reason, listing columns in scope."""
    return (
        F.when(code == "COMPANY_EXCLUDED",
               F.format_string("Company '%s' is in blacklist (%s)", F.col("company"), arg))
        .when(code == "COMPANY_NOT_INCLUDED",
              F.format_string("Company '%s' not in whitelist", F.col("company")))
        .when(code == "TITLE_EXCLUDED",
              F.format_string("Title contains excluded keyword: '%s'", arg))
        .when(code == "TITLE_NOT_INCLUDED", F.lit("Title does not match any required keywords"))
        .when(code == "LOCATION_EXCLUDED",
              F.format_string("Location '%s' contains excluded location: '%s'",
                              F.col("location"), arg))
        .when(code == "LOCATION_NOT_INCLUDED",
              F.format_string("Location '%s' does not match required locations",
                              F.col("location")))
        .when(code == "TOO_OLD", F.format_string("Job was posted %sh ago", arg))
        .when(code == "DESCRIPTION_EXCLUDED",
              F.format_string("Description contains excluded term: '%s'", arg))
        .when(code == "DESCRIPTION_NOT_INCLUDED",
              F.lit("Description does not contain required terms"))
        .otherwise(F.lit("Passed all filters")))


def junior_reason(settings: Settings) -> Column:
    """Reason of the global seniority filter; null when the listing passes.

    An empty override list falls back to the built-in one.
    """
    if not settings.junior_filter_enabled:
        return F.lit(None).cast("struct<code:string,arg:string>")
    title, description = F.col("title"), F.col("description")
    has_text = filled(description).isNotNull()
    title_words = words(settings.junior_title_exclude_keywords or JUNIOR_TITLE_EXCLUDE)
    text_words = words(settings.junior_description_exclude_keywords
                       or JUNIOR_DESCRIPTION_EXCLUDE)
    steps = [
        excluded("JUNIOR_TITLE", title, title_words),
        F.when(has_text, excluded("JUNIOR_DESCRIPTION", description, text_words)),
    ]
    if settings.junior_filter_strict:
        wanted = words(settings.junior_include_keywords or JUNIOR_INCLUDE)
        hit = F.coalesce(first_keyword(title, wanted),
                         F.when(has_text, first_keyword(description, wanted)))
        steps.append(F.when(hit.isNull(), reason("JUNIOR_MISSING", F.lit(None))))
    return F.coalesce(*steps)


def relevant_location(location: Column) -> Column:
    return first_keyword(location, words(LOCATION_HINTS)).isNotNull()


def route_of(explicit: Column, profile_route: Column, default: str | None) -> Column:
    """Explicit route, else the profile's, else the default; null when invalid."""
    route = F.coalesce(filled(explicit), filled(profile_route),
                       filled(F.lit(default).cast("string")))
    return F.when(~F.contains(route, F.lit(ROUTE_PLACEHOLDER)), route)


def status_known(status: Column) -> Column:
    return text(status).isin(ALL_STATUSES)


def require_status(status: str) -> str:
    if status not in ALL_STATUSES:
        raise ValueError(f"Invalid status '{status}'. Must be one of: {', '.join(ALL_STATUSES)}")
    return status
