"""Filter rules over the given tables: each rule alone, the chain, and the gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from postsift.functions import rules
from postsift.functions.text import age_hours, as_of_literal
from postsift.operators.routing import routes
from postsift.plans import reference_sql as sql
from postsift.plans import views
from postsift.plans.registry import query
from postsift.schema import LOCATION_HINTS, Settings
from postsift.sources.profiles import match_profiles

WITH_POSTINGS = f"WITH {sql.POSTINGS} "


def as_of():
    return as_of_literal(views.SETTINGS.as_of)


def _keyword_rule(name: str, column: str, keywords: list[str], code: str, include: bool):
    hit = sql.first_hit(column, sql.word_list(keywords))
    test = f"{hit} IS NULL" if include else f"{hit} IS NOT NULL"
    arg = "NULL" if include else hit
    build = rules.not_included if include else rules.excluded

    @query(name, WITH_POSTINGS + f"""
      SELECT seq, CASE WHEN {test} THEN '{code}' ELSE 'PASS' END AS code,
        CASE WHEN {test} THEN {arg} END AS arg FROM postings""")
    def rule(spark, sf_dir):
        verdict = build(code, F.col(column), rules.words(keywords))
        return (views.postings(spark, sf_dir).select("seq", verdict.alias("v"))
                .select("seq", F.coalesce("v.code", F.lit(rules.PASS)).alias("code"),
                        F.col("v.arg").alias("arg")))
    return rule


_keyword_rule("filter_company_exclude", "company", ["ANY ES", "ny de"], "COMPANY_EXCLUDED", False)
_keyword_rule("filter_company_include", "company", ["ny EN"], "COMPANY_NOT_INCLUDED", True)
_keyword_rule("filter_title_exclude", "title", ["Hahe", "reth", "sch", "de"], "TITLE_EXCLUDED", False)
_keyword_rule("filter_title_include", "title", ["the", "DER", "la"], "TITLE_NOT_INCLUDED", True)
_keyword_rule("filter_location_exclude", "location", ["berl", "madrid"], "LOCATION_EXCLUDED", False)
_keyword_rule("filter_location_include", "location", ["remote", "Par"], "LOCATION_NOT_INCLUDED", True)
_keyword_rule("filter_description_exclude", "description", ["thonthe", "EAUQU", "für"],
              "DESCRIPTION_EXCLUDED", False)
_keyword_rule("filter_description_include", "description", ["that the", "nicht ", "eau la"],
              "DESCRIPTION_NOT_INCLUDED", True)


@query("filter_freshness", WITH_POSTINGS + f"""
SELECT seq, CASE WHEN {sql.AGE} > 400 THEN 'TOO_OLD' ELSE 'PASS' END AS code,
  CASE WHEN {sql.AGE} > 400 THEN printf('%.1f', {sql.AGE}) END AS arg FROM postings""")
def filter_freshness(spark, sf_dir):
    age = age_hours(F.col("post_date"), F.col("post_text"), as_of())
    return (views.postings(spark, sf_dir)
            .select("seq", rules.too_old(age, F.lit(400.0)).alias("v"))
            .select("seq", F.coalesce("v.code", F.lit(rules.PASS)).alias("code"),
                    F.col("v.arg").alias("arg")))


@query("rule_chain", f"""
WITH {sql.POSTINGS}, {sql.PROFILES},
judged AS (SELECT seq, search_name, {sql.CHAIN} AS verdict
  FROM postings JOIN profile_sources USING (platform_code))
SELECT seq, search_name, {sql.code_of('verdict')} = 'PASS' AS matched,
  {sql.code_of('verdict')} AS code, {sql.arg_of('verdict')} AS arg FROM judged""")
def rule_chain(spark, sf_dir):
    pairs = match_profiles(views.postings(spark, sf_dir), views.profiles(spark))
    judged = pairs.select("seq", "search_name",
                          rules.first_reason(F.col("filters"), as_of()).alias("v"))
    return judged.select("seq", "search_name", F.col("v").isNull().alias("matched"),
                         F.coalesce("v.code", F.lit(rules.PASS)).alias("code"),
                         F.col("v.arg").alias("arg"))


@query("profile_routes", f"""
WITH {sql.POSTINGS}, {sql.PROFILES},
judged AS (SELECT seq, profile_ord, {sql.CHAIN} AS verdict
  FROM postings JOIN profile_sources USING (platform_code))
SELECT DISTINCT seq, profile_ord FROM judged WHERE {sql.code_of('verdict')} = 'PASS'""")
def profile_routes(spark, sf_dir):
    """The searches that take each listing, from one automaton over all their keywords."""
    return routes(views.postings(spark, sf_dir), views.profiles(spark), as_of(), ["seq"])


@query("profile_match", f"""
WITH {sql.POSTINGS}, {sql.PROFILES}
SELECT seq, id, search_name, profile_ord, platform_ord, platform_code
FROM postings JOIN profile_sources USING (platform_code)""")
def profile_match(spark, sf_dir):
    pairs = match_profiles(views.postings(spark, sf_dir), views.profiles(spark))
    return pairs.select("seq", "id", "search_name", "profile_ord", "platform_ord",
                        "platform_code")


def _junior(name: str, settings: Settings, verdict: str):
    @query(name, WITH_POSTINGS + f"""
      SELECT seq, {sql.code_of(verdict)} = 'PASS' AS passed, {sql.code_of(verdict)} AS code,
        {sql.arg_of(verdict)} AS arg FROM postings""")
    def junior(spark, sf_dir):
        return (views.postings(spark, sf_dir)
                .select("seq", rules.junior_reason(settings).alias("v"))
                .select("seq", F.col("v").isNull().alias("passed"),
                        F.coalesce("v.code", F.lit(rules.PASS)).alias("code"),
                        F.col("v.arg").alias("arg")))
    return junior


_junior("junior_filter", views.SETTINGS, sql.JUNIOR)
_junior("junior_filter_strict",
        Settings(**{**views.SETTINGS.__dict__, "junior_filter_strict": True}), sql.JUNIOR_STRICT)


@query("filter_relevant_location", WITH_POSTINGS + f"""
SELECT seq, location FROM postings
WHERE {sql.first_hit("location || ' ' || title", sql.word_list(LOCATION_HINTS))} IS NOT NULL""")
def filter_relevant_location(spark, sf_dir):
    place = F.concat("location", F.lit(" "), "title")
    return (views.postings(spark, sf_dir).filter(rules.relevant_location(place))
            .select("seq", "location"))


@query("route_valid", """
WITH r AS (SELECT c_custkey, coalesce(['', NULL, 'https://hooks.example.com/a',
    'https://hooks.example.com/YOUR_WEBHOOK'][c_custkey % 4 + 1], '') AS own,
    ['', 'https://hooks.example.com/b'][c_nationkey % 2 + 1] AS explicit FROM customer),
t AS (SELECT c_custkey, coalesce(nullif(explicit, ''), nullif(own, '')) AS route FROM r)
SELECT c_custkey, CASE WHEN NOT contains(route, 'YOUR_WEBHOOK') THEN route END AS route,
  coalesce(NOT contains(route, 'YOUR_WEBHOOK'), false) AS valid FROM t""")
def route_valid(spark, sf_dir):
    own = views.by_number(F.col("c_custkey"), ["", None, "https://hooks.example.com/a",
                                               "https://hooks.example.com/YOUR_WEBHOOK"])
    explicit = views.by_number(F.col("c_nationkey"), ["", "https://hooks.example.com/b"])
    route = rules.route_of(explicit, own, None)
    return views.load(spark, sf_dir, "customer").select(
        "c_custkey", route.alias("route"), route.isNotNull().alias("valid"))


@query("status_valid", f"""
WITH {sql.TRACKED}, s AS (SELECT job_id, CASE WHEN o_orderkey % 5 = 0 THEN lower(status)
  WHEN o_orderkey % 7 = 0 THEN NULL ELSE status END AS status FROM tracked)
SELECT job_id, status, coalesce(status IN ('NEW', 'APPLIED', 'INTERVIEWING', 'OFFER', 'REJECTED',
  'HIDDEN', 'FILTERED', 'FILTERED_DESC', 'DUPLICATE', 'SEND_FAILED'), false) AS valid FROM s""")
def status_valid(spark, sf_dir):
    n = F.col("job_id").cast("bigint")
    status = F.when(n % 5 == 0, F.lower("status")).when(n % 7 == 0, None).otherwise(F.col("status"))
    return views.tracked(spark, sf_dir).select(
        "job_id", status.alias("status")).withColumn("valid", rules.status_known(F.col("status")))
