"""Detail bodies, searches, rejects and scans by interval over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from postsift.operators import reports
from postsift.plans import reference_sql as sql
from postsift.plans import scan as scans
from postsift.plans import views
from postsift.plans.registry import query
from postsift.sources import rejects
from postsift.sources.boards import extract_details

_STAMP = "yyyy-MM-dd HH:mm:ss"


@query("scan_by_interval", f"""WITH {sql.SCANS}
SELECT strftime(time_bucket(INTERVAL 6 HOUR, timestamp), '%Y-%m-%d %H:%M:%S') AS window_start, search_name,
  count(*) AS scans, CAST(coalesce(sum(jobs_found), 0) AS BIGINT) AS jobs_found,
  CAST(coalesce(sum(jobs_new), 0) AS BIGINT) AS jobs_new,
  CAST(coalesce(sum(jobs_notified), 0) AS BIGINT) AS jobs_notified
FROM scans GROUP BY 1, 2""")
def scan_by_interval(spark, sf_dir):
    found = reports.scans_by_interval(views.scan_log(spark, sf_dir), "6 hours")
    return found.select(F.date_format("window_start", _STAMP).alias("window_start"), "search_name", "scans",
                        "jobs_found", "jobs_new", "jobs_notified")


def _markup(text):
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def detail_bodies(spark, sf_dir):
    """Documents as detail pages; a fifth of them names no seniority and repeats the employment."""
    n = F.col("doc_id")

    def item(name, value):
        return F.concat(F.lit('<li class="description__job-criteria-item"><h3 class="x description__job-criteria-subheader">'
                              f' {name}\n</h3><span class="description__job-criteria-text">'), value, F.lit(" </span></li>"))

    employment = item("Employment type", F.col("source"))
    criteria = F.when(n % 5 > 0, F.concat(item("Seniority level", F.col("lang")), employment)).otherwise(
        F.concat(item("Employment type", F.lit("Contract")), employment))
    logo = F.when(n % 3 == 0, F.concat(F.lit('<img class="artdeco-entity-image" src="https://logo.example.com/'), "lang", F.lit('">'))
                  ).when(n % 3 == 1, F.concat(F.lit('<img class="artdeco-entity-image" data-delayed-url="https://late.example.com/'),
                                              "source", F.lit('" src="x">'))).otherwise(F.lit(""))
    return views.load(spark, sf_dir, "documents").select(
        n.alias("id"), F.concat(
            F.lit("<ul>"), criteria, F.lit('</ul><div class="show-more-less-html__markup"><p>'),
            _markup(F.coalesce("text", F.lit(""))), F.lit('</p><p>End <b>of</b></p></div><span class="num-applicants__caption"> '),
            F.col("n_chars").cast("string"), F.lit("\napplicants</span>"), logo).alias("body"))


@query("detail_extract", f"""
SELECT doc_id AS id, CASE WHEN doc_id % 5 > 0 THEN lang END AS seniority, source AS employment,
  CASE WHEN {sql.stripped("coalesce(text, '')")} = '' THEN '' ELSE {sql.stripped("coalesce(text, '')")} || chr(10) END
    || 'End' || chr(10) || 'of' AS description,
  n_chars || ' applicants' AS applicants,
  CASE doc_id % 3 WHEN 0 THEN 'https://logo.example.com/' || lang WHEN 1 THEN 'https://late.example.com/' || source END AS logo
FROM documents""")
def detail_extract(spark, sf_dir):
    found = extract_details(detail_bodies(spark, sf_dir))
    named = lambda name: F.try_element_at("detail_criteria", F.lit(name))
    return found.select(
        "id", named("Seniority level").alias("seniority"), named("Employment type").alias("employment"),
        F.col("detail_description").alias("description"), F.col("detail_applicants").alias("applicants"),
        F.col("detail_logo_url").alias("logo"))


_NAMES = ["Remote", "Paris", "Everything", None, "Gone", "Closed"]
_NAMED = f"""named AS (
  SELECT seq, id, platform_code, ['Remote', 'Paris', 'Everything', NULL, 'Gone', 'Closed'][(seq // 4) % 6 + 1] AS named
  FROM postings)"""


def _named(spark, sf_dir):
    """Listings of which most name the search that fetched them."""
    number = F.floor(F.col("seq") / 4).cast("bigint")
    return views.postings(spark, sf_dir).withColumn("matched_search_name", views.by_number(number, _NAMES))


@query("search_owner", f"""WITH {sql.POSTINGS}, {sql.PROFILES}, {_NAMED},
firsts AS (SELECT platform_code, min(profile_ord) AS profile_ord FROM profile_sources GROUP BY platform_code),
owned AS (
  SELECT n.seq, n.id, p.profile_ord, p.search_name FROM named n
  JOIN profile_sources p ON p.search_name = n.named AND p.platform_code = n.platform_code
  UNION ALL
  SELECT n.seq, n.id, p.profile_ord, p.search_name FROM named n JOIN firsts f USING (platform_code)
  JOIN profile_sources p ON p.platform_code = f.platform_code AND p.profile_ord = f.profile_ord WHERE n.named IS NULL)
SELECT seq, id, profile_ord, search_name FROM owned""")
def search_owner(spark, sf_dir):
    rows, _ = scans.scanned_rows(_named(spark, sf_dir), views.profiles(spark))
    return rows.select("seq", "id", "profile_ord", "search_name")


@query("lost_search", f"""WITH {sql.POSTINGS}, {sql.PROFILES}, {_NAMED}
SELECT platform_code, named AS search_name, count(*) AS listings FROM named n
WHERE named IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM profile_sources p WHERE p.search_name = n.named AND p.platform_code = n.platform_code)
GROUP BY ALL""")
def lost_search(spark, sf_dir):
    lost = rejects.lost_searches(_named(spark, sf_dir), views.profiles(spark))
    return lost.groupBy("platform_code", "search_name").agg(F.count("*").alias("listings"))


@query("reject_reasons", """
WITH landed AS (
  SELECT doc_id, ['ats', 'jobicy', 'linkedin', 'elsewhere'][doc_id % 4 + 1] AS platform_code,
    doc_id // 4 % 5 AS form, text FROM documents),
judged AS (
  SELECT *, CASE WHEN form = 0 THEN 'EMPTY_BODY' WHEN platform_code = 'elsewhere' THEN 'UNKNOWN_SOURCE'
    WHEN platform_code <> 'linkedin' AND form IN (1, 2) THEN 'BAD_JSON' END AS reason FROM landed)
SELECT platform_code, reason, count(*) AS rejects FROM judged WHERE reason IS NOT NULL GROUP BY ALL""")
def reject_reasons(spark, sf_dir):
    """Documents as landed responses: blank, cut off, or whole JSON."""
    whole = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("text")))
    form = F.floor(F.col("doc_id") / 4).cast("bigint") % 5
    body = F.when(form == 0, F.lit(" \n")).when(form.isin(1, 2), F.substr(whole, F.lit(1), F.length(whole) - form)).otherwise(whole)
    landed = views.load(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("payload_seq"),
        views.by_number(F.col("doc_id"), ["ats", "jobicy", "linkedin", "elsewhere"]).alias("platform_code"),
        F.lit(None).cast("string").alias("search_name"), body.alias("body"))
    return rejects.reject_counts(rejects.payload_rejects(landed))
