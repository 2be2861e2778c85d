"""State changes, reports and alerts over the given tables."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone
from decimal import Decimal

from pyspark.sql import functions as F

from postsift.operators import alerts, reports
from postsift.operators import state as st
from postsift.plans import reference_sql as sql
from postsift.plans import views
from postsift.plans.registry import query
from postsift.plans.scan import scanned_rows
from postsift.session import shared_folder
from postsift.sources.profiles import profiles_from_json
from postsift.functions.text import snippet

LATER = datetime(2024, 1, 31, tzinfo=timezone.utc)
WINDOW_END = datetime(1998, 8, 2, tzinfo=timezone.utc)
_STAMP = "yyyy-MM-dd HH:mm:ss"


@query("state_totals", f"""WITH {sql.TRACKED}, {sql.SCANS}
SELECT (SELECT count(*) FROM tracked) AS total_seen,
  (SELECT count(notified_at) FROM tracked) AS total_notified,
  (SELECT count(*) FROM scans) AS total_scans,
  (SELECT coalesce(strftime(max(timestamp), '%Y-%m-%d %H:%M:%S'), 'Never') FROM scans) AS last_scan""")
def state_totals(spark, sf_dir):
    return reports.state_totals(views.tracked(spark, sf_dir), views.scan_log(spark, sf_dir))


@query("status_breakdown", f"""WITH {sql.TRACKED}
SELECT status, count(*) AS listings FROM tracked GROUP BY status""")
def status_breakdown(spark, sf_dir):
    return reports.status_breakdown(views.tracked(spark, sf_dir))


@query("recent_notified", f"""WITH {sql.TRACKED}
SELECT job_id, substr(title, 1, 35) AS title, substr(company, 1, 25) AS company,
  substr(coalesce(location, '—'), 1, 25) AS location, substr(search_name, 1, 20) AS search_name,
  strftime(notified_at, '%Y-%m-%d %H:%M:%S') AS notified_at
FROM tracked WHERE notified_at IS NOT NULL ORDER BY discovered_at DESC, job_id LIMIT 5""")
def recent_notified(spark, sf_dir):
    return reports.recent_notified(views.tracked(spark, sf_dir))


@query("report_listings", f"""WITH {sql.TRACKED}
SELECT job_id, status, substr(title, 1, 45) AS title, substr(company, 1, 25) AS company,
  substr(coalesce(location, '—'), 1, 22) AS location, platform,
  strftime(discovered_at, '%Y-%m-%d') AS discovered, url
FROM tracked WHERE status IN ('NEW', 'APPLIED', 'INTERVIEWING', 'OFFER', 'REJECTED', 'HIDDEN')
  AND platform = 'O' ORDER BY discovered_at DESC, job_id LIMIT 50""")
def report_listings(spark, sf_dir):
    found = reports.find_listings(views.tracked(spark, sf_dir), platform="O", limit=50)
    return reports.listing_report(found)


@query("report_profiles", """
WITH p AS (SELECT c_custkey, lower(c_mktsegment) AS seg,
    [lower(c_mktsegment), 'senior', 'lead', 'vp', 'head'][1:CAST(c_custkey % 6 AS INT)] AS words,
    coalesce(CASE WHEN c_custkey % 3 > 0 THEN c_acctbal > 0 END, true) AS enabled, * FROM customer)
SELECT c_custkey AS profile_ord,
  CASE WHEN c_custkey % 4 > 0 THEN c_name ELSE 'Search #' || (c_custkey + 1) END AS name,
  seg || ' OR "qa ' || seg || '"' AS keywords,
  CASE WHEN c_custkey % 2 > 0 THEN 'City ' || c_nationkey ELSE 'Remote' END AS location,
  ['past_30min', 'week', 'past_24h', 'any'][c_custkey % 4 + 1] AS date_posted,
  CASE WHEN enabled THEN 'ENABLED' ELSE 'DISABLED' END AS status,
  coalesce(nullif(array_to_string(words[1:3], ', '), ''), '-') ||
    CASE WHEN len(words) > 3 THEN ' (+' || (len(words) - 3) || ')' ELSE '' END AS exclude_keywords
FROM p""")
def report_profiles(spark, sf_dir):
    found = profiles_from_json(views.config_documents(spark, sf_dir), "c_custkey", "body")
    return reports.profile_report(found)


_UPSERT = f"""WITH {sql.TRACKED},
again AS (SELECT CASE WHEN status = 'APPLIED' THEN 'n' || job_id ELSE job_id END AS job_id,
    'Again' AS search_name, CASE WHEN status = 'NEW' THEN 'NEW' ELSE 'FILTERED' END AS status,
    TIMESTAMP '2024-01-31 00:00:00' AS discovered_at,
    CASE WHEN status = 'NEW' THEN TIMESTAMP '2024-01-31 00:00:00' END AS notified_at
  FROM tracked WHERE platform = 'F')
"""

_SHOWN = """job_id, search_name, status, strftime(discovered_at, '%Y-%m-%d %H:%M:%S') AS discovered_at,
  strftime(notified_at, '%Y-%m-%d %H:%M:%S') AS notified_at"""


def _shown(df):
    return df.select("job_id", "search_name", "status",
                     F.date_format("discovered_at", _STAMP).alias("discovered_at"),
                     F.date_format("notified_at", _STAMP).alias("notified_at"))


def _tracked_again(spark, sf_dir):
    """The state, and versions of one platform's listings that come again; those applied for
    come under a new id."""
    tracked = views.tracked(spark, sf_dir)
    applied = F.col("status") == "APPLIED"
    outcomes = tracked.filter("platform = 'F'").select(
        F.when(applied, F.concat(F.lit("n"), "job_id")).otherwise(F.col("job_id")).alias("id"),
        F.lit("Again").alias("search_name"), "title", "company", "location",
        F.col("url").alias("job_url"), "platform",
        F.when(F.col("status") == "NEW", "NEW").otherwise("FILTERED").alias("status"))
    return st.as_versions(tracked, F.col("discovered_at")), st.seen_versions(outcomes, LATER)


@query("state_upsert", f"""{_UPSERT}
SELECT {_SHOWN} FROM (SELECT * FROM again UNION ALL
  SELECT job_id, search_name, status, discovered_at, notified_at FROM tracked
  WHERE job_id NOT IN (SELECT job_id FROM again))""")
def state_upsert(spark, sf_dir):
    """Listings of one platform come again; those applied for come under a new id."""
    tracked, again = _tracked_again(spark, sf_dir)
    log = tracked.unionByName(again)
    return _shown(st.current_state(log))


def _folded_state(spark, sf_dir):
    """The same in three batches of which two are in runs and one is not."""
    tracked, again = _tracked_again(spark, sf_dir)
    tables = st.StateTables(spark, f"{shared_folder(spark).rstrip('/')}/state-{uuid.uuid4().hex}")
    # The later half of the rows of a platform that comes again stays loose.
    half = F.pmod(F.xxhash64("job_id"), F.lit(2)) == 0
    for at, rows in enumerate([tracked, again.where(half), again.where(~half)]):
        tables.fold(at)
        tables.append_state(rows, at)
    return tables


@query("state_runs", f"""{_UPSERT}
SELECT {_SHOWN} FROM (SELECT * FROM again UNION ALL
  SELECT job_id, search_name, status, discovered_at, notified_at FROM tracked
  WHERE job_id NOT IN (SELECT job_id FROM again))""")
def state_runs(spark, sf_dir):
    """The state read from runs and loose batches is that of the whole log."""
    return _shown(_folded_state(spark, sf_dir).state())


@query("known_in_runs", f"""{_UPSERT}
SELECT job_id FROM again UNION SELECT job_id FROM tracked WHERE status = 'NEW'""")
def known_in_runs(spark, sf_dir):
    """Which listings of a batch the state holds, asked of runs and loose batches."""
    tracked, again = _tracked_again(spark, sf_dir)
    new = F.col("status") == "NEW"
    landed = again.select("job_id").union(tracked.where(new).select("job_id")).union(
        tracked.where(new).select(F.concat(F.lit("unknown "), "job_id")))
    return _folded_state(spark, sf_dir).known(landed.withColumnRenamed("job_id", "id"))


@query("status_update", f"""WITH {sql.TRACKED},
u AS (SELECT CASE WHEN platform = 'P' THEN 'x' || job_id ELSE job_id END AS job_id,
  ['APPLIED', 'HIDDEN', 'applied', 'OFFER'][o_orderkey % 4 + 1] AS new_status FROM tracked)
SELECT u.job_id, CASE WHEN new_status = 'applied' THEN 'INVALID'
    WHEN t.job_id IS NULL THEN 'NOT_FOUND' ELSE 'UPDATED' END AS result,
  CASE WHEN new_status = 'applied' OR t.job_id IS NULL THEN t.status ELSE new_status END AS status
FROM u LEFT JOIN tracked t ON u.job_id = t.job_id""")
def status_update(spark, sf_dir):
    """One update per order; those of one platform name ids that do not exist."""
    tracked = views.tracked(spark, sf_dir)
    missing = F.col("platform") == "P"
    updates = tracked.select(
        F.when(missing, F.concat(F.lit("x"), "job_id")).otherwise(F.col("job_id")).alias("job_id"),
        views.by_number(F.col("job_id").cast("bigint"), ["APPLIED", "HIDDEN", "applied", "OFFER"])
        .alias("new_status"))
    return st.status_updates(tracked, updates).select("job_id", "result", "status")


@query("status_migrate", f"""WITH {sql.TRACKED}
SELECT job_id, CASE WHEN o_orderkey % 2 = 0 THEN 'NEW' ELSE status END AS status,
  CAST(NULL AS VARCHAR) AS platform, title FROM tracked""")
def status_migrate(spark, sf_dir):
    odd = F.col("job_id").cast("bigint") % 2 == 0
    legacy = views.tracked(spark, sf_dir).drop("platform").withColumn(
        "status", F.when(odd, "NOTIFIED").otherwise(F.col("status")))
    return st.migrate(legacy).select("job_id", "status", "platform", "title")


@query("purge_old", f"""WITH {sql.TRACKED}
SELECT {_SHOWN} FROM tracked WHERE discovered_at >= TIMESTAMP '1998-08-02' - INTERVAL 60 DAY""")
def purge_old(spark, sf_dir):
    tracked = views.tracked(spark, sf_dir)
    log = st.as_versions(tracked, F.col("discovered_at"))
    log = log.unionByName(st.purge_versions(tracked, WINDOW_END, op_seq=1))
    return _shown(st.current_state(log))


@query("scan_append", f"""WITH {sql.SCANS},
fresh AS (SELECT search_name, TIMESTAMP '2024-01-31 00:00:00' AS timestamp,
  CAST(sum(jobs_found) AS BIGINT) AS jobs_found, CAST(sum(jobs_new) AS BIGINT) AS jobs_new,
  CAST(sum(jobs_notified) AS BIGINT) AS jobs_notified FROM scans GROUP BY search_name)
SELECT search_name, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS scanned_at, jobs_found, jobs_new,
  jobs_notified FROM (SELECT search_name, timestamp, jobs_found, jobs_new, jobs_notified FROM scans
  UNION ALL SELECT * FROM fresh)""")
def scan_append(spark, sf_dir):
    log = views.scan_log(spark, sf_dir).drop("event_id")
    fresh = log.groupBy("search_name").agg(
        F.lit(LATER).alias("timestamp"),
        *[F.sum(c).alias(c) for c in ("jobs_found", "jobs_new", "jobs_notified",
                                      "duration_seconds")])
    return log.unionByName(fresh).select(
        "search_name", F.date_format("timestamp", _STAMP).alias("scanned_at"),
        "jobs_found", "jobs_new", "jobs_notified")


_BESIDE = f"""WITH {sql.POSTINGS},
first_profile AS (SELECT * FROM (VALUES
  ('linkedin', 'Remote', 3634859, 'https://hooks.example.com/remote', '42'),
  ('jobicy', 'Remote', 3634859, 'https://hooks.example.com/remote', '42'),
  ('ejobs', 'Paris', 681666, 'https://hooks.example.com/default', NULL),
  ('arbeitnow', 'Everything', 681666, NULL, NULL)) AS t(platform_code, search_name, color, route, role)),
beside AS (SELECT *, {sql.cleaned('description')} AS cleaned,
  CASE platform_code WHEN 'linkedin' THEN 'https://cdn-icons-png.flaticon.com/512/3536/3536505.png'
    WHEN 'ejobs' THEN 'https://static.ejobs.ro/img/logos/ejobs-share.png'
    WHEN 'jobicy' THEN 'https://jobicy.com/assets/images/logo.png'
    ELSE 'https://www.arbeitnow.com/favicon-32x32.png' END AS icon
  FROM postings JOIN first_profile USING (platform_code))"""


def _beside(spark, sf_dir):
    rows, _ = scanned_rows(views.postings(spark, sf_dir), views.profiles(spark))
    return rows.withColumn("snippet", snippet(F.col("description")))


@query("alert_payload", _BESIDE + """
SELECT seq, '📢 ' || title AS title, job_url AS url,
  CASE WHEN coalesce(description, '') = '' THEN '' ELSE '> ' || CASE WHEN length(cleaned) > 300
    THEN substr(cleaned, 1, 297) || '...' ELSE cleaned END || chr(10) || chr(10) END
    || '🔗 **[Click here to view & apply on ' || platform || '](' || job_url || ')**' AS description,
  CAST(color AS BIGINT) AS color, company AS author_name, coalesce(company_url, job_url) AS author_url,
  CASE WHEN starts_with(logo_url, 'http') THEN logo_url END AS author_icon,
  '📍 Location=' || CASE workplace_type WHEN 'Remote' THEN '🌐 ' || location || ' (Remote)'
      WHEN 'Hybrid' THEN '🏢 ' || location || ' (Hybrid)' ELSE location END
    || coalesce('|💼 Role Details=' || nullif(concat_ws(' • ', nullif(employment_type, ''),
        nullif(seniority_level, '')), ''), '')
    || '|⏰ Posted=*' || coalesce(nullif(post_text, ''), nullif(post_date, ''), 'Recently') || '*'
    || coalesce('|💰 Salary=**' || salary || '**', '') || coalesce('|👥 Applicants=' || applicants, '')
    || '|🏢 Source=**' || platform || '**|🏷️ Matched Filter=`' || search_name || '`' AS fields,
  platform || ' • ' || search_name AS footer,
  CASE WHEN starts_with(logo_url, 'http') THEN logo_url END AS thumbnail
FROM beside""")
def alert_payload(spark, sf_dir):
    rows = _beside(spark, sf_dir).select("seq", alerts.alert_payload(LATER).alias("a"))
    fields = F.array_join(F.transform("a.fields", lambda f: F.concat(
        f["name"], F.lit("="), f["value"])), "|")
    return rows.select(
        "seq", "a.title", "a.url", "a.description", "a.color",
        F.col("a.author.name").alias("author_name"), F.col("a.author.url").alias("author_url"),
        F.col("a.author.icon_url").alias("author_icon"), fields.alias("fields"),
        F.col("a.footer.text").alias("footer"), F.col("a.thumbnail.url").alias("thumbnail"))


@query("alert_route", _BESIDE + """
SELECT id, seq, route, route IS NOT NULL AS valid, platform || ' Alert Bot' AS username,
  icon AS avatar_url,
  '<@&' || role || '> 🔔 **New Job Alert:** [' || title || '](' || job_url || ')' AS content
FROM beside""")
def alert_route(spark, sf_dir):
    rows = _beside(spark, sf_dir)
    envelopes = alerts.alert_envelopes(rows, views.SETTINGS)
    # The packed arrival ends in the landed position.
    seq = F.pmod("arrival", F.lit(Decimal(10**19))).cast("bigint")
    return envelopes.select("id", seq.alias("seq"), "route",
                            F.col("route").isNotNull().alias("valid"), "username", "avatar_url",
                            "content")
