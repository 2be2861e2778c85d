"""Reference SQL fragments: the views of ``views.py`` written for DuckDB.

They restate the views from the same definitions, independently of the Spark
expressions, so that a query and its reference can disagree.
"""

from __future__ import annotations

SPACE = r"[\s\p{Z}\x0b\x1c-\x1f\x85]+"


def cleaned(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '{SPACE}', ' ', 'g'))"


def stripped(c: str) -> str:
    return f"regexp_replace({c}, '^{SPACE}|{SPACE}$', '', 'g')"


def normalized(c: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]+', ' ', 'g'))"


def word_list(values) -> str:
    quoted = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"[{quoted}]::VARCHAR[]"


def first_hit(haystack: str, keywords: str) -> str:
    return (f"list_filter({keywords}, lambda k: contains(lower(coalesce({haystack}, '')), "
            f"lower(k)))[1]")


def titled(c: str) -> str:
    chars = f"string_split({c}, '')"
    return (f"array_to_string(list_transform(range(1, len({chars}) + 1), lambda i: "
            f"CASE WHEN i = 1 OR NOT regexp_matches({chars}[i - 1], '\\p{{L}}') "
            f"THEN upper({chars}[i]) ELSE lower({chars}[i]) END), '')")


ISO = (r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?"
       r"(Z|[+-]\d{2}:?\d{2})?)?$")

AGE = rf"""coalesce(
  CASE WHEN regexp_matches(post_date, '{ISO}') THEN greatest(0.0, (epoch_us(TIMESTAMPTZ '2024-01-31 00:00:00+00')
    - epoch_us(CASE WHEN length(post_date) = 10 THEN CAST(post_date || ' 00:00:00+00' AS TIMESTAMPTZ)
                    WHEN regexp_matches(post_date, '(Z|[+-]\d\d:?\d\d)$') AND length(post_date) > 10
                    THEN CAST(post_date AS TIMESTAMPTZ)
                    ELSE CAST(post_date || '+00' AS TIMESTAMPTZ) END)) / 3600000000.0) END,
  TRY_CAST(nullif(regexp_extract(lower(post_text), '(\d+)\s*minute', 1), '') AS DOUBLE) / 60.0,
  TRY_CAST(nullif(regexp_extract(lower(post_text), '(\d+)\s*hour', 1), '') AS DOUBLE),
  CASE WHEN regexp_matches(lower(post_text), 'day|week|month|year') THEN 10000.0 END)"""

POSTINGS = rf"""postings_base AS (
  SELECT doc_id AS seq, lang, source, n_chars, text, {cleaned('text')} AS cleaned,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes((doc_id * 37) % 43200) AS posted,
    CASE lang WHEN 'en' THEN 'Remote' WHEN 'es' THEN 'Hybrid Madrid'
              WHEN 'fr' THEN 'Paris' ELSE 'Berlin' END AS location,
    ['linkedin', 'ejobs', 'jobicy', 'arbeitnow'][doc_id % 4 + 1] AS platform_code
  FROM documents),
postings AS (
  SELECT 'doc-' || substr(md5(text), 1, 16) AS id,
    regexp_extract(cleaned, '^(\S+( \S+){{0,4}})', 1) AS title,
    'Company ' || lang AS company, location,
    'https://jobs.example.com/view/role-' || seq || '?ref=' || source AS job_url,
    CASE WHEN seq % 3 = 0 THEN 'https://jobs.example.com/company/' || lang END AS company_url,
    CASE WHEN seq % 5 = 0 THEN 'data:image/png;base64,xx'
         WHEN seq % 5 < 3 THEN 'https://logo.example.com/' || source || '.png' END AS logo_url,
    CASE seq % 6 WHEN 0 THEN strftime(posted, '%Y-%m-%dT%H:%M:%SZ')
                 WHEN 1 THEN strftime(posted, '%Y-%m-%d')
                 WHEN 2 THEN strftime(posted, '%Y-%m-%d %H:%M:%S')
                 WHEN 4 THEN CAST(CAST(epoch(posted) AS BIGINT) AS VARCHAR)
                 WHEN 5 THEN strftime(posted, '%Y-%m-%dT%H:%M:%S') || '+02:00' END AS post_date,
    CASE WHEN seq % 6 = 3 THEN (seq % 59 + 1) ||
         [' minutes ago', ' hours ago', ' Days ago', ' ?'][(seq // 6) % 4 + 1] END AS post_text,
    CASE lang WHEN 'en' THEN 'Remote' WHEN 'es' THEN 'Hybrid' END AS workplace_type,
    ['Full-time', '', NULL][seq % 3 + 1] AS employment_type,
    ['Entry level', NULL, '', 'Director', NULL][seq % 5 + 1] AS seniority_level,
    CASE WHEN seq % 4 = 1 THEN (n_chars * 10) || ' lei' END AS salary,
    text AS description,
    CASE WHEN seq % 7 = 0 THEN (seq % 200) || ' applicants' END AS applicants,
    platform_code,
    CASE platform_code WHEN 'linkedin' THEN 'LinkedIn' WHEN 'ejobs' THEN 'eJobs.ro'
                       WHEN 'jobicy' THEN 'Jobicy' ELSE 'Arbeitnow' END AS platform,
    seq, lang, source, n_chars
  FROM postings_base)"""

DETAILS = """details AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT 'doc-' || substr(md5(text), 1, 16) AS id,
      CASE WHEN quality = 1 THEN 'Entry level' ELSE 'Director' END AS detail_seniority,
      CASE WHEN toxic = 1 THEN 'Contract' END AS detail_employment,
      text AS detail_description, (n_chars % 90) || ' applicants' AS detail_applicants,
      'https://logo.example.com/top/' || source AS detail_logo_url,
      row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS rn
    FROM documents JOIN labels USING (doc_id)) WHERE rn = 1)"""

SEEN = """seen AS (
  SELECT DISTINCT 'doc-' || substr(md5(text), 1, 16) AS job_id
  FROM documents JOIN labels USING (doc_id) WHERE quality = 1)"""

TRACKED = """tracked AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS job_id, 'Search ' || (o_custkey % 7) AS search_name,
    'Clerk for order ' || o_orderkey AS title, 'Customer ' || o_custkey AS company,
    CASE WHEN o_orderkey % 3 > 0 THEN 'Warehouse district number ' || (o_orderkey % 11) END AS location,
    'https://jobs.example.com/view/' || o_orderkey AS url, o_orderstatus AS platform,
    o_orderdate AS discovered_at,
    CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS notified_at,
    ['NEW', 'APPLIED', 'INTERVIEWING', 'FILTERED', 'DUPLICATE'][
      CAST(substr(o_orderpriority, 1, 1) AS INT)] AS status,
    o_orderkey
  FROM orders)"""

SCANS = """scans AS (
  SELECT event_id, event_type AS search_name, ts AS timestamp, k AS jobs_found,
    k // 2 AS jobs_new, k // 5 AS jobs_notified, value AS duration_seconds
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""

# One row per enabled profile, with the lists of views.SEARCHES written out.
PROFILES = """profiles AS (
  SELECT * FROM (VALUES
    (0, 'Remote', ['linkedin', 'jobicy'], [0, 1], []::VARCHAR[], ['reth', 'Hahe', 'ouon'],
     []::VARCHAR[], ['thonthe', 'ouèle'], []::VARCHAR[], ['company es'],
     []::VARCHAR[], ['berlin'], 600.0::DOUBLE),
    (1, 'Paris', ['ejobs', 'linkedin'], [0, 1], ['the', 'DE', 'la', 'un'], []::VARCHAR[],
     []::VARCHAR[], []::VARCHAR[], ['company EN', 'company fr'], []::VARCHAR[],
     ['REMOTE'], []::VARCHAR[], 650.0::DOUBLE),
    (3, 'Everything', ['linkedin', 'ejobs', 'bestjobs', 'hipo', 'stagiipebune', 'ats', 'jobicy',
      'remoteok', 'arbeitnow'], [0, 1, 2, 3, 4, 5, 6, 7, 8], []::VARCHAR[], []::VARCHAR[],
     ['and', 'der', 'la'], []::VARCHAR[], []::VARCHAR[], []::VARCHAR[],
     []::VARCHAR[], []::VARCHAR[], NULL::DOUBLE)
  ) AS t(profile_ord, search_name, codes, ords, title_in, title_out, desc_in, desc_out,
         company_in, company_out, location_in, location_out, max_age)),
profile_sources AS (
  SELECT * EXCLUDE (codes, ords), unnest(codes) AS platform_code, unnest(ords) AS platform_ord
  FROM profiles)"""


def _out(code: str, column: str, words: str, guard: str = "") -> str:
    hit = first_hit(column, words)
    return f"CASE WHEN {guard}{hit} IS NOT NULL THEN '{code}|' || {hit} END"


def _in(code: str, column: str, words: str, guard: str = "") -> str:
    return (f"CASE WHEN {guard}len({words}) > 0 AND {first_hit(column, words)} IS NULL "
            f"THEN '{code}|' END")


_TEXT = "coalesce(description, '') <> '' AND "
CHAIN = "coalesce(" + ",\n  ".join([
    _out("COMPANY_EXCLUDED", "company", "company_out"),
    _in("COMPANY_NOT_INCLUDED", "company", "company_in"),
    _out("TITLE_EXCLUDED", "title", "title_out"),
    _in("TITLE_NOT_INCLUDED", "title", "title_in"),
    _out("LOCATION_EXCLUDED", "location", "location_out"),
    _in("LOCATION_NOT_INCLUDED", "location", "location_in"),
    f"CASE WHEN ({AGE}) > max_age THEN 'TOO_OLD|' || printf('%.1f', {AGE}) END",
    _out("DESCRIPTION_EXCLUDED", "description", "desc_out", _TEXT),
    _in("DESCRIPTION_NOT_INCLUDED", "description", "desc_in", _TEXT),
    "'PASS|'",
]) + ")"

JUNIOR_TITLES = word_list(["hahe", "enst", "aulich"])
JUNIOR_TEXTS = word_list(["thonthe", "eauqu"])
JUNIOR_WANTED = word_list(["that", "sch", "eau"])
_HITS = [f"CASE WHEN {first_hit('title', JUNIOR_TITLES)} IS NOT NULL THEN "
         f"'JUNIOR_TITLE|' || {first_hit('title', JUNIOR_TITLES)} END",
         f"CASE WHEN {_TEXT}{first_hit('description', JUNIOR_TEXTS)} IS NOT NULL THEN "
         f"'JUNIOR_DESCRIPTION|' || {first_hit('description', JUNIOR_TEXTS)} END"]
_MISSING = (f"CASE WHEN coalesce({first_hit('title', JUNIOR_WANTED)}, CASE WHEN {_TEXT}true THEN "
            f"{first_hit('description', JUNIOR_WANTED)} END) IS NULL THEN 'JUNIOR_MISSING|' END")
JUNIOR = f"coalesce({', '.join(_HITS)}, 'PASS|')"
JUNIOR_STRICT = f"coalesce({', '.join([*_HITS, _MISSING])}, 'PASS|')"


def code_of(expr: str) -> str:
    return f"split_part({expr}, '|', 1)"


def arg_of(expr: str) -> str:
    return f"nullif(substr({expr}, instr({expr}, '|') + 1), '')"
