"""Scalar functions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from postsift.functions import text as tx
from postsift.plans import reference_sql as sql
from postsift.plans import views
from postsift.plans.registry import query
from postsift.schema import EXPERIENCE_CODES, JOB_TYPE_CODES, WORKPLACE_CODES
from postsift.sources.profiles import profiles_from_json
from postsift.sources.registry import search_urls

WITH_POSTINGS = f"WITH {sql.POSTINGS} "


@query("clean_text", f"SELECT doc_id, {sql.cleaned('text')} AS cleaned FROM documents")
def clean_text(spark, sf_dir):
    docs = views.load(spark, sf_dir, "documents")
    return docs.select("doc_id", tx.clean_text(F.col("text")).alias("cleaned"))


@query("normalize_text", f"SELECT doc_id, {sql.normalized('text')} AS normalized FROM documents")
def normalize_text(spark, sf_dir):
    docs = views.load(spark, sf_dir, "documents")
    return docs.select("doc_id", tx.normalize_text(F.col("text")).alias("normalized"))


@query("hex_color", """
WITH hexed AS (SELECT p_partkey, CASE p_size % 4
    WHEN 0 THEN '##' || upper(substr(md5(p_name || p_partkey), 1, 6))
    WHEN 1 THEN substr(md5(p_name || p_partkey), 1, 6)
    WHEN 2 THEN p_name END AS hex FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(hex, '^#*[0-9A-Fa-f]+$')
  THEN CAST('0x' || ltrim(hex, '#') AS BIGINT) ELSE 681666 END AS color FROM hexed""")
def hex_color(spark, sf_dir):
    digits = F.substring(F.md5(F.concat("p_name", "p_partkey")), 1, 6)
    form = F.col("p_size") % 4
    color = (F.when(form == 0, F.concat(F.lit("##"), F.upper(digits))).when(form == 1, digits)
             .when(form == 2, F.col("p_name")))
    return views.load(spark, sf_dir, "part").select("p_partkey", tx.hex_color(color).alias("color"))


@query("age_hours", WITH_POSTINGS + f"SELECT seq, round({sql.AGE}, 6) AS age FROM postings")
def age_hours(spark, sf_dir):
    age = tx.age_hours(F.col("post_date"), F.col("post_text"),
                       tx.as_of_literal(views.SETTINGS.as_of))
    return views.postings(spark, sf_dir).select("seq", F.round(age, 6).alias("age"))


_SLUG = "replace(lower(c_name), '#', '_') || '-o''neil 2nd-' || lower(c_mktsegment)"


@query("slug_company", f"""
SELECT c_custkey, {sql.titled("translate(" + _SLUG + ", '-_', '  ')")} AS company,
  {sql.titled("replace(lower(c_mktsegment) || '-' || c_custkey, '-', ' ')")} AS path_company
FROM customer""")
def slug_company(spark, sf_dir):
    segment = F.lower("c_mktsegment")
    slug = F.concat(F.replace(F.lower("c_name"), F.lit("#"), F.lit("_")),
                    F.lit("-o'neil 2nd-"), segment)
    href = F.concat(F.lit("/jobs/"), segment, F.lit("-"), "c_custkey", F.lit("/role-1"))
    return views.load(spark, sf_dir, "customer").select(
        "c_custkey", tx.slug_company(slug).alias("company"),
        tx.path_company(href).alias("path_company"))


@query("workplace_type", WITH_POSTINGS + """SELECT seq, CASE
  WHEN contains(lower(location || title), 'remote') THEN 'Remote'
  WHEN contains(lower(location || title), 'hybrid') THEN 'Hybrid' END AS workplace FROM postings""")
def workplace_type(spark, sf_dir):
    return views.postings(spark, sf_dir).select(
        "seq", tx.workplace_type(F.concat("location", "title")).alias("workplace"))


def _tag_sql(support: str, other: str) -> str:
    low = "lower(c_mktsegment || ' ' || ['SOC', 'Linux', 'helpdesk', 'python', 'x'][c_custkey % 5 + 1])"
    return f"""CASE WHEN regexp_matches({low}, 'security|soc|pentest|cyber') THEN 'security'
      WHEN regexp_matches({low}, 'devops|cloud|linux') THEN 'devops'
      WHEN regexp_matches({low}, 'support|helpdesk') THEN '{support}'
      WHEN contains({low}, 'python') THEN 'python' ELSE '{other}' END"""


@query("topic_tag", f"""SELECT c_custkey, {_tag_sql('supporting', 'engineering')} AS jobicy_tag,
  {_tag_sql('support', 'tech')} AS remoteok_tag FROM customer""")
def topic_tag(spark, sf_dir):
    words = views.by_number(F.col("c_custkey"), ["SOC", "Linux", "helpdesk", "python", "x"])
    keywords = F.concat("c_mktsegment", F.lit(" "), words)
    return views.load(spark, sf_dir, "customer").select(
        "c_custkey", tx.topic_tag(keywords, "jobicy").alias("jobicy_tag"),
        tx.topic_tag(keywords, "remoteok").alias("remoteok_tag"))


_OR_QUERY = """CASE c_custkey % 3 WHEN 0 THEN ' "" OR ''' || c_mktsegment || ' Analyst'' OR x'
  WHEN 1 THEN c_name || ' OR y' ELSE ' OR ' END"""


@query("first_term", f"""
WITH terms AS (SELECT c_custkey, list_filter(list_transform(string_split(
    replace(replace({_OR_QUERY}, '"', ''), '''', ''), ' OR '), lambda t: trim(t)), lambda t: t <> '') AS t
  FROM customer)
SELECT c_custkey, coalesce(t[1], 'it') AS term, lower(coalesce(t[1], 'it')) AS lower_term
FROM terms""")
def first_term(spark, sf_dir):
    form = F.col("c_custkey") % 3
    keywords = (F.when(form == 0, F.concat(F.lit(" \"\" OR '"), "c_mktsegment",
                                           F.lit(" Analyst' OR x")))
                .when(form == 1, F.concat("c_name", F.lit(" OR y"))).otherwise(F.lit(" OR ")))
    return views.load(spark, sf_dir, "customer").select(
        "c_custkey", tx.first_term(keywords).alias("term"),
        tx.first_term(keywords, lower=True).alias("lower_term"))


@query("url_parts", r"""
WITH u AS (SELECT page_id, url, split_part(url, '?', 1) AS bare FROM pages),
t AS (SELECT *, regexp_replace(bare, '/+$', '') AS cut FROM u)
SELECT page_id, bare,
  nullif(regexp_extract(cut || '-' || page_id, '(?:^|-)([0-9]+)$', 1), '') AS dash_number,
  nullif(regexp_extract(cut, '(?:^|/)([0-9]+)$', 1), '') AS path_number,
  nullif(regexp_extract(cut || '/role-' || page_id, '-([0-9]+)$', 1), '') AS slug_number
FROM t""")
def url_parts(spark, sf_dir):
    bare = tx.without_query(F.col("url"))
    cut = F.regexp_replace(bare, "/+$", "")
    return views.load(spark, sf_dir, "pages").select(
        "page_id", bare.alias("bare"),
        tx.dash_number(F.concat(cut, F.lit("-"), "page_id")).alias("dash_number"),
        tx.last_path_number(bare).alias("path_number"),
        tx.slug_number(F.concat(cut, F.lit("/role-"), "page_id")).alias("slug_number"))


@query("stable_id", r"""
SELECT page_id, 'ejobs-' || coalesce(nullif(regexp_extract(regexp_replace(url, '/+$', ''), '/([0-9]+)$', 1), ''),
    substr(sha256(url), 1, 16)) AS ejobs_id,
  'google-' || substr(sha256(url), 1, 16) AS google_id
FROM pages""")
def stable_id(spark, sf_dir):
    url = F.col("url")
    return views.load(spark, sf_dir, "pages").select(
        "page_id",
        tx.stable_id("ejobs-", tx.last_path_number(url), url).alias("ejobs_id"),
        tx.stable_id("google-", None, url).alias("google_id"))


@query("code_lookup", """
SELECT c_custkey, CASE WHEN c_custkey % 5 > 0 THEN '2,1' END AS workplace_codes, '2,5' AS level_codes,
  'F,C' AS job_type_codes, ['r1800', 'r604800', 'r86400', NULL][c_custkey % 4 + 1] AS window_code,
  ([0.5, 168.0, 24.0, NULL]::DOUBLE[])[c_custkey % 4 + 1] AS window_hours
FROM customer""")
def code_lookup(spark, sf_dir):
    found = profiles_from_json(views.config_documents(spark, sf_dir), "c_custkey", "body")
    window = F.col("date_posted")
    return found.select(
        F.col("profile_ord").cast("bigint").alias("c_custkey"),
        tx.code_lookup(F.col("workplace_types"), WORKPLACE_CODES).alias("workplace_codes"),
        tx.code_lookup(F.col("experience_levels"), EXPERIENCE_CODES).alias("level_codes"),
        tx.code_lookup(F.col("job_types"), JOB_TYPE_CODES).alias("job_type_codes"),
        tx.date_window_code(window).alias("window_code"),
        tx.date_window_hours(window).alias("window_hours"))


_SNIPPET = f"""CASE WHEN coalesce(description, '') = '' THEN '' ELSE '> ' ||
  CASE WHEN length({sql.cleaned('description')}) > 300
  THEN substr({sql.cleaned('description')}, 1, 297) || '...'
  ELSE {sql.cleaned('description')} END || chr(10) || chr(10) END"""


@query("snippet", WITH_POSTINGS + f"SELECT seq, {_SNIPPET} AS snippet FROM postings")
def snippet(spark, sf_dir):
    return views.postings(spark, sf_dir).select(
        "seq", tx.snippet(F.col("description")).alias("snippet"))


@query("title_suffix_cut", WITH_POSTINGS + r"""
SELECT seq, regexp_replace(title || [' - Careers', ' | Acme | x', ' – y', '-z'][seq % 4 + 1],
  '\s+[|\-–]\s+.*$', '') AS title FROM postings""")
def title_suffix_cut(spark, sf_dir):
    tail = views.by_number(F.col("seq"), [" - Careers", " | Acme | x", " – y", "-z"])
    return views.postings(spark, sf_dir).select(
        "seq", tx.title_suffix_cut(F.concat("title", tail)).alias("title"))


@query("epoch_ms", """
SELECT event_id, CASE WHEN event_id % 9 > 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS posted
FROM events""")
def epoch_ms(spark, sf_dir):
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("bigint")
    ms = F.when(F.col("event_id") % 9 > 0, ms).otherwise(F.lit(0))
    return views.load(spark, sf_dir, "events").select(
        "event_id", tx.epoch_ms_text(ms).alias("posted"))


@query("url_host", r"""
SELECT page_id, replace(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), 'www.', '') AS host,
  'example.com:8080' AS port_host FROM pages""")
def url_host(spark, sf_dir):
    with_port = F.concat(F.lit("https://www.example.com:8080/p"), "page_id")
    return views.load(spark, sf_dir, "pages").select(
        "page_id", tx.url_host(F.col("url")).alias("host"),
        tx.url_host(with_port).alias("port_host"))


_KEYWORDS = ["Zwischen", "Thonthe", "eauqu", "cióng", "AND", "der"]


@query("first_keyword", f"""
SELECT doc_id, {sql.first_hit('text', sql.word_list(_KEYWORDS))} AS keyword FROM documents""")
def first_keyword(spark, sf_dir):
    keywords = F.array(*[F.lit(k) for k in _KEYWORDS])
    return views.load(spark, sf_dir, "documents").select(
        "doc_id", tx.first_keyword(F.col("text"), keywords).alias("keyword"))


@query("location_badge", WITH_POSTINGS + """
SELECT seq, CASE workplace_type WHEN 'Remote' THEN '🌐 ' || location || ' (Remote)'
  WHEN 'Hybrid' THEN '🏢 ' || location || ' (Hybrid)' ELSE location END AS badge FROM postings""")
def location_badge(spark, sf_dir):
    return views.postings(spark, sf_dir).select(
        "seq", tx.location_badge(F.col("location"), F.col("workplace_type")).alias("badge"))


@query("posted_label", WITH_POSTINGS + """
SELECT seq, coalesce(nullif(post_text, ''), nullif(post_date, ''), 'Recently') AS label
FROM postings""")
def posted_label(spark, sf_dir):
    return views.postings(spark, sf_dir).select(
        "seq", tx.posted_label(F.col("post_text"), F.col("post_date")).alias("label"))


@query("role_details", WITH_POSTINGS + """
SELECT seq, nullif(concat_ws(' • ', nullif(employment_type, ''), nullif(seniority_level, '')), '')
  AS details FROM postings""")
def role_details(spark, sf_dir):
    return views.postings(spark, sf_dir).select(
        "seq", tx.role_details(F.col("employment_type"), F.col("seniority_level")).alias("details"))


@query("query_text", """
WITH p AS (SELECT c_custkey, lower(c_mktsegment) AS seg,
    coalesce(CASE WHEN c_custkey % 2 > 0 THEN 'City ' || c_nationkey END, 'Remote') AS location,
    ['&f_TPR=r1800', '&f_TPR=r604800', '&f_TPR=r86400', ''][c_custkey % 4 + 1] AS posted,
    CASE WHEN c_custkey % 3 < 2 THEN '&sortBy=DD' ELSE '' END AS sorted,
    CASE WHEN c_custkey % 5 > 0 THEN '&f_WT=2%2C1' ELSE '' END AS places FROM customer)
SELECT c_custkey,
  '(site:*.ro/careers OR site:*.ro/jobs OR site:*.ro/cariera) "Bucuresti" ("junior" OR "internship" OR "entry level") ('
    || seg || ' OR qa ' || seg || ')' AS site_query,
  'https://www.linkedin.com/jobs-guest/jobs/api/seeMoreJobPostings/search?keywords='
    || seg || '+OR+%22qa+' || seg || '%22&location=' || replace(location, ' ', '+') || '&start=0'
    || posted || sorted || places || '&f_E=2%2C5&f_JT=F%2CC' AS linkedin_url,
  'https://www.ejobs.ro/locuri-de-munca/' || seg || '/' AS ejobs_url,
  'https://www.bestjobs.eu/ro/locuri-de-munca?keyword=' || seg AS bestjobs_url
FROM p""")
def query_text(spark, sf_dir):
    found = profiles_from_json(views.config_documents(spark, sf_dir), "c_custkey", "body")
    return search_urls(found).select(
        F.col("profile_ord").cast("bigint").alias("c_custkey"),
        "site_query", "linkedin_url", "ejobs_url", "bestjobs_url")
