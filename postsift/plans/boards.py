"""Extraction queries: pages and JSON responses derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsift.functions import text as tx
from postsift.operators.enrich import enrich
from postsift.plans import reference_sql as sql
from postsift.plans import views
from postsift.plans.registry import query
from postsift.schema import CARDS_PER_PAGE
from postsift.sources import boards, html, json_boards
from postsift.sources import profiles as profile_source
from postsift.sources.registry import union_sources

WITH_POSTINGS = f"WITH {sql.POSTINGS} "


def page_payloads(spark, sf_dir: str) -> DataFrame:
    return views.load(spark, sf_dir, "pages").select(
        "page_id", F.col("page_id").alias("payload_seq"), "url", F.col("html").alias("body"),
        F.lit("Everything").alias("search_name"), F.lit("Bucharest").alias("search_location"))


def response_payloads(spark, sf_dir: str, item: Column, wrap) -> DataFrame:
    """Postings as board responses of 25 items each."""
    batch = F.floor(F.col("seq") / CARDS_PER_PAGE).cast("bigint")
    rows = views.postings(spark, sf_dir).select(
        "seq", batch.alias("payload_seq"), F.to_json(item).alias("item"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("seq", "item"))),
                          lambda r: r["item"])
    body = wrap(F.array_join(ordered, ","))
    return rows.groupBy("payload_seq").agg(body.alias("body")).select(
        "payload_seq", F.concat(F.lit("acme_"), "payload_seq").alias("board"),
        F.lit("Everything").alias("search_name"), "body")


def _listed(field: str):
    return lambda joined: F.concat(F.lit(f'{{"{field}":['), joined, F.lit("]}"))


def _bare(joined: Column) -> Column:
    return F.concat(F.lit("["), joined, F.lit("]"))


# Position of a posting in its response, as the extractors number it.
_SEQ = f"((seq // {CARDS_PER_PAGE}) << 20) + seq % {CARDS_PER_PAGE}"
_HINTED = "regexp_matches(lower(location), 'bucharest|bucuresti|bucurești|romania|românia|remote')"


@query("json_object_jobs", WITH_POSTINGS + f"""
SELECT 'gh-' || seq AS id, trim(title) AS title, 'Acme ' || (seq // 25) AS company, location,
  job_url, coalesce(nullif(post_date, ''), 'u' || seq) AS post_date, 'Greenhouse' AS platform,
  {_SEQ} AS seq
FROM postings WHERE {_HINTED} AND logo_url IS NOT NULL AND title <> ''""")
def json_object_jobs(spark, sf_dir):
    item = F.struct(
        F.col("seq").alias("id"), F.concat(F.lit(" "), F.replace("title", F.lit(" "), F.lit(" \t ")))
        .alias("title"),
        F.when(F.col("logo_url").isNotNull(), F.col("job_url")).alias("absolute_url"),
        F.struct(F.col("location").alias("name")).alias("location"),
        F.col("post_date").alias("first_published"),
        F.concat(F.lit("u"), "seq").alias("updated_at"))
    payloads = response_payloads(spark, sf_dir, item, _listed("jobs"))
    return json_boards.greenhouse(payloads).select(
        "id", "title", "company", "location", "job_url", "post_date", "platform", "seq")


@query("json_array_jobs", WITH_POSTINGS + f"""
SELECT 'lever-' || coalesce(CASE WHEN seq % 4 > 0 THEN CAST(seq AS VARCHAR) END,
    substr(sha256(job_url), 1, 16)) AS id, title, 'Acme ' || (seq // 25) AS company, location,
  job_url, CASE WHEN seq % 3 > 0 THEN strftime(make_timestamp(1756634400000000 + seq * 1000000),
    '%Y-%m-%d %H:%M:%S') END AS post_date, {_SEQ} AS seq
FROM postings WHERE {_HINTED} AND title <> ''""")
def json_array_jobs(spark, sf_dir):
    seq = F.col("seq")
    item = F.struct(
        F.when(seq % 4 > 0, seq.cast("string")).alias("id"), F.col("title").alias("text"),
        F.col("job_url").alias("hostedUrl"), F.struct("location").alias("categories"),
        F.when(seq % 3 > 0, seq * 1000 + 1756634400000).alias("createdAt"))
    return json_boards.lever(response_payloads(spark, sf_dir, item, _bare)).select(
        "id", "title", "company", "location", "job_url", "post_date", "seq")


@query("json_remote_excerpt", WITH_POSTINGS + f"""
SELECT 'jobicy-' || seq AS id, title, company,
  '🌐 Remote (' || CASE WHEN seq % 2 = 0 THEN location ELSE 'Remote / Europe' END || ')' AS location,
  CASE WHEN seq % 3 = 0 THEN source ELSE {sql.cleaned('description')} END AS description,
  seniority_level, 'Remote' AS workplace_type, {_SEQ} AS seq
FROM postings""")
def json_remote_excerpt(spark, sf_dir):
    seq = F.col("seq")
    item = F.struct(
        seq.alias("id"), F.col("title").alias("jobTitle"), F.col("company").alias("companyName"),
        F.when(seq % 2 == 0, F.col("location")).alias("jobGeo"), F.col("job_url").alias("url"),
        F.when(seq % 3 == 0, F.col("source")).when(seq % 3 == 1, "").alias("jobExcerpt"),
        F.col("description").alias("jobDescription"), F.col("seniority_level").alias("jobLevel"))
    payloads = response_payloads(spark, sf_dir, item, _listed("jobs"))
    return json_boards.jobicy(payloads, None).select(
        "id", "title", "company", "location", "description", "seniority_level",
        "workplace_type", "seq")


@query("json_skip_header", WITH_POSTINGS + f"""
SELECT 'remoteok-' || CASE WHEN seq % 5 > 0 THEN CAST(seq AS VARCHAR)
    ELSE substr(sha256(job_url), 1, 16) END AS id, title,
  '🌐 Remote (' || CASE WHEN seq % 2 = 0 THEN location ELSE 'Worldwide Remote' END || ')' AS location,
  {sql.cleaned('description')} AS description, {_SEQ} + 1 AS seq
FROM postings""")
def json_skip_header(spark, sf_dir):
    seq = F.col("seq")
    item = F.struct(
        F.when(seq % 5 > 0, seq).alias("id"), F.col("title").alias("position"), "company",
        F.when(seq % 2 == 0, F.col("location")).otherwise("").alias("location"),
        F.col("job_url").alias("url"), F.col("description"))
    payloads = response_payloads(
        spark, sf_dir, item, lambda j: F.concat(F.lit('[{"legal":"notice"},'), j, F.lit("]")))
    return json_boards.remoteok(payloads, None).select(
        "id", "title", "location", "description", "seq")


@query("json_remote_flag", WITH_POSTINGS + f"""
SELECT 'arbeitnow-role-' || seq AS id, title,
  CASE WHEN lang = 'en' THEN '🌐 Remote ' ELSE '📍 ' END || location AS location,
  CASE WHEN lang = 'en' THEN 'Remote' ELSE 'On-site' END AS workplace_type,
  CASE WHEN seq % 2 = 0 THEN CAST(1700000000 + seq AS VARCHAR) ELSE '' END AS post_date,
  title || chr(10) || source AS description, {_SEQ} AS seq
FROM postings WHERE title <> ''""")
def json_remote_flag(spark, sf_dir):
    seq = F.col("seq")
    escaped = F.replace(F.replace("title", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    item = F.struct(
        F.concat(F.lit("role-"), "seq").alias("slug"), "title",
        F.col("company").alias("company_name"), "location", F.col("job_url").alias("url"),
        (F.col("lang") == "en").alias("remote"),
        F.when(seq % 2 == 0, seq + 1700000000).alias("created_at"),
        F.concat(F.lit("<p>"), escaped, F.lit("</p> <script>x</script><b>"), "source",
                 F.lit("</b>")).alias("description"))
    payloads = response_payloads(spark, sf_dir, item, _listed("data"))
    return json_boards.arbeitnow(payloads, None).filter("title <> ''").select(
        "id", "title", "location", "workplace_type", "post_date", "description", "seq")


@query("company_list", """
SELECT c_custkey // 25 AS batch, CASE c_nationkey % 2 WHEN 0 THEN 'greenhouse' ELSE 'lever' END AS ats,
  replace(lower(c_name), '#', '-') AS slug
FROM customer WHERE c_acctbal >= 0""")
def company_list(spark, sf_dir):
    return profile_source.company_list(views.company_documents(spark, sf_dir), "body").select(
        "batch", "ats", "slug")


@query("profile_expand", """
WITH c AS (SELECT *, ['linkedin', 'ejobs', 'bestjobs', 'hipo', 'stagiipebune', 'ats', 'jobicy',
    'remoteok', 'arbeitnow'] AS all_codes FROM customer),
p AS (SELECT c_custkey, CASE WHEN c_custkey % 4 > 0 THEN c_name
    ELSE 'Search #' || (c_custkey + 1) END AS search_name,
  coalesce(CASE WHEN c_custkey % 3 > 0 THEN c_acctbal > 0 END, true) AS enabled,
  CASE WHEN c_custkey % 2 > 0 THEN 'City ' || c_nationkey ELSE 'Remote' END AS location,
  ['past_30min', 'week', 'past_24h', 'any'][c_custkey % 4 + 1] AS date_posted,
  ['recent', 'DD', 'relevant'][c_custkey % 3 + 1] AS sort_by,
  CASE (c_custkey // 2) % 4 WHEN 1 THEN ['linkedin'] WHEN 2 THEN ['ats', 'nowhere', 'google']
    ELSE all_codes END AS codes,
  CASE WHEN c_custkey % 6 = 0 THEN 3 ELSE 1 END AS pages FROM c),
x AS (SELECT *, unnest(codes) AS platform_code, generate_subscripts(codes, 1) - 1 AS platform_ord
  FROM p WHERE enabled)
SELECT c_custkey, search_name, location, date_posted, sort_by, pages, platform_ord, platform_code
FROM x WHERE platform_code <> 'nowhere'""")
def profile_expand(spark, sf_dir):
    found = profile_source.profiles_from_json(
        views.config_documents(spark, sf_dir), "c_custkey", "body")
    found = profile_source.effective_pages(found, views.SETTINGS)
    return profile_source.expand_platforms(found).select(
        F.col("profile_ord").cast("bigint").alias("c_custkey"), "search_name",
        F.col("profile_location").alias("location"), "date_posted", "sort_by", "pages",
        "platform_ord", "platform_code")


# --- Pages ----------------------------------------------------------------------

_DECODED = ("replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), "
            "'&quot;', '\"'), '&#39;', ''''), '&amp;', '&')")


def _decoded(c: str) -> str:
    return _DECODED.format(c)


ANCHORS = f"""anchors AS (
  SELECT page_id, pos, {_decoded('href')} AS href, {sql.cleaned(_decoded('label'))} AS title
  FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href,
    unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS label,
    generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1), 1) - 1 AS pos
    FROM pages))"""


def _article_fields(nodes: Column, card: Column) -> boards.Fields:
    inside = html.below(nodes, card)
    root = html.first_of(nodes, html.tagged("html"))
    return {"title": tx.text(html.text_of(nodes, html.first_of(inside, html.tagged("h1")))),
            "location": F.coalesce(html.attr(root, "lang"), F.lit("Unknown Location")),
            "paragraphs": F.size(F.filter(inside, html.tagged("p")))}


ARTICLES = boards.CardSpec("google", html.tagged("article"), _article_fields,
                           lambda c: c["title"] != "")


@query("extract_cards", rf"""
SELECT page_id, 'google-' || coalesce(nullif(regexp_extract(bare, '(?:^|/)([0-9]+)/*$', 1), ''),
    substr(sha256(url), 1, 16)) AS id,
  {sql.cleaned(_decoded("regexp_extract(html, '<h1>([^<]*)</h1>', 1)"))} AS title,
  regexp_extract(html, '<html lang="([^"]*)"', 1) AS location,
  replace(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), 'www.', '') AS company,
  len(regexp_extract_all(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<p>')) AS paragraphs,
  bare AS job_url
FROM (SELECT *, split_part(url, '?', 1) AS bare FROM pages)""")
def extract_cards(spark, sf_dir):
    url = F.col("url")
    bare = tx.without_query(url)
    return boards.card_rows(page_payloads(spark, sf_dir), ARTICLES).select(
        "page_id", tx.stable_id("google-", tx.last_path_number(bare), url).alias("id"),
        "card.title", "card.location", tx.url_host(url).alias("company"), "card.paragraphs",
        bare.alias("job_url"))


def _link_fields(nodes: Column, anchor: Column) -> boards.Fields:
    box = html.ancestor(nodes, anchor, html.tagged("li"))
    return {"href": html.attr(anchor, "href"), "title": html.text_of(nodes, anchor),
            "company": F.coalesce(tx.bind(box, lambda b: html.text_of(nodes, html.first_of(
                html.below(nodes, b), html.tagged("h3")))), F.lit("Unknown Employer"))}


LINKS = boards.CardSpec(
    "ejobs", lambda n: (n["tag"] == "a") & html.attr(n, "href").isNotNull(), _link_fields,
    lambda c: F.contains(c["href"], F.lit("e")) & ~F.contains(c["href"], F.lit("the")))


@query("extract_links", f"""WITH {ANCHORS}
SELECT page_id, title, 'Unknown Employer' AS company, 'https://www.ejobs.ro' || href AS job_url,
  'ejobs-' || substr(sha256('https://www.ejobs.ro' || href), 1, 16) AS id
FROM anchors WHERE contains(href, 'e') AND NOT contains(href, 'the')""")
def extract_links(spark, sf_dir):
    url = boards.absolute(boards.EJOBS_BASE, F.col("card.href"))
    return boards.card_rows(page_payloads(spark, sf_dir), LINKS).select(
        "page_id", "card.title", "card.company", url.alias("job_url"),
        tx.stable_id("ejobs-", tx.last_path_number(url), url).alias("id"))


def _slug_fields(nodes: Column, anchor: Column) -> boards.Fields:
    href = html.attr(anchor, "href")
    return {"href": href, "title": html.text_of(nodes, anchor),
            "id": tx.stable_id("bestjobs-", tx.slug_number(href), href)}


SLUGS = boards.CardSpec(
    "bestjobs", lambda n: (n["tag"] == "a") & html.attr(n, "href").rlike("^/"), _slug_fields,
    lambda c: c["title"] != "", unique_by="id", keep_last=True)


@query("extract_links_id", rf"""WITH {ANCHORS},
k AS (SELECT *, 'bestjobs-' || coalesce(nullif(regexp_extract(href, '-([0-9]+)/*$', 1), ''),
    substr(sha256(href), 1, 16)) AS id FROM anchors WHERE starts_with(href, '/') AND title <> '')
SELECT page_id, id, arg_max(title, pos) AS title, arg_max(href, pos) AS href
FROM k GROUP BY page_id, id""")
def extract_links_id(spark, sf_dir):
    return boards.card_rows(page_payloads(spark, sf_dir), SLUGS).select(
        "page_id", "card.id", "card.title", "card.href")


FIRST_LINKS = boards.CardSpec(
    "hipo", lambda n: (n["tag"] == "a") & F.contains(html.attr(n, "href"), F.lit("/")),
    boards._hipo_fields, lambda c: c["title"] != "", unique_by="href")


@query("anchor_keep_first", f"""WITH {ANCHORS}
SELECT page_id, href, arg_min(title, pos) AS title, 'Hipo.ro Employer' AS company
FROM anchors WHERE contains(href, '/') AND title <> '' GROUP BY page_id, href""")
def anchor_keep_first(spark, sf_dir):
    return boards.card_rows(page_payloads(spark, sf_dir), FIRST_LINKS).select(
        "page_id", "card.href", "card.title", "card.company")


SLUG_LINKS = boards.CardSpec(
    "stagiipebune", lambda n: (n["tag"] == "a") & html.attr(n, "href").rlike("^/.+"),
    boards._anchor_fields, boards.STAGII.keep, unique_by="href")


@query("anchor_slug", rf"""WITH {ANCHORS}, f AS (
  SELECT page_id, href, arg_min(title, pos) AS title FROM anchors
  WHERE regexp_matches(href, '^/.+') AND length(title) >= 4
    AND NOT regexp_matches(title, '^[0-9]+$') GROUP BY page_id, href)
SELECT page_id, href, title, 'spb-' || coalesce(nullif(regexp_extract(
    regexp_replace(href, '/+$', ''), '([^-]*)$', 1), ''), substr(sha256(href), 1, 16)) AS id,
  {sql.titled("replace(substr(href, 2), '-', ' ')")} AS company FROM f
WHERE NOT contains(substr(href, 2), '/')""")
def anchor_slug(spark, sf_dir):
    href = F.col("card.href")
    tail = F.substring_index(F.regexp_replace(href, "/+$", ""), "-", -1)
    return (boards.card_rows(page_payloads(spark, sf_dir), SLUG_LINKS)
            .filter(~F.contains(F.substring(href, 2, 1 << 30), F.lit("/")))
            .select("page_id", "card.href", "card.title",
                    tx.stable_id("spb-", tx.filled(tail), href).alias("id"),
                    tx.path_company(F.concat(F.lit("/jobs"), href, F.lit("/x"))).alias("company")))


@query("page_titles", rf"""
WITH t AS (SELECT page_id, url, {sql.cleaned(_decoded("regexp_extract(html, '<title>([^<]*)', 1)"))} AS title
  FROM pages),
c AS (SELECT *, {sql.stripped(r"regexp_replace(title, '\s+[|\-–]\s+.*$', '')")} AS short FROM t)
SELECT page_id, substr(short, 1, 120) AS title,
  replace(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), 'www.', '') AS company,
  'google-' || substr(sha256(url), 1, 16) AS id
FROM c WHERE length(short) >= 4""")
def page_titles(spark, sf_dir):
    url = F.col("url")
    return boards.career_titles(page_payloads(spark, sf_dir)).select(
        "page_id", "title", tx.url_host(url).alias("company"),
        tx.stable_id("google-", None, url).alias("id"))


@query("html_text", rf"""
WITH s AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<(script|style)\b[^>]*>.*?</(script|style)>', '<x>', 'g'),
    '(?s)<!--.*?-->', '<x>', 'g') AS markup FROM pages),
r AS (SELECT page_id, list_filter(list_transform(regexp_split_to_array(markup, '<[^>]*>'),
  lambda t: {sql.stripped("replace(replace(" + _decoded('t') + ", '&copy;', '©'), '&middot;', '·')")}),
  lambda t: t <> '') AS runs FROM s)
SELECT page_id, array_to_string(runs, chr(10)) AS body FROM r""")
def html_text(spark, sf_dir):
    return views.load(spark, sf_dir, "pages").select(
        "page_id", html.html_text(F.col("html")).alias("body"))


@query("union_sources", rf"""
WITH {sql.POSTINGS}, {ANCHORS},
gh AS (SELECT 'gh-' || seq AS id, title, 'Acme ' || (seq // 25) AS company, location,
    'Greenhouse' AS platform FROM postings WHERE {_HINTED} AND title <> ''),
jb AS (SELECT 'jobicy-' || seq AS id, title, company, '🌐 Remote (' || location || ')' AS location,
    'Jobicy' AS platform FROM postings),
t AS (SELECT url, {sql.cleaned(_decoded("regexp_extract(html, '<title>([^<]*)', 1)"))} AS title
  FROM pages),
c AS (SELECT url, {sql.stripped(r"regexp_replace(title, '\s+[|\-–]\s+.*$', '')")} AS short FROM t),
go AS (SELECT DISTINCT 'google-' || substr(sha256(url), 1, 16) AS id, substr(short, 1, 120) AS title,
    replace(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), 'www.', '') AS company,
    'Bucharest, Romania' AS location, 'Google' AS platform FROM c WHERE length(short) >= 4)
SELECT * FROM gh UNION ALL SELECT * FROM jb UNION ALL SELECT * FROM go""")
def sources_union(spark, sf_dir):
    seq = F.col("seq")
    gh = F.struct(seq.alias("id"), "title", F.col("job_url").alias("absolute_url"),
                  F.struct(F.col("location").alias("name")).alias("location"))
    jb = F.struct(seq.alias("id"), F.col("title").alias("jobTitle"),
                  F.col("company").alias("companyName"), F.col("location").alias("jobGeo"))
    landed = {
        "ats": response_payloads(spark, sf_dir, gh, _listed("jobs")).withColumn(
            "ats", F.lit("greenhouse")),
        "jobicy": response_payloads(spark, sf_dir, jb, _listed("jobs")),
        "google": page_payloads(spark, sf_dir),
        "nowhere": page_payloads(spark, sf_dir),
    }
    return union_sources(landed, views.profiles(spark)).select(
        "id", "title", "company", "location", "platform")


@query("detail_enrich", f"""
WITH {sql.POSTINGS}, {sql.DETAILS}
SELECT seq, p.id, CASE WHEN d.id IS NULL THEN seniority_level ELSE detail_seniority END AS seniority,
  CASE WHEN d.id IS NULL THEN employment_type ELSE detail_employment END AS employment,
  coalesce(detail_description, description) AS description,
  coalesce(detail_applicants, applicants) AS applicants,
  CASE WHEN coalesce(logo_url, '') = '' THEN detail_logo_url ELSE logo_url END AS logo_url
FROM postings p LEFT JOIN details d ON p.id = d.id""")
def detail_enrich(spark, sf_dir):
    return enrich(views.postings(spark, sf_dir), views.details(spark, sf_dir)).select(
        "seq", "id", F.col("seniority_level").alias("seniority"),
        F.col("employment_type").alias("employment"), "description", "applicants", "logo_url")
