"""Views that read the given tables as listings, state, scan log and payloads.

Every view is row-wise over a whole table, so its work grows with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postsift.functions.text import clean_text, workplace_type
from postsift.schema import CARDS_PER_PAGE, PLATFORM_ICONS, PLATFORM_NAMES, Settings
from postsift.session import configure, ship_package
from postsift.sources.profiles import profiles_from_searches

SETTINGS = Settings(default_route="https://hooks.example.com/default",
                    junior_title_exclude_keywords=("hahe", "enst", "aulich"),
                    junior_description_exclude_keywords=("thonthe", "eauqu"),
                    junior_include_keywords=("that", "sch", "eau"))

# The four profiles of the demonstration plans, as they would stand in a config.
SEARCHES = [
    {"name": "Remote", "platforms": ["linkedin", "jobicy", "nowhere"],
     "keywords": "Security OR \"Cloud Engineer\"", "embed_color": "#3776AB",
     "webhook_url": "https://hooks.example.com/remote", "role_id_to_mention": "42",
     "filters": {"title_must_exclude": ["reth", "Hahe", "ouon"],
                 "companies_exclude": ["company es"],
                 "location_must_exclude": ["berlin"],
                 "description_must_exclude": ["thonthe", "ouèle"],
                 "max_age_hours": 600.0, "min_salary": 1000.0}},
    {"name": "Paris", "platforms": ["ejobs", "linkedin"], "location": "Bucharest",
     "keywords": "helpdesk",
     "filters": {"title_must_include": ["the", "DE", "la", "un"],
                 "companies_include": ["company EN", "company fr"],
                 "location_must_include": ["REMOTE"],
                 "max_age_hours": 650.0}},
    {"name": "Closed", "enabled": False, "platforms": ["linkedin"]},
    {"name": "Everything", "webhook_url": "https://hooks.example.com/YOUR_WEBHOOK",
     "filters": {"description_must_include": ["and", "der", "la"]}},
]

# Landed boards of the demonstration listings, by remainder of the document number.
BOARDS = ["linkedin", "ejobs", "jobicy", "arbeitnow"]


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship_package(spark)
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def by_number(number, values):
    """Pick from a fixed list by a row number."""
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(number, F.lit(len(values))))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as listings: the head of the text names the listing, and the whole text
    is its description. Copies of a text share an id, as one listing on several boards."""
    docs = load(spark, sf_dir, "documents")
    docs = docs.withColumn("cleaned", clean_text(F.col("text")))
    n = F.col("doc_id")
    location = (F.when(F.col("lang") == "en", "Remote").when(F.col("lang") == "es", "Hybrid Madrid")
                .when(F.col("lang") == "fr", "Paris").otherwise("Berlin"))
    posted = F.timestamp_seconds(F.lit(1704067200) + F.pmod(n * 37, F.lit(43200)) * 60)
    code = by_number(n, BOARDS)
    names = F.create_map(*[F.lit(v) for pair in PLATFORM_NAMES.items() for v in pair])
    icons = F.create_map(*[F.lit(v) for pair in PLATFORM_ICONS.items() for v in pair])
    day = F.date_format(posted, "yyyy-MM-dd")
    stamp = F.date_format(posted, "yyyy-MM-dd HH:mm:ss")
    form = F.pmod(n, F.lit(6))
    return docs.select(
        F.concat(F.lit("doc-"), F.substring(F.md5("text"), 1, 16)).alias("id"),
        F.regexp_extract("cleaned", r"^(\S+( \S+){0,4})", 1).alias("title"),
        F.concat(F.lit("Company "), "lang").alias("company"),
        location.alias("location"),
        F.concat(F.lit("https://jobs.example.com/view/role-"), n, F.lit("?ref="), "source")
        .alias("job_url"),
        F.when(n % 3 == 0, F.concat(F.lit("https://jobs.example.com/company/"), "lang"))
        .alias("company_url"),
        F.when(n % 5 == 0, F.lit("data:image/png;base64,xx"))
        .when(n % 5 < 3, F.concat(F.lit("https://logo.example.com/"), "source", F.lit(".png")))
        .alias("logo_url"),
        F.when(form == 0, F.concat(F.replace(stamp, F.lit(" "), F.lit("T")), F.lit("Z")))
        .when(form == 1, day).when(form == 2, stamp)
        .when(form == 4, F.unix_seconds(posted).cast("string"))
        .when(form == 5, F.concat(F.replace(stamp, F.lit(" "), F.lit("T")), F.lit("+02:00")))
        .alias("post_date"),
        F.when(form == 3, F.concat((n % 59 + 1).cast("string"),
                                   by_number(F.floor(n / 6).cast("bigint"),
                                             [" minutes ago", " hours ago", " Days ago", " ?"])))
        .alias("post_text"),
        workplace_type(location).alias("workplace_type"),
        by_number(n, ["Full-time", "", None]).alias("employment_type"),
        by_number(n, ["Entry level", None, "", "Director", None]).alias("seniority_level"),
        F.when(n % 4 == 1, F.concat((F.col("n_chars") * 10).cast("string"), F.lit(" lei")))
        .alias("salary"),
        F.col("text").alias("description"),
        F.when(n % 7 == 0, F.concat((n % 200).cast("string"), F.lit(" applicants")))
        .alias("applicants"),
        F.create_map().cast("map<string,string>").alias("criteria"),
        F.lit(None).cast("string").alias("matched_search_name"),
        F.element_at(names, code).alias("platform"),
        F.element_at(icons, code).alias("platform_icon"),
        code.alias("platform_code"),
        n.alias("seq"),
        "source", "lang", "n_chars",
    )


def details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detail pages, already extracted: one row per labelled document's listing id."""
    labels, docs = load(spark, sf_dir, "labels"), load(spark, sf_dir, "documents")
    entries = F.array(
        F.struct(F.lit("Seniority level"),
                 F.when(F.col("quality") == 1, "Entry level").otherwise("Director")),
        F.struct(F.lit("Employment type"), F.when(F.col("toxic") == 1, "Contract")))
    known = F.filter(entries, lambda e: e["col2"].isNotNull())
    rows = docs.join(labels, "doc_id").select(
        F.concat(F.lit("doc-"), F.substring(F.md5("text"), 1, 16)).alias("id"),
        F.map_from_entries(known).alias("detail_criteria"),
        F.col("text").alias("detail_description"),
        F.concat((F.col("n_chars") % 90).cast("string"), F.lit(" applicants"))
        .alias("detail_applicants"),
        F.concat(F.lit("https://logo.example.com/top/"), "source").alias("detail_logo_url"),
        "doc_id")
    first = F.min_by(F.struct("detail_criteria", "detail_description", "detail_applicants",
                              "detail_logo_url"), "doc_id")
    return rows.groupBy("id").agg(first.alias("d")).select("id", "d.*")


def seen_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State ids left by earlier scans: the labelled documents of good quality."""
    labels = load(spark, sf_dir, "labels").filter("quality = 1")
    docs = load(spark, sf_dir, "documents").join(labels, "doc_id")
    return docs.select(
        F.concat(F.lit("doc-"), F.substring(F.md5("text"), 1, 16)).alias("job_id")).distinct()


def seen_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ids with title and company, as listings of an earlier scan that stand."""
    labels = load(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("seq"))
    found = postings(spark, sf_dir).join(labels, "seq").select(
        F.col("id").alias("job_id"), "title", "company").distinct()
    return found.withColumns({"status": F.lit("NEW"), "discovered_at": F.timestamp_seconds(F.lit(1700000000))})


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select(
        F.concat(F.lit("part-"), "p_partkey").alias("id"),
        F.col("p_name").alias("title"), F.col("p_brand").alias("company"),
        F.col("p_type").alias("employment_type"), F.col("p_partkey").alias("seq"))


def tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.substring("o_orderpriority", 1, 1)
    status = (F.when(rank == "1", "NEW").when(rank == "2", "APPLIED")
              .when(rank == "3", "INTERVIEWING").when(rank == "4", "FILTERED")
              .otherwise("DUPLICATE"))
    seen = F.col("o_orderdate").cast("timestamp")
    n = F.col("o_orderkey")
    return load(spark, sf_dir, "orders").select(
        n.cast("string").alias("job_id"),
        F.concat(F.lit("Search "), (F.col("o_custkey") % 7).cast("string")).alias("search_name"),
        F.concat(F.lit("Clerk for order "), n).alias("title"),
        F.concat(F.lit("Customer "), "o_custkey").alias("company"),
        F.when(n % 3 > 0, F.concat(F.lit("Warehouse district number "), (n % 11).cast("string")))
        .alias("location"),
        F.concat(F.lit("https://jobs.example.com/view/"), n).alias("url"),
        F.col("o_orderstatus").alias("platform"),
        seen.alias("discovered_at"),
        F.when(F.col("o_orderstatus") == "F", seen).alias("notified_at"),
        status.alias("status"),
    )


def scan_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scans: what they found grows with the counter in their properties."""
    found = F.get_json_object("props", "$.k").cast("bigint")
    return load(spark, sf_dir, "events").select(
        F.col("event_type").alias("search_name"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        found.alias("jobs_found"),
        F.floor(found / 2).cast("bigint").alias("jobs_new"),
        F.floor(found / 5).cast("bigint").alias("jobs_notified"),
        F.col("value").alias("duration_seconds"), "event_id")


def profiles(spark: SparkSession) -> DataFrame:
    return profiles_from_searches(spark, SEARCHES)


def config_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search config document per customer, with fields left out or null at times."""
    n = F.col("c_custkey")
    segment = F.lower("c_mktsegment")
    body = F.struct(
        F.when(n % 4 > 0, F.col("c_name")).alias("name"),
        F.when(n % 3 > 0, F.col("c_acctbal") > 0).alias("enabled"),
        by_number(n, ["", None, "https://hooks.example.com/a",
                      "https://hooks.example.com/YOUR_WEBHOOK"]).alias("webhook_url"),
        F.concat(segment, F.lit(" OR \"qa "), segment, F.lit("\"")).alias("keywords"),
        F.when(n % 2 > 0, F.concat(F.lit("City "), F.col("c_nationkey"))).alias("location"),
        by_number(n, ["past_30min", "week", None, "any"]).alias("date_posted"),
        by_number(n, [None, "DD", "relevant"]).alias("sort_by"),
        F.when(n % 5 > 0, F.array(F.lit("Remote"), segment, F.lit("on-site")))
        .alias("workplace_types"),
        F.array(F.lit("entry"), F.lit("Director"), segment).alias("experience_levels"),
        F.array(F.lit("full_time"), F.lit("contract")).alias("job_types"),
        F.struct(
            F.slice(F.array(segment, F.lit("senior"), F.lit("lead"), F.lit("vp"), F.lit("head")),
                    F.lit(1), (n % 6).cast("int")).alias("title_must_exclude"),
            F.when(n % 2 == 0, F.lit(0.5)).alias("max_age_hours")).alias("filters"),
        F.when(n % 6 == 0, F.lit(3)).alias("max_pages"),
        by_number(F.floor(n / 2).cast("bigint"), [None, "linkedin", "ats,nowhere,google", ""])
        .alias("sites"),
    )
    sites = F.col("b.sites")
    listed = F.when(sites == "", F.array().cast("array<string>")).otherwise(F.split(sites, ","))
    return (load(spark, sf_dir, "customer").select("c_custkey", body.alias("b"))
            .withColumn("b", F.col("b").withField("platforms", listed).dropFields("sites"))
            .select("c_custkey", F.to_json("b").alias("body")))


def company_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company-board lists from customers, one document per run of 25 customers."""
    batch = F.floor(F.col("c_custkey") / CARDS_PER_PAGE).cast("bigint")
    slug = F.concat(F.lit(" "), F.replace(F.lower("c_name"), F.lit("#"), F.lit("-")), F.lit(" "))
    blank = F.when(F.col("c_acctbal") < 0, F.lit("  ")).otherwise(slug)
    kind = F.col("c_nationkey") % 2
    ordered = F.sort_array(F.collect_list(F.struct("c_custkey", "kind", "slug")))

    def of(k: int):
        return F.transform(F.filter(ordered, lambda r: r["kind"] == k), lambda r: r["slug"])

    listed = F.to_json(F.struct(of(0).alias("greenhouse"), of(1).alias("lever")))
    return (load(spark, sf_dir, "customer")
            .select("c_custkey", batch.alias("batch"), kind.alias("kind"), blank.alias("slug"))
            .groupBy("batch").agg(listed.alias("body")))
