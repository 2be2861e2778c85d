"""Listing extraction from landed JSON responses, with native JSON functions only.

Each response is split into raw items first and every item is parsed on its own, so
one broken item or response yields no row instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsift.functions import text as tx
from postsift.functions.rules import relevant_location
from postsift.sources.boards import payload_seq
from postsift.sources.html import html_text
from postsift.sources.registry import as_listing, register_source
from postsift.schema import LISTING

GREENHOUSE_ITEM = ("id string, title string, absolute_url string, location struct<name:string>, "
                   "first_published string, updated_at string")
LEVER_ITEM = ("id string, text string, hostedUrl string, categories struct<location:string>, "
              "createdAt bigint")
JOBICY_ITEM = ("id string, jobTitle string, companyName string, jobGeo string, url string, "
               "companyLogo string, pubDate string, jobExcerpt string, jobDescription string, "
               "jobLevel string")
REMOTEOK_ITEM = ("id string, position string, company string, location string, url string, "
                 "company_logo string, date string, description string")
ARBEITNOW_ITEM = ("slug string, title string, company_name string, location string, url string, "
                  "remote boolean, created_at string, description string")


def items_of(payloads: DataFrame, item: str, field: str | None) -> DataFrame:
    """One row per object of the response array, ``pos`` its place in the array."""
    if field:
        raw = F.from_json("body", f"{field} array<string>")[field]
    else:
        raw = F.from_json("body", "array<string>")
    # The outer form: a plain explode adds a filter below it that parses the body again.
    return (payloads.withColumn("raw", raw).drop("body")
            .select("*", F.posexplode_outer("raw").alias("pos", "one"))
            .filter(F.startswith(F.ltrim("one"), F.lit("{")))
            .withColumn("item", F.from_json("one", item)).drop("raw", "one"))


def _seq() -> Column:
    return payload_seq(F.col("payload_seq"), F.col("pos"))


def greenhouse(payloads: DataFrame) -> DataFrame:
    """Board responses; ``board`` names the company. Only relevant locations stay."""
    item = F.col("item")
    rows = (items_of(payloads, GREENHOUSE_ITEM, "jobs")
            .withColumn("place", tx.clean_text(item["location"]["name"]))
            .filter(relevant_location(F.col("place")))
            .withColumn("title", tx.clean_text(item["title"]))
            .filter((F.col("title") != "") & (tx.text(item["absolute_url"]) != "")))
    return as_listing(
        rows, "ats", id=tx.stable_id("gh-", item["id"], item["absolute_url"]), title="title",
        company=tx.slug_company(F.col("board")), location="place", job_url=item["absolute_url"],
        post_date=F.coalesce(tx.filled(item["first_published"]), item["updated_at"]),
        platform=F.lit("Greenhouse"), seq=_seq())


def lever(payloads: DataFrame) -> DataFrame:
    item = F.col("item")
    rows = (items_of(payloads, LEVER_ITEM, None)
            .withColumn("place", tx.clean_text(item["categories"]["location"]))
            .filter(relevant_location(F.col("place")))
            .withColumn("title", tx.clean_text(item["text"]))
            .filter((F.col("title") != "") & (tx.text(item["hostedUrl"]) != "")))
    return as_listing(
        rows, "ats", id=tx.stable_id("lever-", item["id"], item["hostedUrl"]), title="title",
        company=tx.slug_company(F.col("board")), location="place", job_url=item["hostedUrl"],
        post_date=tx.epoch_ms_text(item["createdAt"]), platform=F.lit("Lever"), seq=_seq())


def ats(payloads: DataFrame, profiles: DataFrame) -> DataFrame:
    """Both company-board formats; ``ats`` on the payload says which one it is."""
    return greenhouse(payloads.filter("ats = 'greenhouse'")).unionByName(
        lever(payloads.filter("ats = 'lever'"))).select(LISTING.names)


def jobicy(payloads: DataFrame, profiles: DataFrame) -> DataFrame:
    item = F.col("item")
    geo = tx.clean_text(F.coalesce(item["jobGeo"], F.lit("Remote / Europe")))
    return as_listing(
        items_of(payloads, JOBICY_ITEM, "jobs"), "jobicy",
        id=F.concat(F.lit("jobicy-"), F.coalesce(item["id"], F.lit("None"))),
        title=tx.clean_text(item["jobTitle"]), company=tx.clean_text(item["companyName"]),
        location=F.concat(F.lit("🌐 Remote ("), geo, F.lit(")")), job_url=tx.text(item["url"]),
        logo_url=item["companyLogo"], post_date=item["pubDate"], workplace_type=F.lit("Remote"),
        seniority_level=item["jobLevel"],
        description=tx.clean_text(F.coalesce(tx.filled(item["jobExcerpt"]),
                                             item["jobDescription"])),
        matched_search_name="search_name", seq=_seq())


def remoteok(payloads: DataFrame, profiles: DataFrame) -> DataFrame:
    """The first element of the response is a notice, not a listing."""
    item = F.col("item")
    place = tx.clean_text(F.coalesce(tx.filled(item["location"]), F.lit("Worldwide Remote")))
    return as_listing(
        items_of(payloads, REMOTEOK_ITEM, None).filter("pos >= 1"), "remoteok",
        id=tx.stable_id("remoteok-", tx.filled(item["id"]), item["url"]),
        title=tx.clean_text(item["position"]), company=tx.clean_text(item["company"]),
        location=F.concat(F.lit("🌐 Remote ("), place, F.lit(")")), job_url=tx.text(item["url"]),
        logo_url=item["company_logo"], post_date=item["date"], workplace_type=F.lit("Remote"),
        description=tx.clean_text(item["description"]), matched_search_name="search_name",
        seq=_seq())


def arbeitnow(payloads: DataFrame, profiles: DataFrame) -> DataFrame:
    item = F.col("item")
    remote = F.coalesce(item["remote"], F.lit(False))
    place = tx.clean_text(F.coalesce(tx.filled(item["location"]), F.lit("Europe / Remote")))
    return as_listing(
        items_of(payloads, ARBEITNOW_ITEM, "data"), "arbeitnow",
        id=tx.stable_id("arbeitnow-", tx.filled(item["slug"]), item["url"]),
        title=tx.clean_text(item["title"]), company=tx.clean_text(item["company_name"]),
        location=F.concat(F.when(remote, "🌐 Remote").otherwise("📍"), F.lit(" "), place),
        job_url=tx.text(item["url"]), post_date=tx.text(item["created_at"]),
        workplace_type=F.when(remote, "Remote").otherwise("On-site"),
        description=html_text(tx.text(item["description"])),
        matched_search_name="search_name", seq=_seq())


for _code, _source in {"ats": ats, "jobicy": jobicy, "remoteok": remoteok,
                       "arbeitnow": arbeitnow}.items():
    register_source(_code, _source)
