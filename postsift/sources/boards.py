"""Listing extraction from landed web pages.

Payload tables have ``payload_seq BIGINT, search_name, search_location, page INT, url,
body``. One operator, ``card_rows``, serves every board: a spec says which nodes
are cards and how a card becomes a listing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsift.functions import text as tx
from postsift.operators.claim import keep_first, page_cutoff
from postsift.schema import LISTING
from postsift.session import broadcast_if_small, cut_lineage
from postsift.sources import html as h
from postsift.sources.registry import as_listing, register_source

# Positions inside one payload; the payload number takes the remaining bits of seq.
POSITION_BITS = 20
Fields = dict[str, Column]


@dataclass(frozen=True)
class CardSpec:
    """How one board marks up its listings."""

    code: str
    is_card: h.Test
    fields: Callable[[Column, Column], Fields]
    keep: Callable[[Column], Column]
    # Repeats inside a page, by this field: keep the first row, or the last one in its place.
    unique_by: str | None = None
    keep_last: bool = False


def payload_seq(payload: Column, position: Column) -> Column:
    fits = position < (1 << POSITION_BITS)
    return F.when(fits, F.shiftleft(payload.cast("bigint"), POSITION_BITS) + position).otherwise(
        F.raise_error(F.lit("too many listings in one payload")).cast("bigint"))


def _unique(cards: Column, field: str, keep_last: bool) -> Column:
    def dedup(rows: Column) -> Column:
        keys = F.transform(rows, lambda r: r[field])
        first = F.filter(rows, lambda r, i: F.array_position(keys, r[field]) == i + 1)
        if not keep_last:
            return first
        return F.transform(first, lambda r: F.try_element_at(
            F.filter(rows, lambda other: other[field] == r[field]), F.lit(-1)))
    return tx.bind(cards, dedup)


def card_rows(payloads: DataFrame, spec: CardSpec, body: str = "body") -> DataFrame:
    """One row per kept card: the payload columns, ``pos``, and the ``card`` struct."""
    def build(nodes: Column, node: Column) -> Column:
        return F.struct(*[c.alias(name) for name, c in spec.fields(nodes, node).items()])

    cards = F.filter(h.each(F.col("nodes"), spec.is_card, build), spec.keep)
    if spec.unique_by:
        cards = _unique(cards, spec.unique_by, spec.keep_last)
    return (payloads.withColumn("nodes", h.page_nodes(F.col(body)))
            .withColumn("cards", cards).drop("nodes", body)
            .select("*", F.posexplode_outer("cards").alias("pos", "card")).drop("cards")
            .filter("pos IS NOT NULL"))


def absolute(base: str, href: Column) -> Column:
    return F.when(F.startswith(href, F.lit("http")), href).otherwise(F.concat(F.lit(base), href))


# --- LinkedIn -----------------------------------------------------------------

def _linkedin_fields(nodes: Column, card: Column) -> Fields:
    inside = h.below(nodes, card)
    company_node = h.first_of(inside, h.tagged("h4", "base-search-card__subtitle"))
    company_link = tx.bind(company_node, lambda n: h.attr(
        h.first_of(h.below(nodes, n), h.tagged("a")), "href"))
    time_node = h.first_of(inside, h.tagged("time"))
    link_node = h.first_of(inside, h.tagged("a", "base-card__full-link"))
    link = tx.text(tx.without_query(h.attr(link_node, "href")))
    urn = h.attr(card, "data-entity-urn")
    urn_id = F.when(F.contains(urn, F.lit(":")), tx.filled(F.substring_index(urn, ":", -1)))
    listing_id = F.coalesce(urn_id, tx.dash_number(link))
    image = h.first_of(inside, h.tagged("img"))
    logo = F.coalesce(tx.filled(h.attr(image, "data-delayed-url")), h.attr(image, "src"))
    location = F.coalesce(
        h.text_of(nodes, h.first_of(inside, h.tagged("span", "job-search-card__location"))),
        F.lit("Unknown Location"))
    return {
        "id": listing_id,
        "title": tx.text(h.text_of(nodes, h.first_of(
            inside, h.tagged("h3", "base-search-card__title")))),
        "company": F.coalesce(h.text_of(nodes, company_node), F.lit("Unknown Company")),
        "location": location,
        "job_url": F.coalesce(tx.filled(link), F.concat(
            F.lit("https://www.linkedin.com/jobs/view/"), listing_id)),
        "company_url": tx.without_query(tx.filled(company_link)),
        "logo_url": F.when(~F.contains(logo, F.lit("data:image")), logo),
        "post_date": h.attr(time_node, "datetime"),
        "post_text": h.text_of(nodes, time_node),
        "workplace_type": tx.workplace_type(location),
        "salary": h.text_of(nodes, h.first_of(
            inside, h.tagged("span", "job-search-card__salary-info"))),
    }


_LINKEDIN_COLUMNS = ["id", "title", "company", "location", "job_url", "company_url", "logo_url",
                     "post_date", "post_text", "workplace_type", "salary"]
LINKEDIN = CardSpec("linkedin", h.tagged("div", "job-search-card"), _linkedin_fields,
                    lambda c: c["id"].isNotNull() & (c["title"] != ""))


def extract_details(payloads: DataFrame, body: str = "body", keep: list[str] | None = None) -> DataFrame:
    """Detail pages ``(id, body)`` to the columns that enrich a listing; ``keep`` names further ones."""
    nodes = F.col("nodes")
    items = F.transform(
        F.filter(nodes, h.tagged("li", "description__job-criteria-item")),
        lambda item: tx.bind(h.below(nodes, item), lambda sub: F.struct(
            h.text_of(nodes, h.first_of(
                sub, h.tagged("h3", "description__job-criteria-subheader"))).alias("k"),
            h.text_of(nodes, h.first_of(
                sub, h.tagged("span", "description__job-criteria-text"))).alias("v"))))
    # A repeated header keeps its last value, as assignment into a map would.
    named = F.filter(items, lambda e: e["k"].isNotNull() & e["v"].isNotNull())
    criteria = F.map_from_entries(tx.bind(named, lambda rows: F.filter(
        rows, lambda e, i: ~F.exists(F.slice(rows, i + 2, F.size(rows)),
                                     lambda later: later["k"] == e["k"]))))
    markup = h.first_of(nodes, h.tagged("div", "show-more-less-html__markup"))
    top = h.first_of(nodes, h.tagged("img", "artdeco-entity-image"))
    return (payloads.withColumn("nodes", h.page_nodes(F.col(body))).select(
        "id", *(keep or []),
        criteria.alias("detail_criteria"),
        tx.bind(markup, lambda n: F.when(
            n.isNotNull(), h.line_text(h.below(nodes, n)))).alias("detail_description"),
        h.text_of(nodes, h.first_of(nodes, h.tagged("span", "num-applicants__caption")))
        .alias("detail_applicants"),
        F.coalesce(tx.filled(h.attr(top, "data-delayed-url")), h.attr(top, "src"))
        .alias("detail_logo_url")))


def linkedin(payloads: DataFrame, profiles: DataFrame) -> DataFrame:
    """Cards of the pages before the first empty one, the first of each id per search.

    The page limit is the profile's ``pages`` where it has been worked out, else its
    ``max_pages``.
    """
    # Read for the page counts and for the cards: parsed once, not twice.
    rows = cut_lineage(card_rows(payloads, LINKEDIN))
    counts = rows.groupBy("search_name", "page").agg(F.count("*").alias("cards"))
    limit = "pages" if "pages" in profiles.columns else "max_pages"
    limits = profiles.select("search_name", F.col(limit).alias("max_pages"))
    pages = (payloads.select("search_name", "page").distinct()
             .join(counts, ["search_name", "page"], "left").fillna(0, ["cards"])
             .join(broadcast_if_small(limits), "search_name", "left"))
    kept = page_cutoff(rows, pages, ["search_name"])
    listings = as_listing(kept, "linkedin", **{n: f"card.{n}" for n in _LINKEDIN_COLUMNS},
                          matched_search_name="search_name",
                          seq=payload_seq(F.col("payload_seq"), F.col("pos")))
    return keep_first(listings, ["matched_search_name", "id"], "seq").select(LISTING.names)


# --- The Romanian boards --------------------------------------------------------

EJOBS_BASE = "https://www.ejobs.ro"


def _ejobs_fields(nodes: Column, heading: Column) -> Fields:
    parent = F.coalesce(h.ancestor(nodes, heading, h.tagged("div")),
                        h.ancestor(nodes, heading, h.tagged("li")))

    def build(box: Column) -> Column:
        inside = h.below(nodes, box)
        link = F.coalesce(h.first_of(h.below(nodes, heading), h.tagged("a")),
                          h.first_of(inside, h.tagged("a")))

        def names_pay(n: Column) -> Column:
            return tx.bind(F.lower(h.joined_text(h.below(nodes, n))), lambda t: (
                (n["tag"].isin("span", "div") & F.contains(t, F.lit("lei")))
                | F.contains(t, F.lit("€"))))

        pay = h.first_of(inside, lambda n: ~F.startswith(n["tag"], F.lit("#")) & names_pay(n))
        return F.struct(
            h.attr(link, "href").alias("href"),
            F.coalesce(h.text_of(nodes, h.first_of(inside, h.tagged("h3"))),
                       F.lit("eJobs Employer")).alias("company"),
            h.text_of(nodes, pay).alias("salary"))

    # A heading outside any box gives no listing: its href stays null.
    found = tx.bind(parent, lambda box: F.when(box.isNotNull(), build(box)))
    return {"title": h.text_of(nodes, heading), "found": found}


EJOBS = CardSpec(
    "ejobs", h.tagged("h2"), _ejobs_fields,
    lambda c: (F.contains(c["found"]["href"], F.lit("/locuri-de-munca/"))
               & ~F.contains(c["found"]["href"], F.lit("salarii"))))


def ejobs(payloads: DataFrame, profiles: DataFrame) -> DataFrame:
    rows = card_rows(payloads, EJOBS).withColumn("url", absolute(EJOBS_BASE,
                                                                 F.col("card.found.href")))
    url = F.col("url")
    return as_listing(
        rows, "ejobs", id=tx.stable_id("ejobs-", tx.last_path_number(url), url),
        title="card.title", company="card.found.company", salary="card.found.salary",
        location=F.when(tx.names_bucharest(F.col("search_location")), "Bucharest, Romania")
        .otherwise("Romania"),
        job_url="url", matched_search_name="search_name",
        seq=payload_seq(F.col("payload_seq"), F.col("pos")))


BESTJOBS_BASE = "https://www.bestjobs.eu"


def _bestjobs_fields(nodes: Column, anchor: Column) -> Fields:
    box = h.ancestor(nodes, anchor, h.tagged("div"))

    def build(card: Column) -> Column:
        inside = h.below(nodes, card)
        heading = h.first_of(inside, h.tagged("h2"))
        grey = h.first_of(inside, lambda n: (n["tag"] == "div") & F.contains(
            F.coalesce(h.attr(n, "class"), F.lit("")), F.lit("text-ink-medium")))
        return F.struct(
            tx.text(F.coalesce(h.text_of(nodes, heading),
                               tx.clean_text(h.attr(anchor, "aria-label")))).alias("title"),
            F.coalesce(h.text_of(nodes, grey), F.lit("BestJobs Employer")).alias("company"))

    found = tx.bind(box, lambda card: F.when(card.isNotNull(), build(card)))
    href = h.attr(anchor, "href")
    return {"href": href, "found": found,
            "id": tx.stable_id("bestjobs-", tx.slug_number(href), href)}


BESTJOBS = CardSpec(
    "bestjobs",
    lambda n: (n["tag"] == "a") & F.startswith(h.attr(n, "href"), F.lit("/loc-de-munca/")),
    _bestjobs_fields, lambda c: c["found"]["title"] != "", unique_by="id", keep_last=True)


def bestjobs(payloads: DataFrame, profiles: DataFrame) -> DataFrame:
    place = tx.filled(F.col("search_location"))
    return as_listing(
        card_rows(payloads, BESTJOBS), "bestjobs", id="card.id", title="card.found.title",
        company="card.found.company",
        location=F.coalesce(F.concat(place, F.lit(", Romania")), F.lit("Romania")),
        job_url=absolute(BESTJOBS_BASE, F.col("card.href")),
        matched_search_name="search_name", seq=payload_seq(F.col("payload_seq"), F.col("pos")))


HIPO_BASE = "https://www.hipo.ro"


def _anchor_fields(nodes: Column, anchor: Column) -> Fields:
    return {"href": h.attr(anchor, "href"), "title": h.text_of(nodes, anchor)}


def _hipo_fields(nodes: Column, anchor: Column) -> Fields:
    title = h.text_of(nodes, anchor)

    def employer(card: Column) -> Column:
        inside = h.below(nodes, card)
        named = F.coalesce(h.first_of(inside, h.tagged("h3")),
                           h.first_of(inside, h.tagged_any("strong", "b")))
        return tx.bind(h.text_of(nodes, named), lambda name: F.when(
            F.lower(name) != F.lower(title), tx.filled(name)))

    company = tx.bind(h.ancestor(nodes, anchor, h.tagged_any("div", "li", "article")),
                      lambda card: F.when(card.isNotNull(), employer(card)))
    return {"href": h.attr(anchor, "href"), "title": title,
            "company": F.coalesce(company, F.lit("Hipo.ro Employer"))}


HIPO = CardSpec(
    "hipo",
    lambda n: (n["tag"] == "a") & F.contains(h.attr(n, "href"), F.lit("/oferta-de-angajare/")),
    _hipo_fields, lambda c: c["title"] != "", unique_by="href")


def hipo(payloads: DataFrame, profiles: DataFrame) -> DataFrame:
    href = F.col("card.href")
    return as_listing(
        card_rows(payloads, HIPO), "hipo", id=tx.stable_id("hipo-", None, href),
        title="card.title", company="card.company", location=F.lit("Bucharest, Romania"),
        job_url=absolute(HIPO_BASE, href), matched_search_name="search_name",
        seq=payload_seq(F.col("payload_seq"), F.col("pos")))


STAGII_BASE = "https://stagiipebune.ro"
STAGII = CardSpec(
    "stagiipebune",
    lambda n: (n["tag"] == "a") & h.attr(n, "href").rlike("^/jobs/[^/]+/.+"),
    _anchor_fields,
    lambda c: (F.length(c["title"]) >= 4) & ~c["title"].rlike("^[0-9]+$"), unique_by="href")


def stagiipebune(payloads: DataFrame, profiles: DataFrame) -> DataFrame:
    href = F.col("card.href")
    tail = F.substring_index(F.regexp_replace(href, "/+$", ""), "-", -1)
    return as_listing(
        card_rows(payloads, STAGII), "stagiipebune",
        id=tx.stable_id("spb-", tx.filled(tail), href), title="card.title",
        company=tx.path_company(href), location=F.lit("Bucharest, Romania"),
        job_url=absolute(STAGII_BASE, href), matched_search_name="search_name",
        seq=payload_seq(F.col("payload_seq"), F.col("pos")))


# --- Company career pages -------------------------------------------------------

def career_titles(payloads: DataFrame, body: str = "body") -> DataFrame:
    """``(…, title)`` of each page: suffix cut, pages without a usable title dropped."""
    title = tx.title_suffix_cut(h.page_title(F.col("nodes")))
    return (payloads.withColumn("nodes", h.page_nodes(F.col(body)))
            .withColumn("title", title).drop("nodes", body)
            .filter(F.length("title") >= 4)
            .withColumn("title", F.substring("title", 1, 120)))


def google(payloads: DataFrame, profiles: DataFrame) -> DataFrame:
    """Found career pages, the first of each address per search."""
    first = keep_first(payloads.filter(tx.filled(F.col("url")).isNotNull()),
                       ["search_name", "url"], "payload_seq")
    url = F.col("url")
    return as_listing(
        career_titles(first), "google", id=tx.stable_id("google-", None, url), title="title",
        company=tx.url_host(url), location=F.lit("Bucharest, Romania"), job_url=url,
        matched_search_name="search_name", seq=payload_seq(F.col("payload_seq"), F.lit(0)))


for _code, _source in {"linkedin": linkedin, "ejobs": ejobs, "bestjobs": bestjobs, "hipo": hipo,
                       "stagiipebune": stagiipebune, "google": google}.items():
    register_source(_code, _source)
