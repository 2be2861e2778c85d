"""Text, id, time and label functions, all as Column expressions.

Everything here stays inside the JVM: no Python runs per row. Missing text and
empty text are the same thing for most of these (``filled`` says where).
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from postsift.schema import AGE_OVER_A_DAY, DATE_WINDOW_CODES, DEFAULT_COLOR

# Java's \s is ASCII only unless (?U); \x1c-\x1f count as space in the data model.
_SPACE = r"(?U)[\s\x1c-\x1f]+"
_EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
# Date, hour, minute, second, fraction, offset sign, hours and minutes; extended and basic form.
_ISO = (r"^(\d{4})-(\d{2})-(\d{2})(?:[^\d](\d{2})(?::(\d{2})(?::(\d{2})(?:[.,](\d+))?)?)?"
        r"(?:Z|([+-])(\d{2})(?::?(\d{2}))?)?)?$")
_BASIC = (r"^(\d{4})(\d{2})(\d{2})(?:[^\d](\d{2})(?:(\d{2})(?:(\d{2})(?:[.,](\d+))?)?)?"
          r"(?:Z|([+-])(\d{2})(?::?(\d{2}))?)?)?$")


def text(c: Column) -> Column:
    """Null reads as the empty string."""
    return F.coalesce(c, F.lit(""))


def filled(c: Column) -> Column:
    """The empty string reads as null."""
    return F.nullif(c, F.lit(""))


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    An expression named inside a lambda is otherwise re-evaluated for every
    array element, which for a long description means one ``lower`` per keyword.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, _EDGE_SPACE, "")


def clean_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(text(c), _SPACE, " "))


def normalize_text(c: Column) -> Column:
    """ASCII letters and digits only; every other run becomes one space."""
    return F.trim(F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", " "))


def hex_color(c: Column, default: int = DEFAULT_COLOR) -> Column:
    """Value of hex digits after any number of ``#``; leading zeros do not count.

    A value that needs more than 15 digits is no colour and takes the default.
    """
    digits = F.regexp_extract(text(c), "^#*0*([0-9A-Fa-f]{1,15})$", 1)
    return F.coalesce(F.conv(filled(digits), 16, 10).cast("bigint"),
                      F.lit(default).cast("bigint"))


def as_of_literal(as_of: datetime) -> Column:
    return F.lit(as_of)


def parse_iso(c: Column) -> Column:
    """Timestamp of ISO text, UTC unless it names an offset; null when it is not ISO.

    Taken are dates alone, times to the hour, minute or second with any fraction (cut to
    microseconds) and offsets to the hour or minute, in the extended and the basic form.
    """
    def read(t: Column) -> Column:
        extended = t.rlike(_ISO)

        def part(i: int, default: str = "00") -> Column:
            found = F.when(extended, F.regexp_extract(t, _ISO, i)).otherwise(
                F.regexp_extract(t, _BASIC, i))
            return F.coalesce(filled(found), F.lit(default))

        stamp = F.concat(part(1), F.lit("-"), part(2), F.lit("-"), part(3), F.lit("T"), part(4),
                         F.lit(":"), part(5), F.lit(":"), part(6), F.lit("."),
                         F.substring(part(7, "0"), 1, 6), part(8, "+"), part(9), F.lit(":"), part(10))
        return F.when(extended | t.rlike(_BASIC), stamp.try_cast("timestamp"))

    return bind(strip(c), read)


def age_hours(post_date: Column, post_text: Column, as_of: Column) -> Column:
    """Hours since posting, from the ISO stamp, else from relative text, else null."""
    posted = parse_iso(post_date)
    elapsed = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(posted)) / F.lit(3.6e9)
    # greatest() skips nulls, so an unknown stamp has to be kept out of it.
    exact = F.when(elapsed.isNotNull(), F.greatest(elapsed, F.lit(0.0)))
    low = F.lower(text(post_text))
    minutes = filled(F.regexp_extract(low, r"(\d+)\s*minute", 1)).try_cast("double")
    hours = filled(F.regexp_extract(low, r"(\d+)\s*hour", 1)).try_cast("double")
    longer = F.when(low.rlike("day|week|month|year"), F.lit(AGE_OVER_A_DAY))
    return F.coalesce(exact, minutes / 60.0, hours, longer)


# Letters whose upper case is several letters, and the single one that stands for each here.
_LONG_UPPER = [chr(i) for i in range(0x80, 0x10000) if not 0xD800 <= i < 0xE000 and len(chr(i).upper()) > 1]
_ONE_UPPER = ["ẞ" if ch == "ß" else ch.title() if len(ch.title()) == 1 else ch for ch in _LONG_UPPER]


def title_case(c: Column) -> Column:
    """Upper-case every letter that does not follow a letter, lower-case the rest.

    One letter stays one letter: an eszett becomes the capital eszett, and a letter without
    a single upper-case form stays as it is.
    """
    chars = F.split(c, "")

    def upper(ch: Column) -> Column:
        single = F.translate(ch, "".join(_LONG_UPPER), "".join(_ONE_UPPER))
        return F.when(F.length(F.upper(ch)) == 1, F.upper(ch)).otherwise(single)

    return bind(chars, lambda cs: F.array_join(F.transform(
        cs, lambda ch, i: F.when(
            (i == 0) | ~F.coalesce(F.get(cs, i - 1), F.lit("")).rlike(r"\p{L}"),
            upper(ch)).otherwise(F.substring(F.lower(ch), 1, 1))), ""))


def slug_company(slug: Column) -> Column:
    return title_case(strip(F.translate(slug, "-_", "  ")))


def path_company(href: Column) -> Column:
    slug = filled(F.regexp_extract(href, "/jobs/([^/]+)/", 1))
    return F.coalesce(title_case(strip(F.translate(slug, "-", " "))),
                      F.lit("StagiiPeBune Company"))


def workplace_type(location: Column) -> Column:
    low = F.lower(text(location))
    return (F.when(F.contains(low, F.lit("remote")), F.lit("Remote"))
            .when(F.contains(low, F.lit("hybrid")), F.lit("Hybrid")))


def topic_tag(keywords: Column, board: str) -> Column:
    """First matching topic of a query, in the vocabulary of a remote board."""
    support, other = {"jobicy": ("supporting", "engineering"),
                      "remoteok": ("support", "tech")}[board]
    low = F.lower(text(keywords))

    def names(*words: str) -> Column:
        return low.rlike("|".join(words))

    return (F.when(names("security", "soc", "pentest", "cyber"), F.lit("security"))
            .when(names("devops", "cloud", "linux"), F.lit("devops"))
            .when(names("support", "helpdesk"), F.lit(support))
            .when(names("python"), F.lit("python"))
            .otherwise(F.lit(other)))


def first_term(keywords: Column, lower: bool = False) -> Column:
    """First alternative of an OR query, quotes dropped; ``it`` when there is none."""
    bare = F.regexp_replace(text(keywords), "[\"']", "")
    terms = F.filter(F.transform(F.split(bare, " OR "), strip), lambda t: t != "")
    term = F.coalesce(F.get(terms, F.lit(0)), F.lit("it"))
    return F.lower(term) if lower else term


def without_query(url: Column) -> Column:
    return F.substring_index(url, "?", 1)


def dash_number(url: Column) -> Column:
    """Digits after the last dash of a link, a trailing slash ignored; else null."""
    tail = F.substring_index(F.regexp_replace(url, "/+$", ""), "-", -1)
    return F.when(tail.rlike("^[0-9]+$"), tail)


def last_path_number(url: Column) -> Column:
    tail = F.substring_index(F.regexp_replace(url, "/+$", ""), "/", -1)
    return F.when(tail.rlike("^[0-9]+$"), tail)


def slug_number(url: Column) -> Column:
    """Digits closing the last path part as ``-123``; else null."""
    tail = F.substring_index(F.regexp_replace(url, "/+$", ""), "/", -1)
    return filled(F.regexp_extract(tail, "-([0-9]+)$", 1))


def stable_id(prefix: str, native: Column | None, url: Column) -> Column:
    """Source-prefixed id; a link hash stands in when the source gives none."""
    hashed = F.substring(F.sha2(text(url), 256), 1, 16)
    return F.concat(F.lit(prefix), hashed if native is None else F.coalesce(native, hashed))


def code_lookup(names: Column, codes: dict[str, str]) -> Column:
    """Codes of the known names, joined by commas; null when none is known."""
    table = F.create_map(*[F.lit(v) for pair in codes.items() for v in pair])
    found = F.filter(F.transform(names, lambda n: F.try_element_at(table, F.lower(n))),
                     lambda code: code.isNotNull())
    return filled(F.array_join(found, ","))


def date_window_code(name: Column) -> Column:
    table = F.create_map(*[F.lit(v) for pair in DATE_WINDOW_CODES.items() for v in pair])
    return F.try_element_at(table, name)


def date_window_hours(name: Column) -> Column:
    """The same window as a local age limit in hours; null means any age."""
    seconds = F.regexp_extract(text(date_window_code(name)), "^r([0-9]+)$", 1)
    return filled(seconds).cast("double") / 3600.0


def snippet(description: Column) -> Column:
    def shape(d: Column) -> Column:
        short = F.when(F.length(d) > 300, F.concat(F.substring(d, 1, 297), F.lit("...")))
        return F.concat(F.lit("> "), F.coalesce(short, d), F.lit("\n\n"))
    return (F.when(text(description) == "", F.lit(""))
            .otherwise(bind(clean_text(description), shape)))


def title_suffix_cut(title: Column) -> Column:
    return strip(F.get(F.split(title, r"(?U)\s+[|\-–]\s+", 2), F.lit(0)))


def epoch_ms_text(ms: Column) -> Column:
    """Epoch milliseconds as UTC text; zero and missing both give null."""
    return F.when(ms != 0, F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm:ss"))


def url_host(url: Column) -> Column:
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    return F.replace(host, F.lit("www."), F.lit(""))


def first_keyword(haystack: Column, keywords: Column) -> Column:
    """First keyword, in list order, found as a lower-cased substring; else null."""
    return bind(F.lower(text(haystack)), lambda low: F.get(
        F.filter(keywords, lambda k: F.contains(low, F.lower(k))), F.lit(0)))


def location_badge(location: Column, workplace: Column) -> Column:
    icon = F.when(F.contains(F.lower(workplace), F.lit("remote")), F.lit("🌐")).otherwise(F.lit("🏢"))
    badge = F.concat(icon, F.lit(" "), location, F.lit(" ("), workplace, F.lit(")"))
    return F.when(filled(workplace).isNotNull(), badge).otherwise(location)


def posted_label(post_text: Column, post_date: Column) -> Column:
    return F.coalesce(filled(post_text), filled(post_date), F.lit("Recently"))


def role_details(employment: Column, seniority: Column) -> Column:
    """Present parts joined by a bullet; null when both are missing."""
    return filled(F.concat_ws(" • ", filled(employment), filled(seniority)))


def form_encode(c: Column) -> Column:
    """Form encoding: space is plus, only letters, digits and ``_.-~`` stay."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")),
                     F.lit("%7E"), F.lit("~"))


def path_encode(c: Column) -> Column:
    return F.replace(F.replace(form_encode(c), F.lit("+"), F.lit("%20")),
                     F.lit("%2F"), F.lit("/"))


def names_bucharest(location: Column) -> Column:
    return F.lower(text(location)).rlike("bucharest|bucuresti")


def clipped(c: Column, n: int, missing: str = "—") -> Column:
    return F.substring(F.coalesce(filled(c), F.lit(missing)), 1, n)
