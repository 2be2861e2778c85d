"""Table schemas and fixed vocabularies shared by every module."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Status vocabulary, keyword lists and code tables. These must
# equal the published behaviour for results to agree, so they are stated as is.
# ---------------------------------------------------------------------------
TRACKER_STATUSES = ["NEW", "APPLIED", "INTERVIEWING", "OFFER", "REJECTED", "HIDDEN"]
SYSTEM_STATUSES = ["FILTERED", "FILTERED_DESC", "DUPLICATE", "SEND_FAILED"]
ALL_STATUSES = TRACKER_STATUSES + SYSTEM_STATUSES
# Only these count as an existing listing for similarity dedup.
CANDIDATE_STATUSES = ["NEW", "APPLIED", "INTERVIEWING", "OFFER", "REJECTED"]
LEGACY_STATUS, LEGACY_STATUS_BECOMES = "NOTIFIED", "NEW"

JUNIOR_INCLUDE = [
    "junior", "intern", "internship", "entry level", "entry-level", "entry",
    "graduate", "trainee", "stagiu", "practica", "practică",
]
JUNIOR_TITLE_EXCLUDE = [
    "senior", "lead", "manager", "principal", "staff", "director",
    "head of", "architect", "vp", "vice president", "head",
]
JUNIOR_DESCRIPTION_EXCLUDE = [
    "5+ years", "5-7 years", "5 - 7 years", "6+ years", "7+ years",
    "8+ years", "10+ years", "at least 5 years", "minimum 5 years",
    "minimum of 5 years", "minim 5 ani", "peste 5 ani", "5+ ani",
    "5 ani experienta", "5 ani de experienta", "cel putin 5 ani",
]

LOCATION_HINTS = ["bucharest", "bucuresti", "bucurești", "romania", "românia", "remote"]

WORKPLACE_CODES = {
    "on_site": "1", "on-site": "1", "onsite": "1", "remote": "2", "hybrid": "3",
}
EXPERIENCE_CODES = {
    "internship": "1", "entry_level": "2", "entry-level": "2", "entry": "2",
    "associate": "3", "mid_senior": "4", "mid-senior": "4",
    "mid_senior_level": "4", "mid": "4", "director": "5", "executive": "6",
}
JOB_TYPE_CODES = {
    "full_time": "F", "full-time": "F", "fulltime": "F",
    "part_time": "P", "part-time": "P", "parttime": "P",
    "contract": "C", "temporary": "T", "internship": "I", "volunteer": "V",
}
DATE_WINDOW_CODES = {
    "past_30min": "r1800", "30min": "r1800",
    "past_hour": "r3600", "1h": "r3600", "hour": "r3600",
    "past_24h": "r86400", "24h": "r86400",
    "past_week": "r604800", "week": "r604800",
    "past_month": "r2592000", "month": "r2592000",
}
RECENT_SORTS = ["recent", "DD", "date"]

# Source code -> display name, in registry order.
PLATFORM_NAMES = {
    "linkedin": "LinkedIn",
    "ejobs": "eJobs.ro",
    "bestjobs": "BestJobs",
    "hipo": "Hipo.ro",
    "stagiipebune": "StagiiPeBune",
    "ats": "Company ATS",
    "google": "Google",
    "jobicy": "Jobicy",
    "remoteok": "RemoteOK",
    "arbeitnow": "Arbeitnow",
}
DEFAULT_PLATFORMS = [
    "linkedin", "ejobs", "bestjobs", "hipo", "stagiipebune", "ats",
    "jobicy", "remoteok", "arbeitnow",
]
PLATFORM_ICONS = {
    "linkedin": "https://cdn-icons-png.flaticon.com/512/3536/3536505.png",
    "ejobs": "https://static.ejobs.ro/img/logos/ejobs-share.png",
    "bestjobs": "https://www.bestjobs.eu/favicon.ico",
    "hipo": "https://www.hipo.ro/favicon.ico",
    "stagiipebune": "https://stagiipebune.ro/favicon.ico",
    "ats": "https://cdn-icons-png.flaticon.com/512/2913/2913091.png",
    "google": "https://www.google.com/favicon.ico",
    "jobicy": "https://jobicy.com/assets/images/logo.png",
    "remoteok": "https://remoteok.com/assets/favicon-96x96.png",
    "arbeitnow": "https://www.arbeitnow.com/favicon-32x32.png",
}
DEFAULT_ICON = "https://cdn-icons-png.flaticon.com/512/3536/3536505.png"
DEFAULT_COLOR_HEX = "#0A66C2"
DEFAULT_COLOR = 0x0A66C2
ROUTE_PLACEHOLDER = "YOUR_WEBHOOK"

SIMILARITY_THRESHOLD = 0.85
TOKEN_COVERAGE = 0.75
TOKEN_RATIO = 0.7
AGE_OVER_A_DAY = 10000.0
CARDS_PER_PAGE = 25
PURGE_DAYS = 60
# ---------------------------------------------------------------------------

LISTING = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("title", T.StringType(), False),
    T.StructField("company", T.StringType(), False),
    T.StructField("location", T.StringType(), False),
    T.StructField("job_url", T.StringType(), False),
    T.StructField("company_url", T.StringType()),
    T.StructField("logo_url", T.StringType()),
    T.StructField("post_date", T.StringType()),
    T.StructField("post_text", T.StringType()),
    T.StructField("workplace_type", T.StringType()),
    T.StructField("employment_type", T.StringType()),
    T.StructField("seniority_level", T.StringType()),
    T.StructField("salary", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("applicants", T.StringType()),
    T.StructField("criteria", T.MapType(T.StringType(), T.StringType())),
    T.StructField("matched_search_name", T.StringType()),
    T.StructField("platform", T.StringType()),
    T.StructField("platform_icon", T.StringType()),
    T.StructField("platform_code", T.StringType()),
    T.StructField("seq", T.LongType()),
])

# A landed response: who asked for it, which page it was, and its raw body.
PAYLOAD = T.StructType([
    T.StructField("payload_seq", T.LongType(), False),
    T.StructField("platform_code", T.StringType(), False),
    T.StructField("search_name", T.StringType()),
    T.StructField("search_location", T.StringType()),
    T.StructField("page", T.IntegerType()),
    T.StructField("url", T.StringType()),
    T.StructField("ats", T.StringType()),
    T.StructField("board", T.StringType()),
    T.StructField("body", T.StringType()),
])

KEYWORD_FIELDS = [
    "title_must_include", "title_must_exclude",
    "description_must_include", "description_must_exclude",
    "companies_include", "companies_exclude",
    "location_must_include", "location_must_exclude",
]

_WORDS = T.ArrayType(T.StringType())

FILTERS = T.StructType(
    [T.StructField(name, _WORDS) for name in KEYWORD_FIELDS]
    + [T.StructField("max_age_hours", T.DoubleType()),
       T.StructField("min_salary", T.DoubleType())]
)

# One search as written in a config file; every field may be missing.
RAW_PROFILE = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("enabled", T.BooleanType()),
    T.StructField("webhook_url", T.StringType()),
    T.StructField("role_id_to_mention", T.StringType()),
    T.StructField("embed_color", T.StringType()),
    T.StructField("keywords", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("date_posted", T.StringType()),
    T.StructField("sort_by", T.StringType()),
    T.StructField("workplace_types", _WORDS),
    T.StructField("experience_levels", _WORDS),
    T.StructField("job_types", _WORDS),
    T.StructField("filters", FILTERS),
    T.StructField("max_pages", T.IntegerType()),
    T.StructField("platforms", _WORDS),
])

STATE = T.StructType([
    T.StructField("job_id", T.StringType(), False),
    T.StructField("search_name", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("company", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("platform", T.StringType()),
    T.StructField("discovered_at", T.TimestampType()),
    T.StructField("notified_at", T.TimestampType()),
    T.StructField("status", T.StringType()),
])

STATE_LOG = T.StructType(STATE.fields + [
    T.StructField("version_ts", T.TimestampType(), False),
    T.StructField("op_seq", T.LongType(), False),
    T.StructField("deleted", T.BooleanType(), False),
])

SCAN_LOG = T.StructType([
    T.StructField("search_name", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("jobs_found", T.LongType()),
    T.StructField("jobs_new", T.LongType()),
    T.StructField("jobs_notified", T.LongType()),
    T.StructField("duration_seconds", T.DoubleType()),
])


@dataclass(frozen=True)
class Settings:
    """Global limits and switches; they reach the plan as literals."""

    default_route: str | None = None
    check_interval_minutes: int = 15
    request_delay_seconds: float = 3.0
    max_pages_per_search: int = 1
    fetch_job_details: bool = True
    database_path: str = "data/jobs.db"
    log_level: str = "INFO"
    junior_filter_enabled: bool = True
    junior_filter_strict: bool = False
    junior_include_keywords: tuple[str, ...] | None = None
    junior_title_exclude_keywords: tuple[str, ...] | None = None
    junior_description_exclude_keywords: tuple[str, ...] | None = None
    as_of: datetime = datetime(2024, 1, 31, tzinfo=timezone.utc)

# Sources whose landed responses are JSON.
JSON_SOURCES = ["ats", "jobicy", "remoteok", "arbeitnow"]

REJECTS = T.StructType([
    T.StructField("payload_seq", T.LongType()),
    T.StructField("platform_code", T.StringType()),
    T.StructField("search_name", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("detail", T.StringType()),
])
