"""Rules, text functions and ages on known cases and against plain restatements."""

import re
from datetime import datetime, timedelta, timezone

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plain import normal
from postsift.functions import rules
from postsift.functions import text as tx
from postsift.plans.views import profiles_from_searches
from postsift.schema import (
    ALL_STATUSES,
    DATE_WINDOW_CODES,
    JUNIOR_DESCRIPTION_EXCLUDE,
    TRACKER_STATUSES,
    Settings,
)

NOW = datetime(2024, 1, 31, tzinfo=timezone.utc)
SCHEMA = ("id string, title string, company string, location string, post_date string, "
          "post_text string, description string")


def listings(spark, *rows):
    full = [(str(i), *row) for i, row in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def verdicts(spark, filters, *rows):
    profile = profiles_from_searches(spark, [{"name": "P", "filters": filters}])
    judged = listings(spark, *rows).join(F.broadcast(profile.select("filters")), F.lit(True))
    reason = rules.first_reason(F.col("filters"), F.lit(NOW))
    shown = judged.select("id", "company", "location", reason.alias("r")).select(
        "id", F.col("r.code").alias("code"), F.col("r.arg").alias("arg"),
        rules.reason_text(F.col("r.code"), F.col("r.arg")).alias("prose"))
    return [(r.code, r.arg, r.prose) for r in shown.orderBy(F.col("id").cast("int")).collect()]


def test_chain_on_known_listings(spark):
    filters = {"companies_exclude": ["Crumb"], "description_must_exclude": ["own car"],
               "title_must_include": ["Baker", "Miller"], "title_must_exclude": ["Night", "Chief"]}
    got = verdicts(
        spark, filters,
        ("Clerk", "Oven House", None, None, None, ""),
        ("Miller", "Stone Mill", "Cluj", None, None, "Bring your OWN CAR and a coat"),
        ("Chief Miller", "Stone Mill", "Cluj", None, None, "own car"),
        ("Bakers' Help", "Golden Crumb Ltd", None, None, None, None),
        ("Baker", "Oven House", "Cluj", None, None, "Early shifts"))
    assert [g[0] for g in got] == ["TITLE_NOT_INCLUDED", "DESCRIPTION_EXCLUDED", "TITLE_EXCLUDED",
                                   "COMPANY_EXCLUDED", None]
    assert [g[1] for g in got] == [None, "own car", "Chief", "Crumb", None]
    assert got[2][2] == "Title contains excluded keyword: 'Chief'"
    assert got[3][2] == "Company 'Golden Crumb Ltd' is in blacklist (Crumb)"
    assert got[4][2] == "Passed all filters"


def test_freshness_and_missing_text(spark):
    rows = [("Helpdesk", "Acme", None, None, text, None)
            for text in ("12 minutes ago", "59 minutes ago", "2 days ago", None)]
    got = verdicts(spark, {"max_age_hours": 0.5}, *rows)
    assert [g[0] for g in got] == [None, "TOO_OLD", "TOO_OLD", None]
    assert got[1][1] == "1.0" and got[2][1] == "10000.0"
    # A limit of zero is a limit, and description rules need a description.
    got = verdicts(spark, {"max_age_hours": 0, "description_must_include": ["x"]},
                   ("T", "C", "", "2024-01-30T23:59:59Z", None, ""),
                   ("T", "C", "", None, None, ""), ("T", "C", "", None, None, "y"))
    assert [g[0] for g in got] == ["TOO_OLD", None, "DESCRIPTION_NOT_INCLUDED"]


def test_locations(spark):
    got = verdicts(spark, {"location_must_include": ["Bucharest"], "location_must_exclude": ["sector"]},
                   ("T", "C", None, None, None, None), ("T", "C", "BUCHAREST", None, None, None),
                   ("T", "C", "Bucharest Sector 1", None, None, None))
    assert [g[0] for g in got] == ["LOCATION_NOT_INCLUDED", None, "LOCATION_EXCLUDED"]


def junior(spark, settings_, *rows):
    reason = rules.junior_reason(settings_)
    shown = listings(spark, *rows).select("id", reason.alias("r"))
    return [r.r and r.r.code for r in shown.orderBy(F.col("id").cast("int")).collect()]


def test_junior_filter(spark):
    rows = [("Senior SOC Analyst", "A", None, None, None, None),
            ("SOC Analyst", "A", None, None, None, None),
            ("Cybersecurity Specialist", "A", None, None, None, "Candidates need 5+ years."),
            ("Leadership Trainee", "A", None, None, None, None),
            ("Analyst", "A", None, None, None, "an internship")]
    assert junior(spark, Settings(), *rows) == [
        "JUNIOR_TITLE", None, "JUNIOR_DESCRIPTION", "JUNIOR_TITLE", None]
    assert junior(spark, Settings(junior_filter_strict=True), *rows) == [
        "JUNIOR_TITLE", "JUNIOR_MISSING", "JUNIOR_DESCRIPTION", "JUNIOR_TITLE", None]
    assert junior(spark, Settings(junior_filter_enabled=False), *rows) == [None] * 5
    # An empty override falls back to the built-in list.
    assert junior(spark, Settings(junior_title_exclude_keywords=()), *rows)[0] == "JUNIOR_TITLE"


def test_vocabularies():
    assert set(TRACKER_STATUSES) < set(ALL_STATUSES)
    assert DATE_WINDOW_CODES["past_30min"] == "r1800"
    for word in ("5+ ani", "minim 5 ani", "peste 5 ani", "5 ani de experienta"):
        assert word in JUNIOR_DESCRIPTION_EXCLUDE


def ages(spark, *pairs):
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "n int, d string, t string")
    return [r.a for r in frame.select("n", tx.age_hours(F.col("d"), F.col("t"), F.lit(NOW)).alias("a"))
            .orderBy("n").collect()]


def test_ages(spark):
    def iso(**back):
        return (NOW - timedelta(**back)).replace(tzinfo=None).isoformat()

    got = ages(spark, (None, "12 minutes ago"), (None, "45 minutes ago"), (None, "1 hour ago"),
               (None, "2 days ago"), (None, None), (iso(minutes=10), None), (iso(hours=2), None),
               ("2024-01-30", None), ("2024-02-05", None), ("1756634400", None),
               ("Mon, 01 Jan 2024", "3 hours ago"), ("2026", None), ("10:00", None),
               ("2024-01-30T23:00:00+02:00", None), (" 2024-01-30T23:00:00.500Z ", None),
               ("2024-13-40", "1 minute ago"))
    assert got == [0.2, 0.75, 1.0, 10000.0, None, 10 / 60, 2.0, 24.0, 0.0, None, 3.0, None, None,
                   3.0, 1 - 0.5 / 3600, 1 / 60]


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column.alias("x")).first().x


def test_small_functions(spark):
    v = F.col("v")
    assert one(spark, tx.normalize_text(v), "IT-Support  Specialist!") == "it support specialist"
    assert one(spark, tx.normalize_text(v), "București") == "bucure ti"
    assert one(spark, tx.normalize_text(v), None) == ""
    assert one(spark, tx.hex_color(v), "#3776AB") == 0x3776AB
    assert one(spark, tx.hex_color(v), "#zz") == one(spark, tx.hex_color(v), None) == 0x0A66C2
    assert one(spark, tx.slug_company(v), "x2y_o'neil-co") == "x2y_o'neil-co".replace(
        "-", " ").replace("_", " ").strip().title()
    assert one(spark, tx.path_company(v), "/careers/x") == "StagiiPeBune Company"
    assert one(spark, tx.url_host(v), "https://www.a.ro:80/x?y") == "a.ro:80"
    assert one(spark, tx.title_suffix_cut(v), "A-b – Careers | X") == "A-b"
    assert one(spark, tx.form_encode(v), "a b*~é&") == "a+b%2A~%C3%A9%26"
    assert len(one(spark, tx.snippet(v), "x " * 400)) == 2 + 300 + 2
    assert one(spark, tx.snippet(v), None) == ""


@settings(max_examples=8, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(st.lists(st.text(st.sampled_from("aB1 \t\n  é-ß\x1f.+"), max_size=20),
                min_size=20, max_size=60),
       st.lists(st.sampled_from(["a", "B1", "é", "-", "ß", ""]), max_size=4))
def test_text_functions_equal_restatements(spark, texts, keywords):
    frame = spark.createDataFrame(list(enumerate(texts)), "n int, v string")
    v, words = F.col("v"), rules.words(keywords)
    got = frame.select("n", tx.clean_text(v).alias("clean"), tx.normalize_text(v).alias("norm"),
                       tx.first_keyword(v, words).alias("hit")).orderBy("n").collect()
    for text, row in zip(texts, got):
        assert row.clean == re.sub(r"\s+", " ", text).strip()
        assert row.norm == normal(text)
        assert row.hit == next((k for k in keywords if k.lower() in text.lower()), None)


@pytest.mark.parametrize("text, want", [
    ("2024-01-30T10", "2024-01-30 10:00:00"), ("2024-01-30T10:00:00+02", "2024-01-30 08:00:00"),
    ("20240130T101500Z", "2024-01-30 10:15:00"), ("2024-01-30 10:15:00,5-0130", "2024-01-30 11:45:00.5"),
    ("20240130", "2024-01-30 00:00:00"), ("2024-01-30", "2024-01-30 00:00:00"), ("2024-1-30", None),
    ("2024-01-30T", None), ("soon", None), ("2024-13-01", None)])
def test_iso_stamps(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(
        F.regexp_replace(tx.parse_iso(F.col("t")).cast("string"), r"\.0+$", "").alias("x")).first().x
    assert got == want


def test_leading_zeros_of_a_colour(spark):
    df = spark.createDataFrame([("#" + "0" * 40 + "ff",), ("#" + "f" * 40,)], "c string")
    assert [r.x for r in df.select(tx.hex_color(F.col("c"), 7).alias("x")).collect()] == [255, 7]
