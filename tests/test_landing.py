"""Detail pages as a stream, rejects, failing sources and batches, scans by interval."""

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from postsift.operators.reports import scans_by_interval
from postsift.operators.state import StateTables
from postsift.plans import views
from postsift.schema import LISTING, PAYLOAD, SCAN_LOG
from postsift.sources import registry, rejects
from postsift.streaming import poll
from postsift.streaming.enriched import enriched_cards

AS_OF = datetime(2024, 1, 31, tzinfo=timezone.utc)


def page(level, text):
    return (f'<li class="description__job-criteria-item"><h3 class="description__job-criteria-subheader">Seniority level'
            f'</h3><span class="description__job-criteria-text"> {level} </span></li>'
            f'<div class="show-more-less-html__markup"><p>{text}</p><p>second</p></div>')


def run_stream(df, tmp_path, name):
    query = (df.writeStream.format("memory").queryName(name).outputMode("append")
             .option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start())
    query.awaitTermination(240)
    return df.sparkSession.table(name)


def test_details_meet_cards_as_streams(spark, tmp_path):
    def land(folder, rows, schema, batch):
        frame = spark.createDataFrame(rows, schema).withColumn("landed_at", F.timestamp_seconds(F.lit(1706659200) + F.col("at"))).drop("at")
        if folder == "cards":
            frame = spark.createDataFrame([], LISTING).unionByName(
                frame.drop("landed_at"), allowMissingColumns=True).withColumn("n", F.lit(0)).drop("n").join(
                frame.select("id", "landed_at"), "id")
        frame.coalesce(1).write.parquet(str(tmp_path / folder / f"b={batch}"))

    minute = 60
    card, body = "id string, title string, seniority_level string, description string, at long", "id string, body string, at long"
    land("cards", [("a", "A", None, "short", 0), ("b", "B", "old", "kept", minute), ("late", "L", None, "x", 0)], card, 0)
    land("pages", [("a", page("Entry level", "whole"), 2 * minute), ("a", page("Director", "again"), 3 * minute),
                   ("nobody", page("x", "y"), 0), ("late", page("Director", "too late"), 90 * minute)], body, 0)
    # Later rows move both watermarks past the first ones.
    land("cards", [("z", "Z", None, "x", 600 * minute)], card, 1)
    land("pages", [("zz", "not a page", 600 * minute)], body, 1)
    kinds = spark.read.parquet(str(tmp_path / "cards" / "b=0")).schema
    reader = lambda kind, folder: spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(
        str(tmp_path / folder / "*"))
    out = enriched_cards(reader(kinds, "cards"), reader(spark.read.parquet(str(tmp_path / "pages" / "b=0")).schema, "pages"))
    got = {r.id: r for r in run_stream(out, tmp_path, "enriched").collect()}
    assert (got["a"].seniority_level, got["a"].description, got["a"].detail_found) == ("Entry level", "whole\nsecond", True)
    assert (got["b"].seniority_level, got["b"].description, got["b"].detail_found) == ("old", "kept", False)
    assert (got["late"].description, got["late"].detail_found) == ("x", False)


def payloads(spark, extra=()):
    body = json.dumps({"jobs": [{"id": 1, "title": "Graduate Baker", "absolute_url": "https://x/1",
                                 "location": {"name": "Remote"}}]})
    rows = [(1, "ats", None, None, 0, None, "greenhouse", "acme", body), (2, "ats", None, None, 0, None, "greenhouse", "bad", body[:40]),
            (3, "jobicy", None, None, 0, None, None, None, "  "), (4, "elsewhere", None, None, 0, None, None, None, "x"), *extra]
    return spark.createDataFrame(rows, PAYLOAD)


def poller(spark, tmp_path):
    return poll.Poller(views.profiles_from_searches(spark, [{"name": "All"}]),
                       views.Settings(default_route="https://hooks.example.com/x"),
                       StateTables(spark, str(tmp_path / "t")), str(tmp_path / "alerts"), as_of=AS_OF)


def test_bad_responses_are_counted_and_the_rest_stored(spark, tmp_path):
    one = poller(spark, tmp_path)
    one.run_payloads(payloads(spark), 0)
    assert {r.job_id for r in one.tables.state().collect()} == {"gh-1"}
    assert {(r.payload_seq, r.reason) for r in one.tables.rejects().collect()} == {
        (2, "BAD_JSON"), (3, "EMPTY_BODY"), (4, "UNKNOWN_SOURCE")}
    counts = {(r.platform_code, r.reason): r.rejects for r in rejects.reject_counts(one.tables.rejects()).collect()}
    assert counts == {("ats", "BAD_JSON"): 1, ("jobicy", "EMPTY_BODY"): 1, ("elsewhere", "UNKNOWN_SOURCE"): 1}


@pytest.fixture
def broken_source():
    @F.udf("string")
    def fail(body):
        raise ValueError("cannot read this board")

    def source(rows, profiles):
        return registry.as_listing(rows.withColumn("t", fail("body")), "jobicy", id="t", title="t")

    kept = registry.SOURCES["jobicy"]
    registry.register_source("jobicy", source)
    yield
    registry.register_source("jobicy", kept)


def test_a_failing_source_leaves_the_others(spark, tmp_path, broken_source):
    one = poller(spark, tmp_path)
    one.run_payloads(payloads(spark, [(9, "jobicy", None, None, 0, None, None, None, "{}")]), 0)
    assert {r.job_id for r in one.tables.state().collect()} == {"gh-1"}
    failed = one.tables.rejects().where("reason = 'SOURCE_FAILED'").collect()
    assert [r.payload_seq for r in failed] == [9] and "cannot read this board" in failed[0].detail


def test_the_query_outlives_a_failing_batch(spark, tmp_path):
    one = poller(spark, tmp_path)
    for batch in range(2):
        payloads(spark).withColumn("payload_seq", F.col("payload_seq") + batch * 100).coalesce(1).write.parquet(
            str(tmp_path / "in" / f"b={batch}"))

    def run(batch, batch_id):
        if batch_id == 0:
            raise RuntimeError("no such disk")
        one.run_payloads(batch, batch_id)

    stream = poll.landed_files(spark, str(tmp_path / "in" / "*"), PAYLOAD, files_per_batch=1)
    query = poll.start(stream, poll.outliving(run, one.tables), str(tmp_path / "c"))
    query.awaitTermination(240)
    assert query.exception() is None
    assert {r.job_id for r in one.tables.state().collect()} == {"gh-1"}
    told = one.tables.rejects().where("reason = 'BATCH_FAILED'").collect()
    assert len(told) == 1 and "no such disk" in told[0].detail
    # What was kept can be run again.
    again = one.tables.quarantined(0)
    assert again.count() == 4
    one.run_payloads(again, 5)
    assert one.tables.state().count() == 1


def test_lost_searches(spark):
    profiles = views.profiles_from_searches(spark, [
        {"name": "A", "platforms": ["jobicy"]}, {"name": "B", "platforms": ["jobicy"], "enabled": False}])
    rows = [("a", "jobicy", "A", 1), ("b", "jobicy", "B", 2), ("c", "jobicy", "gone", 3), ("d", "ats", "A", 4), ("e", "ats", None, 5)]
    listings = spark.createDataFrame(rows, "id string, platform_code string, matched_search_name string, seq long")
    assert {r.detail for r in rejects.lost_searches(listings, profiles).collect()} == {"b", "c", "d"}


def test_scans_by_interval_as_a_stream(spark, tmp_path):
    def land(batch, rows):
        spark.createDataFrame([(name, at, found, found // 2, 0, 1.0) for name, at, found in rows],
                              "search_name string, at long, jobs_found long, jobs_new long, jobs_notified long, duration_seconds double"
                              ).withColumn("timestamp", F.timestamp_seconds(F.lit(1706659200) + F.col("at"))).select(
            SCAN_LOG.names).coalesce(1).write.parquet(str(tmp_path / "log" / f"b={batch}"))

    land(0, [("A", 0, 10), ("A", 3599, 4), ("B", 10, 1), ("A", 3600, 7)])
    land(1, [("A", 4 * 3600, 1)])
    land(2, [("A", 4 * 3600 + 1, 1)])
    land(3, [("A", 30, 100), ("A", 4 * 3600 + 2, 1)])  # the first is later than the watermark allows
    stream = spark.readStream.schema(SCAN_LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log" / "*"))
    out = scans_by_interval(stream.withWatermark("timestamp", "10 minutes"))
    got = {(r.search_name, int(r.window_start.timestamp()) - 1706659200): (r.scans, r.jobs_found, r.jobs_new)
           for r in run_stream(out, tmp_path, "by_interval").collect()}
    assert got == {("A", 0): (2, 14, 7), ("B", 0): (1, 1, 0), ("A", 3600): (1, 7, 3)}
