"""Streaming cycles: k batches equal one, retries do not double, state carries over."""

import json
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import functions as F

from postsift.operators.state import StateTables
from postsift.plans import views
from postsift.plans.scan import scan
from postsift.schema import LISTING, PAYLOAD
from postsift.streaming import poll

AS_OF = datetime(2024, 1, 31, tzinfo=timezone.utc)


def small_listings(spark, sf_dir):
    parts = views.load(spark, sf_dir, "part").withColumn("n", F.col("p_partkey"))
    code = views.by_number(F.col("n"), ["linkedin", "jobicy"])
    return parts.select(
        F.concat(F.lit("p-"), F.col("n") % 150).alias("id"), F.col("p_name").alias("title"),
        F.concat(F.lit("Brand "), F.col("n") % 3).alias("company"), F.lit("Remote").alias("location"),
        F.concat(F.lit("https://x/"), "n").alias("job_url"), F.col("p_type").alias("description"),
        code.alias("platform_code"), F.lit("Board").alias("platform"), F.col("n").alias("seq"))


def full(df):
    return df.sparkSession.createDataFrame([], LISTING).unionByName(df, allowMissingColumns=True)


def poller(spark, tmp_path, name):
    # One profile, so that arrival order is the landed position alone.
    profiles = views.profiles_from_searches(spark, [
        {"name": "All", "platforms": ["linkedin"],
         "filters": {"title_must_exclude": ["gear"]}}])
    return poll.Poller(profiles, views.SETTINGS, StateTables(spark, str(tmp_path / name)),
                       str(tmp_path / f"{name}-alerts"), as_of=AS_OF)


def statuses(tables):
    return {r["job_id"]: r["status"] for r in tables.state().collect()}


def alert_ids(root):
    lines = [line for f in Path(root).rglob("*.json") for line in f.read_text().splitlines()]
    return sorted(json.loads(line)["id"] for line in lines)


def test_batches_equal_one_scan(spark, sf_dir, tmp_path):
    listings = full(small_listings(spark, sf_dir)).filter("platform_code = 'linkedin'")
    landing = tmp_path / "landing"
    for low, high in [(0, 60), (60, 61), (61, 10_000)]:
        part = listings.filter(F.col("seq").between(low, high - 1)).coalesce(1)
        part.write.mode("append").parquet(str(landing))
    streamed = poller(spark, tmp_path, "stream")
    stream = poll.landed_files(spark, str(landing), files_per_batch=1)
    poll.start(stream, streamed.run, str(tmp_path / "checkpoint")).awaitTermination(300)

    whole = poller(spark, tmp_path, "whole")
    whole.run(listings, 0)
    assert statuses(streamed.tables) == statuses(whole.tables)
    assert alert_ids(streamed.alerts_root) == alert_ids(whole.alerts_root)
    assert set(statuses(whole.tables).values()) == {"NEW", "DUPLICATE", "FILTERED"}
    assert streamed.tables.scans().count() == 3
    # Every landed row is counted as found, whichever batch it came in.
    assert streamed.tables.scans().agg(F.sum("jobs_found")).first()[0] == listings.count()


def test_retried_batch_replaces_itself(spark, sf_dir, tmp_path):
    listings = full(small_listings(spark, sf_dir)).filter("platform_code = 'linkedin'")
    one = poller(spark, tmp_path, "retry")
    one.run(listings, 0)
    first = (statuses(one.tables), alert_ids(one.alerts_root), one.tables.scans().count())
    one.run(listings, 0)
    assert (statuses(one.tables), alert_ids(one.alerts_root), one.tables.scans().count()) == first
    # A later batch with the same listings finds all of them seen.
    one.run(listings, 1)
    assert statuses(one.tables) == first[0]
    assert one.tables.scans().agg(F.sum("jobs_new")).first()[0] == len(first[0])


def test_payload_cycle(spark, tmp_path):
    body = json.dumps({"jobs": [
        {"id": 1, "title": "Graduate Engineer", "absolute_url": "https://x/1",
         "location": {"name": "Bucharest"}},
        {"id": 2, "title": "Senior Engineer", "absolute_url": "https://x/2",
         "location": {"name": "Remote"}},
        {"id": 3, "title": "Graduate engineer!", "absolute_url": "https://x/3",
         "location": {"name": "Romania"}}]})
    rows = [(7, "ats", None, None, 0, None, "greenhouse", "acme", body),
            (8, "unknown", None, None, 0, None, None, None, "x")]
    spark.createDataFrame(rows, PAYLOAD).coalesce(1).write.parquet(str(tmp_path / "in"))
    profiles = views.profiles_from_searches(spark, [{"name": "All"}])
    settings = views.Settings(default_route="https://hooks.example.com/x")
    one = poll.Poller(profiles, settings, StateTables(spark, str(tmp_path / "t")),
                      str(tmp_path / "alerts"), as_of=AS_OF)
    stream = poll.landed_files(spark, str(tmp_path / "in"), PAYLOAD)
    poll.start(stream, one.run_payloads, str(tmp_path / "c")).awaitTermination(300)
    assert statuses(one.tables) == {"gh-1": "NEW", "gh-2": "FILTERED", "gh-3": "DUPLICATE"}


def test_bounded_unseen(spark, tmp_path):
    rows = [("a", 0), ("b", 1), ("a", 2)]
    data = spark.createDataFrame(rows, "id string, n long").withColumn(
        "landed_at", F.timestamp_seconds(F.lit(1700000000) + F.col("n")))
    data.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = poll.landed_files(spark, str(tmp_path / "in"), data.schema)
    query = (poll.bounded_unseen(stream, "landed_at", "1 hour").writeStream.format("memory")
             .queryName("unseen").option("checkpointLocation", str(tmp_path / "c"))
             .trigger(availableNow=True).start())
    query.awaitTermination(120)
    assert sorted(r["id"] for r in spark.table("unseen").collect()) == ["a", "b"]


def test_scan_is_partition_invariant(spark, sf_dir):
    listings = full(small_listings(spark, sf_dir))
    state = spark.createDataFrame(
        [("p-3", "x", "y", "NEW")], "job_id string, title string, company string, status string"
    ).withColumn("discovered_at", F.lit(AS_OF))
    results = []
    for partitions in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions * 2))
        cycle = scan(listings.repartition(partitions), views.profiles(spark), state,
                     views.SETTINGS)
        results.append((sorted(map(tuple, cycle.outcomes.select("id", "search_name", "status")
                                   .collect())),
                        sorted(map(tuple, cycle.counters.collect()))))
        cycle.release()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]


def test_listings_are_judged_by_the_search_that_fetched_them(spark):
    from postsift.plans.scan import scanned_rows
    profiles = views.profiles_from_searches(spark, [
        {"name": "A", "platforms": ["jobicy", "ats"]}, {"name": "B", "platforms": ["jobicy"]},
        {"name": "A", "platforms": ["jobicy"]}])
    rows = [("a", "jobicy", "A", 1), ("b", "jobicy", "B", 2), ("gh-1", "ats", None, 3)]
    listings = full(spark.createDataFrame(
        rows, "id string, platform_code string, matched_search_name string, seq long"))
    judged, found = scanned_rows(listings, profiles)
    by_id = {r["id"]: r["profile_ord"] for r in judged.collect()}
    order = [r["profile_ord"] for r in profiles.orderBy("profile_ord").collect()]
    assert by_id == {"a": order[0], "b": order[1], "gh-1": order[0]}
    assert [(r["search_name"], r["jobs_found"]) for r in found.orderBy("profile_ord").collect()] == [
        ("A", 2), ("B", 1), ("A", 0)]
