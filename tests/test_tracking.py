"""State log, reports, alerts and the scan outcome ladder on small tables."""

import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from postsift.functions.rules import require_status
from postsift.operators import alerts, claim, reports, state
from postsift.plans.scan import scan
from postsift.plans.views import profiles_from_searches
from postsift.schema import LISTING, STATE, Settings

NOW = datetime(2024, 1, 31, tzinfo=timezone.utc)
LATER = NOW + timedelta(hours=1)


def listing(**values):
    base = dict.fromkeys(LISTING.names)
    base.update(id="1", title="T", company="C", location="L", job_url="https://x", criteria={},
                platform="LinkedIn", platform_code="linkedin", seq=0)
    return tuple({**base, **values}[name] for name in LISTING.names)


def tracked(spark, *rows):
    data = [(i, "S", t, c, "L", "u", "LinkedIn", when, None, status)
            for i, t, c, status, when in rows]
    return spark.createDataFrame(data, STATE)


def test_versions_updates_purge_and_reset(spark, tmp_path):
    tables = state.StateTables(spark, str(tmp_path))
    assert tables.state().count() == 0
    first = tracked(spark, ("1", "A", "X", "NEW", NOW), ("2", "B", "X", "NEW",
                                                        NOW - timedelta(days=90)))
    tables.append_state(state.as_versions(first, F.lit(NOW)), 0)
    tables.append_state(state.set_status(tables.state(), "1", "APPLIED", LATER, 1), 1)
    assert state.set_status(tables.state(), "9", "APPLIED", LATER).count() == 0
    found = reports.find_listings(tables.state(), ["APPLIED"]).collect()
    assert [r.job_id for r in found] == ["1"]
    with pytest.raises(ValueError):
        state.set_status(first, "1", "BOGUS", NOW)
    compact = tables.compacted(str(tmp_path / "compact"))
    assert sorted(map(tuple, compact.state().collect())) == sorted(map(tuple, tables.state().collect()))
    assert compact.state_log().count() == 2 < tables.state_log().count()
    tables.append_state(state.purge_versions(tables.state(), LATER, 60, 2), 2)
    assert [r.job_id for r in tables.state().collect()] == ["1"]
    assert tables.state(before=2).count() == 2
    tables.reset(3, LATER + timedelta(hours=1))
    assert tables.state().count() == 0 and tables.scans().count() == 0


def test_legacy_rows_surface_as_new(spark):
    legacy = spark.createDataFrame([("1", "T", "NOTIFIED"), ("2", "T", "FILTERED")],
                                   "job_id string, title string, status string")
    assert {r.job_id: (r.status, r.platform) for r in state.migrate(legacy).collect()} == {
        "1": ("NEW", None), "2": ("FILTERED", None)}
    assert [r.job_id for r in reports.find_listings(state.migrate(legacy)).collect()] == ["1"]


def test_reports(spark):
    rows = tracked(spark, ("b", "T" * 60, "C", "NEW", NOW), ("a", "", None, "NEW", NOW),
                   ("c", "T", "C", "DUPLICATE", LATER))
    assert [r.job_id for r in reports.find_listings(rows).collect()] == ["a", "b"]
    assert reports.find_listings(rows, []).count() == 0
    assert reports.statuses_from_option("NEW, APPLIED") == ["NEW", " APPLIED"]
    assert reports.statuses_from_option("") is None
    shown = reports.listing_report(reports.find_listings(rows)).collect()
    assert (shown[0].title, shown[0].company, len(shown[1].title)) == ("—", "—", 45)
    empty = spark.createDataFrame([], "timestamp timestamp")
    totals = reports.state_totals(rows, empty).first()
    assert (totals.total_seen, totals.total_notified, totals.total_scans, totals.last_scan) == (
        3, 0, 0, "Never")
    require_status("HIDDEN")


def outcomes(spark, listings, searches, seen=(), details=None, **settings):
    profiles = profiles_from_searches(spark, searches)
    known = tracked(spark, *seen) if seen else spark.createDataFrame([], STATE)
    cycle = scan(spark.createDataFrame(listings, LISTING), profiles, known,
                 Settings(default_route="https://d", as_of=NOW, **settings), details)
    rows = {r.id: (r.search_name, r.status) for r in cycle.outcomes.collect()}
    counters = {r.search_name: tuple(r)[1:] for r in cycle.counters.collect()}
    cycle.release()
    return rows, counters


def test_outcome_ladder(spark):
    searches = [
        {"name": "First", "platforms": ["linkedin"], "filters": {
            "title_must_exclude": ["chef"], "description_must_exclude": ["clearance"]}},
        {"name": "Second", "platforms": ["linkedin", "ejobs"], "webhook_url": "YOUR_WEBHOOK"},
        {"name": "Off", "enabled": False, "platforms": ["hipo"]}]
    listings = [
        listing(id="1", title="Chef", seq=1),
        listing(id="2", title="Secret Agent", seq=2),
        listing(id="3", title="Senior Agent", seq=3),
        listing(id="4", title="Python Developer", seq=4),
        listing(id="5", title="python developer!", seq=5),
        listing(id="6", title="Known", seq=6),
        listing(id="4", title="Repeat of 4", seq=7),
        listing(id="7", title="Baker", platform="eJobs.ro", platform_code="ejobs", seq=1),
        listing(id="8", title="Python-Developer", platform="eJobs.ro", platform_code="ejobs", seq=2),
        listing(id="9", title="Baker", platform="eJobs.ro", platform_code="ejobs", seq=3),
        listing(id="10", title="Hidden", platform="Hipo.ro", platform_code="hipo", seq=1),
    ]
    details = spark.createDataFrame(
        [("2", {}, "needs clearance", None, None), ("4", {"Seniority level": "Entry"}, "ok", "3", None)],
        "id string, detail_criteria map<string,string>, detail_description string, "
        "detail_applicants string, detail_logo_url string")
    rows, counters = outcomes(spark, listings, searches, [("6", "x", "y", "FILTERED", NOW)], details)
    assert rows == {
        "1": ("First", "FILTERED"), "2": ("First", "FILTERED_DESC"), "3": ("First", "FILTERED"),
        "4": ("First", "NEW"), "5": ("First", "DUPLICATE"),
        # The route of the second search is a placeholder: not sent, and never a leader.
        "7": ("Second", "SEND_FAILED"), "8": ("Second", "DUPLICATE"), "9": ("Second", "SEND_FAILED")}
    assert counters == {"First": (7, 5, 1), "Second": (10, 3, 0)}
    # With details switched off the detail page changes nothing.
    rows, _ = outcomes(spark, listings, searches, details=details, fetch_job_details=False)
    assert rows["2"] == ("First", "NEW") and rows["6"] == ("First", "NEW")


def test_alert_body(spark, tmp_path):
    rows = spark.createDataFrame([listing(
        id="40871", title="Harbour Clerk", company="Quayside", location="Remote",
        job_url="https://linkedin.com/jobs/view/40871", logo_url="https://example.com/logo.png",
        workplace_type="Remote", employment_type="Full-time", seniority_level="Entry level",
        salary="31k", post_text="1 hour ago"),
        listing(id="2", logo_url="data:image/x", salary="", employment_type="")], LISTING)
    rows = rows.withColumns({
        "search_name": F.lit("Python"), "embed_color": F.lit("#204060"),
        "webhook_url": F.lit(None).cast("string"), "role_id_to_mention": F.lit(None).cast("string"),
        "snippet": F.lit("> x\n\n"), "arrival": F.col("seq")})
    bodies = alerts.alert_bodies(alerts.alert_envelopes(
        rows, Settings(default_route="https://d", as_of=NOW)))
    got = {r.id: (r.route, json.loads(r.body)) for r in bodies.collect()}
    route, body = got["40871"]
    (embed,) = body["embeds"]
    assert route == "https://d" and body["username"] == "LinkedIn Alert Bot" and "content" not in body
    assert embed["color"] == 0x204060 and embed["title"] == "📢 Harbour Clerk"
    assert embed["author"] == {"name": "Quayside", "url": "https://linkedin.com/jobs/view/40871",
                               "icon_url": "https://example.com/logo.png"}
    assert [f["name"] for f in embed["fields"]] == [
        "📍 Location", "💼 Role Details", "⏰ Posted", "💰 Salary", "🏢 Source", "🏷️ Matched Filter"]
    assert embed["thumbnail"] == {"url": "https://example.com/logo.png"}
    assert embed["timestamp"] == NOW.isoformat()
    bare = got["2"][1]["embeds"][0]
    assert "thumbnail" not in bare and "icon_url" not in bare["author"]
    assert [f["name"] for f in bare["fields"]] == [
        "📍 Location", "⏰ Posted", "🏢 Source", "🏷️ Matched Filter"]
    for _ in range(2):
        alerts.write_alerts(bodies, str(tmp_path), 0)
    assert spark.read.json(str(tmp_path)).count() == 2


def test_keep_last_stands_at_first_place(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, "z")],
                                 "id string, seq long, v string")
    assert sorted(map(tuple, claim.keep_last_at_first(rows, ["id"], "seq").select(
        "id", "seq", "v").collect())) == [("a", 1, "z"), ("b", 2, "y")]
    assert sorted(map(tuple, claim.keep_first(rows, ["id"], "seq").select(
        "id", "seq", "v").collect())) == [("a", 1, "x"), ("b", 2, "y")]


def test_arrival_orders_profile_then_source_then_position(spark):
    rows = [(0, 0, 2**62), (0, 1, 0), (1, 0, 0), (1, 0, 1), (5000, 0, 0)]
    frame = spark.createDataFrame(rows, "p int, s int, n long")
    key = claim.arrival_key(F.col("p"), F.col("s"), F.col("n"))
    assert [tuple(r)[:3] for r in frame.orderBy(key.desc()).collect()] == rows[::-1]


def test_user_change_survives_the_next_batch(spark, tmp_path):
    tables = state.StateTables(spark, str(tmp_path))
    tables.append_state(state.as_versions(tracked(spark, ("1", "A", "X", "NEW", NOW)), F.lit(NOW)), 0)
    tables.append_state(state.set_status(tables.state(), "1", "APPLIED", LATER, 1), 1, state.USER)
    # The stream's next batch has the same number and sees the change.
    assert [r.status for r in tables.state(before=1).collect()] == ["APPLIED"]
    tables.append_state(state.as_versions(tracked(spark, ("2", "B", "Y", "NEW", LATER)), F.lit(LATER)), 1)
    assert {r.job_id: r.status for r in tables.state().collect()} == {"1": "APPLIED", "2": "NEW"}


def test_page_gap_ends_a_scan(spark):
    cards = spark.createDataFrame([(p,) for p in (0, 1, 3)], "page int").withColumn("s", F.lit("x"))
    pages = cards.withColumns({"cards": F.lit(1), "max_pages": F.lit(None).cast("int")})
    assert {r.page for r in claim.page_cutoff(cards, pages, ["s"]).collect()} == {0, 1}


def test_one_detail_page_for_each_listing(spark):
    from postsift.operators.enrich import latest_details
    rows = [("1", 1, "old", None, None), ("1", 2, "new", None, None), ("2", 1, "only", None, None)]
    df = spark.createDataFrame(rows, "id string, payload_seq long, detail_description string, "
                                     "detail_applicants string, detail_logo_url string")
    assert {(r.id, r.detail_description) for r in latest_details(df).collect()} == {
        ("1", "new"), ("2", "only")}


def versions(spark, ids, when, status="NEW"):
    return state.as_versions(tracked(spark, *[(i, "T", "C", status, when) for i in ids]), F.lit(when))


def test_runs_hold_what_the_batches_hold(spark, tmp_path):
    tables, plain = (state.StateTables(spark, str(tmp_path / n), buckets=4) for n in ("runs", "plain"))
    for batch in range(12):
        ids = [str(i) for i in range(batch * 5, batch * 5 + 8)]
        when = NOW + timedelta(hours=batch)
        rows = versions(spark, ids, when, "NEW" if batch % 2 else "FILTERED")
        if batch == 7:
            # A removal in a later run hides the user's change.
            rows = rows.unionByName(state.as_versions(plain.state().where("job_id = '3'"), F.lit(when), 9, True))
        for each in (tables, plain):
            each.append_state(rows, batch)
            if batch == 5:
                each.append_state(state.set_status(each.state(), "3", "APPLIED", when, 1), 0, state.USER)
        tables.fold(batch + 1, loose=2)
        assert statuses(tables.state(before=batch + 1)) == statuses(plain.state(before=batch + 1))
    assert "3" not in statuses(tables.state())
    # Geometric sizes keep the runs few; states of earlier batches can still be read.
    assert len(tables.runs()) <= 3 and tables.runs()[0].last == 11
    assert statuses(tables.state(before=4)) == statuses(plain.state(before=4))
    assert tables.state_log().count() < plain.state_log().count()
    # A repeated fold finds nothing to do, a run that was not written whole is not read.
    assert tables.fold(12) == []
    (tmp_path / "runs" / "runs" / "0-99-4").mkdir()
    assert statuses(tables.state()) == statuses(plain.state())


def statuses(rows):
    return {r.job_id: r.status for r in rows.collect()}


def test_given_up_batches_are_in_no_run(spark, tmp_path):
    tables = state.StateTables(spark, str(tmp_path), buckets=2)
    for batch in (0, 1, 3, 4, 5):
        tables.append_state(versions(spark, [str(batch)], NOW), batch)
    # Batch 2 failed before its state was written, batch 4 after it.
    for batch in (2, 4):
        tables.quarantine(spark.range(1), batch)
    assert {(r.first, r.last) for r in tables.fold(6)} == {(0, 1), (3, 3), (5, 5)}
    for batch in (2, 4):
        tables.append_state(versions(spark, [f"again {batch}"], NOW), batch)
    assert set(statuses(tables.state())) == {"0", "1", "3", "5", "again 2", "again 4"}


def read_rows(df):
    """Rows that the scans of a plan without exchanges hand on."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.execute().count()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_a_batch_reads_a_small_part_of_a_run(spark, tmp_path):
    tables = state.StateTables(spark, str(tmp_path), buckets=16)
    ids = spark.range(200_000).select(F.sha2(F.col("id").cast("string"), 256).alias("job_id"))
    tables.append_state(state.as_versions(
        spark.createDataFrame([], STATE).unionByName(ids, allowMissingColumns=True), F.lit(NOW)), 0)
    tables.fold(1)
    rows = [listing(id=r.job_id) for r in ids.limit(2).collect()] + [listing(id="new")]
    few = spark.createDataFrame(rows, LISTING)
    assert {r.job_id for r in tables.known(few).collect()} == {r.id for r in few.collect()} - {"new"}
    asked = few.select(F.col("id").alias("job_id"))
    assert read_rows(tables.asked_rows(asked)) < 200_000 / 4
    # Ids that the state does not hold are ruled out by the filters of the row groups.
    fresh = spark.range(20).select(F.concat(F.lit("a new one "), "id").alias("job_id"))
    assert read_rows(tables.asked_rows(fresh)) < 200_000 / 4
    # More ids than are handed to the scan: folders only, and the same answer.
    many = ids.limit(3_000).union(fresh).select(F.col("job_id").alias("id"))
    assert tables.known(many).count() == 3_000
