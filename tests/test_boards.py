"""Board extractors on small literal pages and responses."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from postsift.plans import views
from postsift.schema import PAYLOAD
from postsift.sources import boards, html
from postsift.sources.profiles import company_list, load_config, profiles_from_searches
from postsift.sources.registry import SOURCES, register_source, search_urls, union_sources


def payload(spark, code, *bodies, search="QA", location="Bucharest, Romania", url=None, ats=None,
            board=None):
    rows = [(i, code, search, location, i, url, ats, board, b) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, PAYLOAD)


def profiles(spark, **more):
    return profiles_from_searches(spark, [
        {"name": "QA", "keywords": '"QA Tester" OR "QA Engineer"',
         "location": "Bucharest, Romania", **more}])


def rows_of(spark, code, *bodies, **more):
    found = SOURCES[code](payload(spark, code, *bodies, **more), profiles(spark))
    return found.orderBy("seq").collect()


def card(urn="urn:li:jobPosting:77", title=" Junior\n Tester ", extra="", link=None, img=""):
    return f"""<div class="base-card job-search-card" {f'data-entity-urn="{urn}"' if urn else ''}>
      {f'<a class="base-card__full-link x" href="{link}">go</a>' if link else ''}{img}
      <h3 class="base-search-card__title">{title}</h3>{extra}</div>"""


RICH = """<h4 class="base-search-card__subtitle"><a href="https://c/acme?trk=1"> Acme &amp; Co </a></h4>
<span class="job-search-card__location">Iasi (Hybrid)</span>
<time datetime="2024-01-30">2 hours\n ago</time>
<span class="job-search-card__salary-info">10 - 20</span>"""


def test_linkedin_cards(spark):
    page = "<ul>" + "".join([
        card(extra=RICH, link="https://l/view/x-77?ref=1",
             img='<img data-delayed-url="https://i/a.png" src="data:image/x">'),
        card(urn=None, link="https://l/view/role-4414037159/?x=1", title="By link",
             img='<img src="data:image/gif">'),
        card(urn=None, link="https://l/view/role-none", title="No id"),
        card(urn="urn:li:jobPosting:78", title="  "),
        card(urn="urn:li:jobPosting:79", title="No link"),
    ]) + "</ul>"
    a, b, c = rows_of(spark, "linkedin", page)
    assert (a.id, a.title, a.company, a.company_url) == ("77", "Junior Tester", "Acme & Co",
                                                         "https://c/acme")
    assert (a.location, a.workplace_type, a.post_date, a.post_text) == (
        "Iasi (Hybrid)", "Hybrid", "2024-01-30", "2 hours ago")
    assert (a.job_url, a.logo_url, a.salary) == ("https://l/view/x-77", "https://i/a.png", "10 - 20")
    assert (b.id, b.company, b.location, b.logo_url) == (
        "4414037159", "Unknown Company", "Unknown Location", None)
    assert (c.id, c.job_url) == ("79", "https://www.linkedin.com/jobs/view/79")
    assert {r.matched_search_name for r in (a, b, c)} == {"QA"}
    assert (a.platform, a.platform_code) == ("LinkedIn", "linkedin")


def test_linkedin_pages_stop_and_keep_first(spark):
    pages = [card("u:1", "One") + card("u:2", "Two"), card("u:2", "Two again") + card("u:3", "Three"),
             "<p>nothing</p>", card("u:4", "After the gap")]
    assert [(r.id, r.title) for r in rows_of(spark, "linkedin", *pages)] == [
        ("1", "One"), ("2", "Two"), ("3", "Three")]
    limited = SOURCES["linkedin"](payload(spark, "linkedin", *pages), profiles(spark, max_pages=1))
    assert sorted(r.id for r in limited.collect()) == ["1", "2"]


def test_linkedin_details(spark):
    body = """<li class="description__job-criteria-item"><h3 class="description__job-criteria-subheader">
      Seniority level </h3><span class="description__job-criteria-text"> Entry </span></li>
      <li class="description__job-criteria-item"><h3 class="description__job-criteria-subheader">X</h3></li>
      <div class="show-more-less-html__markup"> One <b>two</b><br><script>no</script> three </div>
      <span class="num-applicants__caption"> 12  applicants </span>
      <img class="artdeco-entity-image" src="https://i/top.png">"""
    frame = spark.createDataFrame([("1", body), ("2", "<p></p>")], "id string, body string")
    one, two = boards.extract_details(frame).orderBy("id").collect()
    assert one.detail_criteria == {"Seniority level": "Entry"}
    assert one.detail_description == "One\ntwo\nthree"
    assert (one.detail_applicants, one.detail_logo_url) == ("12 applicants", "https://i/top.png")
    assert (two.detail_criteria, two.detail_description) == ({}, None)


def test_ejobs(spark):
    page = """<div><h2>Loose <a href="/locuri-de-munca/tester/123/">x</a></h2><h3>Acme</h3>
        <span>4000 Lei</span></div>
      <ul><li><h2>In list</h2><a href="https://www.ejobs.ro/user/locuri-de-munca/qa/q">x</a>
        <b>10 €</b></li></ul>
      <div><h2>Pay</h2><a href="/locuri-de-munca/salarii/9">x</a></div>
      <div><h2>No link</h2></div><h2>Nowhere</h2>"""
    a, b = rows_of(spark, "ejobs", page)
    assert (a.id, a.company, a.salary, a.job_url) == (
        "ejobs-123", "Acme", "4000 Lei", "https://www.ejobs.ro/locuri-de-munca/tester/123/")
    assert a.title == "Loose x" and a.location == "Bucharest, Romania"
    assert (b.company, b.salary) == ("eJobs Employer", "10 €")
    assert b.id.startswith("ejobs-") and len(b.id) == 22
    assert rows_of(spark, "ejobs", page, location="Cluj")[0].location == "Romania"


def test_bestjobs(spark):
    def one(href, title, company):
        heading = f"<h2>{title}</h2>" if title else ""
        return (f'<div class="card"><a href="{href}" aria-label="From label"><span>x</span></a>'
                f'<div>{heading}<div class="mt-2 text-ink-medium">{company}</div></div></div>')
    page = (one("/loc-de-munca/lumen-release-checker-70417", "Release Checker", "Lumen Works")
            + one("/loc-de-munca/orchid-line-reader-812", "", "Orchid Print")
            + one("/loc-de-munca/again-70417", "Later wins", "Gamma")
            + one("/altceva/x-1", "Other", "No"))
    a, b = rows_of(spark, "bestjobs", page)
    assert (a.id, a.title, a.company) == ("bestjobs-70417", "Later wins", "Gamma")
    assert a.job_url == "https://www.bestjobs.eu/loc-de-munca/again-70417"
    assert a.location == "Bucharest, Romania, Romania"
    assert (b.id, b.title, b.company) == ("bestjobs-812", "From label", "Orchid Print")


def test_hipo(spark):
    page = """<li><h3>Acme</h3><a href="/oferta-de-angajare/1">Junior</a></li>
      <article><a href="/oferta-de-angajare/2">Same</a><b>same</b></article>
      <li><a href="/oferta-de-angajare/1">Repeat</a></li><a href="/oferta-de-angajare/3"> </a>"""
    a, b = rows_of(spark, "hipo", page)
    assert (a.title, a.company, a.job_url) == ("Junior", "Acme",
                                               "https://www.hipo.ro/oferta-de-angajare/1")
    assert b.company == "Hipo.ro Employer"
    assert rows_of(spark, "hipo", "<html><body>maintenance</body></html>") == []


def test_stagiipebune(spark):
    page = """<a href="/students/jobs/">Stagii</a>
      <a href="/jobs/northfold/map-keeper-55102">Map Keeper</a>
      <a href="/jobs/quiet-mill/loom-fitter-20933">Loom Fitter</a>
      <a href="/jobs/x/y-1">123456</a><a href="/jobs/x/y-2">abc</a><a href="/companies/">C</a>"""
    a, b = rows_of(spark, "stagiipebune", page)
    assert (a.id, a.title, a.company) == ("spb-55102", "Map Keeper", "Northfold")
    assert b.company == "Quiet Mill" and b.platform == "StagiiPeBune"


def test_career_pages(spark):
    pages = ['<meta content="Junior QA – Acme Careers" property="og:title"><title>x</title>',
             "<title>Only &amp; title | Acme</title>", "<title>abc</title>", "<p>none</p>"]
    rows = [(i, "google", "QA", None, 0, f"https://www.acme{i}.ro:8080/jobs", None, None, p)
            for i, p in enumerate(pages)]
    rows.append((9, "google", "QA", None, 0, "https://www.acme0.ro:8080/jobs", None, None, pages[1]))
    found = SOURCES["google"](spark.createDataFrame(rows, PAYLOAD), None).orderBy("seq").collect()
    assert [(r.title, r.company) for r in found] == [
        ("Junior QA", "acme0.ro:8080"), ("Only & title", "acme1.ro:8080")]


def test_company_boards(spark):
    lever = json.dumps([
        {"id": "elm-4", "text": "Glass Blower", "hostedUrl": "https://hire.example.org/elm-4",
         "categories": {"location": "Porto, Portugal"}, "createdAt": 1740000000000},
        {"id": "owl-31", "text": "Harbour Pilot", "hostedUrl": "https://hire.example.org/owl-31",
         "categories": {"location": "Cluj, Romania"}, "createdAt": 1740000000000}])
    greenhouse = json.dumps({"jobs": [
        {"id": 9031, "title": "Orchard Keeper", "absolute_url": "https://boards.example.org/9031",
         "location": {"name": "Lisbon"}},
        {"id": 9040, "title": "  ", "absolute_url": "https://boards.example.org/9040",
         "location": {"name": "Remote"}},
        {"id": 9052, "title": "Tram Dispatcher", "absolute_url": "https://boards.example.org/9052",
         "location": {"name": "Remote"}, "updated_at": "2025-03-02T06:30:00Z"}]})
    both = payload(spark, "ats", "not json", lever, ats="lever", board="salt_and_sea").unionByName(
        payload(spark, "ats", greenhouse, ats="greenhouse", board="city-trams"))
    found = {r.id: r for r in SOURCES["ats"](both, profiles(spark)).collect()}
    assert set(found) == {"gh-9052", "lever-owl-31"}
    pilot, tram = found["lever-owl-31"], found["gh-9052"]
    assert (pilot.platform, pilot.post_date) == ("Lever", "2025-02-19 21:20:00")
    assert (tram.platform, tram.company, tram.post_date) == ("Greenhouse", "City Trams", "2025-03-02T06:30:00Z")


def test_remote_boards(spark):
    remoteok = json.dumps([{"legal": "x"}, {"id": "5", "position": "Dev", "url": "u"}, "odd", 3])
    (row,) = rows_of(spark, "remoteok", remoteok)
    assert (row.id, row.location, row.description) == (
        "remoteok-5", "🌐 Remote (Worldwide Remote)", "")
    arbeitnow = json.dumps({"data": [{"slug": "s", "title": "T", "remote": False, "created_at": 17,
                                      "description": "<p>a</p><p> b&nbsp;</p>"}]})
    (row,) = rows_of(spark, "arbeitnow", arbeitnow)
    assert (row.location, row.workplace_type, row.post_date, row.description) == (
        "📍 Europe / Remote", "On-site", "17", "a\nb")


def test_union_skips_unknown_and_takes_registered(spark):
    register_source("mine", lambda p, _: SOURCES["hipo"](p, _))
    try:
        page = '<a href="/oferta-de-angajare/1">Junior</a>'
        landed = {"mine": payload(spark, "mine", page), "hipo": payload(spark, "hipo", page),
                  "nobody": payload(spark, "nobody", page),
                  "ejobs": spark.range(1)}
        assert union_sources(landed, profiles(spark)).count() == 2
    finally:
        SOURCES.pop("mine")


def test_unclosed_and_nested_markup(spark):
    body = "<div><p>a<p>b<br>c<!-- x -->d</p></nope><b>e</div>f"
    nodes = spark.range(1).select(html.page_nodes(F.lit(body)).alias("n")).first().n
    shape = [(n.tag, n.pos, n.end) for n in nodes if n.tag != "#text"]
    assert shape == [("div", 0, 9), ("p", 1, 9), ("p", 3, 7), ("br", 5, 5), ("b", 8, 9)]
    assert [n.text for n in nodes if n.tag == "#text"] == ["a", "b", "c", "d", "e", "f"]


def test_search_urls(spark):
    row = search_urls(profiles(spark, date_posted="past_30min", workplace_types=["Remote", "?"])).first()
    assert row.bestjobs_url == "https://www.bestjobs.eu/ro/locuri-de-munca?keyword=qa+tester&location=bucuresti"
    assert row.ejobs_url == "https://www.ejobs.ro/locuri-de-munca/bucuresti/QA%20Tester/"
    assert "f_TPR=r1800" in row.linkedin_url and row.linkedin_url.endswith("&f_WT=2")


def test_config(spark, tmp_path, monkeypatch):
    monkeypatch.delenv("DISCORD_WEBHOOK_URL", raising=False)
    path = tmp_path / "config.json"
    path.write_text(json.dumps({
        "settings": {"discord_webhook_url": "https://d", "max_pages_per_search": "2",
                     "junior_filter_strict": True},
        "searches": [{"platforms": [], "filters": {"title_must_include": None}, "webhook_url": ""},
                     {"name": "Off", "enabled": False, "platforms": ["ats", "??"]}]}))
    settings, found = load_config(spark, str(path))
    assert (settings.default_route, settings.max_pages_per_search) == ("https://d", 2)
    assert settings.junior_filter_strict and settings.junior_filter_enabled
    first, second = found.orderBy("profile_ord").collect()
    assert (first.search_name, first.enabled, first.webhook_url) == ("Search #1", True, None)
    assert first.platforms == ["linkedin", "ejobs", "bestjobs", "hipo", "stagiipebune", "ats",
                               "jobicy", "remoteok", "arbeitnow"]
    assert first.filters.title_must_include == [] and first.filters.max_age_hours is None
    assert (second.search_name, second.enabled) == ("Off", False)
    monkeypatch.setenv("DISCORD_WEBHOOK_URL", "https://env")
    assert load_config(spark, str(path))[0].default_route == "https://env"


def test_yaml_config(spark, tmp_path):
    pytest.importorskip("yaml")
    path = tmp_path / "config.yaml"
    path.write_text("searches:\n  - name: A\n    filters:\n      max_age_hours: 0.5\n")
    _, found = load_config(spark, str(path))
    assert found.first().filters.max_age_hours == 0.5


def test_company_list(spark):
    docs = spark.createDataFrame([('{"greenhouse": [" a ", "", "b"], "lever": []}',), ("{oops",)],
                                 "body string")
    assert sorted((r.ats, r.slug) for r in company_list(docs, "body").collect()) == [
        ("greenhouse", "a"), ("greenhouse", "b")]


def test_fixture_boards_cover_registry(spark):
    assert set(views.BOARDS) < set(SOURCES)


def _differences(spark, folder, names, pages):
    """Queries over a table of (page_id, url, html) beside their SQL: what differs."""
    import __spark_entry__ as entry
    from compare import difference

    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(
        f"{folder}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    found = {n: difference(entry.queries()[n](spark, str(folder)), con, entry.oracle_sql()[n]) for n in names}
    return {n: d for n, d in found.items() if d}


def test_links_of_letters_without_a_single_upper_case(spark, tmp_path):
    links = "".join(f'<a href="/{w}">{w}</a>' for w in ["ßenkeit", "aßen", "ßa-ßb-7", "ﬁnal", "ᾳbcd", "İstan", "ŉabc"])
    pages = [(1, "https://a.org/de/1", f'<html lang="de"><nav>{links}</nav></html>')]
    assert not _differences(spark, tmp_path, ["anchor_slug"], pages)


def test_references_without_a_semicolon_stay(spark, tmp_path):
    pages = [(i, f"https://a.org/en/{i}", '<html lang="en"><head><title>Some {0}</title><script>a&&b&amp;</script></head>'
              '<body><a href="/x{0}">Some {0}</a><article><h1>Some {0}</h1><p>Some {0}</p><!-- {0} --></article>'
              '</body></html>'.format(cut)) for i, cut in enumerate(
                  ["x &amp;&amp", "&am", "&a", "&", "&&amp;&lt", "&quot", "&copy it", "&#39 &#39;", "&ampx; &amp;lt;"])]
    names = ["extract_cards", "html_text", "page_titles", "extract_links", "extract_links_id", "anchor_keep_first"]
    assert not _differences(spark, tmp_path, names, pages)


def test_page_nodes_of_scripts_and_attributes_keep_ampersands(spark):
    page = '<a title="1 && 2 &amp 3 &amp; 4" b&c>x</a><script>a && b &amp; c</script>'
    row = spark.createDataFrame([(page,)], "h string").select(html.page_nodes("h").alias("n")).first()
    assert [(n.tag, n.attrs, n.text) for n in row.n] == [
        ("a", {"title": "1 && 2 &amp 3 & 4", "b&c": ""}, None), ("#text", None, "x"),
        ("script", {}, None), ("#raw", None, "a && b &amp; c")]


def test_pages_reach_python_in_batches_bounded_in_bytes(spark):
    from postsift.session import PYTHON_BATCH_BYTES

    @F.arrow_udf("long")
    def batch(pages):
        import pyarrow as pa
        return pa.array([sum(len(p) for p in pages.to_pylist())] * len(pages), pa.int64())

    assert PYTHON_BATCH_BYTES == spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "2m"
    pages = spark.range(0, 400, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("p"))
    assert pages.select(batch("p").alias("n")).agg(F.max("n")).first()[0] < 4 << 20
