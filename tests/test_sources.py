"""Files, feeds and crawled bodies."""

import datetime as dt
import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from marram.operators import history, publish, reports, validation
from marram.sources import connectors, crawl, feeds, files
from marram.schemas import PLACE, names
from tests.test_operators import listings


def write(path, text):
    path.write_text(text)
    return str(path)


def test_listing_records_in_three_forms(spark, tmp_path):
    rows = [{"id": "npc:12:3", "source_url": "https://s/1", "bedrooms": 2, "area": "Lekki"}, {"id": "npc:9"}, {"source": "x", "source_listing_id": "7", "source_url": "https://s/7", "property_name": "N", "media": ["a"]}]
    forms = {"lines": "\n".join(map(json.dumps, rows)), "array": json.dumps(rows), "places": json.dumps({"generated_at": "x", "places": rows})}
    for form, text in forms.items():
        got, counts = files.read_listing_records(spark, write(tmp_path / form, text), form)
        assert counts.first() == (3, 1)
        found = sorted((r.source, r.source_listing_id, r.property_name, r.currency) for r in got.collect())
        assert found == [("npc", "12:3", "2-bedroom, Lekki", "NGN"), ("x", "7", "N", "NGN")], form


def test_ledger_in_any_order(spark, tmp_path):
    lines = ['{"source": "s", "source_listing_id": "a", "observed_on": "2026-09-02", "advertised_price": 7}', "", '{"source": "s", "source_listing_id": "a", "observed_on": "2026-09-01"}']
    got = files.read_ledger(spark, write(tmp_path / "ledger", "\n".join(lines)))
    assert sorted((r.observed_on.day, r.advertised_price, r.currency) for r in got.collect()) == [(1, None, "NGN"), (2, 7, "NGN")]
    path = str(tmp_path / "table")
    files.append_ledger(got, path)
    files.append_ledger(got.limit(0), path)
    back = files.read_ledger(spark, path)
    assert reports.parity_check(got.na.fill(-1), back.na.fill(-1), ["source", "source_listing_id", "observed_on", "advertised_price"]).count() == 0
    assert history.price_changes(back).count() == 0


def test_publish_read_publish(spark, tmp_path):
    table = listings(spark, [{"media": ["https://x.ng/a.jpg", "https://x.ng/b.jpg"], "advertised_price": 5_000_000, "phone": "0803"}, {"area": "Lekki"}])
    places = publish.build_directory(table, "2026-09-01", "by us")
    files.write_directory(places, str(tmp_path / "d"))
    back, there = files.read_directory(spark, str(tmp_path / "d/places"))
    assert there and back.columns == names(PLACE)
    key = lambda df: sorted((r.id, r.advertised_price, tuple(r.media or ())) for r in df.collect())
    assert key(back) == key(places) and spark.read.json(str(tmp_path / "d/counts")).first().with_photographs == 1
    again, counts = files.read_listing_records(spark, str(tmp_path / "d/places"))
    assert key(publish.build_directory(again, "2026-09-01", "by us")) == key(places) and counts.first().unusable == 0
    nothing, there = files.read_directory(spark, str(tmp_path / "missing"))
    assert not there and nothing.count() == 0
    bad, there = files.read_directory(spark, write(tmp_path / "bad.json", "{not json"))
    assert there and bad.count() == 0


def test_registry(spark, tmp_path):
    one = {"key": "b", "host": "b.ng", "layer": "DISCOVERY", "termsStatus": "PERMITTED", "robots": {"fetch": "OK", "crawlDelay": 5.0, "sitemaps": ["s"]}}
    for n, document in enumerate([[one, {**one, "key": "a"}], {"sources": [one, {**one, "key": "a"}]}]):
        got = files.read_registry(spark, write(tmp_path / f"r{n}", json.dumps(document, indent=1)))
        assert sorted((r.key, r.robots.crawlDelay) for r in got.collect()) == [("a", 5.0), ("b", 5.0)]
        files.write_registry(got, str(tmp_path / f"out{n}"))
        assert [r.key for r in spark.read.json(str(tmp_path / f"out{n}")).collect()] == ["a", "b"]
    assert files.read_registry(spark, str(tmp_path / "none")).count() == 0


def test_calendar(spark):
    event = lambda *lines: "\r\n".join(["BEGIN:VEVENT", *lines, "END:VEVENT"])
    body = "\r\n".join(["BEGIN:VCALENDAR", event("DTSTART;VALUE=DATE:2026", " 0410", "DTEND:20260413", "SUMMARY:x"), event("DTSTART:20260420T140000Z", "DTEND:20260421T100000Z"), event("DTSTART:20260411", "DTEND:20260412"), event("DTSTART:20260430"), event("DTSTART:20260502", "DTEND:20260501"), "END:VCALENDAR"])
    feeds_ = spark.createDataFrame([("u", body), ("bad", event("DTSTART:20261399", "DTEND:20261401")), ("empty", ""), ("null", None)], "unit_id string, body string")
    nights, broken = feeds.ical_to_nights(feeds_)
    assert sorted((r.unit_id, r.night.day) for r in nights.collect()) == [("u", 10), ("u", 11), ("u", 12), ("u", 20)]
    assert [r.unit_id for r in broken.collect()] == ["bad"]


def test_feeds(spark):
    payload = json.dumps({"units": [{"externalId": "1", "nightlyRateKobo": 5, "closedNights": ["2026-04-10", "2026-04-10", "bad"]}, {"name": "no id"}, {"externalId": "2"}]})
    units, nights = feeds.flatten_snapshot(spark.createDataFrame([("p", payload), ("q", "{"), ("r", None)], "partner_id string, payload string"))
    assert sorted(r.externalId for r in units.collect()) == ["1", "2"] and [(r.unit_id, r.night, r.state) for r in nights.collect()] == [("1", dt.date(2026, 4, 10), "CLOSED")]
    board = feeds.flatten_dashboard(spark.createDataFrame([("1",)], "unit_id string"), spark.createDataFrame([("1", ["2026-04-10"]), ("9", ["2026-04-10"])], "unit_id string, nights array<string>"), spark.createDataFrame([("1", ["2026-04-11"], 7)], "unit_id string, nights array<string>, rate long"))
    assert sorted((r.night.day, r.state, r.nightly_rate_kobo) for r in board.collect()) == [(10, "CLOSED", None), (11, "OPEN", 7)]
    config = json.dumps([{"externalId": "1", "icalUrl": "https://p.ng/1.ics"}, {"externalId": "2"}, {"externalId": "3", "icalUrl": "https://evil.ng/3.ics"}, {}])
    got = feeds.unit_config(spark.createDataFrame([("p", config)], "partner_id string, units string"), "https://p.ng")
    assert [(r.name, r.maxGuests, r.reason) for r in got.collect()] == [("1", 2, None), ("2", 2, "no icalUrl"), ("3", 2, "another origin"), (None, 2, "no externalId")]


def test_crawled_bodies(spark):
    bodies = spark.createDataFrame([("x", "<urlset><loc> https://a/1 </loc><loc>https://a/2</loc></urlset>"), ("y", "https://b/1\n\nhttps://b/2\nnot one"), ("z", None)], "source string, body string")
    assert sorted(r.url for r in crawl.sitemap_urls(bodies).collect()) == ["https://a/1", "https://a/2", "https://b/1", "https://b/2"]
    pages = spark.createDataFrame([("https://a.ng/l/x", '<a class="c" href="/property/p-1?q=1">1</a><a href="/property/p-1#f">again</a><a href="next">n</a><a href="#x">x</a>')], "url string, html string")
    assert [r.link for r in crawl.page_links(pages, "^/property/").collect()] == ["https://a.ng/property/p-1"]
    results = spark.createDataFrame([('{"url": "https://a", "title": "t", "summary": {"bedrooms": "2", "prose": "x"}}',), ('{"title": "t"}',), ("broken",)], "result string")
    got = crawl.discovery_candidates(results).collect()
    assert [(r.url, r.summary) for r in got] == [("https://a", {"bedrooms": "2"})]


def test_robots(spark):
    body = "User-agent: bad\nDisallow: /\n\nUser-agent: *\nUser-agent: other\nDisallow: /private # no\nDisallow:\nCrawl-delay: 5\nSitemap: https://h/s.xml\n"
    disallowed, delays, maps = crawl.robots_rules(spark.createDataFrame([("h", body), ("free", "User-agent: *\nDisallow:\n")], "host string, body string"))
    assert [(r.host, r.prefix) for r in disallowed.collect()] == [("h", "/private")] and [(r.host, r.delay) for r in delays.collect()] == [("h", 5.0)]
    assert [r.url for r in maps.collect()] == ["https://h/s.xml"]
    urls = spark.createDataFrame([("https://h/private/1",), ("https://h/open",), ("https://free/private",)], "url string")
    assert sorted(r.url for r in crawl.robots_admission(urls, disallowed).collect()) == ["https://free/private", "https://h/open"]


def test_geography(spark):
    got = crawl.geography_dim(spark, [("LA", "Lagos", 1, ["Lekki", "Ikoyi"]), ("KN", "Kano", 9, [])]).collect()
    assert sorted((r.state, r.area, r.demand_rank, r.status) for r in got if r.area) == [("LA", "Ikoyi", 20, "LIVE"), ("LA", "Lekki", 10, "LIVE")]
    assert F is not None


ICS = "BEGIN:VCALENDAR\r\nX-WR-CALNAME:{name}\r\nBEGIN:VEVENT\r\nDTSTART;VALUE=DATE:{a}\r\nDTEND;VALUE=DATE:{b}\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n"


def test_calendars_by_their_own_format(spark, tmp_path):
    folder = tmp_path / "calendars"
    (folder / "deep").mkdir(parents=True)
    (folder / "two.ics").write_text(ICS.format(name="u1", a="20260410", b="20260413") + ICS.format(name="u2", a="20260410", b="soon"))
    (folder / "deep" / "u3.ICS").write_text("BEGIN:VCALENDAR\nBEGIN:VEVENT\nDTSTA\n RT:20260420T120000Z\nDTEND:20260421\nEND:VEVENT\nBEGIN:VEVENT\nDTSTART:20260420\nDTEND:20260422\nEND:VEVENT\nBEGIN:VEVENT\nDTSTART:20260420\nEND:VEVENT\nEND:VCALENDAR")
    (folder / "u4.ics").write_text("")
    (folder / ".hidden.ics").write_text(ICS.format(name="x", a="20260410", b="20260413"))
    (folder / "notes.txt").write_text(ICS.format(name="x", a="20260410", b="20260413"))
    connectors.register(spark)
    got = sorted((r.unit_id, r.night and r.night.day, r.reason) for r in spark.read.format("marram_calendars").load(str(folder)).collect())
    assert got == [("u1", 10, None), ("u1", 11, None), ("u1", 12, None), ("u2", None, "malformed date"), ("u3", 20, None), ("u3", 21, None)]
    # the same as the SQL form of the parser
    feeds_in = spark.createDataFrame([("u1", ICS.format(name="u1", a="20260410", b="20260413")), ("u2", ICS.format(name="u2", a="20260410", b="soon"))], "unit_id string, body string")
    nights, bad = feeds.ical_to_nights(feeds_in)
    assert sorted(r.night.day for r in nights.collect()) == [10, 11, 12] and [r.unit_id for r in bad.collect()] == ["u2"]
    many = spark.read.format("marram_calendars").option("partBytes", 1).load(str(folder))
    assert many.rdd.getNumPartitions() == 3 and many.count() == len(got)
    (tmp_path / "none").mkdir()
    assert spark.read.format("marram_calendars").load(str(tmp_path / "none")).count() == 0


def test_calendars_as_a_stream_come_once(spark, tmp_path):
    connectors.register(spark)
    folder = tmp_path / "in"
    folder.mkdir()

    def run():
        stream = spark.readStream.format("marram_calendars").load(str(folder))
        stream.writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"), format="parquet").awaitTermination()
        return sorted(r.unit_id for r in spark.read.parquet(str(tmp_path / "out")).collect())

    for n in range(3):
        (folder / f"{9 - n}.ics").write_text(ICS.format(name=f"u{n}", a="20260410", b="20260411"))
        os.utime(folder / f"{9 - n}.ics", (1000 + n // 2, 1000 + n // 2))  # two files of one time
        if n:
            assert run() == [f"u{i}" for i in range(n + 1)]
    assert run() == ["u0", "u1", "u2"]  # nothing new


@pytest.mark.parametrize("sizes", [[0], [0, 0, 90], [0, 90, 0, 90]])
def test_files_are_dealt_though_the_first_is_empty(sizes):
    parts = connectors._dealt([(n, f"f{n}", size) for n, size in enumerate(sizes)], 100)
    assert [p for part in parts for p in part.paths] == [f"f{n}" for n in range(len(sizes))] and all(part.paths for part in parts)


def test_calendars_whose_first_file_is_empty(spark, tmp_path):
    """As Spark's writer leaves one for an empty partition."""
    (tmp_path / "in").mkdir()
    for n, text in enumerate(["", ICS.format(name="u1", a="20260410", b="20260412"), ""]):
        (tmp_path / "in" / f"{n}.ics").write_text(text)
        os.utime(tmp_path / "in" / f"{n}.ics", (1000 + n, 1000 + n))
    connectors.register(spark)
    assert spark.read.format("marram_calendars").load(str(tmp_path / "in")).count() == 2


def test_a_stream_of_calendars_whose_first_file_is_empty(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n, text in enumerate(["", ICS.format(name="u1", a="20260410", b="20260412")]):
        (tmp_path / "in" / f"{n}.ics").write_text(text)
        os.utime(tmp_path / "in" / f"{n}.ics", (1000 + n, 1000 + n))
    connectors.register(spark)
    stream = spark.readStream.format("marram_calendars").load(str(tmp_path / "in"))
    stream.writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"), format="parquet").awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_calendars_where_only_the_driver_finds_the_package(tmp_path):
    """Python that Spark starts beside the driver to plan a source's batches doesn't get what was sent to executors."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "u1.ics").write_text(ICS.format(name="u1", a="20260410", b="20260412"))
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from marram.sources import connectors
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
connectors.register(spark)
folder = {str(tmp_path)!r}
assert spark.read.format("marram_calendars").load(folder + "/in").count() == 2
stream = spark.readStream.format("marram_calendars").load(folder + "/in")
stream.writeStream.option("checkpointLocation", folder + "/cp").trigger(availableNow=True).start(folder + "/out", format="parquet").awaitTermination()
assert spark.read.parquet(folder + "/out").count() == 2
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]


def test_pages_by_their_own_format(spark, tmp_path):
    folder = tmp_path / "pages"
    folder.mkdir()
    (folder / "a.html").write_text("<link href='https://x.ng/1' rel=canonical><p>one")
    (folder / "b.htm").write_text("<p>two é")
    connectors.register(spark)
    got = {r.url: r.html for r in spark.read.format("marram_pages").load(f"file://{folder}").collect()}
    assert got == {"https://x.ng/1": "<link href='https://x.ng/1' rel=canonical><p>one", f"file://{folder}/b.htm": "<p>two é"}


def test_a_document_has_the_same_bytes_however_it_is_partitioned(spark, tmp_path):
    base = dict.fromkeys(names(PLACE))
    rows = [tuple({**base, "id": f"s:{i:03}", "source": "s", "source_url": f"https://s.ng/{i}", "area": "é \"x\"\nb", "advertised_price": i * 1000, "currency": "NGN", "contact_route": ("NONE" if i % 3 else "PHONE", "tel:1"), "first_seen_at": dt.date(2026, 1, 1)}.values()) for i in range(120)]
    places = spark.createDataFrame(rows, PLACE)
    found = set()
    for parts in (1, 7, 200):
        path = tmp_path / f"d{parts}.json"
        path.write_text("old")
        files.write_document(places.repartition(parts), str(path))
        found.add(path.read_bytes())
    assert len(found) == 1 and sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["d1.json", "d200.json", "d7.json"]
    said = json.loads(found.pop())
    assert [p["id"] for p in said["places"]] == [f"s:{i:03}" for i in sorted(range(120), key=lambda i: (i % 3 > 0, i))] and said["counts"]["places"] == 120
    assert sorted(map(str, files.read_document(spark, str(path)).collect())) == sorted(map(str, places.collect()))
    listed, counts = files.read_listing_records(spark, str(path), "places")
    assert listed.count() == 120 and counts.first().unusable == 0
    files.write_document(places.limit(0), str(path))
    assert json.loads(path.read_text())["places"] == [] and files.read_document(spark, str(path)).count() == 0


def test_a_run_that_is_written_again_replaces_itself(spark, tmp_path):
    rows = spark.createDataFrame([("s", "a", dt.date(2026, 9, d), d, d) for d in (1, 2)], "source string, source_listing_id string, observed_on date, advertised_price long, seq long")
    for run in ("r1", "r2", "r2"):
        files.append_ledger(rows, str(tmp_path / "ledger"), run)
    assert spark.read.json(str(tmp_path / "ledger")).count() == 4
    assert [(r.observed_on.day, r["rank"]) for r in files.ordered_ledger(files.read_ledger(spark, str(tmp_path / "ledger"))).orderBy("rank").collect()] == [(1, 1), (2, 2)]


def test_a_model_is_loaded_once_a_task_and_sees_batches(spark, tmp_path):
    rows = [(i, float(i), None if i % 7 == 0 else 2.0) for i in range(500)]
    calls = str(tmp_path)

    def load():
        import uuid

        with open(f"{calls}/load-{uuid.uuid4().hex}", "w"):
            pass

        def model(x):
            with open(f"{calls}/call-{uuid.uuid4().hex}", "w"):
                pass
            return x[:, 0] * 10 + x[:, 1]

        return model

    df = spark.createDataFrame(rows, "id long, a double, b double").repartition(2)
    got = {r.id: r.model_score for r in validation.score_photos(df, ["a", "b"], load).collect()}
    assert got == {i: None if b is None else a * 10 + b for i, a, b in rows}
    names_ = os.listdir(calls)
    assert sum(n.startswith("load") for n in names_) == 2 and sum(n.startswith("call") for n in names_) <= 4
