"""Single functions that no registered query compares."""

import datetime as dt
import html

from pyspark.sql import functions as F

from marram.functions import dates, money, text, web
from marram.operators import extraction, history, leads, pricing, publish, reports, upserts, validation
from marram.sources import files


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_instants_and_retention(spark):
    as_text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    assert value(spark, as_text(dates.to_utc(F.lit("2026-01-02T03:04:05")))) == "2026-01-02 03:04:05"
    assert value(spark, as_text(dates.to_utc(F.lit("2026-01-02T03:04:05+02:00")))) == "2026-01-02 01:04:05"
    assert value(spark, dates.to_utc(F.lit("soon"))) is None and value(spark, dates.to_utc(F.lit(None).cast("string"))) is None
    at = F.lit("2026-01-01 00:00:00").cast("timestamp")
    assert value(spark, as_text(dates.retention_expiry(at))) == "2027-01-01 00:00:00"
    assert value(spark, dates.is_retention_expired(at, at)) is True
    assert value(spark, dates.is_retention_expired(dates.retention_expiry(at, 1), at)) is False


def test_contacts(spark):
    got = value(spark, web.sanitise_contact(F.lit("0803 000 0000"), F.lit(" A@B.ng "), F.lit("https://x.ng/"), F.lit("@handle")))
    assert (got.phone, got.email.strip(), got.website, got.instagram) == ("+2348030000000", "a@b.ng", "https://x.ng", "handle")
    for site, phone, want in (("https://own.ng", "08030000000", "HIGH"), ("https://jiji.ng/x", "08030000000", "MEDIUM"), ("https://own.ng", None, "MEDIUM"), (None, None, "LOW")):
        assert value(spark, web.contact_confidence(F.lit(site).cast("string"), F.lit(phone).cast("string"))) == want


def test_rates_and_shares(spark):
    rates = F.create_map(F.lit("2026-01-01"), F.lit(500), F.lit("2026-01-02"), F.lit(900))
    assert value(spark, money.effective_nightly_rate(F.lit(700), rates)) == 900
    assert value(spark, money.effective_nightly_rate(F.lit(1_000), rates)) == 1_000
    assert value(spark, money.effective_nightly_rate(F.lit(700), F.lit(None).cast("map<string,int>"))) == 700
    long = lambda x: F.lit(x).cast("long")
    assert [value(spark, pricing.split_percent(long(a), long(b))) for a, b in ((2, 3), (3, 3), (0, 3), (1, 0))] == [66, 100, 0, None]
    documents = ['{"n": 5}', '{"n": "7"}', '{"n": ""}', '{"n": "x"}', "{}", None]
    assert [value(spark, text.json_int(F.lit(d).cast("string"), "n")) for d in documents] == [5, 7, None, None, None, None]


def test_areas_and_links(spark):
    rows = spark.createDataFrame([("lekki 1",), ("nowhere",), (None,)], "area string")
    assert [r.area for r in extraction.canonical_areas(rows).collect()][0] == "Lekki Phase 1"
    places = spark.createDataFrame([("LA", "Lekki Phase 1", 2), ("FC", None, 0), (None, "x", 1)], "state string, area string, bedrooms int")
    assert [r.h for r in places.select(publish.bookable_search_href("state", "area", "bedrooms").alias("h")).collect()] == ["/search?state=LA&area=Lekki+Phase+1&bedrooms=2", "/search?state=FC", None]


def test_publish_violations(spark):
    rows = spark.createDataFrame([(1, '{"phone": "1", "source": "s"}'), (2, '{"booking_url": "u", "phone": "1"}'), (3, '{"made_up": 1}')], "seq long, record string")
    found = {r.seq for r in validation.publish_violations(rows).collect()}
    assert found == {2, 3}


def test_price_history(spark):
    day = dt.date(2026, 1, 1)
    rows = [("s", "1", day + dt.timedelta(days=i), 100 + i) for i in (2, 0, 1)]
    found = history.price_history(spark.createDataFrame(rows, "source string, source_listing_id string, observed_on date, advertised_price long")).collect()
    assert [r.advertised_price for r in found] == [100, 101, 102]


def test_operators_and_locations_are_merged(spark):
    kinds = "operator_key string, display_name string, phone string, email string, website string, instagram string, state string"
    state = spark.createDataFrame([("a", "A", "1", None, "w", None, "LA")], kinds)
    batch = spark.createDataFrame([("a", "A2", None, "e", None, None, "LA", 1), ("b", "B", None, None, None, None, "XX", 1), ("c", None, None, None, None, None, "LA", 1), ("d", "D", None, None, None, None, "FC", 1)], kinds + ", seq long")
    states = spark.createDataFrame([("LA",), ("FC",)], "state string")
    once = upserts.upsert_operators(state, batch, states)
    got = {r.operator_key: r for r in once.collect()}
    assert set(got) == {"a", "d"} and (got["a"].display_name, got["a"].phone, got["a"].email, got["a"].website) == ("A2", "1", "e", "w")
    assert reports.parity_check(once, upserts.upsert_operators(once, batch, states), once.columns).count() == 0
    places = spark.createDataFrame([("LA", "ajah", 1.0)], "state string, slug string, lat double")
    more = spark.createDataFrame([("LA", "ajah", 2.0, 1), ("LA", "yaba", 3.0, 1)], "state string, slug string, lat double, seq long")
    assert {(r.slug, r.lat) for r in upserts.upsert_locations(places, more).collect()} == {("ajah", 2.0), ("yaba", 3.0)}


def test_pages_and_leads_files(spark, tmp_path):
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "a.html").write_text("<p>one\ntwo</p>")
    got = files.read_pages(spark, str(tmp_path / "pages"), "html").collect()
    assert [(r.url.rsplit("/", 1)[1], r.html) for r in got] == [("a.html", "<p>one\ntwo</p>")]
    spark.createDataFrame([("u", "h")], "url string, html string").write.parquet(str(tmp_path / "table"))
    assert [tuple(r) for r in files.read_pages(spark, str(tmp_path / "table")).collect()] == [("u", "h")]
    files.write_leads(spark.createDataFrame([("x", 3)], "id string, score int"), str(tmp_path / "leads"))
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "leads")).select("id", "score").collect()] == [("x", 3)]


def test_crawl_stats_count_every_outcome(spark):
    rows = spark.createDataFrame([("LA", f"o{i:03}") for i in range(150)] + [("LA", None)], "state string, outcome string")
    total = reports.crawl_stats(rows).where("state is null").first().asDict()
    assert total["urls"] == 151 and sum(v for k, v in total.items() if k.startswith("o")) == 150


def test_call_list_order(spark):
    rows = spark.createDataFrame([("b", 10, 1, None), ("a", 10, 1, None), ("c", 10, 5, None), ("d", 90, 1, "NO_CONTACT_CHANNEL"), ("e", 20, 1, None)], "id string, score int, listing_count int, blocked_reason string")
    assert [r.id for r in leads.call_list(rows).collect()] == ["e", "c", "a", "b"]


def test_references_as_the_standard_library_decodes_them(spark):
    texts = [
        "a &amp; b", "&lt;&gt;&quot;&apos;", "&notit; &notin; &not", "&copy 2020", "&#8358;5 &#x20AC;&#x80;&#0;&#xD800;&#x110000;&#99999999999;", "&#1;x&#11;", "&NotEqualTilde;", "&hellip;&ndash;&Aacute", "&", "&;", "&bogus;", "a&b=c", "&#;", "&#x;",
        "&amp;lt;", "&#0065;&#x0041", "&xi;&Xi;", "&frac12;",
    ]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", extraction.unescape(F.col("t")).alias("u")).collect()
    assert {texts[r.i]: r.u for r in got} == {t: html.unescape(t) for t in texts}
