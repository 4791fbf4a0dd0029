"""Scalar functions on literals, nulls included."""

import pytest
from pyspark.sql import functions as F

from marram.functions import dates, facts, geo, money, text, web
from marram.operators import publish

S = lambda x: F.lit(x).cast("string")
L = lambda x: F.lit(x).cast("long")


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("raw, want", [("Lekki Homes Ltd", "lekki homes"), ("LEKKI HOMES LIMITED", "lekki homes"), ("Lekki Homes Nig. Ltd", "lekki homes"), ("Ltd", "ltd"), ("", ""), (None, ""), ("O'Neil & Co", "o neil")])
def test_operator_names(spark, raw, want):
    assert value(spark, text.normalise_operator_name(S(raw))) == want


def test_keys(spark):
    assert value(spark, text.operator_key(S("Prime Suites Ltd"), S(" Lekki  Phase 1 "), S("LA"))) == "la:lekki-phase-1:prime-suites"
    assert value(spark, text.slug(S("Lekki, Phase 1!"))) == "lekki-phase-1"
    assert value(spark, text.stable_id("x", S("a"), S("b"))) == value(spark, text.stable_id("x", S("a"), S("b"))) != value(spark, text.stable_id("x", S("ab"), S("")))


@pytest.mark.parametrize("raw, want", [("0803 000 0000", "+2348030000000"), ("+234 803 000 0000", "+2348030000000"), ("8030000000", "+2348030000000"), (" +44 20 7946 ", "+44 20 7946"), ("", None), (None, None)])
def test_phones(spark, raw, want):
    assert value(spark, text.normalise_phone(S(raw))) == want


def test_phone_keys(spark):
    assert value(spark, text.phone_dedupe_key(S("+2348030000001"))) == "030000001"
    assert value(spark, text.phone_dedupe_key(S("12345678"))) is None
    assert value(spark, text.is_plausible_mobile(S("+2348030000001"))) is True
    assert value(spark, text.is_plausible_mobile(S("+2340100000001"))) is False
    assert value(spark, web.pretty_phone(S("08030000001"))) == "+234 803 000 0001"
    assert value(spark, web.pretty_phone(S("123"))) is None
    assert value(spark, web.whatsapp_href(S("08030000001"))) == "https://wa.me/2348030000001"


@pytest.mark.parametrize(
    "raw, want, longest",
    [("LEKKI 1, Lagos", "Lekki Phase 1", None), ("lekki phase 2 lagos", "Lekki Phase 1", "Lekki Phase 2"), ("ikeja g.r.a", "Ikeja GRA", None), ("wuse ii", "Wuse 2", None), ("3br o'neil ikeja-gra", "3Br O'Neil Ikeja-Gra", None), ("", None, None), (None, None, None)],
)
def test_areas(spark, raw, want, longest):
    assert value(spark, text.canonical_area(S(raw))) == want
    assert value(spark, text.canonical_area(S(raw), longest=True)) == (longest or want)


def test_hosts(spark):
    assert value(spark, web.domain_of(S("https://www.Own.ng/a b"))) == "own.ng"
    assert value(spark, web.domain_of(S("https://sub.propertypro.ng"))) is None
    assert value(spark, web.domain_of(S("own.ng"))) is None
    assert value(spark, web.is_same_host(S("https://www.a.ng"), S("http://a.ng/x"))) is True
    route = value(spark, web.contact_route(S(""), S("https://a.ng"), S("x@a.ng")))
    assert (route.kind, route.href) == ("WEBSITE", "https://a.ng")
    assert value(spark, web.contact_route(S(None), S(None), S(None))).kind == "NONE"
    kinds = [(r.kind, r.primary) for r in value(spark, web.contact_routes(S("https://jiji.ng"), S("08030000001"), S(None), S("https://s/1")))]
    assert kinds == [("PHONE", True), ("SOURCE", False)]
    assert value(spark, web.best_channel(S(None), S(None), S(None), S("https://a.ng"))) == "EMAIL"


def test_money(spark):
    for amount, bps, want in ((15_000_000, 1200, 1_800_000), (1, 5_000, 1), (-1, 5_000, 0), (3, 1, 0)):
        assert value(spark, money.apply_bps(L(amount), F.lit(bps))) == want
    for amount, step, want in ((2_500, 5_000, 5_000), (2_499, 5_000, 0), (-2_500, 5_000, 0), (7, 1, 7), (7, 0, 7)):
        assert value(spark, money.round_to_step(L(amount), F.lit(step))) == want
    assert value(spark, money.clamp_kobo(L(5), L(7), L(None))) == 7
    assert value(spark, money.format_naira(L(-123_456_789))) == "-₦1,234,567.89"
    assert value(spark, money.price_bands(L(5_000_000))) == ["under-50k", "50-100k"]
    assert value(spark, money.price_change_percent(L(200_000), L(170_000))) == -15.0
    assert value(spark, money.price_change_percent(L(0), L(5))) == 0.0
    assert value(spark, money.plausible_price_kobo(L(99_999))) is None


def test_geo(spark):
    d = F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)
    assert value(spark, geo.haversine_km(*d)) == pytest.approx(111.195, abs=0.01)
    assert value(spark, geo.haversine_km(F.lit(91.0), *d[1:])) is None
    assert value(spark, geo.centroid_for_area(S(" ikoyi "))).lat == 6.4541
    assert value(spark, geo.centroid_for_area(S("nowhere"))) is None


def test_dates(spark):
    assert value(spark, dates.iso_date(S("2026-02-28"))).isoformat() == "2026-02-28"
    assert value(spark, dates.iso_date(S("2026-02-31"))) is None and value(spark, dates.iso_date(S("26-2-1"))) is None
    a, b = F.lit("2026-04-10").cast("date"), F.lit("2026-04-12").cast("date")
    assert [d.day for d in value(spark, dates.each_night(a, b))] == [10, 11] and value(spark, dates.each_night(b, a)) == []
    assert value(spark, dates.nights_between(b, a)) is None
    assert value(spark, dates.ranges_overlap(a, b, b, b)) is False
    assert value(spark, dates.days_on_market(b, a)) == 0


def test_places(spark):
    assert value(spark, publish.place_descriptor(F.lit(3), S("FLAT"))) == "3-bedroom flat"
    assert value(spark, publish.place_descriptor(F.lit(None).cast("int"), S(None))) == "Short-let"
    assert value(spark, publish.place_href(S("npc:1 2"))) == "/stay/npc%3A1%202"
    row = spark.createDataFrame([("Lekki", " ", "LA"), ("Lagos", "Lagos", "LA"), (None, None, None)], "area string, city string, state string")
    assert [r.v for r in row.select(publish.place_location("area", "city", "state").alias("v")).collect()] == ["Lekki, Lagos", "Lagos", ""]


def test_facts(spark):
    i = lambda x: F.lit(x).cast("int")
    assert value(spark, facts.describe_factually(i(3), S("SERVICED_APARTMENT"), S(" "), S("Lagos"))) == "3-bedroom serviced apartment, Lagos"
    assert value(spark, facts.describe_factually(i(0), S(None), S(None), S(None))) == "Shortlet"
    assert value(spark, facts.parse_title_documents(S("c_of_o, x ,FREEHOLD"))) == ["C_OF_O", "FREEHOLD"] and value(spark, facts.parse_title_documents(S(None))) == []
    assert (value(spark, facts.title_risk(S("UNREGISTERED"))), value(spark, facts.title_label(S("odd")))) == ("high", None)
    assert value(spark, facts.price_movement_note(L(200), L(170), i(3))) == "Advertised rate cut 15% 3 times since we began tracking."
    assert value(spark, facts.price_movement_note(L(200), L(205), i(1))) is None and value(spark, facts.price_movement_note(L(0), L(5), i(1))) is None
