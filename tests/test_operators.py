"""Operators on hand-made rows."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from marram.operators import availability, entities, history, intervals, leads, pricing, publish, reports, search, upserts, validation
from marram.operators.graph import min_label_components
from marram.operators.order import with_rank
from marram.plans.pipeline import run_listings
from marram.schemas import LISTING, PLACE, names

OBS = "source string, source_listing_id string, observed_on date, advertised_price long, seq long"
day = lambda d: dt.date(2026, 9, d)


def obs(spark, rows):
    return history.listing_history(spark.createDataFrame([("s", i, d and day(d), p, n) for n, (i, d, p) in enumerate(rows)], OBS))


def listings(spark, rows):
    base = dict.fromkeys(names(LISTING))
    return spark.createDataFrame([tuple({**base, "seq": n, "source": "s", "source_listing_id": f"L{n}", "source_url": f"https://s.ng/{n}", "property_name": f"P{n}", "currency": "NGN", **r}.values()) for n, r in enumerate(rows)], LISTING)


def test_history_last_write_of_a_day_wins(spark):
    h = obs(spark, [("a", 2, 5), ("a", 1, 9), ("a", 2, 7), ("a", None, 1)])
    assert sorted((r.observed_on.day, r.advertised_price) for r in h.collect()) == [(1, 9), (2, 7)]
    changes = history.price_changes(h).collect()
    assert [(c.previous, c.current, c.direction, c.percent) for c in changes] == [(9, 7, "cut", -22.2)]


@pytest.mark.parametrize(
    "known, now, today, want",
    [
        ([("a", 1, 200_000)], [("a", 8, 170_000)], 8, {"price_changes": 1}),
        ([("a", 1, None)], [("a", 8, 200_000)], 8, {"unchanged": 1}),
        ([("a", 1, None)], [("a", 8, None)], 8, {"unchanged": 1}),
        ([("a", 1, 5)], [], 4, {}),
        ([("a", 1, 5)], [], 8, {}),
        ([("a", 1, 5)], [], 9, {"delisted": 1}),
        ([("a", 1, 5)], [("b", 20, 5)], 20, {"delisted": 1, "new_listings": 1}),
        ([("a", 1, 5), ("a", 3, 6)], [("a", 3, 6)], 3, {"price_changes": 1}),
        ([("a", 1, 5), ("a", 2, None)], [("a", 3, 6)], 3, {"unchanged": 1}),
        ([], [], 3, {}),
    ],
)
def test_detect_changes(spark, known, now, today, want):
    found = history.change_summary(history.detect_changes(obs(spark, known), obs(spark, now), f"2026-09-{today:02d}")).first().asDict()
    assert {k: v for k, v in found.items() if v} == want


def test_components_do_not_depend_on_order(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, 101)]
    rnd.shuffle(edges)
    nodes = spark.createDataFrame([(i,) for i in [*range(61), 100, 101, 200]], "node long")
    for parts in (1, 7):
        got = dict(min_label_components(nodes, spark.createDataFrame(edges, "a long, b long").repartition(parts)).collect())
        assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, 200: 200}


def test_transitive_operator_and_funnel(spark):
    rows = [
        {"phone": "0803 000 0000", "area": "lekki", "state": "LA"},
        {"phone": "+234 803 000 0000", "email": "bookings@lekkihomes.com", "pms_detected": "smoobu", "operator_name": "Lekki Homes Ltd", "advertised_price": 500},
        {"website": "https://lekkihomes.com/availability", "operator_name": "LH"},
        {"operator_name": "Prime Suites", "state": "FC", "area": "Wuse"},
        {"operator_name": "Prime Suites", "state": "LA", "area": "Wuse"},
        {"operator_name": "Prime Suites Ltd", "state": "FC", "area": "wuse"},
        {},
    ]
    table = listings(spark, rows)
    resolved = entities.resolve_operators(table)
    assert {r.seq: r.component for r in resolved.collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 3, 6: 6}
    profiles = entities.operator_profiles(resolved)
    by = {r.component: r for r in profiles.collect()}
    top = by[0]
    assert (top.display_name, top.identity_status, top.listing_count, top.operator_id) == ("Lekki Homes Ltd", "IDENTIFIED", 3, "la:lekki-phase-1:lekki-homes")
    assert (top.phones, top.pms, top.lowest_price) == (["+2348030000000"], ["smoobu"], 500)
    assert (by[6].display_name, by[6].identity_status, by[6].phones) == ("P6", "UNIDENTIFIED", [])
    assert entities.funnel(table, profiles).first() == (7, 7, 4, 2, 1)
    evidence = {(e.kind, e.signal, e.value, e.a, e.b) for e in entities.match_evidence(table).collect()}
    assert ("STRONG", "domain", "lekkihomes.com", 1, 2) in evidence and ("WEAK", "name", "fc:wuse:prime-suites", 3, 5) in evidence
    empty = table.limit(0)
    assert entities.operator_profiles(entities.resolve_operators(empty)).count() == 0


def sequential_evidence(edges):
    """Edges (kind, signal, value, a, b) taken one after another; those that join two sets."""
    parent, out = {}, set()

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    places = ["phone", "email", "domain", "name"]
    for e in sorted(edges, key=lambda e: (e[0] == "WEAK", e[3], places.index(e[1]), e[2], e[4])):
        if find(e[3]) != find(e[4]):
            parent[find(e[4])] = find(e[3])
            out.add(e)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_evidence_is_what_joins_two_sets(spark, seed):
    rnd = random.Random(seed)
    rows = [
        {
            "phone": rnd.choice([None, f"0803000{rnd.randrange(12):04}"]),
            "email": rnd.choice([None, None, f"a@site{rnd.randrange(9)}.ng", f"b@site{rnd.randrange(9)}.ng"]),
            "website": rnd.choice([None, None, f"https://site{rnd.randrange(12)}.ng/x"]),
            "operator_name": rnd.choice([None, None, f"Name {rnd.randrange(9)}"]),
            "state": "LA",
            "area": "lekki",
        }
        for _ in range(60)
    ]
    table = listings(spark, rows)
    resolved = entities.resolve_operators(table).checkpoint()
    got = {tuple(r) for r in entities.joining_evidence(table).collect()}
    assert got == sequential_evidence({tuple(r) for r in entities.match_evidence(table).collect()})
    sizes = {r.component: r["count"] for r in resolved.groupBy("component").count().collect()}
    held = {r.component: r["count"] for r in entities.profile_evidence(resolved).groupBy("component").count().collect()}
    assert held == {c: n - 1 for c, n in sizes.items() if n > 1}
    assert entities.joining_evidence(table.limit(0)).count() == 0


def test_evidence_of_a_chain(spark):
    rows = [{"phone": f"0803000{i // 2:04}", "website": f"https://s{(i + 1) // 2}.ng"} for i in range(60)]
    assert entities.joining_evidence(listings(spark, rows)).count() == 59


def test_leads_bear_every_rate(spark):
    rows = [
        {"phone": "08030000001", "state": "LA", "area": "lekki", "advertised_price": 100},
        {"phone": "08030000001", "state": "LA", "area": "lekki", "advertised_price": 300},
        {"phone": "08030000001", "state": "LA", "area": "lekki", "advertised_price": 300},
        {"phone": "08030000002", "state": "LA", "area": "lekki", "advertised_price": 500},
        {"phone": "08030000003", "state": "LA", "area": "lekki", "advertised_price": None},
        {"phone": "08030000004", "state": "OY", "area": "ibadan", "advertised_price": 0},
    ]
    resolved = entities.resolve_operators(listings(spark, rows)).checkpoint()
    profiles, rates = entities.operator_profiles(resolved, with_lists=False), entities.observed_rates(resolved)
    assert sorted(tuple(r) for r in rates.collect()) == [(0, 100), (0, 300), (3, 500)]
    found = entities.profiles_to_leads(profiles, "2026-01-01 00:00:00")
    assert "observed_rates" not in found.columns and {r.component: r.lowest_rate for r in found.collect()} == {0: 100, 3: 500, 4: None, 5: None}
    # the median of all rates, 100 300 500; of the lowest ones it would be 300 of two
    assert [tuple(r) for r in leads.market_benchmark(found, rates).collect()] == [("LA", "Lekki Phase 1", 300, 3)]
    whole = entities.profiles_to_leads(profiles, "2026-01-01 00:00:00", rates)
    assert {r.component: r.observed_rates for r in whole.collect()} == {0: [100, 300], 3: [500], 4: [], 5: []}
    assert [tuple(r) for r in leads.market_benchmark(whole).collect()] == [("LA", "Lekki Phase 1", 300, 3)]
    position = lambda x: {r.component: r.rate_position_bps for r in leads.assess_leads(x, leads.market_benchmark(found, rates), F.lit("2026-01-02").cast("timestamp")).collect()}
    assert position(found) == position(whole) == {0: -6_667, 3: 6_667, 4: None, 5: None}


def test_ranks(spark):
    rnd = random.Random(7)
    rows = [(i, rnd.randrange(20)) for i in range(500)]
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "id long, x int").repartition(parts)
        got = {r.id: r.rank for r in with_rank(df, F.desc("x"), F.col("id")).collect()}
        assert got == {i: n for n, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}
    assert with_rank(df.limit(0), F.col("id")).count() == 0
    profiles = entities.operator_profiles(entities.resolve_operators(listings(spark, [{"phone": "08030000001"}, {"phone": "08030000002"}, {"phone": "08030000002"}])))
    assert [(r.component, r["rank"]) for r in entities.ranked_profiles(profiles).orderBy("rank").collect()] == [(1, 1), (0, 2)]


def quoted(spark, nights, rate, state="LA", **extra):
    rows = spark.createDataFrame([(1, nights, rate, state, *extra.values())], ", ".join(["booking_id long", "nights int", "rate long", "state string", *(f"{k} long" for k in extra)]))
    return pricing.compute_quotes(pricing.resolve_fee_policy(rows, pricing.default_fee_policies(spark), partner_col=None), "rate", **{k: k for k in extra})


def test_quotes(spark):
    q = quoted(spark, 1, 15_000_000).first()
    assert (q.fee_kobo, q.vat_kobo, q.total_kobo, q.policy_id, q.problem) == (1_800_000, 135_000, 16_935_000, "state-la", None)
    assert quoted(spark, 10, 10_000_000, discount_bps=1000).first().fee_kobo == 8_000_000
    assert quoted(spark, 1, 1_000_000).first().fee_kobo == 300_000
    assert quoted(spark, 1, 1_000_000, "XX").first().policy_id == "global-default"
    assert quoted(spark, 1, 0).first().problem == "rate must be positive"
    assert quoted(spark, 0, 5).first().problem == "check-out must be after check-in"
    full = quoted(spark, 2, 1_000_000, extra_guests=2, extra_fee=10_000, cleaning_fee=50_000, discount_bps=500)
    lines = {r.line: r.amount_kobo for r in pricing.quote_lines(full, ["booking_id"]).collect()}
    assert list(lines) == ["room", "extra_guests", "los_discount", "cleaning_fee", "service_fee", "service_fee_vat"]
    assert sum(lines.values()) == full.first().total_kobo and lines["extra_guests"] == 40_000 and lines["los_discount"] == -100_000
    balance = pricing.ledger_balance(pricing.quote_lines(full, ["booking_id"]), full).first()
    assert balance.balanced


def test_partner_policy_comes_first(spark):
    policies = pricing.default_fee_policies(spark).union(spark.createDataFrame([("p7", "PARTNER", "7", 500, 0, None, 750, 1, None)], pricing.FEE_POLICY))
    rows = spark.createDataFrame([(7, "LA"), (8, "LA"), (9, None)], "partner_id int, state string")
    assert {r.partner_id: r.policy.id for r in pricing.resolve_fee_policy(rows, policies).collect()} == {7: "p7", 8: "state-la", 9: "global-default"}
    none = pricing.resolve_fee_policy(rows, policies.where("scope = 'PARTNER'"))
    assert [r.policy is None for r in none.orderBy("partner_id").collect()] == [False, True, True]


def test_splits(spark):
    q = quoted(spark, 1, 15_000_000)
    s = pricing.compute_splits(q, 150, 10_000, 200_000).first()
    assert (s.partner_share_kobo, s.processor_fee_kobo, s.platform_share_kobo) == (15_000_000, 200_000, 1_735_000)
    s = pricing.compute_splits(q, 150, 10_000, 200_000, bearer="partner").first()
    assert (s.partner_share_kobo, s.platform_share_kobo, s.split_problem) == (14_800_000, 1_935_000, None)
    assert pricing.compute_splits(q, 150, 10_000, 200_000, withholding=15_000_000).first().split_problem == "partner share is not positive"
    rnd = random.Random(2)
    rows = spark.createDataFrame([(i, rnd.randint(1, 30), rnd.randint(1, 10**9), rnd.choice(["LA", "OY", "x"])) for i in range(300)], "booking_id long, nights int, rate long, state string")
    all_ = pricing.compute_splits(pricing.compute_quotes(pricing.resolve_fee_policy(rows, pricing.default_fee_policies(spark), partner_col=None), "rate"), 150, 10_000, 200_000)
    assert all_.where("partner_share_kobo + platform_share_kobo + processor_fee_kobo <> total_kobo").count() == 0


def test_discount_ties_go_to_the_first(spark):
    rules = [("a", 7, 1000), ("b", 3, 1000), ("c", 2, 500)]
    got = spark.createDataFrame([(8,), (4,), (2,), (1,)], "n int").select(pricing.best_discount("n", rules)["label"].alias("l")).collect()
    assert [r.l for r in got] == ["a", "b", "c", None]


UNITS = "unit_id string, partner_id string, max_guests int, bedrooms int, min_nights int, max_nights int, nightly_rate_kobo long, cleaning_fee_kobo long, state string, area string, lat double, lng double, title_document string, status string"


def test_search_gives_reasons(spark):
    good = ("u", "p", 4, 2, 1, 30, 10_000_000, 0, "LA", "Lekki", 6.45, 3.47, "C_OF_O", "LISTED")
    change = lambda **kw: tuple({**dict(zip([c.split()[0] for c in UNITS.split(", ")], good)), **kw}.values())
    units = spark.createDataFrame(
        [good, change(unit_id="small", max_guests=1), change(unit_id="long", min_nights=5), change(unit_id="lost", lat=None), change(unit_id="far", lat=7.9), change(unit_id="orphan", partner_id="q"), change(unit_id="free", nightly_rate_kobo=0), change(unit_id="other", state="FC"), change(unit_id="off", status="DRAFT"), change(unit_id="flat", title_document="FREEHOLD")], UNITS
    )
    found = search.search_places(units, spark.createDataFrame([("p",)], "partner_id string"), pricing.default_fee_policies(spark), state="LA", check_in="2026-05-01", check_out="2026-05-03", near=(6.45, 3.47, 5.0), titles=["C_OF_O"])
    reasons = {r.unit_id: r.reasons for r in found.collect()}
    assert reasons == {
        "u": [], "small": ["Sleeps 1, 2 requested"], "long": ["Minimum stay is 5 nights"], "lost": ["Location not yet surveyed"], "far": ["outside the search area"], "orphan": ["Place has no registered operator"], "free": ["rate must be positive"], "flat": ["Title is FREEHOLD"],
    }
    assert [r.unit_id for r in search.order_results(found, "distance").collect()] == ["u"]
    outside = search.search_places(units.limit(1), spark.createDataFrame([("p",)], "partner_id string"), pricing.default_fee_policies(spark), state="LA", check_in="2026-05-01", check_out="2026-05-03", band="under-50k")
    assert outside.first().reasons == ["total is outside under-50k"]
    queries = spark.createDataFrame([(1, "LA", "Lekki", 2, 0, None, None, None, 2), (2, "LA", None, 2, 0, 6.45, 3.47, 5.0, 2)], "query_id int, q_state string, q_area string, q_guests int, q_bedrooms int, q_lat double, q_lng double, q_radius double, nights int")
    batch = search.search_batch(units, spark.createDataFrame([("p",)], "partner_id string"), pricing.default_fee_policies(spark), queries)
    assert {r.unit_id for r in batch.collect() if not r.reasons and r.query_id == 2} == {"u", "flat"}


def test_batch_search_finds_the_same_without_the_excluded(spark):
    names_ = [c.split()[0] for c in UNITS.split(", ")]
    good = dict(zip(names_, ("u", "p", 4, 2, 1, 30, 10_000_000, 0, "LA", "Lekki", 6.45, 3.47, "C_OF_O", "LISTED")))
    changes = [{}, *[{"unit_id": f"no {c}", c: None} for c in ("max_guests", "bedrooms", "min_nights", "max_nights")], {"unit_id": "small", "max_guests": 1}, {"unit_id": "long", "min_nights": 5}, {"unit_id": "orphan", "partner_id": "q"}, {"unit_id": "nobody", "partner_id": None}]
    units = spark.createDataFrame([tuple((good | c).values()) for c in changes], UNITS)
    queries = spark.createDataFrame([(1, "LA", None, 2, 0, None, None, None, 2), (2, "LA", None, 2, 3, 6.45, 3.47, 5.0, 2)], "query_id int, q_state string, q_area string, q_guests int, q_bedrooms int, q_lat double, q_lng double, q_radius double, nights int")
    found = [
        {(r.query_id, r.unit_id) for r in search.search_batch(units, spark.createDataFrame([("p",)], "partner_id string"), pricing.default_fee_policies(spark), queries, with_excluded=x).collect() if not r.reasons}
        for x in (True, False)
    ]
    assert found[0] == found[1] == {(1, u) for u in ("u", "no max_guests", "no bedrooms", "no min_nights", "no max_nights")} | {(2, "no bedrooms")}


def test_radius_edge(spark):
    from marram.functions.geo import haversine_km

    points = spark.createDataFrame([("p", 6.5, 3.5)], "unit_id string, lat double, lng double")
    d = points.select(haversine_km(F.lit(6.4), F.lit(3.4), "lat", "lng").alias("d")).first().d
    centre = lambda r: spark.createDataFrame([(6.4, 3.4, r)], "q_lat double, q_lng double, q_radius double")
    assert search.radius_join(points, centre(d)).count() == 1 and search.radius_join(points, centre(d * 0.999)).count() == 0
    assert search.radius_join(points, centre(0.0)).count() == 0


def test_crowded_cells_are_cut(spark):
    """Most points lie in one small town, many at one spot: the same pairs, and no leaf of more than its share."""
    from marram.functions.geo import haversine_km

    rnd = random.Random(6)
    rows = [(i, 6.45 + rnd.random() / 500, 3.47 + rnd.random() / 500) for i in range(400)] + [(400 + i, 6.45, 3.47) for i in range(150)] + [(600 + i, 6 + rnd.random(), 3 + rnd.random()) for i in range(200)] + [(900, None, 3.0), (901, 95.0, 3.0), (902, -6.3, -3.2)]
    points = spark.createDataFrame(rows, "unit_id long, lat double, lng double").repartition(5)
    centres = spark.createDataFrame([(i, 6 + rnd.random(), 3 + rnd.random(), rnd.choice([0.05, 2.0, 40.0])) for i in range(25)] + [(50, 6.45, 3.47, 0.01), (51, 6.451, 3.471, 0.1), (52, -6.3, -3.2, 1.0), (53, None, 3.0, 1.0)], "c long, q_lat double, q_lng double, q_radius double")
    want = {(r.c, r.unit_id) for r in points.crossJoin(centres).where(haversine_km("q_lat", "q_lng", "lat", "lng") <= F.col("q_radius")).where("lat < 90").collect()}
    for most in (10, 100, 20_000):
        got = search.radius_join(points, centres, leaf_points=most).collect()
        assert {(r.c, r.unit_id) for r in got} == want and len(got) == len(want)
        assert sorted(got[0].asDict()) == ["c", "distance_km", "lat", "lng", "q_lat", "q_lng", "q_radius", "unit_id"]
    step = 25.0 / search.KM_PER_DEGREE
    cells = points.where("lat < 90").selectExpr("unit_id", f"floor(lat / {step}) AS cell_lat", f"floor(lng / {step}) AS cell_lng", f"int(floor((lat / {step} - floor(lat / {step})) * 256)) AS fine_lat", f"int(floor((lng / {step} - floor(lng / {step})) * 256)) AS fine_lng")
    leaves = search._leaves(cells, step, 100).collect()
    assert sum(r.n for r in leaves) == 751 and all(r.n <= 100 or r.depth == search.CUTS for r in leaves) and max(r.depth for r in leaves) > 3


def test_the_cheapest_of_each_query(spark):
    rnd = random.Random(8)
    one = lambda i: (f"u{i:03}", rnd.choice(["p", "p", "q", None]), rnd.choice([2, 4, None]), rnd.choice([0, 1, 3]), rnd.choice([1, 2]), rnd.choice([2, 30, None]), rnd.choice([0, 5_000_000, 9_000_000, 7_000_000]), rnd.choice([0, 10_000]), rnd.choice(["LA", "FC"]), rnd.choice(["Lekki", "Ikeja", None]), rnd.choice([None, 6.45, 6.46]), 3.47, "C_OF_O", rnd.choice(["LISTED", "LISTED", "DRAFT"]))
    units = spark.createDataFrame([one(i) for i in range(150)], UNITS)
    rows = [(i, rnd.choice(["LA", "FC"]), rnd.choice([None, "Lekki"]), rnd.choice([1, 3]), rnd.choice([0, 2]), *rnd.choice([(None, None, None), (6.45, 3.47, 0.5), (6.45, 3.47, 9.0)]), rnd.choice([0, 1, 2, 5])) for i in range(30)]
    queries = spark.createDataFrame(rows, "query_id int, q_state string, q_area string, q_guests int, q_bedrooms int, q_lat double, q_lng double, q_radius double, nights int")
    rest = (spark.createDataFrame([("p",), ("p",)], "partner_id string"), pricing.default_fee_policies(spark), queries)
    every = [r for r in search.search_batch(units, *rest).collect() if not r.reasons]
    for limit in (1, 3, 1000):
        want = []
        for q in {r.query_id for r in every}:
            own = sorted((r for r in every if r.query_id == q), key=lambda r: (r.total_kobo, r.unit_id))[:limit]
            want += [(q, n, r.unit_id, r.total_kobo, r.distance_km) for n, r in enumerate(own, 1)]
        assert sorted(tuple(r) for r in search.search_batch_top(units, *rest, limit=limit).collect()) == sorted(want)
    facets = {(r.query_id, r.results, r.least_unit, r.least_kobo, r.most_kobo) for r in search.search_batch_facets(units, *rest).collect()}
    of = lambda q: [r for r in every if r.query_id == q]
    assert facets == {(q, len(of(q)), min(r.unit_id for r in of(q)), min(r.total_kobo for r in of(q)), max(r.total_kobo for r in of(q))) for q in {r.query_id for r in every}}


def spans(spark, rows, name="id"):
    return spark.createDataFrame([(i, u, a and dt.date(2026, 1, 1) + dt.timedelta(a), b and dt.date(2026, 1, 1) + dt.timedelta(b)) for i, u, a, b in rows], f"{name} long, key string, begin date, end date")


@pytest.mark.parametrize("bucket", [1, 7, 64])
def test_overlaps_match_all_pairs(spark, bucket):
    rnd = random.Random(bucket)
    make = lambda first: [(first + i, rnd.choice(["u", "v", "w", None]), a := rnd.randrange(1, 90), a + rnd.choice([0, 1, 1, 2, 5, 40, -3])) for i in range(120)]
    left, right = make(0), [*make(1000), (2000, "u", None, 5), (2001, "u", 5, None)]
    meet = lambda x, y: x[1] is not None and x[1] == y[1] and None not in (*x[2:], *y[2:]) and x[2] < x[3] and y[2] < y[3] and x[2] < y[3] and y[2] < x[3]
    want = sorted((x[0], y[0]) for x in left for y in right if meet(x, y))
    a, b = spans(spark, left), spans(spark, right)
    assert sorted(tuple(r) for r in intervals.overlapping_pairs(a, b, bucket).collect()) == want
    counts = {x: sum(w[0] == x for w in want) for x in {w[0] for w in want}}
    assert {r.id: r.n for r in intervals.overlap_totals(a, b, bucket).collect()} == counts
    assert intervals.overlap_totals(a.limit(0), b).count() == intervals.overlapping_pairs(a, b.limit(0)).count() == 0


def test_conflicts_of_a_hot_unit(spark):
    """A hundred thousand stays of one unit: each overlaps its two neighbours, and nothing is made of the nights they last."""
    n = 100_000
    stays = spark.range(n).selectExpr("id AS stay_id", "'u' AS unit_id", "date_add(date'1900-01-01', int(id * 30 % 3000000)) AS check_in", "date_add(date'1900-01-01', int(id * 30 % 3000000) + 31) AS check_out")
    found = availability.stay_conflicts(stays, stays.withColumnRenamed("stay_id", "other"), "other", "n")
    assert found.groupBy("n").count().orderBy("n").collect() == [(1, 2), (2, n - 2)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan and "Generate" not in plan


def test_availability(spark):
    stays = spark.createDataFrame([("s", "u", dt.date(2026, 4, 10), dt.date(2026, 4, 13)), ("t", "v", dt.date(2026, 4, 10), dt.date(2026, 4, 13))], "stay_id string, unit_id string, check_in date, check_out date")
    nights = [("u", dt.date(2026, 4, d), state, rate, n) for n, (d, state, rate) in enumerate([(10, "CLOSED", None), (10, "OPEN", 500), (11, "CLOSED", None), (12, "OPEN", None)])] + [("v", dt.date(2026, 4, 10), "OPEN", None, 9)]
    calendar = spark.createDataFrame(nights, "unit_id string, night date, state string, nightly_rate_kobo long, seq long")
    hold = lambda i, status, at: (i, "u", dt.date(2026, 4, 12), dt.date(2026, 4, 14), status, dt.datetime(2026, 4, 1, at))
    holds = spark.createDataFrame([hold("a", "ACTIVE", 13), hold("b", "ACTIVE", 12), hold("c", "RELEASED", 13)], "hold_id string, unit_id string, check_in date, check_out date, status string, expires_at timestamp")
    bookings = spark.createDataFrame([("k", "v", dt.date(2026, 4, 13), dt.date(2026, 4, 15))], "booking_id string, unit_id string, check_in date, check_out date")
    found = {r.stay_id: r for r in availability.check_availability(stays, calendar, holds, bookings, F.lit("2026-04-01 12:00:00").cast("timestamp")).collect()}
    assert [d.day for d in found["s"].blocked_nights] == [11] and found["s"].overrides == {dt.date(2026, 4, 10): 500}
    assert (found["s"].conflicting_holds, found["s"].available) == (1, False)
    assert [d.day for d in found["t"].blocked_nights] == [11, 12] and found["t"].conflicting_bookings == 0
    asked = availability.check_availability(stays.where("stay_id = 't'"), calendar, holds, bookings, F.lit("2026-04-01 12:00:00").cast("timestamp"), allow_on_request=True)
    assert asked.first().available and availability.propose_holds(asked, F.lit("2026-04-01 12:00:00").cast("timestamp")).first().expires_at.minute == 15


LEAD = "seq long, id string, display_name string, area string, state_code string, identity_status string, contact struct<phone: string, email: string, website: string, instagram: string>, listing_count int, observed_rates array<long>, pms_fingerprints array<string>, contacted_at timestamp, retain_until timestamp"


def test_merged_leads_hold_no_array_of_all_rows(spark):
    contact = ("p", None, None, None)
    rows = [(i, None if i % 2 else "a", "A", "Lekki", "LA", "IDENTIFIED", contact, 1, [100 - i, None, 7 + i], ["smoobu", f"s{i // 40 % 3}"] if i else None, None, dt.datetime(2027, 1, 1)) for i in range(200)]
    source = spark.createDataFrame(rows, LEAD)
    merged = leads.merge_leads(source)
    assert "observed_rates" not in merged.columns
    plan = merged._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") == 1 and re.search(r"collect_list\(struct\(at, at#\d+, system", plan)
    got = {r.id: (r.listing_count, r.rate_count, r.lowest_rate, r.pms_fingerprints) for r in merged.collect()}
    assert got == {"a": (100, 300, -98, ["smoobu", "s0", "s1", "s2"]), None: (100, 300, -99, ["smoobu", "s0", "s1", "s2"])}
    rates = [r.rate for r in leads.lead_rates(source).where("id = 'a'").orderBy("seq", "place").collect()]
    assert rates == leads.merge_leads(source, with_rates=True).where("id = 'a'").first().observed_rates and len(rates) == 300


def test_leads(spark):
    until, past = dt.datetime(2027, 1, 1), dt.datetime(2026, 1, 1)
    none = (None, None, None, None)
    rows = [
        (0, "a", "A", "Lekki", "LA", "IDENTIFIED", (None, "e", None, None), 3, [100], ["smoobu"], None, until),
        (1, "a", "A2", "Lekki", "LA", "IDENTIFIED", ("p", None, "w", None), 4, [50, 60], ["smoobu", "beds24"], dt.datetime(2026, 2, 1), dt.datetime(2027, 2, 1)),
        (2, "b", "B", "Lekki", "LA", "IDENTIFIED", none, 1, [], [], None, until),
        (3, "c", "C", "Lekki", "LA", "IDENTIFIED", ("p", None, None, None), 1, [200], [], None, past),
        (4, "d", "D", "Wuse", "OY", "IDENTIFIED", ("p", None, None, "i"), 12, [200], [], None, until),
    ]
    merged = leads.merge_leads(spark.createDataFrame(rows, LEAD), with_rates=True)
    a = merged.where("id = 'a'").first()
    assert (a.listing_count, a.observed_rates, a.pms_fingerprints, a.display_name) == (7, [100, 50, 60], ["smoobu", "beds24"], "A")
    assert tuple(a.contact) == ("p", "e", "w", None) and a.retain_until == dt.datetime(2027, 2, 1)
    bench = spark.createDataFrame([("LA", "Lekki", 100)], "state_code string, area string, median_kobo long")
    found = {r.id: r for r in leads.assess_leads(merged, bench, F.lit("2026-06-01").cast("timestamp")).collect()}
    assert (found["a"].score, found["a"].tier, found["a"].rate_position_bps) == (22 + 25 + 10 + 10 + 15 - 15, "B", -5_000)
    assert (found["b"].blocked_reason, found["c"].blocked_reason, found["c"].score) == ("NO_CONTACT_CHANNEL", "RETENTION_EXPIRED", 0)
    assert (found["d"].score, found["d"].tier, found["d"].rate_position_bps) == (35, "C", None)
    assert [r.id for r in leads.call_list(leads.assess_leads(merged, bench, F.lit("2026-06-01").cast("timestamp"))).collect()] == ["a", "d"]
    medians = leads.median_rates(spark.createDataFrame([("x", r) for r in (1, 4, 0, -3)] + [("y", 0)], "k string, rate long"), ["k"]).collect()
    assert [tuple(r) for r in medians] == [("x", 3, 2)]


def test_upserts_replay(spark):
    state = spark.createDataFrame([("s", "1", day(1), day(1), "op", None, "A")], "source string, source_listing_id string, first_seen date, last_seen date, operator_id string, location_id string, property_id string")
    batch = spark.createDataFrame([("s", "1", day(3), day(3), None, "loc", 1), ("s", "1", day(2), day(2), None, None, 0), ("s", "2", day(2), day(2), "x", None, 2)], "source string, source_listing_id string, first_seen date, last_seen date, operator_id string, location_id string, seq int")
    once = upserts.upsert_listings(state, batch)
    assert sorted(map(tuple, once.collect())) == [("s", "1", day(1), day(3), "op", "loc", "A"), ("s", "2", day(2), day(2), "x", None, None)]
    assert reports.parity_check(once.na.fill(""), upserts.upsert_listings(once, batch).na.fill(""), once.columns).count() == 0
    prices = upserts.upsert_prices(spark.createDataFrame([], "source string, source_listing_id string, observed_on date, advertised_price long"), spark.createDataFrame([("s", "1", day(1), None, 1), ("s", "1", day(1), 5, 0)], OBS))
    assert [r.advertised_price for r in prices.collect()] == [5]
    old = spark.createDataFrame([("k", "PERMITTED", "me", "d", "attr", None)], "key string, terms_status string, reviewed_by string, last_reviewed_at string, attribution string, blocked_reason string")
    new = upserts.upsert_registry_evidence(old, spark.createDataFrame([("k", 7.0), ("n", None)], "key string, crawl_delay double"))
    assert {r.key: (r.terms_status, r.rate_limit_per_minute, r.blocked_reason) for r in new.collect()} == {"k": ("PERMITTED", 8, None), "n": ("REVIEW_REQUIRED", None, "not reviewed yet")}


def test_validation(spark):
    table = listings(spark, [{}, {"source": " "}, {"source_url": "ftp://x"}, {"property_name": None}, {"advertised_price": -1}, {"source_listing_id": ""}])
    ok, bad = validation.validate_listings(table)
    assert ok.count() == 1 and bad.count() == 5
    assert {r.reason for r in validation.ingest_report(table).collect()} == {None, "source is required", "source_url must be an absolute HTTP(S) URL", "property_name is required", "advertised_price cannot be negative", "source_listing_id is required"}
    records = spark.createDataFrame([('{"area": "x", "description": "y", "odd": 1}',), ('{"area": "x", "summary": null}',)], "record string")
    bad = validation.field_policy_violations(records).collect()
    assert [(r.forbidden, r.undeclared) for r in bad] == [(["description"], ["odd"])]
    registry = spark.createDataFrame([("a", "DISCOVERY", "PERMITTED"), ("b", "DISCOVERY", "REVIEW"), ("c", "OTHER", "PERMITTED")], "key string, layer string, termsStatus string")
    gate = validation.permitted_sources(spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "key string"), registry)
    assert {r.key: r.permitted for r in gate.collect()} == {"a": True, "b": False, "c": False, "d": False}
    channels = spark.createDataFrame([("ICAL_FEED", "PARTNER_PUBLISHED_FEED", "p", "p", "ref", None), ("ICAL_FEED", "AFFILIATE_PROGRAM_TERMS", "p", "p", "ref", None), ("PARTNER_API", "SIGNED_SUPPLY_AGREEMENT", "p", "p", "ref", dt.datetime(2026, 1, 1)), ("PARTNER_API", "SIGNED_SUPPLY_AGREEMENT", "p", "q", "ref", None)], "kind string, basis string, partner_id string, owner_id string, reference string, expires_at timestamp")
    assert [r.reason for r in validation.authorised_channels(channels, F.lit("2026-01-01").cast("timestamp")).collect()] == [None, "basis does not cover this kind of channel", "expired", "another partner's channel"]
    signals = spark.createDataFrame([("l", f"u{i}", i, 1.0, r, m, d) for i, (r, m, d) in enumerate([(0.1, None, True), (0.9, None, True), (0.9, 0.1, True), (0.1, 0.9, True), (0.1, None, False), (0.2, None, True)])], "listing_id string, url string, pos int, whole_spread double, centre_spread double, model_score double, decoded boolean")
    assert [r.url for r in validation.photo_verdicts(signals, limit=2).where("kept").collect()] == ["u0", "u2"]


def test_media_licences(spark):
    now = F.lit("2026-06-01").cast("timestamp")
    asset = lambda i, **kw: tuple({"id": i, "unit_external_id": "u", "partner_id": "p", "licence": "PARTNER_SUPPLIED", "licence_ref": "r", "licence_expires_at": None, "position": 1, "variants": ["k"], **kw}.values())
    rows = [asset("a", position=2), asset("b"), asset("c", partner_id="x"), asset("d", licence_ref=" "), asset("e", licence="LICENSED_FEED"), asset("f", licence_expires_at=dt.datetime(2026, 6, 1)), asset("g", variants=[]), asset("h", unit_external_id="v")]
    assets = spark.createDataFrame(rows, "id string, unit_external_id string, partner_id string, licence string, licence_ref string, licence_expires_at timestamp, position int, variants array<string>")
    partners = spark.createDataFrame([("p", "ACTIVE", "ref", dt.datetime(2025, 1, 1))], "id string, status string, agreement_ref string, agreement_signed_at timestamp")
    judged = validation.usable_media(assets, partners, spark.createDataFrame([("u", "p"), ("v", "q")], "external_id string, partner_id string"), now)
    assert {r.id: r.reason for r in judged.collect()} == {"a": None, "b": None, "c": "no partner", "d": "no licence reference", "e": "feed licence without expiry", "f": "licence expired", "g": "no files", "h": "another partner's unit"}
    assert [(r.gallery, r.card) for r in validation.select_gallery(judged).collect()] == [(["b", "a"], "b")]


def test_directory(spark):
    table = listings(spark, [{"media": ["https://x.ng/a.jpg", "https://x.ng/jiji/b.jpg"], "advertised_price": 50}, {"phone": "0803 1", "advertised_price": 5_000_000}, {"source_listing_id": "L1", "source": "t"}])
    places = publish.build_directory(table, "2026-09-01", "by us")
    rows = places.collect()
    assert [r.id for r in rows] == ["s:L1", "s:L0"] and rows[0].contact_route.href == "tel:08031"
    assert (rows[1].advertised_price, rows[1].media, rows[1].cover_image_url) == (None, ["https://x.ng/a.jpg"], "https://x.ng/a.jpg")
    assert publish.build_directory(table, "2026-09-01", "by us", by_source=True).count() == 3
    assert reports.directory_counts(places).first() == (2, 1, 1)
    fine, bad = validation.validate_places(places)
    assert fine.count() == 2 and bad.count() == 0 and fine.columns == names(PLACE)
    spoilt = places.withColumn("property_name", F.lit("x"))
    assert {r.reason for r in validation.validate_places(spoilt)[1].collect()} == {"carries property_name"}
    wrong = places.withColumns({"affiliate_url": F.lit("https://a"), "media": F.array(F.lit("https://x/a?url=b.jpg"), F.lit(" https://x/c.jpg "))})
    assert {r.reason for r in validation.validate_places(wrong)[1].collect()} == {"affiliate fields without authority"}
    details = {(r.id, r.label): r.value for r in publish.place_detail_rows(places).collect()}
    assert details[("s:L1", "Source")] == "by us" and ("s:L1", "Bedrooms") not in details
    units = search.places_to_units(places)
    assert {r.unit_id: (r.nightly_rate_kobo, r.is_placeholder) for r in units.collect()} == {"s:L1": (5_000_000, False), "s:L0": (100_000, True)}
    clicks = publish.affiliate_clicks(spark.createDataFrame([("s:L1",), ("zz",)], "id string"), places)
    assert [r.status for r in clicks.collect()] == [404, 404]


def test_whole_run_is_idempotent(spark):
    table = listings(spark, [{"phone": "08030000001", "advertised_price": 500_000, "area": "lekki", "state": "LA"}, {"phone": "08030000001", "advertised_price": None}, {"source": ""}])
    ledger = obs(spark, [("L0", 1, 400_000), ("gone", 1, 5)]).drop("seq")
    run = run_listings(table, ledger, "2026-09-20", "by us")
    assert run.summary.first().asDict() == {"new_listings": 1, "price_changes": 1, "delisted": 1, "unchanged": 0}
    assert run.rejected.count() == 1 and run.directory.count() == 2 and run.calls.count() == 1
    again = run_listings(table, run.ledger, "2026-09-20", "by us")
    assert reports.parity_check(run.ledger.na.fill(-1), again.ledger.na.fill(-1), run.ledger.columns).count() == 0


def test_transitions(spark):
    rows = [("b", n, dt.datetime(2026, 1, 1, n), s) for n, s in enumerate(["HELD", "AWAITING_PAYMENT", "CONFIRMED", "COMPLETED", "HELD"])]
    got = availability.transition_audit(spark.createDataFrame(rows, "booking_id string, seq int, created_at timestamp, to_status string")).orderBy("seq").collect()
    assert [r.allowed for r in got] == [True, True, True, True, False]


def test_source_health(spark):
    schema = "source string, error boolean, found boolean, loaded boolean, parsed boolean, has_rate boolean, has_contact boolean"
    rows = [("ok", False, True, True, True, True, True), ("ok", True, False, False, False, False, False), ("err", True, False, False, False, False, False), ("none", False, False, False, False, False, False), ("load", False, True, False, False, False, False), ("nowhere", False, True, True, False, False, False), ("idle", False, True, True, True, True, False)]
    got = {r.source: r.health for r in reports.source_health(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"ok": "OK", "err": "ERROR", "none": "NO LISTINGS", "load": "WOULD NOT LOAD", "nowhere": "WENT NOWHERE", "idle": "NOT ACTIONABLE"}


def test_affiliates(spark):
    base = {"id": "a", "source": "s", "source_url": "u", "attribution": "t", "affiliate_partner": "p", "affiliate_disclosure": "d", "first_seen_at": "2026-01-01", "last_seen_at": "2026-01-01", "affiliate_url": "https://p.ng/1"}
    rows = [tuple({**base, **kw}.values()) for kw in ({}, {"id": " "}, {"affiliate_url": "p.ng"}, {"affiliate_disclosure": None})]
    fine, bad = publish.affiliate_rows(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in base)))
    assert [(r.distribution, r.contact_route.kind) for r in fine.collect()] == [("AFFILIATE", "AFFILIATE_URL")]
    assert sorted(r.reason for r in bad.collect()) == ["destination is no absolute HTTP(S) URL", "no affiliate_disclosure", "no id"]
    clicks = publish.affiliate_clicks(spark.createDataFrame([("a",), ("b",)], "id string"), fine)
    assert {r.id: (r.destination, r.status) for r in clicks.collect()} == {"a": ("https://p.ng/1", 302), "b": (None, 404)}


def test_frontier_and_small_reports(spark):
    host = "https://www.portal.ng/for-rent/short-let"
    urls = spark.createDataFrame([(f"{host}/lagos/lekki/x-1",), (f"{host}/abuja/y-2",), ("https://other.ng/for-rent/short-let/lagos/x",), (f"{host}/lagos",), ("https://www.portal.ng/for-sale/lagos/z",)], "url string")
    assert validation.frontier_filter(urls, "lagos", "portal.ng").count() == 2
    assert validation.frontier_filter(urls, "lagos", "portal.ng", area="Lekki").count() == 1
    table = listings(spark, [{"source_listing_id": "lekki", "source_url": "https://s/x?page=2"}, {"source_listing_id": "12345"}, {"source_url": "https://s.ng/1"}])
    assert [r.source_listing_id for r in reports.place_name_ids(table).collect()] == ["lekki"]
    assert [r.source_listing_id for r in reports.list_page_urls(table).collect()] == ["lekki"]
    assert {r.source_listing_id for r in reports.junk_ids(table).collect()} == {"L2"}
    rates = validation.bookable_rates(spark.createDataFrame([("PARTNER_RATE", 5), ("OBSERVED", 5), ("PARTNER_RATE", 0)], "kind string, amount_kobo long")).collect()
    assert [r.reason is None for r in rates] == [True, False, False]
    states = spark.createDataFrame([("LA", 1), ("KN", 9)], "state string, launch_order int")
    assert validation.live_states(states, 1).count() == 1 and validation.live_states(states, None).count() == 2
    places = publish.build_directory(table, "2026-09-01", "t")
    assert publish.group_by_state(places).first().state == "UNKNOWN" and publish.top_places(places, 2).count() == 2
    assert search.places_to_partners(places).count() == 3 and reports.operator_count(search.places_to_partners(places)).first().operators == 3
    assert publish.places_for_ids(places, places.select("id").limit(1)).count() == 1
    link = spark.range(1).select(publish.affiliate_deep_link(F.lit("https://p/x?a=1"), F.lit("2026-01-01"), F.lit("2026-01-03"), F.lit(2)).alias("l")).first().l
    assert link == "https://p/x?a=1&checkin=2026-01-01&checkout=2026-01-03&guests=2"


def test_a_merge_of_constant_days_is_no_comparison_of_all_rows(spark):
    day = lambda d: F.lit(d).cast("date").alias("observed_on")
    rows = spark.range(3).select(F.lit("s").alias("source"), F.col("id").cast("string").alias("source_listing_id"), F.col("id").alias("advertised_price"))
    state = rows.select("source", "source_listing_id", day("2024-01-01"), "advertised_price")
    for today, want in (("2024-01-02", 6), ("2024-01-01", 3)):
        merged = upserts.upsert_observations(state, rows.select("source", "source_listing_id", day(today), (F.col("advertised_price") + 10).alias("advertised_price"), F.lit(1).alias("seq")))
        assert merged.columns == state.columns and merged.count() == want
        assert "NestedLoop" not in merged._jdf.queryExecution().toString()
        assert sorted(r.advertised_price for r in merged.collect()) == ([0, 1, 2] if want == 6 else []) + [10, 11, 12]


def test_a_merge_keeps_keys_with_nulls_apart(spark):
    state = spark.createDataFrame([("a", None, 1), (None, "x", 2), ("a", "x", 3)], "k string, l string, v int")
    batch = spark.createDataFrame([("a", None, 4, 1), ("a", "x", 5, 1)], "k string, l string, v int, seq int")
    assert sorted(map(tuple, upserts.merge(state, batch, ["k", "l"]).collect()), key=str) == sorted([("a", None, 1), (None, "x", 2), ("a", "x", 5), ("a", None, 4)], key=str)
    wide = spark.createDataFrame([(1, 4, 1), (2, 5, 1)], "k long, v int, seq int")
    assert sorted(map(tuple, upserts.merge(spark.createDataFrame([(1, 3)], "k int, v int"), wide, ["k"]).collect())) == [(1, 4), (2, 5)]


def test_a_run_from_pages_extracts_them_once(spark, monkeypatch):
    from marram.operators import extraction
    from marram.plans import pipeline, queries

    calls, real = [], extraction.extract_listings

    def counted(pages, *rest):
        calls.append(pages.rdd.getNumPartitions())
        return real(pages, *rest)

    monkeypatch.setattr(extraction, "extract_listings", counted)
    monkeypatch.setattr(pipeline, "extract_listings", counted)
    queries.queries()["run_pipeline_pages"](spark, "/root/testdata/sf0.001")
    assert calls == [spark.sparkContext.defaultParallelism]  # and pages are rendered by all cores


def _crowd(spark):
    """120 units at two points, six queries of which three with a radius ask the same."""
    one = lambda i: (f"u{i:03}", "p", 4 - i % 2, 2, 1, 30, 5_000_000 + i % 50 * 1_000_000, 0, "LA", f"area {i % 7}", 6.45 + i % 2 / 50, 3.47, "C_OF_O", "LISTED")
    rows = [(i, "LA", None, 4 if i == 3 else 2, 0, 6.45, 3.47, 0.5 if i < 4 else 9.0, 2) for i in range(5)] + [(9, "LA", "area 1", 3, 0, None, None, None, 2)]
    queries = spark.createDataFrame(rows, "query_id int, q_state string, q_area string, q_guests int, q_bedrooms int, q_lat double, q_lng double, q_radius double, nights int")
    return spark.createDataFrame([one(i) for i in range(120)], UNITS), spark.createDataFrame([("p",)], "partner_id string"), pricing.default_fee_policies(spark), queries


def test_results_of_a_batch_are_quoted_once(spark):
    args = _crowd(spark)
    got, want = search.search_batch(*args, with_excluded=False), search.search_batch(*args).where("size(reasons) = 0")
    assert "rate_bps" not in got._jdf.queryExecution().toString()  # pairs carry no fee policy, and no quote is made of them
    assert sorted(got.columns) == sorted(want.columns) and got.count() == want.count() > 100
    columns = [c for c in sorted(want.columns) if c != "reasons"]
    assert got.select(columns).exceptAll(want.select(columns)).isEmpty() and want.select(columns).exceptAll(got.select(columns)).isEmpty()


def test_facets_meet_points_and_not_units(spark, monkeypatch):
    met, real = [], search.radius_join

    def counted(points, centres, **rest):
        met.append((points.count(), centres.count()))
        return real(points, centres, **rest)

    monkeypatch.setattr(search, "radius_join", counted)
    args = _crowd(spark)
    got = {r.query_id: r.results for r in search.search_batch_facets(*args).collect()}
    assert met == [(2, 3)]
    every = search.search_batch(*args).where("size(reasons) = 0").groupBy("query_id").count().collect()
    assert got == {r.query_id: r["count"] for r in every}


def test_the_cheapest_near_in_rounds(spark, monkeypatch):
    met, real = [], search.radius_join

    def counted(points, centres, **rest):
        met.append((points.count(), centres.count()))
        return real(points, centres, **rest)

    monkeypatch.setattr(search, "radius_join", counted)
    monkeypatch.setattr(search, "FIRST_STAYS", 8, raising=False)
    monkeypatch.setattr(search, "MORE_STAYS", 4, raising=False)
    args = _crowd(spark)
    every = [r for r in search.search_batch(*args).collect() if not r.reasons]
    met.clear()
    for limit in (2, 30, 1000):
        want = []
        for q in {r.query_id for r in every}:
            own = sorted((r for r in every if r.query_id == q), key=lambda r: (r.total_kobo, r.unit_id))[:limit]
            want += [(q, n, r.unit_id, r.total_kobo, r.distance_km) for n, r in enumerate(own, 1)]
        assert sorted(tuple(r) for r in search.search_batch_top(*args, limit=limit).collect()) == sorted(want)
    assert met[:2] == [(8, 5), (8, 5)] and met[-3:] == [(8, 5), (32, 5), (120, 5)]
