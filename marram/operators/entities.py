"""Operators behind listings: components over shared contacts, profiles, funnel and leads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marram.functions.constants import RETENTION_DAYS
from marram.functions.text import canonical_area, normalise_operator_name, normalise_phone, operator_key, phone_dedupe_key
from marram.functions.web import domain_of
from marram.operators.graph import few_tasks, min_label_components, star_edges, stored
from marram.operators.order import with_rank


def match_keys(listings: DataFrame) -> DataFrame:
    """(node, kind, key): the strong keys (phone, e-mail, domain) and the weak key (name, area and state) of each listing."""
    email = F.lower(F.trim("email"))
    has_email = F.coalesce(F.contains(F.col("email"), F.lit("@")), F.lit(False))
    phone = phone_dedupe_key(normalise_phone("phone"))
    name = F.nullif(normalise_operator_name("operator_name"), F.lit(""))
    weak = F.when(name.isNotNull(), operator_key("operator_name", F.coalesce(canonical_area("area"), F.lit("")), "state"))
    pairs = [
        ("STRONG", F.concat(F.lit("phone:"), phone)),
        ("STRONG", F.when(has_email, F.concat(F.lit("email:"), email))),
        ("STRONG", F.when(has_email, F.concat(F.lit("domain:"), domain_of(F.concat(F.lit("https://"), F.split_part(email, F.lit("@"), F.lit(2))))))),
        ("STRONG", F.concat(F.lit("domain:"), domain_of("website"))),
        ("WEAK", F.concat(F.lit("name:"), weak)),
    ]
    keys = F.filter(F.array(*[F.struct(F.lit(kind).alias("kind"), key.alias("key")) for kind, key in pairs]), lambda p: p["key"].isNotNull())
    return listings.select(F.col("seq").alias("node"), F.inline(F.array_distinct(keys)))


def match_evidence(listings: DataFrame) -> DataFrame:
    """(kind, signal, value, a, b): every star edge, from the first listing that has a key to each other one."""
    keys = match_keys(listings)
    edges = star_edges(keys.select("node", F.concat_ws("\x1f", "kind", "key").alias("key")))
    kind, key = F.split_part("key", F.lit("\x1f"), F.lit(1)), F.split_part("key", F.lit("\x1f"), F.lit(2))
    signal = F.split_part(key, F.lit(":"), F.lit(1))
    return edges.select(kind.alias("kind"), signal.alias("signal"), F.substr(key, F.length(signal) + 2).alias("value"), "a", "b")


#: Where a key stands among those of its listing, by what it is made of.
_PLACES = ("phone", "email", "domain", "name")


def joining_evidence(listings: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(kind, signal, value, a, b): of match_evidence the edges that join two sets of listings if edges are taken one after another,
    strong ones first, then by the first listing that has the key, the kind of key, and the other listing. A component of n listings has n - 1.

    These are the least spanning forest in that order, found in rounds: every set takes its least edge that leads out of it,
    and sets so tied become one. Edges carry their sets, so a round is a minimum by set, a walk along the chosen edges, whose
    length is halved each step, and two joins; edges within a set go. Sets at least halve in number each round."""
    edges = match_evidence(listings)
    strong = F.when(F.col("kind") == "STRONG", 0).otherwise(1)
    place = F.array_position(F.array(*map(F.lit, _PLACES)), F.col("signal"))
    order = F.struct(strong.alias("k"), "a", place.alias("p"), "value", "b")
    open_ = stored(edges.select(F.col("a").alias("x"), F.col("b").alias("y"), order.alias("o")))
    n = open_.count()
    forest = None
    for _ in range(max_rounds):
        open_ = few_tasks(open_, n)
        ends = open_.select("x", F.struct("o", F.col("y").alias("to")).alias("e")).union(open_.select("y", F.struct("o", F.col("x").alias("to"))))
        best = stored(few_tasks(ends.groupBy("x").agg(F.min("e").alias("e")).select("x", "e.to", "e.o"), n))
        if best.isEmpty():
            break
        chosen = few_tasks(best.select("o").distinct(), n)
        forest = chosen if forest is None else forest.union(chosen)
        roots = _ends_of_walks(best.select("x", "to"), n)
        left = open_.join(roots.toDF("x", "rx"), "x").join(roots.toDF("y", "ry"), "y").where("rx <> ry")
        # of several edges between two sets only the least can be taken
        left = left.select(F.least("rx", "ry").alias("x"), F.greatest("rx", "ry").alias("y"), "o").groupBy("x", "y").agg(F.min("o").alias("o"))
        open_ = stored(few_tasks(left, n))
    else:
        raise RuntimeError(f"sets did not settle in {max_rounds} rounds")
    if forest is None:
        return edges.limit(0)
    kind = F.when(F.col("o.k") == 0, "STRONG").otherwise("WEAK")
    return forest.select(kind.alias("kind"), F.element_at(F.array(*map(F.lit, _PLACES)), F.col("o.p").cast("int")).alias("signal"), "o.value", "o.a", "o.b")


def _ends_of_walks(steps: DataFrame, n: int) -> DataFrame:
    """(x, root) for steps (x, to), one from each x, that run into pairs which point at each other: the lesser of the pair."""
    back = steps.select(F.col("x").alias("to"), F.col("to").alias("again"))
    ahead = steps.join(back, "to").select("x", F.when((F.col("again") == F.col("x")) & (F.col("x") < F.col("to")), F.col("x")).otherwise(F.col("to")).alias("to"))
    ahead = stored(few_tasks(ahead, n))
    while True:
        further = ahead.select(F.col("x").alias("to"), F.col("to").alias("next"))
        joined = stored(few_tasks(ahead.join(further, "to").select("x", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")), n))
        ahead = joined.select("x", "to")
        if joined.where("moved").isEmpty():
            return ahead.toDF("x", "root")


def profile_evidence(resolved: DataFrame) -> DataFrame:
    """(component, kind, signal, value, a, b): the evidence that holds each component of resolve_operators together, as rows."""
    members = resolved.select(F.col("seq").alias("a"), "component")
    return joining_evidence(resolved).join(members, "a").select("component", "kind", "signal", "value", "a", "b")


def resolve_operators(listings: DataFrame) -> DataFrame:
    """listings with component, the least seq of the listings that share a key with it, directly or not."""
    edges = star_edges(match_keys(listings).select("node", "key"))
    components = min_label_components(listings.select(F.col("seq").alias("node")), edges)
    return listings.join(components, listings["seq"] == components["node"]).drop("node")


def _lists() -> dict:
    names = {"emails": "email", "websites": "website", "instagrams": "instagram", "states": "state", "property_types": "property_type", "pms": "pms_detected", "availability_hint_urls": "availability_hint_url", "sources": "source", "source_urls": "source_url"}
    return {"phones": normalise_phone("phone"), "areas": canonical_area("area")} | {k: F.col(v) for k, v in names.items()}


def profile_values(resolved: DataFrame) -> DataFrame:
    """(component, field, seq, value): the distinct values of each component's facts, with the first listing that has them.

    By seq and value they are in order. Rows, however many a component has: no array grows with it."""
    facts = F.filter(F.array(*[F.struct(F.lit(k).alias("field"), c.alias("value")) for k, c in _lists().items()]), lambda f: f["value"].isNotNull() & (f["value"] != ""))
    return resolved.select("component", "seq", F.inline(facts)).groupBy("component", "field", "value").agg(F.min("seq").alias("seq")).select("component", "field", "seq", "value")


def operator_profiles(resolved: DataFrame, with_lists: bool = True) -> DataFrame:
    """One row for each component: name, identity status, listing count, prices, `firsts` and `counts`, the first value of each
    fact and how many distinct ones there are.

    with_lists adds the distinct values as arrays in the order of their first listing; one component may hold a tenth of
    all rows, so leave them out at scale: profile_values has them as rows."""
    longest = F.max(F.when(F.coalesce(F.col("operator_name") != "", F.lit(False)), F.struct(F.length("operator_name").alias("n"), (-F.col("seq")).alias("first"), F.col("operator_name").alias("name"))))
    base = resolved.groupBy("component").agg(
        longest.alias("best"), F.min_by("property_name", "seq").alias("title"), F.min_by("state", "seq").alias("first_state"), F.count("*").alias("listing_count"),
        F.min(F.when(F.col("advertised_price") > 0, F.col("advertised_price"))).alias("lowest_price"), F.max("advertised_price").alias("highest_price"),
    )
    fields = list(_lists())
    values = profile_values(resolved)
    of_field = values.groupBy("component", "field").agg(F.min(F.struct("seq", "value"))["value"].alias("first"), F.count("*").alias("n"))
    maps = of_field.groupBy("component").agg(F.map_from_entries(F.collect_list(F.struct("field", "first"))).alias("firsts"), F.map_from_entries(F.collect_list(F.struct("field", "n"))).alias("counts"))  # an entry for each field
    out = base.join(maps, "component", "left")
    if with_lists:
        lists = values.groupBy("component").agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("field") == k, F.struct("seq", "value")))), lambda x: x["value"]).alias(k) for k in fields])
        out = out.join(lists, "component", "left")
    name = F.coalesce(F.trim(F.col("best.name")), "title")
    arrays = [F.coalesce(k, F.array().cast("array<string>")).alias(k) for k in fields] if with_lists else []
    return out.select(
        operator_key(name, F.coalesce(F.col("firsts.areas"), F.lit("")), "first_state").alias("operator_id"),
        name.alias("display_name"), F.when(F.col("best.name").isNotNull(), "IDENTIFIED").otherwise("UNIDENTIFIED").alias("identity_status"), "component", "listing_count", "lowest_price", "highest_price", "firsts", "counts", *arrays,
    )


def ranked_profiles(profiles: DataFrame) -> DataFrame:
    """profiles with rank: the most listings first, then the earliest component."""
    return with_rank(profiles, F.desc("listing_count"), F.col("component"))


def observed_rates(resolved: DataFrame) -> DataFrame:
    """(component, rate): the distinct positive prices of each component."""
    return resolved.where("advertised_price > 0").select("component", F.col("advertised_price").alias("rate")).distinct()


def funnel(listings: DataFrame, profiles: DataFrame, by_source: bool = False) -> DataFrame:
    """One row: listings, distinct properties (by listing id alone, or with its source), operators, those with two listings
    or more, and those of them with a site, a calendar page or a booking system."""
    ids = [F.col("source_listing_id"), *([F.col("source")] if by_source else [])]
    left = listings.agg(F.count("*").alias("listings"), F.count_distinct(*ids).alias("properties"))
    multi = F.col("listing_count") >= 2
    bookable = F.greatest(*[F.coalesce(F.col(f"counts.{c}"), F.lit(0)) for c in ("websites", "availability_hint_urls", "pms")]) > 0
    right = profiles.agg(F.count("*").alias("operators"), F.count_if(multi).alias("multi_property_operators"), F.count_if(multi & bookable).alias("multi_with_booking"))
    return left.crossJoin(right)  # one row each


def profiles_to_leads(profiles: DataFrame, observed_at: str, rates: DataFrame | None = None) -> DataFrame:
    """Profiles as leads for scoring: the first of each contact, area and state, the lowest rate, kept for RETENTION_DAYS.

    All rates of a lead are rows of observed_rates, by component, which market_benchmark takes beside the leads. With rates
    they are also collected here, as the sorted array observed_rates; without them no array grows with a component. Booking systems are
    few kinds, so pms_fingerprints is an array of the first."""
    first = lambda c: F.col(f"firsts.{c}")
    out = profiles.select(
        F.col("operator_id").alias("id"), "component", "display_name", normalise_operator_name("display_name").alias("normalised_name"), first("areas").alias("area"), first("states").alias("state_code"),
        F.struct(first("phones").alias("phone"), first("emails").alias("email"), first("websites").alias("website"), first("instagrams").alias("instagram")).alias("contact"),
        F.col("listing_count").cast("int").alias("listing_count"), F.col("lowest_price").alias("lowest_rate"), F.array_compact(F.array(first("pms"))).alias("pms_fingerprints"), "identity_status",
        F.lit(None).cast("timestamp").alias("contacted_at"), (F.lit(observed_at).cast("timestamp") + F.expr(f"interval {RETENTION_DAYS} days")).alias("retain_until"),
    )
    if rates is None:
        return out
    arrays = rates.groupBy("component").agg(F.array_sort(F.collect_set("rate")).alias("observed_rates"))
    return out.join(arrays, "component", "left").withColumn("observed_rates", F.coalesce("observed_rates", F.array().cast("array<long>")))
