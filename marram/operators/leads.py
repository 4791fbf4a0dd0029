"""Leads: merged by id, set against the rates of their area, scored and ordered for calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marram.functions.constants import TIER_ONE_STATES
from marram.functions.money import int_div
from marram.functions.web import best_channel
from marram.operators.order import with_rank


def merge_leads(leads: DataFrame, seq: str = "seq", with_rates: bool = False) -> DataFrame:
    """One lead for each id: counts summed, systems collected in order, the first contact of each kind that any row has, the
    earliest contact made, the latest retention; other facts from the first row; rate_count and lowest_rate of its rates.

    lead_rates has the rates as rows, so no array grows with the rows of an id; with_rates also collects them in order, as
    observed_rates."""
    contact = lambda f: F.min_by(F.col(f"contact.{f}"), F.when(F.coalesce(F.col(f"contact.{f}") != "", F.lit(False)), F.col(seq))).alias(f)
    first = lambda c: F.min_by(c, seq).alias(c)
    ordered = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col("observed_rates").alias("v")))), lambda x: x["v"]))
    merged = leads.groupBy("id").agg(
        first("display_name"), first("area"), first("state_code"), first("identity_status"), contact("phone"), contact("email"),
        contact("website"), contact("instagram"), F.sum("listing_count").alias("listing_count"), *([ordered.alias("observed_rates")] if with_rates else []),
        F.sum(F.coalesce(F.array_size("observed_rates"), F.lit(0))).alias("rate_count"), F.min(F.array_min("observed_rates")).alias("lowest_rate"),
        F.min("contacted_at").alias("contacted_at"), F.max("retain_until").alias("retain_until"),
    ).withColumn("contact", F.struct("phone", "email", "website", "instagram")).drop("phone", "email", "website", "instagram")
    # each system of an id once before they are collected
    systems = leads.select("id", F.col(seq).alias("s"), F.posexplode("pms_fingerprints").alias("p", "system")).groupBy("id", "system").agg(F.min(F.struct("s", "p")).alias("at"))
    systems = systems.groupBy(F.col("id").alias("of_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "system"))), lambda x: x["system"]).alias("pms_fingerprints"))
    joined = merged.join(systems, F.col("id").eqNullSafe(F.col("of_id")), "left").drop("of_id")
    return joined.withColumn("pms_fingerprints", F.coalesce("pms_fingerprints", F.array().cast(leads.schema["pms_fingerprints"].dataType)))


def lead_rates(leads: DataFrame, seq: str = "seq") -> DataFrame:
    """(id, seq, place, rate): every observed rate of each lead as a row; by seq and place they are in order."""
    return leads.select("id", F.col(seq).alias("seq"), F.posexplode("observed_rates").alias("place", "rate"))


def median_rates(rates: DataFrame, keys: list[str], rate_col: str = "rate") -> DataFrame:
    """Exact median and number of positive rates by key; of an even number the mean of the middle two, halves up.

    Equal rates are counted before the shuffle, and the middle is found on the counts, so a large area is no large buffer."""
    counted = rates.where(F.col(rate_col) > 0).groupBy(*keys, rate_col).agg(F.count("*").alias("n"))
    return counted.groupBy(*keys).agg(F.floor(F.percentile(rate_col, 0.5, F.col("n")) + 0.5).cast("long").alias("median_kobo"), F.sum("n").alias("sample_size"))


def market_benchmark(leads: DataFrame, rates: DataFrame | None = None) -> DataFrame:
    """(state_code, area, median_kobo, sample_size) of all rates observed by the leads of an area, not of the lowest of each.

    rates: (component, rate), for leads that bear a component; else the leads' own arrays are taken."""
    if rates is None:
        rows = leads.select("state_code", "area", F.explode("observed_rates").alias("rate"))
    else:
        rows = rates.join(leads.select("component", "state_code", "area"), "component")
    return median_rates(rows, ["state_code", "area"])


def rate_position_bps(low: Column | str, median: Column | str) -> Column:
    """How far a rate lies from the median, in basis points, halves up; null without a positive median."""
    low, median = (F.col(c) if isinstance(c, str) else c for c in (low, median))
    return F.when(median > 0, int_div((low - median) * 20_000 + median, 2 * F.nullif(median, F.lit(0).cast("long"))))


def assess_leads(leads: DataFrame, benchmarks: DataFrame, now: Column) -> DataFrame:
    """Each lead with score (0 to 100), tier, channel, blocked_reason, lowest_rate, rate_position_bps and points by cause."""
    one = benchmarks.groupBy("state_code", "area").agg(F.min("median_kobo").alias("median_kobo"))
    rows = leads.join(one, ["state_code", "area"], "left")
    c = "contact."
    channel = best_channel(f"{c}phone", f"{c}instagram", f"{c}email", f"{c}website")
    has = lambda f: F.coalesce(F.col(f) != "", F.lit(False))
    blocked = F.when(F.col("retain_until") <= now, "RETENTION_EXPIRED").when(channel == "NONE", "NO_CONTACT_CHANNEL")
    lowest = (F.array_min("observed_rates") if "observed_rates" in leads.columns else F.col("lowest_rate")).cast("long")
    rows = rows.withColumns({"channel": channel, "blocked_reason": blocked, "lowest_rate": F.when(blocked.isNull(), lowest)})
    rows = rows.withColumn("rate_position_bps", rate_position_bps("lowest_rate", "median_kobo"))
    n, position = F.col("listing_count"), F.col("rate_position_bps")
    points = {
        "size": F.when(n >= 10, 30).when(n >= 4, 22).when(n >= 2, 12).otherwise(4),
        "booking_system": F.when(F.size("pms_fingerprints") > 0, 25).otherwise(0),
        "website": F.when(has(f"{c}website"), 10).otherwise(0),
        "instagram": F.when(has(f"{c}instagram"), 5).otherwise(0),
        "market": F.when(F.col("state_code").isin(TIER_ONE_STATES), 10).otherwise(0),
        "rate": F.when(position.isNull(), 0).when(position <= -2_000, 15).when(position >= 2_500, 10).otherwise(6),
        "contacted": F.when(F.col("contacted_at").isNotNull(), -15).otherwise(0),
    }
    total = sum(points.values(), F.lit(0))
    score = F.when(F.col("blocked_reason").isNotNull(), 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), total)))
    rows = rows.withColumns({"points": F.struct(*[p.alias(k) for k, p in points.items()]), "score": score})
    return rows.withColumn("tier", F.when(F.col("score") >= 70, "A").when(F.col("score") >= 45, "B").otherwise("C")).drop("median_kobo")


def _call_order() -> list[Column]:
    return [F.desc("score"), F.desc("listing_count"), F.col("id")]


def call_list(assessed: DataFrame) -> DataFrame:
    """Leads that aren't blocked, the best first: by score, then by listings, then by id."""
    return assessed.where("blocked_reason is null").orderBy(*_call_order())


def ranked_calls(assessed: DataFrame) -> DataFrame:
    """The call list with rank from 1 on; leads of one id go by component."""
    return with_rank(assessed.where("blocked_reason is null"), *_call_order(), F.col("component"))
