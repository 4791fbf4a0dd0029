"""Calendars, holds and bookings of units by night."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marram.functions.constants import BOOKING_TRANSITIONS, HOLD_MINUTES
from marram.functions.dates import each_night, hold_expiry
from marram.operators.intervals import overlap_totals


def latest_night_state(nights: DataFrame) -> DataFrame:
    """One row for each unit and night: the one with the greatest seq."""
    rest = [c for c in nights.columns if c not in ("unit_id", "night")]
    last = nights.groupBy("unit_id", "night").agg(F.max_by(F.struct(*rest), "seq").alias("last"))
    return last.select("unit_id", "night", *[F.col(f"last.{c}").alias(c) for c in rest])


def active_holds(holds: DataFrame, now: Column) -> DataFrame:
    """Holds that are ACTIVE and whose end lies after now."""
    return holds.where((F.col("status") == "ACTIVE") & (F.col("expires_at") > now))


def stay_conflicts(stays: DataFrame, others: DataFrame, other_id: str, name: str) -> DataFrame:
    """(stay_id, name): how many of the others (unit_id, check_in, check_out), a stay of the same id not among them, overlap each stay
    on its unit; stays without any have no row. Repeated rows of the others count once, an id has one stay.

    The counts come from a sweep over each unit's days; no stay meets another one as a row, but for its own id."""
    theirs = others.select(F.col(other_id).alias("id"), F.col("unit_id").alias("key"), F.col("check_in").alias("begin"), F.col("check_out").alias("end")).distinct()
    mine = stays.select(F.col("stay_id").alias("id"), F.col("unit_id").alias("key"), F.col("check_in").alias("begin"), F.col("check_out").alias("end"))
    found = overlap_totals(mine, theirs).select(F.col("id").alias("stay_id"), "n")
    same = mine.alias("m").join(theirs.alias("t"), F.col("m.id").cast("string") == F.col("t.id").cast("string")).where("m.key = t.key and m.begin < t.end and t.begin < m.end and m.begin < m.end and t.begin < t.end")
    own = same.groupBy(F.col("m.id").alias("stay_id")).agg(F.count("*").alias("own"))
    counted = found.join(own, "stay_id", "left").select("stay_id", (F.col("n") - F.coalesce("own", F.lit(0))).alias(name))
    return counted.where(F.col(name) > 0)


def check_availability(stays: DataFrame, calendar: DataFrame, holds: DataFrame, bookings: DataFrame, now: Column, allow_on_request: bool = False) -> DataFrame:
    """Each stay with available, blocked nights, rate overrides by night, the numbers of conflicting holds and bookings, and
    reasons. A night that nobody has published is blocked unless allow_on_request, as is one on request.

    calendar: unit_id, night, state, nightly_rate_kobo, seq. holds and bookings have ids, unit_id, check_in and check_out."""
    nights = stays.select("stay_id", "unit_id", F.explode(each_night("check_in", "check_out")).alias("night"))
    met = nights.join(latest_night_state(calendar).select("unit_id", "night", "state", "nightly_rate_kobo"), ["unit_id", "night"], "left")
    asks = F.lit(allow_on_request)
    day = F.col("night").cast("string")
    reason = (
        F.when(F.col("state").isNull() & ~asks, F.concat(F.lit("No published rate for night "), day))
        .when(F.col("state") == "CLOSED", F.concat(F.lit("Night "), day, F.lit(" is closed by the partner")))
        .when((F.col("state") == "ON_REQUEST") & ~asks, F.concat(F.lit("Night "), day, F.lit(" requires a partner confirmation")))
    )
    # a stay's nights are few, so its arrays are bounded by its length
    by_stay = met.withColumn("reason", reason).groupBy("stay_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.col("night")))).alias("blocked_nights"),
        F.array_sort(F.collect_list("reason")).alias("night_reasons"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("nightly_rate_kobo").isNotNull(), F.struct("night", "nightly_rate_kobo"))))).alias("overrides"),
    )
    held = stay_conflicts(stays, active_holds(holds, now), "hold_id", "conflicting_holds")
    booked = stay_conflicts(stays, bookings, "booking_id", "conflicting_bookings")
    out = stays.join(by_stay, "stay_id", "left").join(held, "stay_id", "left").join(booked, "stay_id", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("conflicting_holds", "conflicting_bookings")})
    more = F.array_compact(
        F.array(
            F.when(F.col("conflicting_holds") > 0, F.concat(F.lit("Unit is held by "), F.col("conflicting_holds").cast("string"), F.lit(" active checkout session(s)"))),
            F.when(F.col("conflicting_bookings") > 0, "Unit already booked for an overlapping stay"),
        )
    )
    out = out.withColumn("reasons", F.concat(F.coalesce("night_reasons", F.array().cast("array<string>")), more)).drop("night_reasons")
    return out.withColumn("available", F.size("reasons") == 0)


def propose_holds(checked: DataFrame, now: Column, minutes: int = HOLD_MINUTES) -> DataFrame:
    """A hold for each available stay, ending after `minutes`."""
    return checked.where("available").select(F.concat(F.lit("hold_"), F.col("stay_id").cast("string")).alias("hold_id"), "unit_id", "check_in", "check_out", F.lit("ACTIVE").alias("status"), hold_expiry(now, minutes).alias("expires_at"))


def overlap_counts(stays: DataFrame) -> DataFrame:
    """(unit_id, overlaps): consecutive stays of a unit, by check-in, of which the later begins before all earlier ones end."""
    order = Window.partitionBy("unit_id").orderBy("check_in", "stay_id")
    ended = F.max("check_out").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return stays.where("check_out > check_in").withColumn("ended", ended).groupBy("unit_id").agg(F.count_if(F.col("check_in") < F.col("ended")).alias("overlaps"))


def transition_audit(events: DataFrame, key: str = "booking_id") -> DataFrame:
    """Events (key, seq, created_at, to_status) with from_status and allowed: whether the step is in the table of
    transitions. The first event of a booking is always allowed."""
    order = Window.partitionBy(key).orderBy("created_at", "seq")
    pairs = [f"{a}>{b}" for a, after in BOOKING_TRANSITIONS.items() for b in after]
    seen = events.withColumn("from_status", F.lag("to_status").over(order))
    return seen.withColumn("allowed", F.col("from_status").isNull() | F.concat_ws(">", "from_status", "to_status").isin(pairs))
