"""Observation histories: one row for each listing and day, price changes, and what changed since."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marram.functions.constants import DELIST_GRACE_DAYS
from marram.functions.facts import price_movement_note
from marram.functions.money import price_change_percent, price_direction

KEY = ["source", "source_listing_id"]


def listing_history(observations: DataFrame) -> DataFrame:
    """One observation for each listing and day: the one with the greatest seq. Rows without a day are left out.

    An aggregate, not a window: the last row of a day is found before the shuffle too."""
    rest = [c for c in observations.columns if c not in {*KEY, "observed_on"}]
    last = F.max(F.struct(F.col("seq").alias("_seq"), *[F.col(c) for c in rest])).alias("last")
    days = observations.where(F.col("observed_on").isNotNull()).groupBy(*KEY, "observed_on").agg(last)
    return days.select(*KEY, "observed_on", *[F.col(f"last.{c}").alias(c) for c in rest])


def history_ends(history: DataFrame, today: str) -> DataFrame:
    """First and last day, the latest price, the number of days seen, and the days on the market by `today`."""
    ends = history.groupBy(*KEY).agg(
        F.min("observed_on").alias("first_seen"), F.max("observed_on").alias("last_seen"), F.max_by("advertised_price", "observed_on").alias("latest_price"), F.count("*").alias("days_seen")
    )
    return ends.withColumn("days_on_market", F.greatest(F.lit(0), F.datediff(F.lit(today).cast("date"), "first_seen")))


def price_changes(history: DataFrame) -> DataFrame:
    """Adjacent days with two different prices. A missing price breaks the pair; it is not carried forward."""
    before = F.lag("advertised_price").over(Window.partitionBy(*KEY).orderBy("observed_on"))
    pairs = history.withColumn("previous", before).where(F.col("previous").isNotNull() & (F.col("previous") != F.col("advertised_price")))
    return pairs.select(*KEY, F.col("observed_on").alias("changed_on"), "previous", F.col("advertised_price").alias("current")).withColumns(
        {"delta": F.col("current") - F.col("previous"), "direction": price_direction("previous", "current"), "percent": price_change_percent("previous", "current")}
    )


def price_history(history: DataFrame) -> DataFrame:
    """The (day, price) series of each listing, in order."""
    return history.select(*KEY, "observed_on", "advertised_price").orderBy(*KEY, "observed_on")


def movement_notes(history: DataFrame) -> DataFrame:
    """(source, source_listing_id, note): a sentence on each listing's last price movement, where it is large enough."""
    moves = price_changes(history).groupBy(*KEY).agg(F.max_by("previous", "changed_on").alias("previous"), F.max_by("current", "changed_on").alias("current"), F.count("*").alias("movements"))
    return moves.select(*KEY, price_movement_note("previous", "current", "movements").alias("note")).where("note is not null")


def detect_changes(history: DataFrame, current: DataFrame, today: str, grace_days: int = DELIST_GRACE_DAYS) -> DataFrame:
    """Each current observation as new_listing, price_change or unchanged, and known listings that have been missing for
    more than grace_days as delisted.

    A price changes if the last known day before the observation had another price; an observation of a day already known
    replaces that day. A listing that is new twice counts twice. One shuffle, by listing."""
    columns = [*KEY, "observed_on", "advertised_price"]
    rows = history.select(*columns, F.lit(0).alias("now")).union(current.select(*columns, F.lit(1).alias("now")))
    order = Window.partitionBy(*KEY).orderBy("observed_on", "now")
    whole = Window.partitionBy(*KEY)
    rows = rows.withColumns(
        {
            "day_before": F.lag("observed_on").over(order),
            "price_before": F.lag("advertised_price").over(order),
            "price_two_before": F.lag("advertised_price", 2).over(order),
            "known": F.count(F.when(F.col("now") == 0, 1)).over(whole) > 0,
            "seen": F.max("now").over(whole) == 1,
            "last_known": F.max("observed_on").over(whole),
        }
    )
    rows = rows.withColumn("previous", F.when(F.col("day_before") == F.col("observed_on"), F.col("price_two_before")).otherwise(F.col("price_before")))
    price_moved = F.coalesce(F.col("previous") != F.col("advertised_price"), F.lit(False))
    gone = F.datediff(F.lit(today).cast("date"), "observed_on") > grace_days
    kind = (
        F.when((F.col("now") == 1) & ~F.col("known"), "new_listing")
        .when((F.col("now") == 1) & price_moved, "price_change")
        .when(F.col("now") == 1, "unchanged")
        .when(~F.col("seen") & (F.col("observed_on") == F.col("last_known")) & gone, "delisted")
    )
    found = rows.withColumn("change", kind).where("change is not null")
    return found.select(*columns, "change", F.when(F.col("change") == "price_change", F.col("previous")).alias("previous"))


def change_summary(changes: DataFrame) -> DataFrame:
    """One row: how many observations of each kind of change."""
    return changes.agg(*[F.count_if(F.col("change") == kind).alias(name) for kind, name in (("new_listing", "new_listings"), ("price_change", "price_changes"), ("delisted", "delisted"), ("unchanged", "unchanged"))])


def ledger_join(observations: DataFrame, listings: DataFrame, prices: DataFrame) -> DataFrame:
    """History rows from three tables: observations, their listing, and their price at the same instant if there is one."""
    joined = observations.join(listings.select("listing_pk", "source", "source_listing_id"), "listing_pk").join(prices.select("listing_pk", "observed_at", "amount", "currency"), ["listing_pk", "observed_at"], "left")
    return joined.select("source", "source_listing_id", F.to_date("observed_at").alias("observed_on"), F.col("amount").alias("advertised_price"), F.coalesce("currency", F.lit("NGN")).alias("currency"), "observed_at", "listing_pk")


def diff_known_current(known: DataFrame, current: DataFrame) -> DataFrame:
    """Keys of either side with a status: both, gone (known only) or new (current only)."""
    a, b = known.select(*KEY).distinct().withColumn("a", F.lit(True)), current.select(*KEY).distinct().withColumn("b", F.lit(True))
    both = a.join(b, KEY, "full_outer")
    return both.select(*KEY, F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "gone").otherwise("new").alias("status"))


def first_in_group(df: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The row with the least seq of each key, found before the shuffle too."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.col(seq)).alias("first")
    return df.groupBy(*keys).agg(first).select(*keys, *[F.col(f"first.{c}").alias(c) for c in rest]).select(*df.columns)
