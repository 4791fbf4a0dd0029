"""Partner feeds and calendars as units and nights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marram.functions.dates import each_night
from marram.functions.text import blank_to_null
from marram.functions.web import authority

UNIT = "externalId: string, name: string, stateCode: string, area: string, bedrooms: int, maxGuests: int, nightlyRateKobo: long, deepLink: string, icalUrl: string"


def flatten_snapshot(payloads: DataFrame, column: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Units, and a CLOSED night for each of their closed nights, of feed snapshots (partner_id, payload as JSON). An affiliate
    feed simply has no closed nights."""
    schema = f"units array<struct<{UNIT}, closedNights: array<string>>>"
    units = payloads.select("partner_id", F.inline(F.from_json(column, schema)["units"])).where(blank_to_null("externalId").isNotNull())
    nights = units.select("partner_id", F.col("externalId").alias("unit_id"), F.explode("closedNights").alias("day")).select("partner_id", "unit_id", F.col("day").try_cast("date").alias("night"), F.lit("CLOSED").alias("state"))
    return units.drop("closedNights"), nights.where("night is not null").distinct()


def flatten_dashboard(units: DataFrame, blackouts: DataFrame, open_rates: DataFrame) -> DataFrame:
    """Nights of a partner's dashboard: blackouts (unit_id, nights) are CLOSED, open rates (unit_id, nights, rate) OPEN; only
    those of known units."""
    closed = blackouts.select("unit_id", F.explode("nights").alias("night"), F.lit("CLOSED").alias("state"), F.lit(None).cast("long").alias("nightly_rate_kobo"))
    opened = open_rates.select("unit_id", F.explode("nights").alias("night"), F.lit("OPEN").alias("state"), F.col("rate").cast("long").alias("nightly_rate_kobo"))
    both = closed.unionByName(opened).withColumn("night", F.col("night").try_cast("date")).where("night is not null")
    return both.join(units.select("unit_id").distinct(), "unit_id", "left_semi")


def ical_to_nights(feeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocked nights (unit_id, night) of calendars (unit_id, body), and feeds with a malformed date (unit_id, reason), which
    give no nights at all. Folded lines are joined; parameters behind `;` are dropped; events without both ends, or that end
    before they begin, block nothing; nights that events share are one."""
    unfolded = F.regexp_replace(F.regexp_replace("body", "\r\n", "\n"), "\n[ \t]", "")
    events = feeds.select("unit_id", F.explode(F.regexp_extract_all(unfolded, F.lit(r"(?s)BEGIN:VEVENT\n(.*?)END:VEVENT"), F.lit(1))).alias("event"))
    value = lambda key: F.nullif(F.regexp_extract("event", rf"(?im)^{key}(?:;[^:\n]*)?:[ \t]*([^\n]*?)[ \t]*$", 1), F.lit(""))
    day = lambda c: F.expr(f"try_to_date(regexp_extract({c}, '^([0-9]{{8}})(?:T[0-9]{{6}}Z?)?$', 1), 'yyyyMMdd')")
    parsed = events.select("unit_id", value("DTSTART").alias("a"), value("DTEND").alias("b")).where("a is not null and b is not null")
    parsed = parsed.select("unit_id", "a", "b", day("a").alias("check_in"), day("b").alias("check_out"))
    bad = parsed.where("check_in is null or check_out is null").select("unit_id").distinct()
    good = parsed.join(bad, "unit_id", "left_anti").where("check_out > check_in")
    return good.select("unit_id", F.explode(each_night("check_in", "check_out")).alias("night")).distinct(), bad.withColumn("reason", F.lit("malformed date"))


def unit_config(configs: DataFrame, origin: str | None = None) -> DataFrame:
    """Units of a partner's configuration (partner_id, units as a JSON array) with defaults and reason: null where the unit has
    an id and a calendar URL, which must lie under the declared origin."""
    rows = configs.select("partner_id", F.inline(F.from_json("units", f"array<struct<{UNIT}>>")))
    reason = F.when(blank_to_null("externalId").isNull(), "no externalId").when(blank_to_null("icalUrl").isNull(), "no icalUrl")
    if origin is not None:
        reason = F.coalesce(reason, F.when(authority("icalUrl") != authority(F.lit(origin)), "another origin"))
    return rows.withColumns({"name": F.coalesce("name", "externalId"), "maxGuests": F.coalesce("maxGuests", F.lit(2)), "bedrooms": F.coalesce("bedrooms", F.lit(1)), "reason": reason})
