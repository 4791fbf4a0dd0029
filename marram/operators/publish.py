"""The public directory: listings as places, in order, with counts; and what reads it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marram.functions.constants import STATE_NAMES
from marram.functions.money import plausible_price_kobo
from marram.functions.text import blank_to_null
from marram.functions.web import absolute_http, contact_route, url_encode_path
from marram.operators.extraction import has_watermark, is_hotlinkable
from marram.operators.history import first_in_group
from marram.schemas import PLACE, names

TYPE_LABELS = {
    "SHORTLET": "short-let", "SHORT_LET": "short-let", "APARTMENT": "apartment", "FLAT": "flat", "SERVICED_APARTMENT": "serviced apartment", "DUPLEX": "duplex",
    "BUNGALOW": "bungalow", "HOUSE": "house", "VILLA": "villa", "STUDIO": "studio", "HOSTEL_BED": "hostel bed",
}
MEDIA_LIMIT = 40


def build_directory(listings: DataFrame, day: str, attribution: str, by_source: bool = False) -> DataFrame:
    """One place for each listing id (or source and id), the first by seq, contactable ones first. An implausible price, and
    branded or proxied images, are left out."""
    first = first_in_group(listings, ["source_listing_id", *(["source"] if by_source else [])])
    media = F.slice(F.filter(F.coalesce("media", F.array().cast("array<string>")), lambda u: (F.trim(u) != "") & ~has_watermark(u) & ~is_hotlinkable(u)), 1, MEDIA_LIMIT)
    rows = first.withColumns(
        {
            "id": F.concat_ws(":", "source", "source_listing_id"), "distribution": F.lit("DIRECTORY"), "contact_route": contact_route("phone", "website", "email"), "attribution": F.lit(attribution),
            "advertised_price": plausible_price_kobo("advertised_price"), "first_seen_at": F.lit(day).cast("date"), "last_seen_at": F.lit(day).cast("date"), "media": F.when(F.size(media) > 0, media),
        }
    )
    rows = rows.withColumns({"media_count": F.size("media"), "cover_image_url": F.get("media", F.lit(0))})
    rows = rows.withColumns({c: F.lit(None).cast("string") for c in ("affiliate_partner", "affiliate_url", "affiliate_disclosure")})
    rows = rows.withColumn("media_count", F.when(F.col("media").isNotNull(), F.col("media_count")))
    return rows.orderBy(F.col("contact_route.kind") == "NONE", "seq").select(*names(PLACE))


def affiliate_rows(feed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of an authorised partner feed as places, and the rejected ones with their reason."""
    missing = lambda c: F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True))
    needed = ["id", "source", "source_url", "attribution", "affiliate_partner", "affiliate_disclosure", "first_seen_at", "last_seen_at"]
    reason = F.coalesce(*[F.when(missing(c), f"no {c}") for c in needed], F.when(~absolute_http("affiliate_url"), "destination is no absolute HTTP(S) URL"))
    judged = feed.withColumns({"reason": reason, "distribution": F.lit("AFFILIATE"), "contact_route": F.struct(F.lit("AFFILIATE_URL").alias("kind"), F.col("affiliate_url").alias("href"))})
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def group_by_state(places: DataFrame) -> DataFrame:
    """Places by state (UNKNOWN where there is none), the latest seen first."""
    return places.withColumn("state", F.coalesce("state", F.lit("UNKNOWN"))).orderBy("state", F.desc("last_seen_at"), "id")


def places_for_ids(places: DataFrame, ids: DataFrame) -> DataFrame:
    return places.join(ids.select("id").distinct(), "id", "left_semi")


def affiliate_clicks(clicks: DataFrame, places: DataFrame) -> DataFrame:
    """Clicks (id) with destination and status: 302 to an affiliate's http(s) target, else 404."""
    targets = places.where(F.col("distribution") == "AFFILIATE").select("id", F.col("affiliate_url").alias("target")).dropDuplicates(["id"])
    found = clicks.join(targets, "id", "left")
    fine = F.coalesce(absolute_http("target"), F.lit(False))
    return found.select(*clicks.columns, F.when(fine, F.col("target")).alias("destination"), F.when(fine, 302).otherwise(404).alias("status"))


def type_label(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in TYPE_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.upper(c)), F.replace(F.lower(c), F.lit("_"), F.lit(" ")))


def place_descriptor(bedrooms: Column | str, property_type: Column | str) -> Column:
    """`3-bedroom flat`; without bedrooms the type alone; `short-let` where there is no type. The first letter is upper case."""
    b, t = (F.col(c) if isinstance(c, str) else c for c in (bedrooms, property_type))
    text = F.coalesce(F.concat(b.cast("string"), F.lit("-bedroom "), F.coalesce(type_label(t), F.lit("short-let"))), type_label(t), F.lit("short-let"))
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


def place_location(area: str, city: str, state: str) -> Column:
    """Area, city or state's name, and state's name, without blanks and repetitions."""
    name = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in STATE_NAMES.items() for x in pair]), F.col(state)), blank_to_null(state))
    return F.array_join(F.array_distinct(F.array_compact(F.array(blank_to_null(area), F.coalesce(blank_to_null(city), name), name))), ", ")


def place_detail_rows(places: DataFrame) -> DataFrame:
    """(id, position, label, value) of what a place page shows; empty facts left out."""
    number = lambda c: F.when(F.col(c) > 0, F.col(c).cast("string"))
    pairs = [
        ("Type", type_label(F.col("property_type"))), ("Bedrooms", number("bedrooms")), ("Bathrooms", number("bathrooms")), ("Location", F.nullif(place_location("area", "city", "state"), F.lit(""))),
        ("First seen", F.col("first_seen_at").cast("string")), ("Last checked", F.col("last_seen_at").cast("string")), ("Source", F.col("attribution")), ("Booking system", F.col("pms_detected")),
    ]
    rows = F.filter(F.array(*[F.struct(F.lit(k).alias("label"), v.alias("value")) for k, v in pairs]), lambda r: r["value"].isNotNull())
    return places.select("id", F.posexplode(rows).alias("position", "r")).select("id", "position", "r.label", "r.value")


def place_href(c: Column | str) -> Column:
    return F.concat(F.lit("/stay/"), url_encode_path(c))


def bookable_search_href(state: str, area: str, bedrooms: str) -> Column:
    """The search page for a place's state, with its area and bedrooms where they are known; null without a state."""
    return F.concat(
        F.lit("/search?state="), F.url_encode(F.col(state)), F.coalesce(F.concat(F.lit("&area="), F.url_encode(blank_to_null(area))), F.lit("")), F.when(F.col(bedrooms) > 0, F.concat(F.lit("&bedrooms="), F.col(bedrooms).cast("string"))).otherwise("")
    )


def affiliate_deep_link(base: Column | str, check_in: Column | str, check_out: Column | str, guests: Column | str) -> Column:
    """A destination with the stay as parameters, behind those that it has."""
    b, i, o, g = (F.col(c) if isinstance(c, str) else c for c in (base, check_in, check_out, guests))
    return F.concat(b, F.when(F.contains(b, F.lit("?")), "&").otherwise("?"), F.lit("checkin="), i.cast("string"), F.lit("&checkout="), o.cast("string"), F.lit("&guests="), g.cast("string"))


def homepage_score(partner: str = "operator_name") -> Column:
    """Cover 3, rate 2, more than one photograph 1, stated operator 1."""
    return F.when(F.col("cover_image_url").isNotNull(), 3).otherwise(0) + F.when(F.col("advertised_price") > 0, 2).otherwise(0) + F.when(F.col("media_count") > 1, 1).otherwise(0) + F.when(F.col(partner).isNotNull(), 1).otherwise(0)


def top_places(places: DataFrame, n: int = 9) -> DataFrame:
    return places.withColumn("score", homepage_score()).orderBy(F.desc("score"), "id").limit(n)
