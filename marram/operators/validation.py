"""Rules with reasons: which rows may be stored, published, shown or sold, and why others may not."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marram.functions.constants import NEVER_PUBLISHED, PUBLISHABLE_FIELDS
from marram.functions.text import blank_to_null
from marram.functions.web import absolute_http, authority, url_path
from marram.operators.extraction import BRAND_TOKENS
from marram.package import ship

# What a record may hold besides publishable facts, and what it never holds.
ALLOWED_FIELDS = sorted({*PUBLISHABLE_FIELDS, *NEVER_PUBLISHED, "seq", "operator_hint", "price_basis", "source_listing_id"})
FORBIDDEN_FIELDS = ["description", "body_text", "summary", "amenities_text", "reviews", "raw_html"]
FORBIDDEN_PUBLIC_KEYS = ["description", "body_text", "summary", "property_name", "propertyName", "title_document", "titleDocument", "booking_url", "availability_url", "availability_hint_url"]
ROUTE_KINDS = ["AFFILIATE_URL", "PHONE", "WEBSITE", "EMAIL", "NONE"]
# Channel kinds and the grounds on which they may be used.
CHANNEL_BASES = [
    ("PARTNER_API", ["SIGNED_SUPPLY_AGREEMENT", "API_CREDENTIALS_ISSUED"]),
    ("ICAL_FEED", ["PARTNER_PUBLISHED_FEED", "SIGNED_SUPPLY_AGREEMENT"]),
    ("PARTNER_DASHBOARD", ["SIGNED_SUPPLY_AGREEMENT", "PARTNER_PUBLISHED_FEED"]),
    ("AFFILIATE_PROGRAM", ["AFFILIATE_PROGRAM_TERMS"]),
]


def _missing(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)) == "", F.lit(True))


def listing_problem() -> Column:
    """The first rule that a listing breaks; null if none."""
    return F.coalesce(
        F.when(_missing("source"), "source is required"),
        F.when(_missing("source_listing_id"), "source_listing_id is required"),
        F.when(_missing("source_url"), "source_url is required"),
        F.when(~absolute_http("source_url"), "source_url must be an absolute HTTP(S) URL"),
        F.when(_missing("property_name"), "property_name is required"),
        F.when(F.col("advertised_price") < 0, "advertised_price cannot be negative"),
    )


def validate_listings(listings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted listings, and rejected ones with their reason."""
    judged = listings.withColumn("reason", listing_problem())
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def ingest_report(listings: DataFrame) -> DataFrame:
    """(reason, rows): accepted rows have a null reason."""
    return listings.groupBy(listing_problem().alias("reason")).agg(F.count("*").alias("rows"))


def _field_check(raw_json: Column, allowed: list[str], forbidden: list[str]) -> tuple[Column, Column]:
    fields = F.map_keys(F.map_filter(F.from_json(raw_json, "map<string,string>"), lambda k, v: v.isNotNull()))
    return F.array_sort(F.array_intersect(fields, F.array(*[F.lit(x) for x in forbidden]))), F.array_sort(F.array_except(fields, F.array(*[F.lit(x) for x in [*allowed, *forbidden]])))


def field_policy_violations(records: DataFrame, json_col: str = "record", allowed: list[str] | None = None, forbidden: list[str] | None = None) -> DataFrame:
    """Records (as JSON) that hold a forbidden or an undeclared field, with both lists. A run stops when there is any."""
    bad, unknown = _field_check(F.col(json_col), allowed or ALLOWED_FIELDS, forbidden or FORBIDDEN_FIELDS)
    return records.withColumns({"forbidden": bad, "undeclared": unknown}).where((F.size("forbidden") > 0) | (F.size("undeclared") > 0))


def publish_violations(records: DataFrame, json_col: str = "record") -> DataFrame:
    """The same for rows to publish: fields that are never published, and undeclared ones."""
    return field_policy_violations(records, json_col, PUBLISHABLE_FIELDS, NEVER_PUBLISHED)


def is_publishable_image(url: Column) -> Column:
    """The directory's own test of an image URL; extraction has another, and what is published passes both."""
    lowered = F.lower(url)
    brands = "|".join(t for t in BRAND_TOKENS if "." not in t)
    surface = rf"(?:^|[/._-])(?:{brands})(?:$|[/._-])"
    return absolute_http(lowered) & ~lowered.rlike(r"(watermark|water-mark|_branded|branded\.|stamp\.)") & ~lowered.rlike(r"[?&](url|src|source|image|img|u|q)=|[?&]utm_|imgix|wsrv\.nl|images\.weserv") & ~authority(lowered).rlike(surface) & ~url_path(lowered).rlike(surface)


def publishable_media(media: Column) -> Column:
    """Distinct publishable images in order."""
    clean = F.filter(F.transform(F.coalesce(media, F.array().cast("array<string>")), blank_to_null), lambda u: u.isNotNull())
    return F.array_distinct(F.filter(clean, is_publishable_image))


def validate_places(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Published rows (PLACE, and any forbidden columns) split into places, with media filtered and the first as cover, and
    rejected rows with the reason."""
    forbidden = [c for c in rows.columns if c in FORBIDDEN_PUBLIC_KEYS]
    kind, href = F.coalesce(blank_to_null("contact_route.kind"), F.lit("NONE")), blank_to_null("contact_route.href")
    distribution = F.coalesce(blank_to_null("distribution"), F.lit("DIRECTORY"))
    affiliate = [blank_to_null(c).isNotNull() for c in ("affiliate_partner", "affiliate_url", "affiliate_disclosure")]
    every, some = affiliate[0] & affiliate[1] & affiliate[2], affiliate[0] | affiliate[1] | affiliate[2]
    reason = F.coalesce(
        *[F.when(_missing(c), f"no {c}") for c in ("id", "source", "source_url", "attribution")],
        *[F.when(F.col(c).isNotNull(), f"carries {c}") for c in forbidden],
        F.when(~distribution.isin("DIRECTORY", "AFFILIATE"), "unknown distribution"),
        F.when((distribution == "AFFILIATE") & ~every, "affiliate fields missing"),
        F.when((distribution == "AFFILIATE") & ~absolute_http("affiliate_url"), "invalid destination"),
        F.when((distribution == "DIRECTORY") & some, "affiliate fields without authority"),
        F.when(~kind.isin(ROUTE_KINDS), "unknown contact route"),
        F.when((distribution == "AFFILIATE") & (kind != "AFFILIATE_URL"), "affiliate place needs an affiliate route"),
        F.when((distribution == "DIRECTORY") & (kind == "AFFILIATE_URL"), "directory place with an affiliate route"),
        F.when((kind != "NONE") & href.isNull(), "contact route without href"),
    )
    judged = rows.withColumns({"reason": reason, "media": publishable_media(F.col("media"))})
    judged = judged.withColumns({"distribution": distribution, "cover_image_url": F.get("media", F.lit(0)), "media_count": F.size("media")})
    return judged.where("reason is null").drop("reason", *forbidden), judged.where("reason is not null")


def permitted_sources(wanted: DataFrame, registry: DataFrame) -> DataFrame:
    """wanted (key) with permitted and the reason if not: unknown, of another layer, or not cleared."""
    known = registry.select("key", "layer", F.col("termsStatus").alias("terms_status"), F.lit(True).alias("known"))
    reason = F.when(F.col("known").isNull(), "not in the registry").when(F.coalesce(F.col("layer") != "DISCOVERY", F.lit(True)), "not a discovery source").when(F.coalesce(F.col("terms_status") != "PERMITTED", F.lit(True)), "terms not permitted")
    judged = wanted.join(known, "key", "left").withColumn("reason", reason)
    return judged.select(*wanted.columns, F.col("reason").isNull().alias("permitted"), "reason")


def authorised_channels(channels: DataFrame, now: Column) -> DataFrame:
    """channels (kind, basis, partner_id, owner_id, reference, expires_at) with reason: null where the channel may be used."""
    bases = F.create_map(*[x for kind, b in CHANNEL_BASES for x in (F.lit(kind), F.array(*[F.lit(i) for i in b]))])
    fits = F.coalesce(F.array_contains(F.try_element_at(bases, F.col("kind")), F.col("basis")), F.lit(False))
    reason = F.when(~fits, "basis does not cover this kind of channel").when(_missing("reference"), "no reference").when(F.col("expires_at") <= now, "expired").when(F.coalesce(F.col("partner_id") != F.col("owner_id"), F.lit(True)), "another partner's channel")
    return channels.withColumn("reason", reason)


def usable_media(assets: DataFrame, partners: DataFrame, units: DataFrame, now: Column) -> DataFrame:
    """Media assets with reason: null where licence, partner, unit, reference, expiry and files allow them to be shown."""
    p = partners.select(F.col("id").alias("partner_id"), F.col("status").alias("partner_status"), "agreement_ref", "agreement_signed_at", F.lit(True).alias("has_partner"))
    u = units.select(F.col("external_id").alias("unit_external_id"), F.col("partner_id").alias("unit_partner_id"), F.lit(True).alias("has_unit"))
    rows = assets.join(p, "partner_id", "left").join(u, "unit_external_id", "left")
    reason = (
        F.when(F.col("has_partner").isNull(), "no partner")
        .when(F.coalesce(F.col("partner_status") != "ACTIVE", F.lit(True)), "partner is not active")
        .when(_missing("agreement_ref") | F.col("agreement_signed_at").isNull(), "no signed agreement")
        .when(F.col("has_unit").isNull(), "no unit")
        .when(F.col("unit_partner_id") != F.col("partner_id"), "another partner's unit")
        .when(_missing("licence_ref"), "no licence reference")
        .when((F.col("licence") == "LICENSED_FEED") & F.col("licence_expires_at").isNull(), "feed licence without expiry")
        .when(F.col("licence_expires_at") <= now, "licence expired")
        .when(F.coalesce(F.size("variants"), F.lit(0)) < 1, "no files")
    )
    return rows.withColumn("reason", reason).select(*assets.columns, "reason")


def select_gallery(judged: DataFrame) -> DataFrame:
    """(unit_external_id, gallery, card): a unit's usable assets in order, and the first of them."""
    fine = judged.where("reason is null").groupBy("unit_external_id").agg(F.array_sort(F.collect_list(F.struct("position", "id"))).alias("g"))
    return fine.select("unit_external_id", F.transform("g", lambda x: x["id"]).alias("gallery"), F.get("g", F.lit(0))["id"].alias("card"))


def photo_verdicts(signals: DataFrame, limit: int = 6) -> DataFrame:
    """Per image (listing_id, url, pos, whole_spread, centre_spread, model_score, decoded): kept, or why not. A centre much
    flatter than the whole is clear; a model's score decides where there is one; `limit` images of a listing at most."""
    from pyspark.sql import Window

    ratio = F.col("centre_spread") / F.nullif(F.col("whole_spread"), F.lit(0.0))
    reason = F.when(~F.coalesce(F.col("decoded"), F.lit(False)), "could not be read").when(F.col("model_score") >= 0.5, "model sees a mark").when(F.col("model_score").isNull() & F.coalesce(ratio >= 0.6, F.lit(True)), "centre may hold a mark")
    judged = signals.withColumn("reason", reason)
    rank = F.sum(F.col("reason").isNull().cast("int")).over(Window.partitionBy("listing_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return judged.withColumn("reason", F.when(F.col("reason").isNull() & (rank > limit), "enough photographs").otherwise(F.col("reason"))).withColumn("kept", F.col("reason").isNull())


def score_photos(signals: DataFrame, features: list[str], load: Callable[[], Callable[[np.ndarray], np.ndarray]]) -> DataFrame:
    """signals with model_score, from a model over the features; null where a feature is.

    load() runs once in each Python worker's task and gives model(rows x features) -> scores, which is called for a batch of rows at a
    time. load is sent to the executors, so it should name a file that they reach, or hold a small model. A column model_score gives way."""
    ship(signals.sparkSession)

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            rows = np.column_stack([x.to_numpy(dtype=float, na_value=np.nan) for x in batch])
            whole = ~np.isnan(rows).any(axis=1)
            out = np.full(len(rows), np.nan)
            if whole.any():
                out[whole] = model(rows[whole])
            yield pd.Series(out).astype(object).where(whole, None)

    return signals.withColumn("model_score", score(*[F.col(c).cast("double") for c in features]))


def bookable_rates(rates: DataFrame) -> DataFrame:
    """rates (kind, amount_kobo) with reason: only a partner's own positive rate can be booked."""
    return rates.withColumn("reason", F.when(F.coalesce(F.col("kind") != "PARTNER_RATE", F.lit(True)), "not a partner's rate").when(F.coalesce(F.col("amount_kobo") <= 0, F.lit(True)), "no positive amount"))


def live_states(states: DataFrame, gate: int | None) -> DataFrame:
    """States (launch_order) that are open at a launch gate; all without one."""
    return states if gate is None else states.where(F.col("launch_order") <= gate)


def frontier_filter(urls: DataFrame, state_slug: str, host: str, marker: str = "/for-rent/short-let/", area: str | None = None) -> DataFrame:
    """Candidate URLs of a state (and area) on one host that have a listing's shape."""
    u = F.col("url")
    own = F.endswith(F.concat(F.lit("."), authority(u)), F.lit(f".{host}"))
    place = u.contains(f"/{state_slug}/") | F.endswith(u, F.lit(f"/{state_slug}"))
    if area:
        place = place & u.contains(f"/{state_slug}/{area.strip().lower().replace(' ', '-')}")
    return urls.where(own & u.contains(marker) & place)
