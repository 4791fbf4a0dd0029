"""Registered queries of rules with reasons, state tables, feeds, crawled bodies, places, contacts and streams with state."""

from __future__ import annotations

import datetime as dt
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marram.functions import dates, facts, geo, money, text, web
from marram.functions.constants import AREA_CENTROIDS
from marram.functions.facts import TITLE_DOCUMENTS
from marram.functions.text import stable_id
from marram.operators import availability, extraction, history, pricing, publish, reports, search, upserts, validation
from marram.operators.graph import checkpoint_folder, checkpointed
from marram.plans import queries as base
from marram.plans.registry import query
from marram.plans.views import table, view
from marram.sources import connectors, crawl, feeds, files
from marram.streaming import ledger

NOW, TODAY = base.NOW, base.TODAY


def _now():
    return F.lit(NOW).cast("timestamp")


# ---- state tables -------------------------------------------------------------------------------------------------


@query(
    "upsert_prices",
    """SELECT source, source_listing_id, observed_on, advertised_price FROM (SELECT *, row_number() OVER (PARTITION BY source, source_listing_id, observed_on ORDER BY seq % 2 DESC, seq DESC) AS r
    FROM fx_observations WHERE advertised_price IS NOT NULL AND observed_on IS NOT NULL) WHERE r = 1""",
)
def upsert_prices(spark, sf_dir):
    """Observations of odd seq merged over those of even seq, whichever are later."""
    o = view(spark, sf_dir, "fx_observations").where("observed_on is not null")
    state = history.listing_history(o.where("seq % 2 = 0 and advertised_price is not null")).select("source", "source_listing_id", "observed_on", "advertised_price")
    return upserts.upsert_prices(state, o.where("seq % 2 = 1"))


_CONTACTS = ("phone", "email", "website", "instagram", "state")


@query(
    "upsert_operators",
    f"""WITH s AS (SELECT operator_key, min(display_name) AS display_name, {", ".join(f"min({c}) AS {c}" for c in _CONTACTS)} FROM fx_operator_rows WHERE seq % 4 = 0 GROUP BY 1),
    n AS (SELECT operator_key, true AS changed, arg_max(display_name, seq) AS display_name, {", ".join(f"arg_max({c}, seq) FILTER ({c} IS NOT NULL) AS {c}" for c in _CONTACTS)} FROM fx_operator_rows
      WHERE seq % 4 <> 0 AND display_name IS NOT NULL AND state IN ('LA', 'FC', 'OY') GROUP BY 1)
    SELECT coalesce(s.operator_key, n.operator_key) AS operator_key, CASE WHEN n.changed THEN n.display_name ELSE s.display_name END AS display_name, {", ".join(f"coalesce(n.{c}, s.{c}) AS {c}" for c in _CONTACTS)}
    FROM s FULL JOIN n ON s.operator_key = n.operator_key""",
)
def upsert_operators(spark, sf_dir):
    x = view(spark, sf_dir, "fx_operator_rows").drop("size")
    state = x.where("seq % 4 = 0").groupBy("operator_key").agg(*[F.min(c).alias(c) for c in ("display_name", *_CONTACTS)])
    return upserts.upsert_operators(state, x.where("seq % 4 <> 0"), x.select("state").where("state in ('LA', 'FC', 'OY')"))


@query(
    "upsert_locations",
    """WITH b AS (SELECT state, concat('area-', CAST(size AS VARCHAR)) AS slug, seq FROM fx_operator_rows), s AS (SELECT DISTINCT state, slug FROM b WHERE seq % 3 = 0), n AS (SELECT state, slug, max(seq) AS seq FROM b WHERE seq % 3 = 1 GROUP BY 1, 2)
    SELECT coalesce(s.state, n.state) AS state, coalesce(s.slug, n.slug) AS slug, CASE WHEN n.seq IS NULL THEN 'old' ELSE concat('name ', CAST(n.seq AS VARCHAR)) END AS name FROM s FULL JOIN n ON s.state = n.state AND s.slug = n.slug""",
)
def upsert_locations(spark, sf_dir):
    b = view(spark, sf_dir, "fx_operator_rows").select("state", F.concat(F.lit("area-"), F.col("size").cast("string")).alias("slug"), F.concat(F.lit("name "), F.col("seq").cast("string")).alias("name"), "seq")
    return upserts.upsert_locations(b.where("seq % 3 = 0").select("state", "slug", F.lit("old").alias("name")).distinct(), b.where("seq % 3 = 1"))


@query(
    "upsert_registry_evidence",
    """SELECT key, robots, crawl_delay, CASE WHEN n % 2 = 0 AND terms_status IS NOT NULL THEN terms_status ELSE 'REVIEW_REQUIRED' END AS terms_status, CASE WHEN n % 2 = 0 AND n % 3 <> 0 THEN 'reviewer' END AS reviewed_by,
    CASE WHEN n % 2 = 0 AND n % 7 = 0 THEN 'refused' WHEN n % 2 = 0 AND n % 3 <> 0 THEN NULL ELSE 'not reviewed yet' END AS blocked_reason, CAST(CASE WHEN crawl_delay > 0 THEN floor(60 / crawl_delay) END AS INT) AS rate_limit_per_minute FROM fx_probes""",
)
def upsert_registry_evidence(spark, sf_dir):
    x = view(spark, sf_dir, "fx_probes")
    reviewed, none = F.when(F.col("n") % 3 != 0, "reviewer"), F.lit(None).cast("string")
    previous = x.where("n % 2 = 0").select("key", "terms_status", reviewed.alias("reviewed_by"), none.alias("last_reviewed_at"), none.alias("attribution"), F.when(F.col("n") % 7 == 0, "refused").alias("blocked_reason"))
    return upserts.upsert_registry_evidence(previous, x.select("key", "robots", "crawl_delay")).select("key", "robots", "crawl_delay", "terms_status", "reviewed_by", "blocked_reason", "rate_limit_per_minute")


# ---- rules with reasons -------------------------------------------------------------------------------------------


@query(
    "field_policy_violations",
    """WITH r AS (SELECT seq, array_to_string(list_filter([CASE WHEN seq % 5 = 0 THEN 'description' END, CASE WHEN seq % 10 = 0 THEN 'reviews' END], lambda x: x IS NOT NULL), ',') AS forbidden,
    CASE WHEN seq % 7 = 0 THEN 'colour' ELSE '' END AS undeclared FROM fx_listings) SELECT * FROM r WHERE forbidden <> '' OR undeclared <> ''""",
)
def field_policy_violations(spark, sf_dir):
    """A null field counts as absent."""
    k = F.col("seq")
    record = F.to_json(F.struct("seq", "source", "phone", F.when(k % 10 == 0, "r").alias("reviews"), F.when(k % 5 == 0, "d").alias("description"), F.when(k % 7 == 0, "c").alias("colour"), F.lit(None).cast("string").alias("body_text")))
    found = validation.field_policy_violations(view(spark, sf_dir, "fx_listings").select("seq", record.alias("record")))
    return found.select("seq", *[F.array_join(c, ",").alias(c) for c in ("forbidden", "undeclared")])


@query(
    "publish_violations",
    """WITH r AS (SELECT seq, array_to_string(list_filter([CASE WHEN seq % 6 = 0 THEN 'booking_url' END, CASE WHEN seq % 4 = 0 THEN 'property_name' END], lambda x: x IS NOT NULL), ',') AS forbidden,
    CASE WHEN seq % 9 = 0 THEN 'operator_hint' ELSE '' END AS undeclared FROM fx_listings) SELECT * FROM r WHERE forbidden <> '' OR undeclared <> ''""",
)
def publish_violations(spark, sf_dir):
    k = F.col("seq")
    record = F.to_json(F.struct("source", "phone", "bedrooms", F.when(k % 4 == 0, F.col("property_name")).alias("property_name"), F.when(k % 6 == 0, "u").alias("booking_url"), F.when(k % 9 == 0, "h").alias("operator_hint")))
    found = validation.publish_violations(view(spark, sf_dir, "fx_listings").select("seq", record.alias("record")))
    return found.select("seq", *[F.array_join(c, ",").alias(c) for c in ("forbidden", "undeclared")])


@query(
    "permitted_sources",
    """SELECT key, reason IS NULL AS permitted, reason FROM (SELECT key, CASE WHEN n % 4 = 0 THEN 'not in the registry' WHEN layer IS DISTINCT FROM 'DISCOVERY' THEN 'not a discovery source' WHEN terms_status IS DISTINCT FROM 'PERMITTED' THEN 'terms not permitted' END AS reason FROM fx_probes)""",
)
def permitted_sources(spark, sf_dir):
    x = view(spark, sf_dir, "fx_probes")
    return validation.permitted_sources(x.select("key"), x.where("n % 4 <> 0").select("key", "layer", F.col("terms_status").alias("termsStatus")))


@query(
    "authorised_channels",
    f"""SELECT channel_id, CASE WHEN (kind = 'PARTNER_API' AND basis IN ('SIGNED_SUPPLY_AGREEMENT', 'API_CREDENTIALS_ISSUED') OR kind IN ('ICAL_FEED', 'PARTNER_DASHBOARD') AND basis IN ('PARTNER_PUBLISHED_FEED', 'SIGNED_SUPPLY_AGREEMENT')
        OR kind = 'AFFILIATE_PROGRAM' AND basis = 'AFFILIATE_PROGRAM_TERMS') IS NOT TRUE THEN 'basis does not cover this kind of channel' WHEN trim(reference) = '' THEN 'no reference' WHEN expires_at <= TIMESTAMP '1996-06-01' THEN 'expired'
      WHEN owner_id IS DISTINCT FROM partner_id THEN 'another partner''s channel' END AS reason FROM fx_channels""",
)
def authorised_channels(spark, sf_dir):
    return validation.authorised_channels(view(spark, sf_dir, "fx_channels"), F.lit("1996-06-01").cast("timestamp")).select("channel_id", "reason")


_JUDGED = """j AS (SELECT a.*, CASE WHEN p.s_suppkey IS NULL THEN 'no partner' WHEN p.s_suppkey % 6 = 0 THEN 'partner is not active' WHEN p.s_suppkey % 7 = 0 THEN 'no signed agreement' WHEN u.unit_id IS NULL THEN 'no unit'
    WHEN u.unit_id % 5 = 0 THEN 'another partner''s unit' WHEN a.licence_ref = '' THEN 'no licence reference' WHEN a.licence = 'LICENSED_FEED' AND a.licence_expires_at IS NULL THEN 'feed licence without expiry'
    WHEN a.licence_expires_at <= TIMESTAMP '1995-06-01' THEN 'licence expired' WHEN a.files < 1 THEN 'no files' END AS reason
  FROM fx_assets a LEFT JOIN supplier p ON p.s_suppkey = a.partner_id LEFT JOIN fx_units u ON u.unit_id = a.unit_external_id)"""


def _judged_media(spark, sf_dir) -> DataFrame:
    """The assets of lineitem, judged; a unit belongs to the asset's partner but for every fifth."""
    assets = view(spark, sf_dir, "fx_assets").withColumn("variants", F.array_repeat(F.lit("f.jpg"), F.col("files"))).drop("files")
    k = F.col("s_suppkey")
    partners = table(spark, sf_dir, "supplier").select(k.alias("id"), F.when(k % 6 == 0, "PAUSED").otherwise("ACTIVE").alias("status"), F.lit("agreement").alias("agreement_ref"), F.when(k % 7 != 0, F.lit("2020-01-01").cast("timestamp")).alias("agreement_signed_at"))
    units = view(spark, sf_dir, "fx_units").select(F.col("unit_id").alias("external_id"), (F.col("unit_id") % 5 == 0).alias("foreign"))
    # usable_media compares a unit's one partner; assets of one unit here have many, so each (unit, partner) is a unit of its own
    pair = F.concat_ws("/", "unit_external_id", "partner_id")
    owned = assets.select("unit_external_id", "partner_id").distinct().join(units, F.col("unit_external_id") == F.col("external_id"))
    owned = owned.select(pair.alias("external_id"), F.when(F.col("foreign"), F.lit(-1)).otherwise(F.col("partner_id")).alias("partner_id"))
    return validation.usable_media(assets.withColumn("unit_external_id", pair), partners, owned, F.lit("1995-06-01").cast("timestamp"))


@query("usable_media", f"WITH {_JUDGED} SELECT id, position, reason FROM j")
def usable_media(spark, sf_dir):
    return _judged_media(spark, sf_dir).select("id", "position", "reason")


@query(
    "select_gallery",
    f"""WITH {_JUDGED} SELECT concat(CAST(unit_external_id AS VARCHAR), '/', CAST(partner_id AS VARCHAR)) AS unit, string_agg(id, ',' ORDER BY position, id) AS gallery, first(id ORDER BY position, id) AS card FROM j WHERE reason IS NULL GROUP BY 1""",
)
def select_gallery(spark, sf_dir):
    return validation.select_gallery(_judged_media(spark, sf_dir)).select(F.col("unit_external_id").alias("unit"), F.array_join("gallery", ",").alias("gallery"), "card")


@query(
    "photo_verdicts",
    """WITH j AS (SELECT *, CASE WHEN decoded IS NOT TRUE THEN 'could not be read' WHEN model_score >= 0.5 THEN 'model sees a mark' WHEN model_score IS NULL AND (whole_spread = 0 OR centre_spread / whole_spread >= 0.6) THEN 'centre may hold a mark' END AS r FROM fx_photos),
    k AS (SELECT *, count(*) FILTER (r IS NULL) OVER (PARTITION BY listing_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS rank FROM j)
    SELECT listing_id, pos, CASE WHEN r IS NULL AND rank > 6 THEN 'enough photographs' ELSE r END AS reason, r IS NULL AND rank <= 6 AS kept FROM k""",
)
def photo_verdicts(spark, sf_dir):
    return validation.photo_verdicts(view(spark, sf_dir, "fx_photos")).select("listing_id", "pos", "reason", "kept")


#: A small logistic model of a photograph's spreads.
_WEIGHTS, _BIAS = (-0.11, 0.17), -0.6


def _load_model():
    weights = np.array(_WEIGHTS)
    return lambda rows: 1 / (1 + np.exp(-(rows @ weights + _BIAS)))


@query(
    "photo_verdicts_by_model",
    f"""WITH p AS (SELECT listing_id, pos, decoded, whole_spread, centre_spread, whole_spread * {_WEIGHTS[0]} + centre_spread * {_WEIGHTS[1]} + {_BIAS} AS x FROM fx_photos),
    j AS (SELECT *, CASE WHEN decoded IS NOT TRUE THEN 'could not be read' WHEN x >= 0 THEN 'model sees a mark' WHEN x IS NULL AND (whole_spread = 0 OR centre_spread / whole_spread >= 0.6) THEN 'centre may hold a mark' END AS r FROM p),
    k AS (SELECT *, count(*) FILTER (r IS NULL) OVER (PARTITION BY listing_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS rank FROM j)
    SELECT listing_id, pos, CAST(round(1000 / (1 + exp(-x))) AS BIGINT) AS score_milli, CASE WHEN r IS NULL AND rank > 6 THEN 'enough photographs' ELSE r END AS reason FROM k""",
)
def photo_verdicts_by_model(spark, sf_dir):
    scored = validation.score_photos(view(spark, sf_dir, "fx_photos"), ["whole_spread", "centre_spread"], _load_model)
    return validation.photo_verdicts(scored).select("listing_id", "pos", F.round(F.col("model_score") * 1000).cast("long").alias("score_milli"), "reason")


@query(
    "bookable_rates",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 3 = 0 OR l_orderkey % 10 = 1 THEN 'not a partner''s rate' WHEN l_orderkey % 7 = 0 OR l_orderkey % 11 = 0 THEN 'no positive amount' END AS reason FROM fx_charges""",
)
def bookable_rates(spark, sf_dir):
    k = F.col("l_orderkey")
    kind = F.when(k % 3 == 0, "ADVERTISED").when(k % 10 != 1, "PARTNER_RATE")
    amount = F.when(k % 7 == 0, F.lit(0).cast("long")).when(k % 11 != 0, F.col("nightly_rate_kobo"))
    return validation.bookable_rates(view(spark, sf_dir, "fx_charges").select(k, "l_linenumber", kind.alias("kind"), amount.alias("amount_kobo"))).select("l_orderkey", "l_linenumber", "reason")


@query("live_states", "SELECT c_custkey AS state, c_nationkey % 4 AS launch_order FROM customer WHERE c_nationkey % 4 <= 1")
def live_states(spark, sf_dir):
    return validation.live_states(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("state"), (F.col("c_nationkey") % 4).alias("launch_order")), 1)


@query(
    "frontier_filter",
    """SELECT seq, url FROM fx_pages WHERE regexp_matches(url, '://([^/?#]*[.])?nigeriapropertycentre[.]com([/?#]|$)') AND contains(url, '/for-rent/short-let/') AND contains(url, '/lagos/victoria-island')""",
)
def frontier_filter(spark, sf_dir):
    return validation.frontier_filter(view(spark, sf_dir, "fx_pages").select("seq", "url"), "lagos", "nigeriapropertycentre.com", area=" Victoria Island")


@query(
    "source_health",
    """SELECT source, count(*) FILTER (error) AS errors, count(*) FILTER (found) AS found, count(*) FILTER (loaded) AS loaded, count(*) FILTER (parsed) AS parsed, count(*) FILTER (has_rate AND has_contact) AS usable,
    CASE CAST(substr(source, 5) AS INT) % 8 WHEN 1 THEN 'ERROR' WHEN 2 THEN CASE WHEN count(*) FILTER (error) > 0 THEN 'ERROR' ELSE 'NO LISTINGS' END WHEN 3 THEN 'WOULD NOT LOAD' WHEN 4 THEN 'WENT NOWHERE' WHEN 5 THEN 'NOT ACTIONABLE' ELSE 'OK' END AS health
    FROM fx_outcomes GROUP BY 1""",
)
def source_health(spark, sf_dir):
    return reports.source_health(view(spark, sf_dir, "fx_outcomes"))


@query(
    "affiliate_rows",
    """SELECT seq, CASE WHEN id IS NULL THEN 'no id' WHEN trim(attribution) = '' THEN 'no attribution' WHEN affiliate_partner IS NULL THEN 'no affiliate_partner' WHEN affiliate_disclosure IS NULL THEN 'no affiliate_disclosure'
    WHEN last_seen_at IS NULL THEN 'no last_seen_at' WHEN affiliate_url IS NULL OR affiliate_url LIKE 'ftp%' THEN 'destination is no absolute HTTP(S) URL' END AS reason, 'AFFILIATE_URL' AS kind, affiliate_url AS href FROM fx_feed""",
)
def affiliate_rows(spark, sf_dir):
    accepted, rejected = publish.affiliate_rows(view(spark, sf_dir, "fx_feed"))
    return accepted.withColumn("reason", F.lit(None).cast("string")).unionByName(rejected).select("seq", "reason", "contact_route.kind", "contact_route.href")


@query(
    "propose_holds",
    f"""WITH n AS (SELECT stay_id, unit_id, CAST(unnest(range(check_in, check_out, INTERVAL 1 DAY)) AS DATE) AS night FROM fx_stays WHERE status = 'O'), b AS (SELECT DISTINCT stay_id FROM n WHERE (unit_id + CAST(night - DATE '1990-01-01' AS BIGINT)) % 23 IN (0, 1)),
    o AS (SELECT DISTINCT a.stay_id FROM fx_stays a JOIN fx_stays x ON a.unit_id = x.unit_id AND a.stay_id <> x.stay_id AND a.check_in < x.check_out AND x.check_in < a.check_out WHERE x.status = 'F' OR (x.status = 'P' AND x.stay_id % 2 = 0))
    SELECT concat('hold_', CAST(stay_id AS VARCHAR)) AS hold_id, unit_id, check_in, check_out, 'ACTIVE' AS status, '2024-01-30 00:15:00' AS expires_at FROM fx_stays
    WHERE status = 'O' AND stay_id NOT IN (SELECT stay_id FROM b) AND stay_id NOT IN (SELECT stay_id FROM o)""",
)
def propose_holds(spark, sf_dir):
    """Holds for the stays that nothing blocks; of the holds there are, every second one has ended."""
    s = view(spark, sf_dir, "fx_stays")
    stays = s.where("status = 'O'")
    nights = stays.select("unit_id", F.explode(dates.each_night("check_in", "check_out")).alias("night")).distinct()
    k = (F.col("unit_id") + F.datediff("night", F.lit("1990-01-01").cast("date"))) % 23
    calendar = nights.where(k != 0).select("unit_id", "night", F.when(k == 1, "CLOSED").otherwise("OPEN").alias("state"), F.lit(None).cast("long").alias("nightly_rate_kobo"), F.lit(1).alias("seq"))
    ends = F.when(F.col("stay_id") % 2 == 0, F.lit("2030-01-01")).otherwise(F.lit(NOW)).cast("timestamp")
    holds = s.where("status = 'P'").select(F.col("stay_id").alias("hold_id"), "unit_id", "check_in", "check_out", F.lit("ACTIVE").alias("status"), ends.alias("expires_at"))
    checked = availability.check_availability(stays, calendar, holds, s.where("status = 'F'").withColumnRenamed("stay_id", "booking_id"), _now())
    return availability.propose_holds(checked, _now()).withColumn("expires_at", F.col("expires_at").cast("string"))


# ---- places -------------------------------------------------------------------------------------------------------

_PLAUSIBLE = "CASE WHEN advertised_price BETWEEN 100000 AND 2000000000 THEN advertised_price END"
_STATE_NAME = "CASE state WHEN 'LA' THEN 'Lagos' WHEN 'FC' THEN 'FCT Abuja' WHEN 'OY' THEN 'Oyo' WHEN 'IM' THEN 'Imo' ELSE 'Akwa Ibom' END"


def _places(spark, sf_dir) -> DataFrame:
    return publish.build_directory(base._listings(spark, sf_dir), TODAY, "by the source")


@query(
    "places_to_units",
    f"""WITH p AS (SELECT *, concat(source, ':', source_listing_id) AS id, {_PLAUSIBLE} AS price FROM fx_listings) SELECT id AS unit_id, concat('op:', coalesce(operator_name, id)) AS partner_id, 4 AS max_guests, bedrooms, 1 AS min_nights, 90 AS max_nights,
    coalesce(price, 100000) AS nightly_rate_kobo, price IS NULL AS is_placeholder, state, area FROM p""",
)
def places_to_units(spark, sf_dir):
    return search.places_to_units(_places(spark, sf_dir)).drop("cleaning_fee_kobo", "lat", "lng", "title_document", "status")


@query(
    "places_to_partners",
    """WITH p AS (SELECT coalesce(operator_name, concat(source, ':', source_listing_id)) AS n, state FROM fx_listings) SELECT concat('op:', n) AS partner_id, min(n) AS display_name, min(state) AS state FROM p GROUP BY 1""",
)
def places_to_partners(spark, sf_dir):
    return search.places_to_partners(_places(spark, sf_dir))


@query("group_by_state", "SELECT concat(source, ':', source_listing_id) AS id, CASE WHEN bedrooms = 0 THEN 'UNKNOWN' ELSE state END AS state FROM fx_listings")
def group_by_state(spark, sf_dir):
    return publish.group_by_state(_places(spark, sf_dir).withColumn("state", F.when(F.col("bedrooms") != 0, F.col("state")))).select("id", "state")


@query(
    "affiliate_clicks",
    """SELECT event_id, concat('p', CAST(user_id AS VARCHAR)) AS id, CASE WHEN affiliate_url LIKE 'https:%' THEN affiliate_url END AS destination, CASE WHEN affiliate_url LIKE 'https:%' THEN 302 ELSE 404 END AS status
    FROM events LEFT JOIN (SELECT * FROM fx_feed WHERE listed_as = 'AFFILIATE') f ON f.id = concat('p', CAST(user_id AS VARCHAR))""",
)
def affiliate_clicks(spark, sf_dir):
    clicks = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("id"))
    return publish.affiliate_clicks(clicks, view(spark, sf_dir, "fx_feed").withColumnRenamed("listed_as", "distribution"))


@query("places_for_ids", "SELECT id, affiliate_url FROM fx_feed WHERE id IN (SELECT concat('p', CAST(user_id AS VARCHAR)) FROM events)")
def places_for_ids(spark, sf_dir):
    wanted = table(spark, sf_dir, "events").select(F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("id"))
    return publish.places_for_ids(view(spark, sf_dir, "fx_feed"), wanted).select("id", "affiliate_url")


@query(
    "top_places",
    f"""SELECT concat(source, ':', source_listing_id) AS id, (CASE WHEN {_PLAUSIBLE} > 0 THEN 2 ELSE 0 END) + (CASE WHEN operator_name IS NOT NULL THEN 1 ELSE 0 END) AS score FROM fx_listings ORDER BY score DESC, id LIMIT 9""",
)
def top_places(spark, sf_dir):
    return publish.top_places(_places(spark, sf_dir)).select("id", "score")


@query(
    "place_detail_rows",
    f"""WITH r AS (SELECT concat(source, ':', source_listing_id) AS id, list_filter([struct_pack(label := 'Type', value := replace(lower(property_type), '_', ' ')), struct_pack(label := 'Bedrooms', value := CASE WHEN bedrooms > 0 THEN CAST(bedrooms AS VARCHAR) END),
      struct_pack(label := 'Location', value := concat(area, ', ', {_STATE_NAME})), struct_pack(label := 'First seen', value := '{TODAY}'), struct_pack(label := 'Last checked', value := '{TODAY}'), struct_pack(label := 'Source', value := 'by the source')],
      lambda x: x.value IS NOT NULL) AS l FROM fx_listings)
    SELECT id, CAST(i - 1 AS BIGINT) AS position, l[i].label AS label, l[i].value AS value FROM (SELECT id, l, unnest(range(1, len(l) + 1)) AS i FROM r)""",
)
def place_detail_rows(spark, sf_dir):
    return publish.place_detail_rows(_places(spark, sf_dir)).withColumn("position", F.col("position").cast("long"))


@query(
    "place_links",
    """SELECT concat(source, ':', source_listing_id) AS id, concat('/search?state=', state, '&area=', replace(replace(area, ',', '%2C'), ' ', '+'), CASE WHEN bedrooms > 0 THEN concat('&bedrooms=', CAST(bedrooms AS VARCHAR)) ELSE '' END) AS search_href,
    concat('/stay/', replace(replace(property_name, '#', '%23'), ' ', '%20')) AS href, concat(website, '?checkin=2024-02-01&checkout=2024-02-03&guests=2') AS deep_link FROM fx_listings""",
)
def place_links(spark, sf_dir):
    x = view(spark, sf_dir, "fx_listings")
    day = lambda d: F.lit(d).cast("date")
    link = publish.affiliate_deep_link("website", day("2024-02-01"), day("2024-02-03"), F.lit(2))
    id_ = F.concat_ws(":", "source", "source_listing_id")
    return x.select(id_.alias("id"), publish.bookable_search_href("state", "area", "bedrooms").alias("search_href"), publish.place_href("property_name").alias("href"), F.coalesce(link, F.lit("?checkin=2024-02-01&checkout=2024-02-03&guests=2")).alias("deep_link"))


# ---- contacts, dates, rates ---------------------------------------------------------------------------------------


@query(
    "contact_functions",
    """SELECT seq, '+234' || substr(phone, 2) AS phone, CASE WHEN seq % 4 = 0 THEN concat('a', CAST(seq AS VARCHAR), '@op.ng') END AS email, website, CASE WHEN seq % 6 = 0 THEN concat('stay_', CAST(seq AS VARCHAR)) END AS instagram,
    'tel:+234' || substr(phone, 2) AS tel, 'https://wa.me/234' || substr(phone, 2) AS whatsapp, CASE WHEN phone IS NOT NULL THEN 'PHONE' WHEN website IS NOT NULL THEN 'WEBSITE' WHEN seq % 4 = 0 THEN 'EMAIL' ELSE 'NONE' END AS route,
    CASE WHEN phone IS NOT NULL AND website IS NOT NULL THEN 'HIGH' WHEN phone IS NOT NULL OR website IS NOT NULL THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
    CASE WHEN phone IS NOT NULL THEN 'PHONE' WHEN seq % 6 = 0 THEN 'INSTAGRAM' WHEN seq % 4 = 0 OR website IS NOT NULL THEN 'EMAIL' ELSE 'NONE' END AS channel,
    concat_ws(',', CASE WHEN website IS NOT NULL THEN 'OPERATOR_SITE' END, CASE WHEN phone IS NOT NULL THEN 'PHONE' END, CASE WHEN phone IS NOT NULL THEN 'WHATSAPP' END, CASE WHEN seq % 2 = 0 THEN 'SOURCE' END) AS routes FROM fx_listings""",
)
def contact_functions(spark, sf_dir):
    k = F.col("seq")
    x = view(spark, sf_dir, "fx_listings").select(
        "seq", "phone", F.when(k % 4 == 0, F.concat(F.lit(" A"), k.cast("string"), F.lit("@Op.ng"))).alias("email"), F.concat("website", F.lit("/")).alias("slashed"), "website",
        F.when(k % 6 == 0, F.concat(F.lit("@stay_"), k.cast("string"))).alias("instagram"), F.when(k % 2 == 0, "https://s.ng/1").alias("source_url"),
    )
    routes = F.transform(web.contact_routes("website", "phone", "phone", "source_url"), lambda r: r["kind"])
    return x.select("seq", "*", web.sanitise_contact("phone", "email", "slashed", "instagram").alias("c")).select(
        x["seq"], "c.phone", "c.email", "c.website", "c.instagram", web.tel_href(x["phone"]).alias("tel"), web.whatsapp_href(x["phone"]).alias("whatsapp"), web.contact_route(x["phone"], x["website"], x["email"])["kind"].alias("route"),
        web.contact_confidence(x["website"], x["phone"]).alias("confidence"), web.best_channel(x["phone"], x["instagram"], x["email"], x["website"]).alias("channel"), F.array_join(routes, ",").alias("routes"),
    )


@query(
    "retention",
    """SELECT event_id, CAST(ts + INTERVAL 365 DAY AS DATE) AS retain_until, ts + INTERVAL 365 DAY <= TIMESTAMP '2025-01-15 00:00:00' AS expired, concat('event_', substr(sha256(concat(event_type, chr(31), CAST(user_id AS VARCHAR))), 1, 24)) AS pk FROM events""",
)
def retention(spark, sf_dir):
    until = dates.retention_expiry(F.col("ts").cast("timestamp"))
    expired = dates.is_retention_expired(until, F.lit("2025-01-15 00:00:00").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", until.cast("date").alias("retain_until"), expired.alias("expired"), stable_id("event", "event_type", "user_id").alias("pk"))


@query("effective_nightly_rate", "SELECT l_orderkey, greatest(min(nightly_rate_kobo), coalesce(max(nightly_rate_kobo) FILTER (nights > 7), 0)) AS rate FROM fx_charges GROUP BY 1")
def effective_nightly_rate(spark, sf_dir):
    """An order's least rate, and those of its long stays as overrides by length; lengths are few."""
    by_length = view(spark, sf_dir, "fx_charges").groupBy("l_orderkey", "nights").agg(F.min("nightly_rate_kobo").alias("least"), F.max("nightly_rate_kobo").alias("most"))
    overrides = F.map_from_entries(F.collect_list(F.when(F.col("nights") > 7, F.struct("nights", "most"))))
    x = by_length.groupBy("l_orderkey").agg(F.min("least").alias("base"), overrides.alias("overrides"))
    return x.select("l_orderkey", money.effective_nightly_rate("base", "overrides").alias("rate"))


@query("price_history", "WITH h AS (SELECT *, row_number() OVER (PARTITION BY source, source_listing_id, observed_on ORDER BY seq DESC) AS r FROM fx_observations WHERE observed_on IS NOT NULL) SELECT source, source_listing_id, observed_on, advertised_price FROM h WHERE r = 1")
def price_history(spark, sf_dir):
    return history.price_history(base._history(spark, sf_dir))


# ---- feeds and crawled bodies -------------------------------------------------------------------------------------


def _snapshots(spark, sf_dir):
    u, k = view(spark, sf_dir, "fx_units"), F.col("unit_id")
    days = F.array(F.lit("2026-01-02"), F.lit("2026-01-03"), F.lit("2026-01-02"), F.when(k % 5 == 0, "soon").otherwise("2026-01-09"))
    unit = F.struct(F.when(k % 10 != 0, k.cast("string")).alias("externalId"), F.concat(F.lit("Unit "), k.cast("string")).alias("name"), F.col("state").alias("stateCode"), "bedrooms", F.col("nightly_rate_kobo").alias("nightlyRateKobo"), F.when(k % 3 == 0, days).alias("closedNights"))
    return feeds.flatten_snapshot(u.select("partner_id", F.to_json(F.struct(F.array(unit).alias("units"))).alias("payload")))


@query("feed_units", "SELECT partner_id, CAST(unit_id AS VARCHAR) AS unit_id, concat('Unit ', CAST(unit_id AS VARCHAR)) AS name, state, bedrooms, nightly_rate_kobo FROM fx_units WHERE unit_id % 10 <> 0")
def feed_units(spark, sf_dir):
    units, _ = _snapshots(spark, sf_dir)
    return units.select("partner_id", F.col("externalId").alias("unit_id"), "name", F.col("stateCode").alias("state"), "bedrooms", F.col("nightlyRateKobo").alias("nightly_rate_kobo"))


@query(
    "feed_nights",
    """SELECT partner_id, CAST(unit_id AS VARCHAR) AS unit_id, d AS night, 'CLOSED' AS state FROM fx_units, (VALUES (DATE '2026-01-02'), (DATE '2026-01-03'), (DATE '2026-01-09')) t(d) WHERE unit_id % 10 <> 0 AND unit_id % 3 = 0 AND (d < DATE '2026-01-09' OR unit_id % 5 <> 0)""",
)
def feed_nights(spark, sf_dir):
    return _snapshots(spark, sf_dir)[1]


@query(
    "dashboard_nights",
    """WITH n AS (SELECT unit_id, status, CAST(unnest(range(check_in, check_out, INTERVAL 1 DAY)) AS DATE) AS night, stay_id FROM fx_stays WHERE status IN ('F', 'O'))
    SELECT unit_id, night, CASE status WHEN 'F' THEN 'CLOSED' ELSE 'OPEN' END AS state, CASE status WHEN 'O' THEN stay_id * 100 END AS nightly_rate_kobo FROM n WHERE unit_id IN (SELECT unit_id FROM fx_units WHERE unit_id % 2 = 0)""",
)
def dashboard_nights(spark, sf_dir):
    s = view(spark, sf_dir, "fx_stays")
    nights = F.concat(dates.each_night("check_in", "check_out").cast("array<string>"), F.array(F.lit("never")))
    closed, opened = s.where("status = 'F'").select("unit_id", nights.alias("nights")), s.where("status = 'O'").select("unit_id", nights.alias("nights"), (F.col("stay_id") * 100).alias("rate"))
    return feeds.flatten_dashboard(view(spark, sf_dir, "fx_units").where("unit_id % 2 = 0"), closed, opened)


def _calendars(spark, sf_dir):
    """A calendar for each stay: folded lines, parameters, an event without an end, and every fiftieth with a malformed date."""
    day = lambda c: F.date_format(c, "yyyyMMdd")
    end = F.when(F.col("stay_id") % 50 == 0, "some day").otherwise(day("check_out"))
    body = F.concat(
        F.lit("BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nSUMMARY:taken\r\nDTSTART;VALUE=DATE:"), F.substring(day("check_in"), 1, 4), F.lit("\r\n "), F.substring(day("check_in"), 5, 4), F.lit("\r\nDTEND:"), end,
        F.lit("\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nDTSTART:20300101\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n"),
    )
    return feeds.ical_to_nights(view(spark, sf_dir, "fx_stays").select(F.col("stay_id").alias("unit_id"), body.alias("body")))


@query("calendar_nights", "SELECT stay_id AS unit_id, CAST(unnest(range(check_in, check_out, INTERVAL 1 DAY)) AS DATE) AS night FROM fx_stays WHERE stay_id % 50 <> 0")
def calendar_nights(spark, sf_dir):
    return _calendars(spark, sf_dir)[0]


def _calendar_files(spark, sf_dir) -> tuple[DataFrame, str]:
    """The stays as calendars (part, value), a hundred or so in a file, and a new folder for them."""
    day = lambda c: F.date_format(c, "yyyyMMdd")
    s = view(spark, sf_dir, "fx_stays")
    end = F.when(F.col("stay_id") % 50 == 0, F.lit("soon")).otherwise(day("check_out"))
    body = F.concat(F.lit("BEGIN:VCALENDAR\nX-WR-CALNAME:"), F.col("stay_id").cast("string"), F.lit("\nBEGIN:VEVENT\nDTSTART;VALUE=DATE:"), day("check_in"), F.lit("\nDTEND;VALUE=DATE:"), end, F.lit("\nEND:VEVENT\nEND:VCALENDAR"))
    return s.select((F.col("stay_id") % 3).cast("int").alias("part"), body.alias("value")), f"{checkpoint_folder(spark)}/calendars-{uuid.uuid4().hex}"


def _write_calendars(rows: DataFrame, folder: str) -> None:
    """As text files below a new folder, which are then named as calendars."""
    spark = rows.sparkSession
    rows.write.text(folder)
    at = spark._jvm.org.apache.hadoop.fs.Path
    files = at(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for f in files.listStatus(at(folder)):
        name = f.getPath().getName()
        if name.endswith(".txt"):
            files.rename(f.getPath(), at(f"{folder}/{name[:-4]}.ics"))


_NIGHTS = """SELECT CAST(stay_id AS VARCHAR) AS unit_id, CAST(unnest(range(check_in, check_out, INTERVAL 1 DAY)) AS DATE) AS night, NULL::VARCHAR AS reason FROM fx_stays WHERE stay_id % 50 <> 0
    UNION ALL SELECT CAST(stay_id AS VARCHAR), NULL, 'malformed date' FROM fx_stays WHERE stay_id % 50 = 0"""


@query("calendar_source", _NIGHTS)
def calendar_source(spark, sf_dir):
    """The stays' calendars written as files and read by their own format."""
    rows, folder = _calendar_files(spark, sf_dir)
    _write_calendars(rows.select("value"), folder)
    connectors.register(spark)
    return spark.read.format("marram_calendars").load(folder)


@query("calendar_stream", _NIGHTS)
def calendar_stream(spark, sf_dir):
    """The same as a stream: files come in three runs, each from the checkpoint of the one before."""
    rows, folder = _calendar_files(spark, sf_dir)
    rows = checkpointed(rows)
    connectors.register(spark)
    for part in range(3):
        _write_calendars(rows.where(F.col("part") == part).select("value"), f"{folder}/in/{part}")
        stream = spark.readStream.format("marram_calendars").load(f"{folder}/in")
        stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/out", format="parquet").awaitTermination()
    return spark.read.schema("unit_id string, night date, reason string").parquet(f"{folder}/out")


@query("calendar_rejects", "SELECT stay_id AS unit_id, 'malformed date' AS reason FROM fx_stays WHERE stay_id % 50 = 0")
def calendar_rejects(spark, sf_dir):
    return _calendars(spark, sf_dir)[1]


@query(
    "unit_config",
    """SELECT partner_id, CASE WHEN unit_id % 7 <> 0 THEN CAST(unit_id AS VARCHAR) END AS unit_id, CASE WHEN unit_id % 2 = 0 THEN concat('Unit ', CAST(unit_id AS VARCHAR)) WHEN unit_id % 7 <> 0 THEN CAST(unit_id AS VARCHAR) END AS name, CASE WHEN unit_id % 3 = 0 THEN max_guests ELSE 2 END AS max_guests,
    CASE WHEN unit_id % 7 = 0 THEN 'no externalId' WHEN unit_id % 11 = 0 THEN 'no icalUrl' WHEN unit_id % 13 = 0 THEN 'another origin' END AS reason FROM fx_units""",
)
def unit_config(spark, sf_dir):
    u, k = view(spark, sf_dir, "fx_units"), F.col("unit_id")
    ical = F.when(k % 11 == 0, F.lit("")).when(k % 13 == 0, F.lit("https://other.ng/c.ics")).otherwise(F.concat(F.lit("https://host.ng/"), k.cast("string"), F.lit(".ics")))
    unit = F.struct(F.when(k % 7 != 0, k.cast("string")).alias("externalId"), F.when(k % 2 == 0, F.concat(F.lit("Unit "), k.cast("string"))).alias("name"), F.when(k % 3 == 0, F.col("max_guests")).alias("maxGuests"), ical.alias("icalUrl"))
    found = feeds.unit_config(u.select("partner_id", F.to_json(F.array(unit)).alias("units")), origin="https://host.ng")
    return found.select("partner_id", F.col("externalId").alias("unit_id"), "name", F.col("maxGuests").cast("long").alias("max_guests"), "reason")


@query("sitemap_urls", "SELECT page_id AS source, url FROM pages WHERE contains(url, '/') UNION ALL SELECT page_id, concat(regexp_replace(url, '[?#].*$', ''), '/more') FROM pages WHERE page_id % 2 = 0")
def sitemap_urls(spark, sf_dir):
    """Bodies with <loc> entries, and plain lists of one URL a line."""
    p = table(spark, sf_dir, "pages")
    plain = F.concat("url", F.lit("\n# no address\n"))
    more = F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit("/more"))
    marked = F.concat(F.lit("<urlset><url><loc> "), "url", F.lit("</loc></url>\nhttps://not.read/\n<url><LOC>"), more, F.lit("\n</LOC></url></urlset>"))
    return crawl.sitemap_urls(p.select(F.col("page_id").alias("source"), F.when(F.col("page_id") % 2 == 0, marked).otherwise(plain).alias("body")))


@query(
    "discovery_candidates",
    """SELECT url, concat('Title ', CAST(page_id AS VARCHAR)) AS title, CASE WHEN page_id % 3 = 0 THEN '2026-01-01' END AS published, CAST(page_id % 4 AS VARCHAR) AS bedrooms, 1::BIGINT AS n FROM pages WHERE page_id % 5 <> 0""",
)
def discovery_candidates(spark, sf_dir):
    k = F.col("page_id")
    result = F.to_json(F.struct(F.when(k % 5 == 0, "").otherwise(F.col("url")).alias("url"), F.concat(F.lit("Title "), k.cast("string")).alias("title"), F.when(k % 3 == 0, "2026-01-01").alias("publishedDate"), F.struct((k % 4).cast("string").alias("bedrooms"), F.lit("long").alias("essay")).alias("summary")))
    found = crawl.discovery_candidates(table(spark, sf_dir, "pages").select(result.alias("result")))
    return found.select("url", "title", "published", F.col("summary")["bedrooms"].alias("bedrooms"), F.size("summary").cast("long").alias("n"))


def _robots(spark, sf_dir):
    host, k = F.concat(F.lit("site"), F.col("c_custkey").cast("string"), F.lit(".ng")), F.col("c_custkey")
    body = F.concat(
        F.lit("# rules\r\nUser-agent: other\r\nDisallow: /all\r\n\r\nUser-agent: x\r\nUser-agent: *\r\nDisallow: /p"), (k % 3).cast("string"), F.lit("/ # closed\r\nDisallow:\r\nCrawl-delay: "), (k % 7).cast("string"),
        F.lit("\r\nSitemap: https://"), host, F.lit("/sitemap.xml\r\n"),
    )
    return crawl.robots_rules(table(spark, sf_dir, "customer").select(host.alias("host"), body.alias("body")))


@query(
    "robots_rules",
    """SELECT concat('site', CAST(c_custkey AS VARCHAR), '.ng') AS host, concat('/p', CAST(c_custkey % 3 AS VARCHAR), '/') AS prefix, CAST(c_custkey % 7 AS DOUBLE) AS delay, concat('https://site', CAST(c_custkey AS VARCHAR), '.ng/sitemap.xml') AS sitemap FROM customer""",
)
def robots_rules(spark, sf_dir):
    disallowed, delays, maps = _robots(spark, sf_dir)
    return disallowed.join(delays, "host").join(maps, "host").select("host", "prefix", "delay", F.col("url").alias("sitemap"))


@query("robots_admission", "SELECT o_orderkey, concat('https://site', CAST(o_custkey AS VARCHAR), '.ng/p', CAST(o_orderkey % 3 AS VARCHAR), '/', CAST(o_orderkey AS VARCHAR)) AS url FROM orders WHERE o_orderkey % 3 <> o_custkey % 3")
def robots_admission(spark, sf_dir):
    parts = [F.lit("https://site"), F.col("o_custkey").cast("string"), F.lit(".ng/p"), (F.col("o_orderkey") % 3).cast("string"), F.lit("/"), F.col("o_orderkey").cast("string")]
    return crawl.robots_admission(table(spark, sf_dir, "orders").select("o_orderkey", F.concat(*parts).alias("url")), _robots(spark, sf_dir)[0])


# ---- streams with state -------------------------------------------------------------------------------------------


def _as_stream(rows: DataFrame) -> tuple[DataFrame, str]:
    """The rows as a stream that gives all of them in its first batch, below a new folder of the session's shared one."""
    folder = f"{checkpoint_folder(rows.sparkSession)}/stream-{uuid.uuid4().hex}"
    rows.write.parquet(f"{folder}/in")
    return rows.sparkSession.readStream.schema(rows.schema).parquet(f"{folder}/in"), folder


def _run(stream: DataFrame, folder: str) -> DataFrame:
    stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/out", format="parquet").awaitTermination()
    return stream.sparkSession.read.parquet(f"{folder}/out")


#: Runs that a table is dealt to by time; a quarter of each run's rows come one run late.
_RUNS = 4


def _dealt(rows: DataFrame, time: str, key: str) -> tuple[DataFrame, int, object]:
    """rows with the run that they come in, the seconds of delay within which all of them are, and their greatest time."""
    first, last = rows.agg(F.min(F.unix_seconds(F.col(time).cast("timestamp"))), F.max(F.unix_seconds(F.col(time).cast("timestamp")))).first()
    first, last = first or 0, last or 0
    era = F.floor((F.unix_seconds(F.col(time).cast("timestamp")) - first) * _RUNS / (last - first + 1))
    late = (F.pmod(F.xxhash64(key), F.lit(4)) == 0).cast("int")
    return rows.withColumn("run", (era + late).cast("int")), (last - first) * 2 // _RUNS + 86_400, last


def _in_runs(dealt: DataFrame, start) -> str:
    """Gives each run's rows to the stream in a run of its own, from the checkpoint of the run before; start(stream, folder) begins one."""
    spark = dealt.sparkSession
    folder = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = checkpointed(dealt)
    for n in range(_RUNS + 1):
        part = rows.where(F.col("run") == n).drop("run")
        part.write.parquet(f"{folder}/in/run-{n}")
        start(spark.readStream.schema(part.schema).parquet(f"{folder}/in/run-*"), folder).awaitTermination()
    return folder


def _to_files(make, **trigger):
    """start of _in_runs for a stream whose rows are appended to files."""
    return lambda stream, folder: make(stream).writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(**(trigger or {"availableNow": True})).start(f"{folder}/out", format="parquet")


def _with_beats(dealt: DataFrame, beat: list) -> DataFrame:
    """dealt with a row in the last run that ends all times: without newer events a stream judges nothing."""
    return dealt.unionByName(dealt.sparkSession.createDataFrame([beat], dealt.schema))


_STEPS = """h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, source_listing_id, observed_on ORDER BY seq DESC) AS r FROM fx_observations WHERE observed_on IS NOT NULL) WHERE r = 1),
    c AS (SELECT *, lag(advertised_price) OVER w AS previous, lead(observed_on) OVER w AS next_day, row_number() OVER w AS n FROM h WINDOW w AS (PARTITION BY source, source_listing_id ORDER BY observed_on)), k AS (SELECT *, advertised_price <> previous AS moved FROM c)"""
_JUDGED = """SELECT source, source_listing_id, observed_on, CASE WHEN n = 1 THEN 'new_listing' WHEN moved THEN 'price_change' ELSE 'unchanged' END AS change, CASE WHEN n > 1 AND moved THEN previous END AS previous, advertised_price AS current FROM k"""


@query(
    "stream_changes",
    f"""WITH {_STEPS} {_JUDGED}
    UNION ALL SELECT source, source_listing_id, observed_on, 'delisted', NULL, advertised_price FROM k WHERE coalesce(next_day, (SELECT max(observed_on) + 1 FROM h)) - observed_on > 8""",
)
def stream_changes(spark, sf_dir):
    """The raw observations in five runs of a stream, each from the checkpoint of the one before and a quarter of each a run late. A listing is
    delisted where a day after its grace ends without it. A beat behind the last day lets the stream judge that day."""
    o = view(spark, sf_dir, "fx_observations").where("observed_on is not null").select("source", "source_listing_id", F.col("observed_on").cast("timestamp").alias("observed_at"), "advertised_price", "seq")
    dealt, delay, last = _dealt(o, "observed_at", "seq")
    beat = dt.datetime.fromtimestamp(last + 86_400 + delay + 1, dt.UTC)
    folder = _in_runs(_with_beats(dealt, ["beat", "beat", beat, None, -1, _RUNS]), _to_files(lambda x: ledger.detect_changes_stream(x, delay=f"{delay} seconds")))
    return spark.read.schema(ledger.CHANGES).parquet(f"{folder}/out").where("source <> 'beat'")


@query("stream_rebuild", f"WITH {_STEPS} {_JUDGED}")
def stream_rebuild(spark, sf_dir):
    """Histories and changes kept by a stream whose rows come late, by more than its delay too: the touched histories are made anew."""
    o = view(spark, sf_dir, "fx_observations").where("observed_on is not null").select("source", "source_listing_id", "observed_on", "advertised_price", "seq")
    dealt, _, _ = _dealt(o, "observed_on", "seq")
    folder = _in_runs(dealt, lambda stream, folder: ledger.stream_history(stream, f"{folder}/state", f"{folder}/checkpoint"))
    return ledger.read_changes(spark, f"{folder}/state")


@query(
    "stream_holds",
    """WITH e AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 5 MINUTE WHEN event_id % 3 = 1 THEN ts + INTERVAL 40 MINUTE END AS ended FROM events)
    SELECT event_id AS hold_id, 'ACTIVE' AS status, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM e UNION ALL SELECT event_id, 'CONVERTED', strftime(ended, '%Y-%m-%d %H:%M:%S') FROM e WHERE ended IS NOT NULL
    UNION ALL SELECT event_id, 'EXPIRED', strftime(ts + INTERVAL 15 MINUTE, '%Y-%m-%d %H:%M:%S') FROM e WHERE event_id % 3 > 0""",
)
def stream_holds(spark, sf_dir):
    """Every event begins a hold; a third of them are converted in time, a third too late and a third never. The rows come in five
    runs, out of order, so that many a conversion is there before its hold; a beat lets the last of them run out."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    ended = F.when(F.col("event_id") % 3 == 0, F.col("ts") + F.expr("interval 5 minutes")).when(F.col("event_id") % 3 == 1, F.col("ts") + F.expr("interval 40 minutes"))
    rows = e.select(F.col("event_id").cast("string").alias("hold_id"), F.lit("ACTIVE").alias("status"), F.col("ts").alias("at")).union(e.select(F.col("event_id").cast("string"), F.lit("CONVERTED"), ended).where(ended.isNotNull()))
    dealt, delay, last = _dealt(rows.withColumn("key", F.concat("hold_id", "status")), "at", "key")
    beat = dt.datetime.fromtimestamp(last + 86_400 + delay, dt.UTC)
    folder = _in_runs(_with_beats(dealt.drop("key"), ["beat", "RELEASED", beat, _RUNS]), _to_files(lambda x: ledger.expire_holds(x, delay=f"{delay} seconds")))
    found = spark.read.schema(ledger.HOLDS).parquet(f"{folder}/out").where("hold_id <> 'beat'")
    return found.select(F.col("hold_id").cast("long").alias("hold_id"), "status", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"))


_WEBHOOKS = "SELECT DISTINCT event_type AS processor, CAST(user_id AS VARCHAR) AS signature FROM events"


@query("stream_webhooks", _WEBHOOKS)
def stream_webhooks(spark, sf_dir):
    """The events as webhooks, each user's of a type being replays; the delay is longer than the time that the table spans."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("processor"), F.col("user_id").cast("string").alias("signature"), F.col("ts").cast("timestamp").alias("received_at"))
    span = e.agg(F.datediff(F.max("received_at"), F.min("received_at"))).first()[0] or 0
    dealt, _, _ = _dealt(e, "received_at", "event_id")
    folder = _in_runs(dealt.drop("event_id"), _to_files(lambda x: ledger.dedupe_webhooks(x, delay=f"{span + 1} days").select("processor", "signature")))
    return spark.read.parquet(f"{folder}/out")


@query("stream_webhooks_by_clock", _WEBHOOKS)
def stream_webhooks_by_clock(spark, sf_dir):
    """The same of events without a time of their own: what was seen is forgotten a week later by the clock."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("processor"), F.col("user_id").cast("string").alias("signature"), F.col("ts").cast("timestamp").alias("received_at"))
    dealt, _, _ = _dealt(e, "received_at", "event_id")
    folder = _in_runs(dealt.select("processor", "signature", "run"), _to_files(ledger.dedupe_webhooks_by_clock, once=True))
    return spark.read.parquet(f"{folder}/out")


@query("stream_late", f"SELECT event_id FROM events WHERE CAST(ts AS DATE) <= DATE '{base.MIDDLE}'")
def stream_late(spark, sf_dir):
    stream, folder = _as_stream(table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("observed_at")))
    return _run(ledger.late_observations(stream, base.MIDDLE).select("event_id"), folder)


# ---- files that are written and read back -------------------------------------------------------------------------


def _folder(spark, name: str) -> str:
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


_DIRECTORY = """SELECT concat(source, ':', source_listing_id) AS id, source, CASE WHEN advertised_price BETWEEN 100000 AND 2000000000 THEN advertised_price END AS advertised_price,
    CASE WHEN phone IS NOT NULL THEN 'PHONE' WHEN website IS NOT NULL THEN 'WEBSITE' ELSE 'NONE' END AS kind FROM fx_listings"""


@query("directory_document", _DIRECTORY)
def directory_document(spark, sf_dir):
    """The public directory as one document, read back."""
    path = _folder(spark, "directory") + ".json"
    files.write_document(publish.build_directory(base._listings(spark, sf_dir), TODAY, "by the source"), path)
    return files.read_document(spark, path).select("id", "source", "advertised_price", F.col("contact_route.kind").alias("kind"))


@query("directory_files", _DIRECTORY)
def directory_files(spark, sf_dir):
    """The same as JSON lines beside their counts."""
    path = _folder(spark, "directory")
    files.write_directory(publish.build_directory(base._listings(spark, sf_dir), TODAY, "by the source"), path)
    places, there = files.read_directory(spark, f"{path}/places")
    return places.where(F.lit(there)).select("id", "source", "advertised_price", F.col("contact_route.kind").alias("kind"))


_LEDGER = """h AS (SELECT *, row_number() OVER (PARTITION BY source, source_listing_id, observed_on ORDER BY seq DESC) AS r FROM fx_observations WHERE observed_on IS NOT NULL)"""


@query("ledger_files", f"WITH {_LEDGER} SELECT source, source_listing_id, observed_on, advertised_price, row_number() OVER (ORDER BY observed_on, source, source_listing_id) AS rank FROM h WHERE r = 1")
def ledger_files(spark, sf_dir):
    """Observations appended in two runs, the second of them twice, and read back in the ledger's order."""
    path = _folder(spark, "ledger")
    o = view(spark, sf_dir, "fx_observations").where("observed_on is not null").select("source", "source_listing_id", "observed_on", "advertised_price", "seq")
    for run in (0, 1, 1):
        files.append_ledger(o.where(F.col("seq") % 2 == run), path, f"run-{run}")
    return files.ordered_ledger(files.read_ledger(spark, path)).select("source", "source_listing_id", "observed_on", "advertised_price", F.col("rank").cast("long").alias("rank"))


@query("listing_records", "SELECT source, source_listing_id, property_name, advertised_price FROM fx_listings WHERE seq % 9 <> 0")
def listing_records(spark, sf_dir):
    """Listings written as JSON lines, with an id that holds their source, and read back; every ninth has no URL and can't be used."""
    path = _folder(spark, "records")
    x = base._listings(spark, sf_dir)
    url = F.when(F.col("seq") % 9 != 0, F.concat(F.lit("https://x.ng/"), F.col("seq").cast("string")))
    x.select(F.concat("source", F.lit(":"), "source_listing_id").alias("id"), url.alias("source_url"), "property_name", "advertised_price").write.json(path)
    return files.read_listing_records(spark, path)[0].select("source", "source_listing_id", "property_name", "advertised_price")


@query("lead_files", f"WITH RECURSIVE {base._LEADS} SELECT component, n AS listing_count, low AS lowest_rate FROM lead")
def lead_files(spark, sf_dir):
    path = _folder(spark, "leads")
    files.write_leads(base._leads(spark, sf_dir)[0], path)
    return spark.read.schema("component long, listing_count long, lowest_rate long").json(path)


# ---- single functions over whole tables ---------------------------------------------------------------------------


@query(
    "instants",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts - INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') WHEN 2 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS instant,
    CASE WHEN event_id % 3 = 0 THEN CAST(ts AS DATE) END AS day FROM events""",
)
def instants(spark, sf_dir):
    """Times without an offset, with one, with a Z and with none that can be read; dates among other strings."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    said = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    k = F.col("event_id") % 4
    written = F.when(k == 0, said).when(k == 1, F.concat(said, F.lit("+01:00"))).when(k == 2, F.concat(F.replace(said, F.lit(" "), F.lit("T")), F.lit("Z"))).otherwise(F.concat(F.lit("on "), said))
    day = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd")).when(F.col("event_id") % 3 == 1, said).otherwise(F.lit("2024-02-30"))
    return e.select("event_id", F.date_format(dates.to_utc(written), "yyyy-MM-dd HH:mm:ss").alias("instant"), dates.iso_date(day).alias("day"))


_CENTROIDS = ", ".join(f"({i}, '{name}', {lat}, {lng})" for i, (name, lat, lng) in enumerate(AREA_CENTROIDS))
_TITLES = ", ".join(f"({i}, '{key}', '{risk}')" for i, (key, _, risk) in enumerate(TITLE_DOCUMENTS))


@query(
    "facts_of_places",
    f"""SELECT p_partkey AS seq, CAST(c.lat AS DOUBLE) AS lat, CAST(c.lng AS DOUBLE) AS lng, t.risk, CASE p_partkey % 5 WHEN 0 THEN p_size WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE -p_size END AS n
    FROM part LEFT JOIN (VALUES {_CENTROIDS}) c(i, name, lat, lng) ON c.i = p_partkey % {len(AREA_CENTROIDS) + 3} LEFT JOIN (VALUES {_TITLES}) t(i, key, risk) ON t.i = p_partkey % {len(TITLE_DOCUMENTS) + 2}""",
)
def facts_of_places(spark, sf_dir):
    """Centroids of areas, risks of title documents and integers of JSON documents, with unknown ones among them."""
    k = F.col("p_partkey")
    area = F.element_at(F.array(*[F.lit(f" {name.upper()} ") for name, _, _ in AREA_CENTROIDS], *[F.lit("nowhere")] * 3), (k % (len(AREA_CENTROIDS) + 3) + 1).cast("int"))
    title = F.element_at(F.array(*[F.lit(key) for key, _, _ in TITLE_DOCUMENTS], F.lit("OTHER"), F.lit(None).cast("string")), (k % (len(TITLE_DOCUMENTS) + 2) + 1).cast("int"))
    n = F.when(k % 5 == 0, F.col("p_size").cast("string")).when(k % 5 == 1, F.lit('""')).when(k % 5 == 2, F.lit('"many"')).when(k % 5 == 3, F.lit("null")).otherwise(F.concat(F.lit('"-'), F.col("p_size").cast("string"), F.lit('"')))
    rows = table(spark, sf_dir, "part").select(k.alias("seq"), geo.centroid_for_area(area).alias("c"), facts.title_risk(title).alias("risk"), text.json_int(F.concat(F.lit('{"n": '), n, F.lit("}")), "n").alias("n"))
    return rows.select("seq", "c.lat", "c.lng", "risk", "n")


@query("operator_count", "SELECT count(DISTINCT partner_id) AS operators FROM fx_units WHERE state = 'LA'")
def operator_count(spark, sf_dir):
    return reports.operator_count(view(spark, sf_dir, "fx_units").where("state = 'LA'"))


@query("split_percent", "SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 9 <> 0 THEN nightly_rate_kobo * 100 // (nightly_rate_kobo + nights * 100000) END AS percent FROM fx_charges")
def split_percent(spark, sf_dir):
    total = F.when(F.col("l_orderkey") % 9 == 0, F.lit(0).cast("long")).otherwise(F.col("nightly_rate_kobo") + F.col("nights") * 100_000)
    return view(spark, sf_dir, "fx_charges").select("l_orderkey", "l_linenumber", pricing.split_percent("nightly_rate_kobo", total).alias("percent"))


@query(
    "geography_dim",
    """SELECT n_name AS state, n_nationkey % 3 AS launch_order, CASE WHEN n_nationkey % 3 <= 1 THEN 'LIVE' ELSE 'PLANNED' END AS status, CASE WHEN n_nationkey % 4 > 0 THEN 'area ' || i END AS area, CASE WHEN n_nationkey % 4 > 0 THEN i * 10 END AS demand_rank, customers
    FROM nation JOIN (SELECT c_nationkey, count(*) AS customers FROM customer GROUP BY 1) ON c_nationkey = n_nationkey, unnest(range(1, greatest(2, n_nationkey % 4 + 1))) r(i)""",
)
def geography_dim(spark, sf_dir):
    """Nations as states with up to three areas, each with the number of its customers."""
    states = [(r.n_name, r.n_name.title(), r.n_nationkey % 3, [f"area {i}" for i in range(1, r.n_nationkey % 4 + 1)]) for r in table(spark, sf_dir, "nation").collect()]  # 25 rows
    customers = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("customers")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return crawl.geography_dim(spark, states).join(customers.select(F.col("n_name").alias("state"), "customers"), "state").select("state", "launch_order", "status", "area", "demand_rank", "customers")


@query(
    "image_rules",
    """SELECT l_orderkey, l_linenumber, l_orderkey % 7 IN (1, 2, 3) AS watermark, l_orderkey % 7 IN (4, 5) AS proxied, l_orderkey % 7 = 6 AND l_linenumber > 1 AS other_listing FROM lineitem""",
)
def image_rules(spark, sf_dir):
    """Addresses of images: plain, with a mark in the name, of a brand's host or path, proxied in two ways, and of a listing that may be another."""
    k, n = F.col("l_orderkey") % 7, F.col("l_linenumber")
    name = F.concat(F.col("l_partkey").cast("string"), F.lit(".jpg"))
    at = lambda left, right="": F.concat(F.lit(left), name, F.lit(right))
    own = F.lit(1_000_000) + F.col("l_orderkey")
    url = F.when(k == 1, at("https://cdn.pics.ng/watermark_")).when(k == 2, at("https://img.propertypro.ng/")).when(k == 3, at("https://cdn.pics.ng/jiji/")).when(k == 4, at("https://wsrv.nl/?w=200&x=")).when(k == 5, at("https://cdn.pics.ng/get?url=a/"))
    url = url.when(k == 6, F.concat(F.lit("https://cdn.pics.ng/"), F.when(n > 1, own + n).otherwise(own).cast("string"), F.lit("/"), name)).otherwise(at("https://cdn.pics.ng/"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", url.alias("url"), own.cast("string").alias("own"))
    return rows.select("l_orderkey", "l_linenumber", extraction.has_watermark("url").alias("watermark"), extraction.is_hotlinkable("url").alias("proxied"), extraction.is_other_listing("url", "own").alias("other_listing"))
