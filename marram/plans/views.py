"""Views over the driver's tables in the shape that the operators take. The text runs in Spark SQL and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "fx_observations": """SELECT event_type AS source, CAST(user_id AS STRING) AS source_listing_id, CAST(ts AS DATE) AS observed_on,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(floor(value * 100 + 0.5) AS BIGINT) END AS advertised_price, event_id AS seq FROM {events}""",
    "fx_listings": """SELECT p_partkey AS seq, lower(p_brand) AS source, concat('L', CAST(p_partkey AS STRING)) AS source_listing_id, p_name AS property_name,
  p_type AS property_type, p_size % 6 AS bedrooms, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE CAST(floor(p_retailprice * 100 + 0.5) AS BIGINT) * 100 END AS advertised_price,
  CASE WHEN p_partkey % 3 <> 0 THEN concat('0803', lpad(CAST(CAST(floor(p_partkey / 4.0) AS BIGINT) AS STRING), 7, '0')) END AS phone,
  CASE WHEN p_partkey % 5 = 0 THEN concat('https://www.op', CAST(p_partkey % 700 AS STRING), '.ng/a') END AS website,
  CASE WHEN p_partkey % 7 = 0 THEN concat('Operator ', CAST(p_partkey % 90 AS STRING), ' Nig. Ltd') END AS operator_name,
  CASE p_partkey % 5 WHEN 0 THEN 'LA' WHEN 1 THEN 'FC' WHEN 2 THEN 'OY' WHEN 3 THEN 'IM' ELSE 'AK' END AS state,
  CASE p_partkey % 4 WHEN 0 THEN 'LEKKI 1, Lagos' WHEN 1 THEN 'ikeja g.r.a' WHEN 2 THEN 'wuse ii' ELSE 'Some Place' END AS area FROM {part}""",
    "fx_units": """SELECT p_partkey AS unit_id, p_partkey % (SELECT count(*) FROM {supplier}) AS partner_id, CAST(floor(p_retailprice * 100 + 0.5) AS BIGINT) * 50 AS nightly_rate_kobo,
  CAST(p_size AS BIGINT) * 10000 AS cleaning_fee_kobo, 2 + p_size % 5 AS max_guests, p_size % 6 AS bedrooms, 1 + p_size % 3 AS min_nights, 14 + p_size % 3 AS max_nights,
  CASE p_partkey % 5 WHEN 0 THEN 'LA' WHEN 1 THEN 'FC' WHEN 2 THEN 'OY' WHEN 3 THEN 'IM' ELSE 'AK' END AS state,
  CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE CAST(6350 + p_partkey % 200 AS DOUBLE) / 1000 END AS lat, CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE CAST(3400 + p_partkey % 173 AS DOUBLE) / 1000 END AS lng FROM {part}""",
    "fx_stays": """SELECT o_orderkey AS stay_id, o_custkey % (SELECT count(*) FROM {part}) AS unit_id, CAST(o_orderdate AS DATE) AS check_in,
  CAST(o_orderdate AS DATE) + CAST(1 + o_orderkey % 14 AS INT) AS check_out, 1 + o_orderkey % 6 AS guests, o_orderstatus AS status FROM {orders}""",
    "fx_booking_events": """SELECT event_id AS seq, user_id AS booking_id, ts AS created_at, CASE event_type WHEN 'signup' THEN 'HELD' WHEN 'view' THEN 'AWAITING_PAYMENT'
  WHEN 'click' THEN 'CONFIRMED' WHEN 'purchase' THEN 'COMPLETED' ELSE 'EXPIRED' END AS to_status FROM {events}""",
    # listing pages of four sources, and pages that are no listing's; braces are written as chr, since the text is formatted
    "fx_pages": """SELECT k AS seq, url, concat('<!DOCTYPE html><html><head><title>Title ', CAST(k AS STRING), ' | Site</title>',
  CASE WHEN k % 12 = 4 THEN concat('<link rel="canonical" href="', regexp_replace(url, '[0-9]+([?]x=1)?$', CAST(2000000 + k AS STRING)), '">') ELSE '' END,
  CASE WHEN k % 5 = 0 THEN concat('<meta property="og:title" content="OG &amp; name ', CAST(k AS STRING), '">') ELSE '' END,
  CASE WHEN k % 9 = 0 THEN '<script src="https://app.smoobu.com/w.js"></script>' ELSE '' END,
  CASE WHEN k % 3 = 0 THEN concat('<script type="application/ld+json">', chr(123), '"@type":"Apartment","name":"LD name ', CAST(k AS STRING), '","offers":', chr(123), '"price":"', CAST(60000 + k AS STRING), '"', chr(125), ',"address":', chr(123),
    '"addressRegion":"Lagos","addressLocality":"Ikoyi"', chr(125), ',"seller":', chr(123), '"name":"Seller ', CAST(k % 50 AS STRING), ' Homes"', chr(125), chr(125), '</script>') ELSE '' END, '</head><body><video src="a.mp4">flat</video>',
  CASE WHEN k % 7 <> 1 THEN concat('<h1 class="t">Caf&eacute; stay <b>', CAST(k AS STRING), '</b></h1>') ELSE '' END,
  CASE WHEN k % 4 = 1 AND k % 8 = 1 THEN '<a href="/region,1">Lagos</a><a href="/region,2">Yaba</a>' ELSE '' END,
  '<p>Lovely ', CASE k % 3 WHEN 0 THEN 'place' WHEN 1 THEN 'duplex' ELSE 'studio' END, '. ', CAST(1 + k % 5 AS STRING), ' bedroom', CASE WHEN k % 2 = 0 THEN concat(', ', CAST(1 + k % 3 AS STRING), ' bathrooms') ELSE '' END, '.</p><p>',
  CASE k % 6 WHEN 0 THEN concat('₦', price, ' per night') WHEN 1 THEN concat('weekly: ₦', price) WHEN 2 THEN concat('₦10,000 caution, returned to every guest who leaves the place as it was found, and then ₦', price, ' per month')
    WHEN 4 THEN 'N500' WHEN 5 THEN concat('<span class="pd-pr"> <b>₦', price, '</b> <span>per annum</span></span>') ELSE 'ask' END, '</p>',
  CASE k % 5 WHEN 2 THEN '<p>Certificate of Occupancy</p>' WHEN 3 THEN '<p>Freehold</p>' ELSE '' END, CASE WHEN k % 7 = 3 THEN concat('<div class="agent-name">Agency ', CAST(k % 40 AS STRING), ' Ltd</div>') ELSE '' END,
  CASE WHEN k % 2 = 1 THEN concat('<a href="tel:+234 803 ', lpad(CAST(k AS STRING), 7, '0'), '">call</a>') ELSE '' END, CASE WHEN k % 7 = 0 THEN concat('<a href="https://wa.me/2348', lpad(CAST(k AS STRING), 9, '0'), '">chat</a>') ELSE '' END,
  CASE WHEN k % 3 = 1 THEN concat('<a href="mailto:Stay', CAST(k AS STRING), '@Op.ng?subject=x">mail</a>') ELSE '' END, CASE WHEN k % 8 = 1 THEN concat('<a href="https://instagram.com/stay_', CAST(k AS STRING), '">pictures</a>') ELSE '' END,
  CASE WHEN k % 5 < 2 THEN concat('<a href="https://op', CAST(k % 700 AS STRING), '.ng/a.css">s</a><a href="https://op', CAST(k % 700 AS STRING), '.ng/home">site</a>') ELSE '' END,
  CASE WHEN k % 6 = 0 THEN concat('<a href="https://book', CAST(k AS STRING), '.ng/availability">free?</a>') ELSE '' END, CASE WHEN k % 10 = 3 THEN concat('<a href="https://www.guesty.com/p/', CAST(k AS STRING), '">g</a>') ELSE '' END,
  '<img src="/static/logo.png"><img data-src="//cdn.pics.ng/b', CAST(k AS STRING), '.webp" width="800"><img src="p.gif" width="1" height="1">',
  CASE WHEN k % 3 = 0 THEN concat('<img src="https://cdn.pics.ng/', lid, '/s.jpg" srcset="https://cdn.pics.ng/', lid, '/s.jpg 320w, https://cdn.pics.ng/', lid, '/l.jpg 1280w">') ELSE '' END, '</body></html>') AS html
  FROM (SELECT k, lid, price, CASE WHEN k % 4 = 0 THEN concat('https://www.nigeriapropertycentre.com/for-rent/short-let/', CASE k % 5 WHEN 0 THEN 'lagos' WHEN 1 THEN 'abuja' WHEN 2 THEN 'oyo' WHEN 3 THEN 'imo' ELSE 'akwa-ibom' END, '/',
      CASE k % 3 WHEN 0 THEN 'victoria-island' WHEN 1 THEN 'ajah' ELSE 'lekki' END, '/bright-place-', CAST(1000000 + k AS STRING), CASE WHEN k % 8 = 0 THEN '?x=1' ELSE '' END)
    WHEN k % 4 = 1 THEN concat('https://propertypro.ng/property/nice-place-', lid) WHEN k % 4 = 2 THEN concat('https://www.jiji.ng/lekki/houses/', lid, '.html')
    WHEN k % 8 = 3 THEN 'https://www.nigeriapropertycentre.com/for-rent/short-let/lagos' ELSE 'https://elsewhere.com/x' END AS url
    FROM (SELECT p_partkey AS k, concat(CAST(50 + p_partkey % 100 AS STRING), ',', lpad(CAST((p_partkey * 100) % 1000 AS STRING), 3, '0')) AS price,
      CASE p_partkey % 4 WHEN 0 THEN CAST(CASE WHEN p_partkey % 12 = 4 THEN 2000000 ELSE 1000000 END + p_partkey AS STRING) WHEN 1 THEN concat('A', lpad(CAST(p_partkey AS STRING), 7, '0')) ELSE concat('zq', lpad(CAST(p_partkey AS STRING), 6, '0')) END AS lid FROM {part}))""",
    "fx_operator_rows": """SELECT p_partkey AS seq, concat('k', CAST(p_partkey % 301 AS STRING)) AS operator_key, CASE WHEN p_partkey % 11 <> 0 THEN concat('Name ', CAST(p_partkey % 70 AS STRING)) END AS display_name,
  CASE WHEN p_partkey % 3 <> 0 THEN concat('+234', CAST(p_partkey AS STRING)) END AS phone, CASE WHEN p_partkey % 4 = 1 THEN concat('a', CAST(p_partkey AS STRING), '@op.ng') END AS email,
  CASE WHEN p_partkey % 5 < 2 THEN concat('https://op', CAST(p_partkey AS STRING), '.ng') END AS website, CASE WHEN p_partkey % 7 = 0 THEN concat('stay_', CAST(p_partkey AS STRING)) END AS instagram,
  CASE p_partkey % 5 WHEN 0 THEN 'LA' WHEN 1 THEN 'FC' WHEN 2 THEN 'OY' WHEN 3 THEN 'IM' ELSE 'AK' END AS state, p_size AS size FROM {part}""",
    "fx_probes": """SELECT concat('site', CAST(c_custkey AS STRING)) AS key, c_custkey AS n, CASE WHEN c_custkey % 8 < 6 THEN CAST(c_custkey % 8 AS DOUBLE) END AS crawl_delay, CASE WHEN c_custkey % 9 = 0 THEN 'missing' ELSE 'found' END AS robots,
  CASE c_custkey % 3 WHEN 0 THEN 'DISCOVERY' WHEN 1 THEN 'SUPPLY' END AS layer, CASE c_custkey % 5 WHEN 0 THEN 'REVIEW_REQUIRED' WHEN 4 THEN NULL ELSE 'PERMITTED' END AS terms_status FROM {customer}""",
    "fx_channels": """SELECT o_orderkey AS channel_id, CASE o_orderkey % 5 WHEN 0 THEN 'PARTNER_API' WHEN 1 THEN 'ICAL_FEED' WHEN 2 THEN 'PARTNER_DASHBOARD' WHEN 3 THEN 'AFFILIATE_PROGRAM' ELSE 'SCRAPED' END AS kind,
  CASE o_custkey % 6 WHEN 0 THEN 'API_CREDENTIALS_ISSUED' WHEN 1 THEN 'PARTNER_PUBLISHED_FEED' WHEN 2 THEN 'AFFILIATE_PROGRAM_TERMS' WHEN 3 THEN NULL ELSE 'SIGNED_SUPPLY_AGREEMENT' END AS basis,
  o_custkey AS partner_id, CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN o_custkey + 1 ELSE o_custkey END AS owner_id, CASE WHEN o_orderkey % 11 = 0 THEN ' ' ELSE 'ref' END AS reference,
  CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderdate AS TIMESTAMP) END AS expires_at FROM {orders}""",
    "fx_assets": """SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS id, l_suppkey + CASE WHEN l_orderkey % 37 = 0 THEN 1000000000 ELSE 0 END AS partner_id, l_partkey + CASE WHEN l_orderkey % 29 = 0 THEN 1000000000 ELSE 0 END AS unit_external_id,
  l_linenumber AS position, CASE WHEN l_orderkey % 19 = 0 THEN '' ELSE 'ref' END AS licence_ref, CASE WHEN l_returnflag = 'A' THEN 'LICENSED_FEED' ELSE 'PARTNER_SUPPLIED' END AS licence,
  CASE WHEN l_orderkey % 2 = 0 THEN CAST(l_shipdate AS TIMESTAMP) END AS licence_expires_at, CAST(l_quantity AS INT) % 5 AS files FROM {lineitem}""",
    "fx_photos": """SELECT l_partkey AS listing_id, concat('https://cdn.ng/', CAST(l_orderkey AS STRING), '/', CAST(l_linenumber AS STRING), '.jpg') AS url, l_orderkey * 10 + l_linenumber AS pos,
  CASE WHEN l_orderkey % 17 = 0 THEN 0.0 ELSE l_quantity END AS whole_spread, CAST(l_orderkey % 40 AS DOUBLE) AS centre_spread, CASE WHEN l_orderkey % 4 = 0 THEN CAST(l_orderkey % 10 AS DOUBLE) / 10 END AS model_score,
  CASE WHEN l_orderkey % 23 = 0 THEN NULL ELSE l_orderkey % 29 <> 0 END AS decoded FROM {lineitem}""",
    "fx_outcomes": """SELECT concat('site', CAST(o_custkey % 40 AS STRING)) AS source, o_custkey % 8 = 1 OR o_orderkey % 50 = 0 AS error, o_custkey % 8 NOT IN (1, 2) AS found, o_custkey % 8 NOT IN (1, 2, 3) AS loaded,
  o_custkey % 8 NOT IN (1, 2, 3, 4) AS parsed, o_custkey % 8 <> 5 AS has_rate, o_orderkey % 2 = 0 AS has_contact FROM {orders}""",
    "fx_feed": """SELECT p_partkey AS seq, CASE WHEN p_partkey % 31 <> 0 THEN concat('p', CAST(p_partkey AS STRING)) END AS id, lower(p_brand) AS source, concat('https://feed.ng/', CAST(p_partkey AS STRING)) AS source_url,
  CASE WHEN p_partkey % 13 = 0 THEN ' ' ELSE 'by the partner' END AS attribution, CASE WHEN p_partkey % 17 <> 0 THEN 'partner' END AS affiliate_partner, CASE WHEN p_partkey % 19 <> 0 THEN 'we earn' END AS affiliate_disclosure,
  CASE WHEN p_partkey % 21 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN 'ftp://partner.ng/x' ELSE concat('https://partner.ng/', CAST(p_partkey AS STRING)) END AS affiliate_url, DATE '2024-01-01' AS first_seen_at,
  CASE WHEN p_partkey % 37 <> 0 THEN DATE '2024-01-30' END AS last_seen_at, CASE WHEN p_partkey % 3 = 0 THEN 'DIRECTORY' ELSE 'AFFILIATE' END AS listed_as FROM {part}""",
    "fx_charges": """SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS nightly_rate_kobo, CAST(l_quantity AS INT) % 14 + 1 AS nights,
  CASE l_suppkey % 5 WHEN 0 THEN 'LA' WHEN 1 THEN 'FC' WHEN 2 THEN 'OY' WHEN 3 THEN 'IM' ELSE 'AK' END AS state FROM {lineitem}""",
}
_TABLES = ["events", "part", "supplier", "customer", "orders", "lineitem"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, dealt: bool = False) -> DataFrame:
    """dealt: the tables' rows are dealt to all cores first, for a view whose rows are much work or much wider than theirs."""
    text = VIEWS[name]
    tables = {t: table(spark, sf_dir, t) for t in _TABLES if f"{{{t}}}" in text}
    return spark.sql(text, **{t: rows.repartition(spark.sparkContext.defaultParallelism) if dealt else rows for t, rows in tables.items()})


def with_views(sql: str) -> str:
    """A DuckDB query over the views that it names."""
    named = [v for v in VIEWS if v in sql]
    parts = ", ".join(f"{v} AS ({VIEWS[v]})" for v in named).replace("{", "").replace("}", "")
    body = sql.strip()
    if body.upper().startswith("WITH "):
        recursive = body.upper().startswith("WITH RECURSIVE ")
        body = body[len("WITH RECURSIVE ") if recursive else len("WITH ") :]
        return f"WITH {'RECURSIVE ' if recursive else ''}{parts}, {body}" if parts else sql
    return f"WITH {parts} {body}" if parts else sql
