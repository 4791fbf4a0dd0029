"""Data-quality and inventory reports: each one aggregate pass over its table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marram.functions.money import round_half_up

# Place names that are no listing ids, and URLs of list pages.
PLACE_NAMES = ["lagos", "abuja", "oyo", "imo", "akwa-ibom", "lekki", "ikeja", "ikoyi", "ajah", "lagos-island"]
LIST_PAGE_URLS = [r"\?(page|type|state|area|min_price|max_price|sort|limit)=", "/property-for-short-let/in/", "/for-rent/short-let/[a-z-]+$"]
LIST_PAGE_LIMIT = 25
#: Outcomes that get a column each; with more it is an error.
MAX_OUTCOMES = 1_000


def table_counts(**tables: DataFrame) -> DataFrame:
    """(table_name, row_count) of each table."""
    parts = [df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count") for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def distinct_sources(listings: DataFrame) -> DataFrame:
    return listings.agg(F.count("*").alias("listings"), F.count_distinct("source").alias("sources"))


def crawl_stats(events: DataFrame, state_col: str = "state", outcome_col: str = "outcome", outcomes: list[str] | None = None) -> DataFrame:
    """Counts of each outcome by state and, with a null state, in total; a null outcome counts among the URLs alone."""
    if outcomes is None:
        outcomes = sorted(r[0] for r in events.select(outcome_col).where(F.col(outcome_col).isNotNull()).distinct().limit(MAX_OUTCOMES + 1).collect())
        if len(outcomes) > MAX_OUTCOMES:
            raise ValueError(f"more than {MAX_OUTCOMES} outcomes: name those to count")
    return events.rollup(state_col).agg(F.count("*").alias("urls"), *[F.count_if(F.col(outcome_col) == o).alias(o) for o in outcomes])


def geocode_quality(geocodes: DataFrame) -> DataFrame:
    return geocodes.groupBy("provider", "precision", "review_status").agg(
        F.count("*").alias("records"), round_half_up(F.avg("confidence_bps")).alias("avg_confidence_bps"), F.count_if(F.col("confidence_bps").isNull()).alias("without_confidence")
    )


def price_by_basis(listings: DataFrame) -> DataFrame:
    """Count, least and greatest price of each basis; bases are never mixed."""
    basis = F.upper(F.trim(F.coalesce("price_basis", F.lit("UNKNOWN"))))
    return listings.groupBy(basis.alias("price_basis")).agg(F.count("*").alias("listings"), F.min("advertised_price").alias("min_kobo"), F.max("advertised_price").alias("max_kobo"))


def freshness(observations: DataFrame) -> DataFrame:
    return observations.groupBy("source").agg(
        F.count("*").alias("observations"), F.min("observed_on").alias("first_seen"), F.max("observed_on").alias("last_seen"), F.count_distinct("observed_on").alias("distinct_days")
    )


def area_spread(listings: DataFrame, located: Column) -> DataFrame:
    return listings.groupBy("state", "area").agg(F.count("*").alias("listings"), F.count_if(located).alias("located"))


def duplicates(df: DataFrame, keys: list[Column | str], name: str) -> DataFrame:
    """(check_name, duplicates): how many keys occur more than once."""
    groups = df.groupBy(*keys).count().where("count > 1")
    return groups.agg(F.count("*").alias("duplicates")).select(F.lit(name).alias("check_name"), "duplicates")


def duplicate_report(listings: DataFrame, observations: DataFrame, prices: DataFrame, geocodes: DataFrame | None = None) -> DataFrame:
    out = duplicates(listings, ["source", "source_listing_id"], "listings").union(duplicates(observations, ["source", "source_listing_id", "observed_on"], "observations")).union(duplicates(prices, ["source", "source_listing_id", "observed_on"], "prices"))
    if geocodes is not None:
        subject = F.coalesce("source_listing_id", "location_id", "property_id")
        out = out.union(duplicates(geocodes, ["subject", subject.alias("subject_id"), "provider"], "geocodes"))
    return out


def junk_ids(listings: DataFrame) -> DataFrame:
    """Listing ids of neither five digits in a row nor five to eight letters and digits, with how often each comes."""
    lid = F.col("source_listing_id")
    odd = ~lid.rlike("[0-9]{5,}") & ~lid.rlike("^[A-Za-z0-9]{5,8}$")
    return listings.where(odd).groupBy("source", "source_listing_id").agg(F.count("*").alias("affected_rows"))


def place_name_ids(listings: DataFrame) -> DataFrame:
    return listings.where(F.lower("source_listing_id").isin(PLACE_NAMES)).select("source", "source_listing_id", "source_url")


def list_page_urls(listings: DataFrame, limit: int | None = LIST_PAGE_LIMIT) -> DataFrame:
    """Listings whose URL is a list page's; the report shows the first `limit` by URL."""
    found = listings.where(F.col("source_url").rlike("|".join(LIST_PAGE_URLS))).select("source", "source_listing_id", "source_url")
    return found if limit is None else found.orderBy("source_url", "source", "source_listing_id").limit(limit)


def reused_urls(listings: DataFrame) -> DataFrame:
    return listings.groupBy("source", "source_url").agg(F.count("*").alias("rows_for_one_url")).where("rows_for_one_url > 1")


def distinctness(listings: DataFrame, id_col: str = "source_listing_id", url_col: str = "source_url") -> DataFrame:
    one = listings.agg(F.count("*").alias("listings"), F.count_distinct(id_col).alias("distinct_ids"), F.count_distinct(url_col).alias("distinct_urls"))
    return one.withColumns({"id_collisions": F.col("listings") - F.col("distinct_ids"), "url_collisions": F.col("listings") - F.col("distinct_urls")})


def parity_check(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one of two tables has, with its name: both directions, no rows if they agree. Nulls are equal."""
    x, y = a.select(*keys), b.select(*keys)
    return x.subtract(y).withColumn("only_in", F.lit("a")).union(y.subtract(x).withColumn("only_in", F.lit("b")))


def directory_counts(places: DataFrame) -> DataFrame:
    return places.agg(F.count("*").alias("places"), F.count_if(F.col("contact_route.kind") != "NONE").alias("contactable"), F.count_if(F.size("media") > 0).alias("with_photographs"))


def places_by_state(places: DataFrame) -> DataFrame:
    """One row: places in LA, in FC and elsewhere."""
    s = F.col("state")
    return places.agg(F.count_if(s == "LA").alias("la"), F.count_if(s == "FC").alias("fc"), F.count_if(F.coalesce(~s.isin("LA", "FC"), F.lit(True))).alias("other"))


def city_counts(cities: DataFrame, places: DataFrame) -> DataFrame:
    """cities (state) with the number of their places, 0 for none, and whether it is real."""
    counts = places.groupBy("state").agg(F.count("*").alias("n"))
    return cities.join(counts, "state", "left").withColumns({"places": F.coalesce("n", F.lit(0)), "count_is_real": F.col("n").isNotNull()}).drop("n")


def operator_count(results: DataFrame, partner_col: str = "partner_id") -> DataFrame:
    return results.agg(F.count_distinct(partner_col).alias("operators"))


def source_health(outcomes: DataFrame) -> DataFrame:
    """(source, …counts, health) from rows (source, error, listings, loaded, with_rate, with_contact): the first that holds of
    ERROR, NO LISTINGS, WOULD NOT LOAD, WENT NOWHERE, NOT ACTIONABLE, else OK. Usable: a rate and a way to make contact."""
    by = outcomes.groupBy("source").agg(
        F.count_if("error").alias("errors"), F.count_if("found").alias("found"), F.count_if("loaded").alias("loaded"), F.count_if("parsed").alias("parsed"), F.count_if(F.col("has_rate") & F.col("has_contact")).alias("usable")
    )
    health = F.when((F.col("errors") > 0) & (F.col("found") == 0), "ERROR").when(F.col("found") == 0, "NO LISTINGS").when(F.col("loaded") == 0, "WOULD NOT LOAD").when(F.col("parsed") == 0, "WENT NOWHERE").when(F.col("usable") == 0, "NOT ACTIONABLE").otherwise("OK")
    return by.withColumn("health", health)


def marketplace_metrics(bookings: DataFrame, nights_open: DataFrame) -> DataFrame:
    """One row of ratios: fill rate of open nights, paid bookings of checkouts, cancelled of paid, and take rate."""
    paid = F.col("status").isin("CONFIRMED", "COMPLETED", "REFUNDED", "PARTIALLY_REFUNDED")
    b = bookings.agg(
        F.sum(F.when(paid, F.col("nights"))).alias("sold"), F.count_if(paid).alias("paid"), F.count_if(F.col("status") != "DRAFT").alias("checkouts"), F.count_if(F.col("status") == "CANCELLED").alias("cancelled"),
        F.sum(F.when(paid, F.col("platform_net_kobo"))).alias("platform"), F.sum(F.when(paid, F.col("total_kobo"))).alias("turnover"),
    )
    n = nights_open.agg(F.count("*").alias("open_nights"))
    ratio = lambda a, c: F.col(a) / F.nullif(F.col(c), F.lit(0))
    return b.crossJoin(n).select(ratio("sold", "open_nights").alias("fill_rate"), ratio("paid", "checkouts").alias("paid_rate"), ratio("cancelled", "checkouts").alias("cancel_rate"), ratio("platform", "turnover").alias("take_rate"))
