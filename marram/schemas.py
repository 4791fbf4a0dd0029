"""Schemas, as DDL, of the tables that the operators take."""

LISTING = (
    "seq long, source string, source_url string, source_listing_id string, property_name string, property_type string, bedrooms int, bathrooms int, "
    "advertised_price long, currency string, state string, city string, area string, operator_name string, operator_hint string, phone string, email string, "
    "website string, instagram string, pms_detected string, booking_url string, availability_hint_url string, price_basis string, title_document string, "
    "media array<string>, cover_image_url string"
)
OBSERVATION = "source string, source_listing_id string, observed_on date, advertised_price long, currency string, bedrooms int, area string, seq long"
PLACE = (
    "id string, distribution string, operator_name string, phone string, email string, website string, instagram string, pms_detected string, property_type string, "
    "bedrooms int, bathrooms int, state string, city string, area string, advertised_price long, currency string, source string, source_url string, attribution string, "
    "first_seen_at date, last_seen_at date, contact_route struct<kind: string, href: string>, affiliate_partner string, affiliate_url string, affiliate_disclosure string, "
    "media array<string>, media_count int, cover_image_url string"
)
NIGHT = "unit_id string, night date, state string, nightly_rate_kobo long, source string"
FEE_POLICY = "id string, scope string, subject_id string, rate_bps int, min_fee_kobo long, max_fee_kobo long, vat_rate_bps int, rounding_step_kobo long, min_nightly_fee_kobo long"
REGISTRY = (
    "key string, host string, displayName string, layer string, accessMethod string, termsStatus string, "
    "robots struct<fetch: string, url: string, sitemaps: array<string>, disallowCount: int, disallowSamples: array<string>, crawlDelay: double, notes: string>, "
    "reviewedBy string, lastReviewedAt string, blockedReason string"
)


def names(ddl: str) -> list[str]:
    """Top-level column names of a DDL string."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(ddl + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(ddl[at:i].split()[0].rstrip(":"))
            at = i + 1
    return out
