"""Word lists, codes, tables and bounds that decide results. Kept as plain data, in natural order."""

# Words that say nothing about which operator a name means.
LEGAL_SUFFIXES = [
    "limited", "ltd", "enterprises", "enterprise", "ventures", "venture", "nigeria", "nig", "and sons", "sons", "integrated",
    "services", "company", "co", "global", "group",
]

# First four digits of national mobile numbers.
MOBILE_PREFIXES = [
    "0703", "0704", "0705", "0706", "0707", "0708", "0709",
    "0802", "0803", "0804", "0805", "0806", "0807", "0808", "0809",
    "0810", "0811", "0812", "0813", "0814", "0815", "0816", "0817", "0818", "0819",
    "0902", "0903", "0904", "0905", "0906", "0907", "0908", "0909",
    "0912", "0913", "0915", "0916",
]

# Canonical area names and their spellings; the order decides which prefix wins.
AREA_ALIASES = [
    ("Lekki Phase 1", ["lekki", "lekki phase 1", "lekki phase1", "lekki 1", "lekki p1", "lekki i"]),
    ("Lekki Phase 2", ["lekki phase 2", "lekki phase2", "lekki 2", "lekki p2", "lekki ii"]),
    ("Victoria Island", ["victoria island", "victoria island vi", "vi", "v i", "victoria isl"]),
    ("Ikoyi", ["ikoyi", "ikoyi lagos"]),
    ("Ajah", ["ajah", "ajah lagos"]),
    ("Ikeja GRA", ["ikeja gra", "ikeja g r a", "gra ikeja"]),
    ("Ikeja", ["ikeja"]),
    ("Yaba", ["yaba"]),
    ("Surulere", ["surulere", "surulere lagos"]),
    ("Gbagada", ["gbagada"]),
    ("Magodo", ["magodo", "magodo gra", "magodo phase 1", "magodo phase 2"]),
    ("Ogudu", ["ogudu", "ogudu gra"]),
    ("Maryland", ["maryland", "maryland lagos"]),
    ("Lagos Island", ["lagos island"]),
    ("Eko Atlantic City", ["eko atlantic", "eko atlantic city"]),
    ("Maitama", ["maitama"]),
    ("Asokoro", ["asokoro"]),
    ("Wuse 2", ["wuse 2", "wuse ii", "wuse2"]),
    ("Wuse", ["wuse"]),
    ("Garki", ["garki"]),
    ("Gwarinpa", ["gwarinpa", "gwarimpa"]),
    ("Jabi", ["jabi", "jabi abuja"]),
    ("Lugbe", ["lugbe"]),
    ("Guzape", ["guzape"]),
    ("Katampe Extension", ["katampe", "katampe extension"]),
    ("Bodija", ["bodija", "bodija ibadan"]),
    ("Jericho", ["jericho", "jericho ibadan"]),
    ("Ring Road", ["ring road", "ringroad", "ring road ibadan"]),
    ("Dugbe", ["dugbe"]),
    ("Oluyole Estate", ["oluyole", "oluyole estate"]),
    ("New Owerri", ["new owerri"]),
    ("Aladinma", ["aladinma"]),
    ("Ikenegbu", ["ikenegbu"]),
    ("GRA Owerri", ["gra owerri", "owerri gra"]),
    ("Ewet Housing Estate", ["ewet housing", "ewet housing estate", "ewet"]),
    ("Shelter Afrique", ["shelter afrique"]),
    ("Osongama", ["osongama"]),
    ("Oron Road", ["oron road"]),
]

CITY_BY_STATE = {"LA": "Lagos", "FC": "Abuja", "OY": "Ibadan", "IM": "Owerri", "AK": "Uyo"}
STATE_NAMES = {"LA": "Lagos", "FC": "FCT Abuja", "OY": "Oyo", "IM": "Imo", "AK": "Akwa Ibom"}
STATE_SLUGS = {"LA": ["lagos"], "FC": ["abuja"], "OY": ["oyo", "ibadan"], "IM": ["imo", "owerri"], "AK": ["akwa-ibom", "uyo"]}

# (area, latitude, longitude)
AREA_CENTROIDS = [
    ("Lekki Phase 1", 6.4418, 3.474), ("Lekki Phase 2", 6.4478, 3.5286), ("Ikoyi", 6.4541, 3.4348), ("Victoria Island", 6.4281, 3.4219),
    ("Oniru", 6.4321, 3.4599), ("Ajah", 6.4667, 3.5667), ("Ikate", 6.4399, 3.4906), ("Ikeja GRA", 6.5833, 3.35), ("Yaba", 6.5095, 3.3711),
    ("Surulere", 6.4998, 3.3526), ("Gbagada", 6.5556, 3.3886), ("Magodo", 6.6217, 3.3733), ("Ogudu", 6.5817, 3.3867), ("Festac", 6.4667, 3.2833),
    ("Maitama", 9.0833, 7.4951), ("Asokoro", 9.0422, 7.5242), ("Wuse 2", 9.0736, 7.4764), ("Garki", 9.0333, 7.4833), ("Gwarinpa", 9.1092, 7.4022),
    ("Jabi", 9.0705, 7.4373), ("Katampe Extension", 9.0983, 7.4719), ("Lugbe", 8.9667, 7.3667), ("Guzape", 9.0558, 7.5086), ("Karsana", 9.0583, 7.3667),
    ("Bodija", 7.4206, 3.909), ("Jericho", 7.3915, 3.8714), ("Ring Road", 7.3572, 3.8772), ("Dugbe", 7.3872, 3.8842), ("Akobo", 7.4444, 3.8833),
    ("Oluyole Estate", 7.3392, 3.8558), ("Agodi", 7.4019, 3.9019), ("New Owerri", 5.4667, 7.0333), ("Aladinma", 5.4833, 7.0167), ("Ikenegbu", 5.4931, 7.0253),
    ("GRA Owerri", 5.4786, 7.0289), ("MCC Road", 5.4725, 7.0403), ("Orji", 5.4967, 7.0617), ("Ewet Housing Estate", 5.0167, 7.9167),
    ("Shelter Afrique", 5.05, 7.9333), ("Osongama", 5.0333, 7.9), ("Oron Road", 5.0236, 7.9514), ("Itam", 5.0261, 7.88), ("Ibesikpo", 5.0, 7.95),
]

# (id, least, most) in kobo; both ends belong to a band, so a shared end belongs to two.
PRICE_BANDS = [
    ("under-50k", 0, 5_000_000),
    ("50-100k", 5_000_000, 10_000_000),
    ("100-200k", 10_000_000, 20_000_000),
    ("200-400k", 20_000_000, 40_000_000),
    ("above-400k", 40_000_000, None),
]

# (id, scope, subject, rate bps, least fee, greatest fee, VAT bps, rounding step, least fee a night)
FEE_POLICIES = [
    ("global-default", "GLOBAL", None, 1_000, 200_000, 4_000_000, 750, 5_000, None),
    ("state-la", "STATE", "LA", 1_200, 300_000, 8_000_000, 750, 5_000, 100_000),
    ("state-fc", "STATE", "FC", 1_200, 300_000, 8_000_000, 750, 5_000, None),
    ("state-oy", "STATE", "OY", 900, 150_000, 3_000_000, 750, 5_000, None),
    ("state-im", "STATE", "IM", 900, 150_000, 3_000_000, 750, 5_000, None),
    ("state-ak", "STATE", "AK", 900, 150_000, 3_000_000, 750, 5_000, None),
]

# Allowed next states of a booking; states not named on the left are final.
BOOKING_TRANSITIONS = {
    "DRAFT": ["HELD", "CANCELLED"],
    "HELD": ["AWAITING_PAYMENT", "EXPIRED", "CANCELLED"],
    "AWAITING_PAYMENT": ["CONFIRMED", "FAILED", "EXPIRED", "CANCELLED"],
    "CONFIRMED": ["COMPLETED", "CANCELLED", "REFUNDED", "PARTIALLY_REFUNDED"],
}
OCCUPYING_STATUSES = ["HELD", "AWAITING_PAYMENT", "CONFIRMED", "COMPLETED"]

# Bounds of a believable nightly price, in naira.
LEAST_NAIRA, MOST_NAIRA = 1_000, 20_000_000

# (needle, type): the first needle found decides.
PROPERTY_TYPES = [
    ("short let", "SHORTLET"), ("shortlet", "SHORTLET"), ("flat", "APARTMENT"), ("apartment", "APARTMENT"), ("studio", "STUDIO"), ("duplex", "HOUSE"),
    ("bungalow", "HOUSE"), ("house", "HOUSE"), ("terrace", "HOUSE"), ("penthouse", "APARTMENT"), ("hostel", "HOSTEL"), ("hotel", "HOTEL"), ("room", "ROOM"), ("villa", "VILLA"),
]

# (pattern on lower-case text, title document): the first that matches decides.
TITLE_PATTERNS = [
    (r"certificate of occupancy", "C_OF_O"),
    (r"\bc\s*of\s*o\b", "C_OF_O"),
    (r"governor'?s consent", "GOVERNORS_CONSENT"),
    (r"deed of assignment", "DEED_OF_ASSIGNMENT"),
    (r"excision|gazette", "EXCISION_GAZETTE"),
    (r"right of occupancy", "RIGHT_OF_OCCUPANCY"),
    (r"freehold", "FREEHOLD"),
    (r"registered deed", "REGISTERED_DEED"),
]

# (pattern, price basis): the first that matches decides.
PRICE_BASIS_PATTERNS = [
    (r"per\s+person\s+per\s+night|per\s+person\s*/?\s*night", "PER_PERSON_NIGHT"),
    (r"per\s+night|nightly|a\s+night|/\s*night", "PER_NIGHT"),
    (r"per\s+day|daily|a\s+day|/\s*day", "PER_NIGHT"),
    (r"per\s+week|weekly", "PER_WEEK"),
    (r"per\s+month|monthly|per\s+calendar\s+month|p\.?c\.?m\.?", "PER_MONTH"),
    (r"per\s+annum|per\s+year|yearly|annually|p\.?a\.\b", "PER_YEAR"),
    (r"per\s+stay|for\s+the\s+stay", "PER_STAY"),
]
PRICE_BASES = ["PER_NIGHT", "PER_WEEK", "PER_MONTH", "PER_YEAR", "PER_STAY", "PER_PERSON_NIGHT", "UNKNOWN"]
PRICE_BASIS_WINDOW = 60

# (part of a page or host, booking system): the first found decides.
BOOKING_SYSTEMS = [
    ("smoobu.com", "smoobu"), ("beds24.com", "beds24"), ("hostaway.com", "hostaway"), ("lodgify.com", "lodgify"), ("guesty.com", "guesty"),
    ("cloudbeds.com", "cloudbeds"), ("littlehotelier.com", "littlehotelier"), ("hotelrunner.com", "hotelrunner"), ("resavenue.com", "resavenue"),
    ("ical.airbnb", "airbnb_ical"), ("airbnb.com/calendar", "airbnb_ical"), ("booking.com/hotel", "booking_com"), ("agoda.com", "agoda"), ("reservations.com", "reservations"),
]

# Registrable domains that never are an operator's own.
NON_OPERATOR_HOSTS = [
    "nigeriapropertycentre.com", "kenyapropertycentre.com", "propertypro.ng", "jiji.ng", "facebook.com", "twitter.com", "x.com", "linkedin.com", "youtube.com",
    "whatsapp.com", "wa.me", "instagram.com", "apple.com", "google.com", "googleapis.com", "gstatic.com", "cloudflare.com", "cloudfront.net", "amazonaws.com",
    "jsdelivr.net", "unpkg.com", "bootstrapcdn.com", "fontawesome.com", "jquery.com", "w3.org", "googletagmanager.com", "google-analytics.com", "doubleclick.net",
    "sentry.io", "hotjar.com", "mixpanel.com", "segment.com", "tawk.to", "livechatinc.com", "intercom.com", "zendesk.com", "gravatar.com",
]
PORTAL_HOST = "propertycent(?:re|er)"

ASSET_EXTENSIONS = [
    ".css", ".js", ".mjs", ".json", ".map", ".xml", ".ics", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".ico", ".avif", ".woff", ".woff2", ".ttf", ".otf", ".eot", ".pdf", ".zip",
]

GENERIC_OPERATOR_LABELS = [
    "agent", "agents", "estate agent", "property", "properties", "contact", "contact agent", "view agent", "company", "owner", "advertiser", "verified", "premium",
]
PROPERTY_WORDS = r"(?i)\b(bedroom|bathroom|duplex|bungalow|terrace|apartment|flat|penthouse|shortlet|short let|for rent|for sale|per night|per day|sqm|plot)\b"
DOMAIN_SUFFIXES = [".ng", ".com", ".com.ng", ".org", ".net", ".africa"]

PUBLISHABLE_FIELDS = [
    "operator_name", "phone", "email", "website", "instagram", "pms_detected", "property_type", "bedrooms", "bathrooms", "state", "city", "area",
    "advertised_price", "currency", "source", "source_url", "first_seen_at", "last_seen_at", "media", "media_count", "cover_image_url",
    "id", "distribution", "attribution", "contact_route", "affiliate_partner", "affiliate_url", "affiliate_disclosure",
]
NEVER_PUBLISHED = ["property_name", "title_document", "source_listing_id", "booking_url", "availability_hint_url"]

TIER_ONE_STATES = ["LA", "FC"]
RETENTION_DAYS = 365
DELIST_GRACE_DAYS = 7
HOLD_MINUTES = 15
UNIT_DEFAULTS = {"max_guests": 4, "min_nights": 1, "max_nights": 90, "placeholder_rate_kobo": 100_000}
