"""Listing facts from page bodies, as columns: regular expressions and JSON functions that run in the JVM.

`extract_listings` joins pages to a small table of rules by host and builds one row of facts for each page that is a
listing's. Patterns are bounded so that a large page costs time in proportion to its size."""

from __future__ import annotations

import html as _html
import html.entities as _entities
import json
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marram.functions.constants import (
    ASSET_EXTENSIONS, BOOKING_SYSTEMS, DOMAIN_SUFFIXES, GENERIC_OPERATOR_LABELS, LEAST_NAIRA, MOST_NAIRA, PRICE_BASIS_PATTERNS, PRICE_BASIS_WINDOW, PROPERTY_TYPES, PROPERTY_WORDS, STATE_SLUGS, TITLE_PATTERNS,
)
from marram.functions.text import blank_to_null, canonical_area, city_for_state, col, first_match, let, title_case
from marram.functions.web import authority, is_non_operator_host, registrable_domain, url_path

#: The most frequent named references, tried before the whole table of the HTML standard.
COMMON_REFERENCES = ("amp", "nbsp", "lt", "gt", "quot")
# Patterns of the facts in a page.
PRICE = r"(?i)(?:₦|&#8358;|NGN|N)\s?([\d][\d,\.]{2,})"
BEDROOMS = r"(?i)\b(\d+)\s*(?:bedroom|bedrooms|bed|br)\b"
BATHROOMS = r"(?i)\b(\d+)\s*(?:bathroom|bathrooms|bath)\b"
HEADING = r"(?is)<h1[^>]*>(.*?)</h1>"
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
OG_TITLE = r"""(?i)property=["']og:title["'][^>]*content=["']([^"']+)"""
OG_URL = r"""(?i)property=["']og:url["'][^>]*content=["']([^"']+)"""
CANONICAL = r"""(?i)<link[^>]+rel=["']canonical["'][^>]+href=["']([^"']+)"""
JSON_LD = r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
TEL = r'(?i)href="tel:([^"]+)"'
MAILTO = r'(?i)href="mailto:([^"?]+)'
WHATSAPP = r"(?i)(?:wa\.me/?|api\.whatsapp\.com/send\?phone=)(\+?\d{7,15})"
INSTAGRAM = r"(?i)instagram\.com/([A-Za-z0-9_.]{2,30})"
BUSINESS_MAIL = r"(?i)^[a-z0-9._%+-]+@(?![a-z0-9.-]*\.(?:gmail|yahoo|hotmail|outlook|icloud)\.)"
BUSINESS_NAME = r"^[A-Za-z0-9&'.,\- ]{3,60}$"
CALENDAR = r'(?i)href="([^"]+\.ics[^"]*)"'
AVAILABILITY = r'(?i)href="([^"]*(?:availab|booking|book-now|reserve|check-?in)[^"]*)"'
REGION_LINK = r'(?i)<a href="[^"]*region,[^"]+">([^<]+)</a>'
LABELLED_BLOCK = (
    r'(?is)<(?:div|span|p|a|h[2-4])[^>]+(?:class|id)="[^"]*(?:agent|agency|estate-?agent|company|developer|owner|advertiser|lister|provider|brand)'
    r'[^"]*"[^>]*>(.*?)</(?:div|span|p|a|h[2-4])>'
)
MEDIA_MARK = "about:blank#removed"
# Parts of URLs that tell chrome, branded and proxied images.
CHROME_IMAGES = (
    r"(?i)(?:logo|favicon|sprite|placeholder|blank\.|spacer|pixel|tracking|beacon|/static/|/assets/img/icon|/images/icon|/img/icon|/theme/|/skin/|avatar|/user/|/agent/|/icon|/icons/|1x1|2x2"
    r"|/profiles?/|/brand/|/partner-logos?/|/thumbs?/)"
)
IMAGE_EXTENSION = r"(?i)\.(?:jpe?g|png|gif|webp|avif|bmp|tiff?|heic)$"
WATERMARK_ASSET = r"(?i)(?:watermark|water-mark|wm_|_wm\.|_branded|branded\.|stamp\.|overlay-watermark)"
BRAND_TOKENS = ["npc", "nigeriapropertycentre", "nigeria-property-centre", "propertycentre", "propertypro", "propertypro.ng", "privateproperty", "jiji", "jiji.ng", "realestate", "nigeriaproperty"]
PROXIED_IMAGE = r"(?i)[?&](?:url|src|source|image|img|u|q)=|[?&]utm_|imgix|wsrv\.nl|images\.weserv"
STORAGE_HOST = r"(?i)(?:^|\.)(?:cloudinary\.com|imgix\.net|images\.unsplash\.com|storage\.googleapis\.com|s3\.amazonaws\.com|r2\.dev)$"
IMAGE_ATTRIBUTES = ["data-src", "data-lazy-src", "data-original", "data-image", "data-full-src", "data-hi-res-src", "src"]
GALLERY_LIMIT = 40

# (source, host, pattern of a listing's path, pattern whose first group is its id, whether a stated name is an identity)
SOURCE_RULES = [
    ("npc", "nigeriapropertycentre.com", r"/for-rent/short-let/.*\d{6,}", r"(?:^|[-/])(\d{6,})(?=[-/]|$)", True),
    ("propertypro", "propertypro.ng", r"^/property/[^/?]+-[A-Za-z0-9]{5,8}/?$", r"-([A-Za-z0-9]{5,8})/?$", True),
    ("apartments_ng", "apartments.com.ng", r"_\d+(?:/|$)", r"_(\d+)(?:/|$)", True),
    ("jiji", "jiji.ng", r"[A-Za-z0-9]{6,}\.html$", r"([A-Za-z0-9]{6,})\.html$", False),
    ("krent", "krent.ng", r"\d{5,}", r"(\d{5,})", True),
    ("gidistays", "gidistays.com", r"/[A-Za-z0-9-]{5,}/?$", r"([A-Za-z0-9]{5,})/?$", True),
    ("shortlethomes", "shortlethomes.com", r"/[A-Za-z0-9-]{5,}/?$", r"([A-Za-z0-9]{5,})/?$", True),
]


def source_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SOURCE_RULES, "source string, rule_host string, path_pattern string, id_pattern string, names_identify boolean")


def group(c: Column, pattern: str, n: int = 1) -> Column:
    """A group of the first match; null where nothing or an empty string matches."""
    return F.nullif(F.regexp_extract(c, pattern, n), F.lit(""))


def all_of(c: Column, pattern: str, n: int = 1) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(n))


def strip_media(html: Column | str) -> Column:
    """Without video, audio, objects and embeds; pictures unwrapped; inline images and tracks replaced by a mark. Images stay."""
    c = F.regexp_replace(col(html), r"(?is)<(video|audio|object|embed)\b[^>]*>.*?</\1\s*>", "")
    c = F.regexp_replace(c, r"(?i)<(?:video|audio|object|embed)\b[^>]*>", "")
    c = F.regexp_replace(c, r"(?i)</?picture\b[^>]*>", "")
    c = F.regexp_replace(c, r"(?i)<track\b[^>]*>", MEDIA_MARK)
    return F.regexp_replace(c, r"(?i)data:[a-z]+/[a-z0-9.+-]+;base64,[a-z0-9+/=]*", MEDIA_MARK)


@lru_cache
def _references() -> tuple[str, str, str, str]:
    """From the standard library's tables, as JSON: named references that end in `;`, those that may lack it, and what the
    numbers below 160 stand for; and a pattern of those that may lack it, the longest first."""
    names = _entities.html5
    opened = {n: t for n, t in names.items() if not n.endswith(";")}
    small = {str(n): _html.unescape(f"&#{n};") for n in range(160)}
    return json.dumps({n[:-1]: t for n, t in names.items() if n.endswith(";")}), json.dumps(opened), json.dumps(small), "^&(" + "|".join(sorted(opened, key=len, reverse=True)) + ")"


def unescape(c: Column, unclosed: bool = True) -> Column:
    """Character references decoded as HTML does: all named ones, some of them without `;`, and numbers. With unclosed=False
    what lacks its `;` stays as it is."""
    *tables, open_pattern = _references()
    closed, opened, small = (F.from_json(F.lit(t), "map<string,string>") for t in tables)
    end = ";?" if unclosed else ";"
    pattern = rf"(?s)&#[xX][0-9a-fA-F]+{end}|&#[0-9]+{end}|&[^\t\n\f <&#;]{{1,32}}{end}|[^&]+|&"

    def letter(n: Column) -> Column:
        none = n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(0xFFFE) == 0xFFFE)
        unknown = n.isNull() | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
        return F.when(unknown, "\uFFFD").when(n < 160, F.try_element_at(small, n.cast("string"))).when(none, "").otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))

    def number(p: Column) -> Column:
        digits = F.regexp_extract(p, r"^&#[xX]?0*([0-9a-fA-F]+)", 1)
        value = F.when(p.rlike("^&#[xX]"), F.conv(digits, 16, 10).try_cast("bigint")).otherwise(digits.try_cast("bigint"))
        return let(F.when(F.length(digits) <= 8, value), letter)

    def name(p: Column) -> Column:
        start = lambda s: F.concat(F.try_element_at(opened, F.nullif(s, F.lit(""))), F.substr(p, F.length(s) + 2))
        begun = [let(F.regexp_extract(p, open_pattern, 1), start)] if unclosed else []
        return F.coalesce(F.try_element_at(closed, F.nullif(F.regexp_extract(p, "^&(.*);$", 1), F.lit(""))), *begun, p)

    def one(p: Column) -> Column:
        out = F.when(~F.startswith(p, F.lit("&")) | (p == "&"), p)
        for n in COMMON_REFERENCES:
            out = out.when(p == f"&{n};", _entities.html5[f"{n};"])
        return out.when(F.startswith(p, F.lit("&#")), number(p)).otherwise(name(p))

    return let(c, lambda x: F.when(F.contains(x, F.lit("&")), F.array_join(F.transform(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), one), "")).otherwise(x))


def strip_tags(c: Column | str, unclosed: bool = True) -> Column:
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(F.coalesce(col(c), F.lit("")), "<[^>]+>", " "), unclosed), r"^\s+|\s+$", ""))


def json_ld_items(html: Column | str) -> Column:
    """The objects of all ld+json blocks in order, as JSON strings; malformed blocks left out, lists flattened."""
    blocks = all_of(col(html), JSON_LD)
    blocks = F.filter(F.transform(blocks, lambda b: F.regexp_replace(b, r"^\s+|\s+$", "")), lambda b: F.try_parse_json(b).isNotNull())
    return F.flatten(F.transform(blocks, lambda b: F.when(F.startswith(b, F.lit("[")), F.coalesce(F.from_json(b, "array<string>"), F.array().cast("array<string>"))).otherwise(F.array(b))))


def json_ld(items: Column | str, key: str, string: bool = True) -> Column:
    """The first value of a key among the objects; with string=True null unless it is a string."""
    path = f"$['{key}']"
    found = F.get(F.filter(F.transform(col(items), lambda b: F.get_json_object(b, path)), lambda v: v.isNotNull()), F.lit(0))
    return let(found, lambda v: F.when(~v.rlike(r"^\s*[\[{]") & ~v.rlike(r"^-?\d+(\.\d+)?$"), v)) if string else found


def property_name(html: Column | str, items: Column | str, unclosed: bool = True) -> Column:
    """og:title, else the JSON-LD name, else the first h1, else the title before `|`. unclosed: as in unescape."""
    html = col(html)
    return F.coalesce(
        F.trim(unescape(group(html, OG_TITLE), unclosed)),
        blank_to_null(json_ld(items, "name")),
        F.nullif(strip_tags(group(html, HEADING), unclosed), F.lit("")),
        blank_to_null(F.split_part(strip_tags(group(html, TITLE), unclosed), F.lit("|"), F.lit(1))),
    )


def property_type(plain: Column | str, items: Column | str) -> Column:
    """By the first needle in the JSON-LD type, category or property type, else in the page's text."""
    first = lambda c: let(F.lower(c), lambda t: first_match(t, PROPERTY_TYPES, lambda v, k: F.contains(v, F.lit(k))))
    return F.coalesce(*[first(json_ld(items, k)) for k in ("@type", "category", "propertyType")], first(col(plain)))


def title_document(plain: Column | str) -> Column:
    return let(F.lower(col(plain)), lambda t: first_match(t, TITLE_PATTERNS, lambda v, k: v.rlike(k)))


def parse_price_to_kobo(raw: Column | str) -> Column:
    """The digits of a price in naira, in kobo; null outside what is believable."""
    naira = F.nullif(F.regexp_replace(col(raw), r"[^0-9]", ""), F.lit("")).try_cast("bigint")
    return let(naira, lambda n: F.when(n.between(LEAST_NAIRA, MOST_NAIRA), n * 100))


def price_basis(window: Column | str) -> Column:
    return let(col(window), lambda w: first_match(w, [(f"(?i){p}", b) for p, b in PRICE_BASIS_PATTERNS], lambda v, k: v.rlike(k)))


def first_price(plain: Column | str) -> Column:
    """A struct of the first marked price in kobo and the basis stated within 60 characters after, else before it."""
    plain = col(plain)

    def around(m: Column) -> Column:
        after = F.substr(plain, m["at"] + F.length(m["text"]), F.lit(PRICE_BASIS_WINDOW))
        before = F.substr(plain, F.greatest(F.lit(1), m["at"] - PRICE_BASIS_WINDOW), F.least(F.lit(PRICE_BASIS_WINDOW), m["at"] - 1))
        return F.struct(parse_price_to_kobo(m["text"]).alias("kobo"), F.coalesce(price_basis(after), price_basis(before)).alias("basis"))

    located = lambda text: F.struct(text.alias("text"), F.call_function("instr", plain, text).alias("at"))
    return let(let(group(plain, PRICE, 0), located), around)


def best_price(plain: Column | str, items: Column | str) -> Column:
    """Of all marked prices the first with a unit behind it (`/night`, `per month`), else the first, else the JSON-LD offer."""
    pattern = r"(?i)(?:₦{1,2}|NGN)\s?[\d][\d,\.]{2,}\s*(?:(?:/\s*|per\s+)[a-z]+)?"
    found = F.transform(all_of(col(plain), pattern, 0), lambda m: F.struct(parse_price_to_kobo(F.regexp_extract(m, r"[\d][\d,\.]{2,}", 0)).alias("kobo"), price_basis(m).alias("basis")))
    found = F.filter(found, lambda p: p["kobo"].isNotNull())
    stated = F.get(F.filter(found, lambda p: p["basis"].isNotNull()), F.lit(0))
    offer = F.coalesce(json_ld(items, "price", string=False), F.get_json_object(json_ld(items, "offers", string=False), "$.price")).try_cast("double")
    return F.coalesce(stated, F.get(found, F.lit(0)), F.when(offer > 0, F.struct(F.floor(offer * 100 + 0.5).cast("long").alias("kobo"), F.lit(None).cast("string").alias("basis"))))


def bedrooms(plain: Column | str, most: int | None = None) -> Column:
    n = group(col(plain), BEDROOMS).try_cast("int")
    return n if most is None else F.when(n.between(1, most), n)


def bathrooms(plain: Column | str) -> Column:
    return group(col(plain), BATHROOMS).try_cast("int")


def find_phones(html: Column | str) -> Column:
    """Distinct `tel:` numbers in the order of the page; WhatsApp numbers only where there are none."""
    clean = lambda found: F.array_distinct(F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != ""))
    tel = clean(all_of(col(html), TEL))
    chat = clean(all_of(col(html), WHATSAPP))
    return F.when(F.size(tel) > 0, tel).otherwise(chat)


def find_email(html: Column | str) -> Column:
    return F.lower(F.trim(group(col(html), MAILTO)))


def find_instagram(html: Column | str) -> Column:
    return let(group(col(html), INSTAGRAM), lambda h: F.when(~F.lower(h).isin("p", "explore", "reel", "reels", "accounts"), h))


def is_business_email(email: Column | str) -> Column:
    return F.coalesce(col(email).rlike(BUSINESS_MAIL), F.lit(False))


def operator_website(html: Column | str) -> Column:
    """The first absolute link whose host is no portal's and whose path is no asset's."""
    links = all_of(col(html), r'(?i)<a\s[^>]*href="(https?://[^"]+)"')
    asset = "(?i)(" + "|".join(e.replace(".", r"\.") for e in ASSET_EXTENSIONS) + ")$"
    return F.get(F.filter(links, lambda u: ~is_non_operator_host(authority(u)) & ~url_path(u).rlike(asset)), F.lit(0))


def name_from_domain(url: Column | str) -> Column:
    """First label of a host without `www.` and one known suffix, capitalised; null under three letters."""
    host = F.replace(authority(url), F.lit("www."), F.lit(""))
    bare = host
    for suffix in reversed(DOMAIN_SUFFIXES):
        bare = F.when(F.endswith(host, F.lit(suffix)), F.substr(host, F.lit(1), F.length(host) - len(suffix))).otherwise(bare)
    label = F.split_part(bare, F.lit("."), F.lit(1))
    return F.when(F.length(label) >= 3, F.concat(F.upper(F.substring(label, 1, 1)), F.lower(F.substr(label, F.lit(2)))))


def looks_like_business(name: Column) -> Column:
    fits = name.rlike(BUSINESS_NAME) & name.rlike("[A-Za-z]")
    return F.coalesce(fits & ~F.lower(name).isin(GENERIC_OPERATOR_LABELS) & ~name.rlike(PROPERTY_WORDS), F.lit(False))


def extract_operator(html: Column | str, items: Column | str, website: Column | str) -> Column:
    """A struct of name, confidence and evidence: JSON-LD seller, provider, author, publisher or brand (high), a labelled
    block (medium), the site's domain (low, a hint and no identity); null where none gives a business name."""

    def clean(c: Column) -> Column:
        return F.regexp_replace(strip_tags(c), r"^[ ·\-|\n\t]+|[ ·\-|\n\t]+$", "")

    def claim(name: Column, confidence: str, evidence: Column) -> Column:
        return let(name, lambda n: F.when(looks_like_business(n), F.struct(n.alias("name"), F.lit(confidence).alias("confidence"), evidence.alias("evidence"))))

    claims = []
    for key in ("seller", "provider", "author", "publisher", "brand"):
        name = let(json_ld(items, key, string=False), lambda v: F.coalesce(F.get_json_object(F.when(v.startswith("{"), v), "$.name"), F.when(~v.rlike(r"^\s*[\[{]"), v)))
        claims.append(claim(clean(name), "high", F.lit(f"json-ld {key}")))
    blocks = all_of(col(html), LABELLED_BLOCK)
    names = F.transform(blocks, lambda b: F.trim(F.split_part(clean(b), F.lit("\n"), F.lit(1))))
    claims.append(claim(F.get(F.filter(names, looks_like_business), F.lit(0)), "medium", F.lit("labelled block")))
    claims.append(let(name_from_domain(website), lambda d: F.when(d.isNotNull(), F.struct(d.alias("name"), F.lit("low").alias("confidence"), F.lit("domain").alias("evidence")))))
    return F.coalesce(*claims)


def detect_pms(html: Column | str) -> Column:
    return let(F.lower(col(html)), lambda t: first_match(t, BOOKING_SYSTEMS, lambda v, k: F.contains(v, F.lit(k))))


def booking_url(html: Column | str) -> Column:
    links = all_of(col(html), r'(?i)href="(https?://[^"]+)"')
    hosts = [k for k, _ in BOOKING_SYSTEMS]
    has_host = lambda host: F.exists(F.array(*[F.lit(h) for h in hosts]), lambda h: F.contains(host, h))
    return F.get(F.filter(links, lambda u: let(authority(u), has_host)), F.lit(0))


def ical_feed(html: Column | str) -> Column:
    return group(col(html), CALENDAR)


def absolute(url: Column | str, page_url: Column | str) -> Column:
    """A link on a page as an absolute http(s) URL; null for other schemes and inline data."""
    page = col(page_url)
    origin = F.regexp_extract(page, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    scheme = F.coalesce(group(page, r"^([A-Za-z][A-Za-z0-9+.-]*):"), F.lit("https"))
    folder = let(F.regexp_extract(page, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/(?:[^?#]*/)?)?", 0), lambda f: F.when(F.endswith(f, F.lit("/")), f).otherwise(F.concat(f, F.lit("/"))))

    def resolved(u: Column) -> Column:
        return (
            F.when(u == "", None)
            .when(u.rlike("^(?i:https?)://"), u)
            .when(u.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
            .when(F.startswith(u, F.lit("//")), F.concat(scheme, F.lit(":"), u))
            .when(F.startswith(u, F.lit("/")), F.concat(origin, u))
            .when(u.rlike("^[?#]"), F.concat(F.regexp_extract(page, "^[^?#]*", 0), u))
            .otherwise(F.concat(folder, F.regexp_replace(u, r"^(\./)+", "")))
        )

    return let(F.regexp_replace(col(url), r"""^[\s'"]+|[\s'"]+$""", ""), resolved)


def availability_hint(html: Column | str, page_url: Column | str) -> Column:
    """The first link that looks like availability, if it leaves the page's own registrable domain."""
    page_domain = registrable_domain(authority(page_url))
    leaves = lambda u: let(authority(u), lambda h: (h != "") & (registrable_domain(h) != page_domain))
    return let(absolute(group(col(html), AVAILABILITY), page_url), lambda u: F.when(leaves(u), u))


def attribute(tag: Column, name: str) -> Column:
    """An attribute of a tag, quoted either way or not at all."""
    quoted = rf"""(?is)(?:^|\s){name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""
    return F.coalesce(*[blank_to_null(F.regexp_extract(tag, quoted, i)) for i in (1, 2, 3)])


def srcset_largest(srcset: Column | str) -> Column:
    """The candidate of the greatest width, a density counting a thousand, the first of equals."""
    candidates = F.filter(F.transform(F.split(col(srcset), ","), lambda c: F.trim(c)), lambda c: c != "")

    def scored(c: Column, i: Column) -> Column:
        parts = F.split(c, r"\s+")
        d = F.lower(F.coalesce(F.get(parts, F.lit(1)), F.lit("")))
        number = F.regexp_extract(d, r"^([0-9.]+)[wx]$", 1).try_cast("double")
        score = F.when(number.isNull(), 1.0).when(F.endswith(d, F.lit("x")), number * 1000).otherwise(number)
        return F.struct(score.alias("score"), (-i).alias("first"), F.get(parts, F.lit(0)).alias("url"))

    return F.array_max(F.transform(candidates, scored))["url"]


def has_watermark(url: Column | str) -> Column:
    brand = r"(?:^|[/._-])(?:" + "|".join(t.replace(".", r"\.") for t in BRAND_TOKENS) + r")(?:$|[/._-])"
    return let(F.lower(col(url)), lambda u: u.rlike(WATERMARK_ASSET) | authority(u).rlike(brand) | url_path(u).rlike(brand))


def is_hotlinkable(url: Column | str) -> Column:
    return ~authority(url).rlike(STORAGE_HOST) & col(url).rlike(PROXIED_IMAGE)


def is_other_listing(url: Column | str, listing_id: Column | str) -> Column:
    """Whether the path names another listing's number."""
    ids = all_of(col(url), r"/(\d{5,})(?=/)")
    return F.coalesce(F.size(F.filter(ids, lambda x: x != col(listing_id))) > 0, F.lit(False)) & F.coalesce(col(listing_id) != "", F.lit(False))


def image_urls(html: Column | str) -> Column:
    """All image references of a page, for audit."""
    return F.array_distinct(F.filter(F.transform(all_of(col(html), r"(?is)<(?:img|source)\b[^>]*>", 0), lambda t: F.coalesce(attribute(t, "src"), attribute(t, "srcset"))), lambda u: u.isNotNull()))


def gallery(html: Column | str, page_url: Column | str, listing_id: Column | str, limit: int = GALLERY_LIMIT) -> Column:
    """A listing's images: largest of a srcset, else lazy attributes, else src; absolute; no tiny, chrome, branded, proxied or
    other listings' ones; distinct, those with the listing's id first, `limit` at most."""
    tags = all_of(col(html), r"(?is)<(?:img|source)\b([^>]*)>")
    tags = F.filter(tags, lambda t: ~F.coalesce(attribute(t, "width").isin("1", "2") & attribute(t, "height").isin("1", "2"), F.lit(False)))
    urls = F.transform(tags, lambda t: absolute(F.coalesce(srcset_largest(attribute(t, "srcset")), *[attribute(t, a) for a in IMAGE_ATTRIBUTES]), page_url))
    fine = lambda u: u.isNotNull() & url_path(u).rlike(IMAGE_EXTENSION) & ~u.rlike(CHROME_IMAGES) & ~has_watermark(u) & ~is_hotlinkable(u) & ~is_other_listing(u, listing_id)
    urls = F.array_distinct(F.filter(urls, fine))
    own = lambda u: F.coalesce(F.contains(u, col(listing_id)) & (col(listing_id) != ""), F.lit(False))
    return F.slice(F.concat(F.filter(urls, own), F.filter(urls, lambda u: ~own(u))), 1, limit)


def location_from_url(url: Column | str) -> Column:
    """A struct of state, city and area: the state's slug in the path, and the next segment that is no number."""
    parts = F.filter(F.split(url_path(url), "/"), lambda p: p != "")
    codes = F.create_map(*[F.lit(x) for code, slugs in STATE_SLUGS.items() for s in slugs for x in (s, code)])
    slugs = [s for v in STATE_SLUGS.values() for s in v]
    at = F.array_min(F.filter(F.transform(parts, lambda p, i: F.when(p.isin(slugs), i)), lambda i: i.isNotNull()))
    state = F.try_element_at(codes, F.get(parts, at))
    after = F.get(parts, at + 1)
    area = F.when(~after.rlike(r"^\d+$"), title_case(F.replace(after, F.lit("-"), F.lit(" "))))
    return F.struct(state.alias("state"), city_for_state(state).alias("city"), area.alias("area"))


def location_from_address(items: Column | str) -> Column:
    """A struct of state and area from a JSON-LD address: whichever of region and locality names a state is the state."""
    address = json_ld(items, "address", string=False)
    region, locality = (blank_to_null(F.get_json_object(address, f"$.{k}")) for k in ("addressRegion", "addressLocality"))
    names = [("lagos", "LA"), ("abuja", "FC"), ("fct", "FC"), ("oyo", "OY"), ("imo", "IM"), ("akwa ibom", "AK")]
    code = lambda c: first_match(F.lower(c), names, lambda v, k: F.contains(v, F.lit(k)))
    swapped = code(region).isNull() & code(locality).isNotNull()
    return F.struct(F.coalesce(code(region), code(locality)).alias("state"), F.when(swapped, region).otherwise(locality).alias("area"))


def location_from_breadcrumb(html: Column | str) -> Column:
    """A struct of city and area from region links: a known city's label is the city, the last other label the area."""
    labels = F.transform(all_of(col(html), REGION_LINK), lambda x: F.trim(x))
    cities = ["lagos", "abuja", "ibadan", "owerri", "uyo"]
    other = F.filter(labels, lambda x: ~F.lower(x).isin(cities) & ~x.isin("Home", "Residential Short Lets"))
    return F.struct(F.try_element_at(F.filter(labels, lambda x: F.lower(x).isin(cities)), F.lit(-1)).alias("city"), F.try_element_at(other, F.lit(-1)).alias("area"))


def clean_title(title: Column | str) -> Column:
    """A title without the portal's part behind `|` and a reference in brackets at its end."""
    before = F.trim(F.split_part(col(title), F.lit("|"), F.lit(1)))
    return F.nullif(F.trim(F.regexp_replace(before, r"(?:\s+in\s+[^|]*?)?\s*\([A-Za-z0-9]{5,8}\)\s*$", "")), F.lit(""))


def type_from_slug(url: Column | str) -> Column:
    """A property type by the longest needle in the path."""
    table = sorted(((k.replace(" ", "-"), v) for k, v in PROPERTY_TYPES), key=lambda x: -len(x[0]))
    return first_match(F.lower(url_path(url)), table, lambda v, k: F.contains(v, F.lit(k)))


def selector_facts(html: Column | str) -> Column:
    """A struct of price, basis, bedrooms and bathrooms from class-tagged elements."""
    html = col(html)
    price = group(html, r'(?i)class="pd-pr"[^>]*>\s*<b>([^<]+)</b>')
    unit = group(html, r'(?i)class="pd-pr"[^>]*>\s*<b>[^<]+</b>\s*<span>([^<]+)</span>')
    return F.struct(parse_price_to_kobo(price).alias("price"), price_basis(unit).alias("basis"), bedrooms(strip_tags(group(html, r'(?is)class="pd-(?:bed|beds)"[^>]*>(.{0,80}?)</'))).alias("bedrooms"), bathrooms(strip_tags(group(html, r'(?is)class="pd-(?:bath|baths)"[^>]*>(.{0,80}?)</'))).alias("bathrooms"))


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns that are computed once for each row. A plain projection would be merged with the next one, and its
    expressions repeated at each of their uses; a generator of one row is not."""
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _with_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Pages of the hosts, or subdomains of the hosts, that rules name: an equi-join on each suffix of a page's host."""
    labels = F.split(authority("url"), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    few = rules.limit(MAX_RULES + 1).count() <= MAX_RULES
    return pages.where("url is not null").select("*", F.explode(suffixes).alias("rule_host")).join(F.broadcast(rules) if few else rules, "rule_host")


#: Rules that may be broadcast.
MAX_RULES = 100_000


def extract_listings(pages: DataFrame, rules: DataFrame | None = None, unclosed: bool = True) -> DataFrame:
    """Listings of pages (seq, url, html): pages are met with their source's rules by host, identified by their canonical
    link, og:url or own URL, and dropped where they are no listing's page or have no name. No Python runs in the executors.
    unclosed: whether names decode references without `;`, as in unescape.

    A page is cut in stages, each computed once: without media; its identity; its text, JSON-LD objects and links; facts.
    The work is all in the processor, so a table of fewer partitions than there are cores is dealt to all of them first."""
    cores = pages.sparkSession.sparkContext.defaultParallelism
    if pages.rdd.getNumPartitions() < cores:
        pages = pages.repartition(cores)
    rows = _with_rules(pages, source_rules(pages.sparkSession) if rules is None else rules)
    rows = computed(rows, {"html": strip_media("html")})
    canonical = absolute(F.coalesce(group(F.col("html"), CANONICAL), group(F.col("html"), OG_URL)), "url")
    rows = computed(rows, {"canonical": canonical})
    shaped = lambda u: F.call_function("rlike", url_path(u), F.col("path_pattern"))
    same = F.endswith(authority("canonical"), F.col("rule_host"))
    rows = computed(rows, {"source_url": F.regexp_extract(F.when(F.coalesce(same & shaped("canonical"), F.lit(False)), F.col("canonical")).otherwise(F.col("url")), "^[^?#]*", 0)}).where(shaped("source_url"))
    by_pattern = F.call_function("regexp_extract", url_path("source_url"), F.col("id_pattern"), F.lit(1))
    last = F.regexp_extract(url_path("source_url"), r"([^/]+)/?$", 1)
    rows = computed(rows, {"source_listing_id": F.coalesce(F.nullif(by_pattern, F.lit("")), last), "plain": strip_tags("html"), "items": json_ld_items("html"), "website": operator_website("html"), "facts": selector_facts("html"), "crumb": location_from_breadcrumb("html")})
    rows = computed(rows, {"property_name": F.substring(property_name("html", "items", unclosed), 1, 200)}).where("property_name is not null")
    rows = computed(rows, {
        "operator": extract_operator("html", "items", "website"), "price": first_price("plain"), "best": best_price("plain", "items"), "place": location_from_url("source_url"), "address": location_from_address("items"),
        "media": gallery("html", "url", "source_listing_id"), "text_type": property_type("plain", "items"),
    })
    identity = (F.col("operator.confidence") != "low") & F.col("names_identify")
    state = F.coalesce("place.state", "address.state")
    stated = F.when(F.col("price.kobo").isNotNull() & F.col("price.basis").isNotNull(), F.col("price"))
    price = F.coalesce(F.col("facts.price"), stated["kobo"], F.col("best.kobo"), F.col("price.kobo"))
    basis = F.when(F.col("facts.price").isNotNull(), F.col("facts.basis")).when(stated.isNotNull(), stated["basis"]).otherwise(F.col("best.basis"))
    return rows.select(
        "seq", "source", "source_url", "source_listing_id", "property_name", F.coalesce("text_type", type_from_slug("source_url")).alias("property_type"), F.coalesce("facts.bedrooms", bedrooms("plain")).alias("bedrooms"),
        F.coalesce("facts.bathrooms", bathrooms("plain")).alias("bathrooms"), price.alias("advertised_price"), F.lit("NGN").alias("currency"), state.alias("state"), F.coalesce("place.city", "crumb.city", city_for_state(state)).alias("city"),
        F.coalesce("place.area", "address.area", "crumb.area").alias("area"), F.when(identity, F.col("operator.name")).alias("operator_name"), F.when(~F.coalesce(identity, F.lit(False)), F.col("operator.name")).alias("operator_hint"),
        F.get(find_phones("html"), F.lit(0)).alias("phone"), find_email("html").alias("email"), "website", find_instagram("html").alias("instagram"), detect_pms("html").alias("pms_detected"), booking_url("html").alias("booking_url"),
        availability_hint("html", "url").alias("availability_hint_url"), basis.alias("price_basis"), title_document("plain").alias("title_document"), "media", F.get("media", F.lit(0)).alias("cover_image_url"),
    )


def canonical_areas(listings: DataFrame) -> DataFrame:
    return listings.withColumn("area", canonical_area("area"))
