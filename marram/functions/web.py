"""Hosts, URLs, phones as links, and contact routes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marram.functions.constants import NON_OPERATOR_HOSTS, PORTAL_HOST
from marram.functions.text import blank_to_null, col, normalise_phone


def authority(c: Column | str) -> Column:
    """What stands between `://` and the path, in lower case; empty if there is none. Spaces in a URL do no harm."""
    return F.lower(F.regexp_extract(F.coalesce(col(c), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def url_path(c: Column | str) -> Column:
    return F.regexp_extract(F.coalesce(col(c), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def registrable_domain(host: Column | str) -> Column:
    """The last two labels; the host itself if it has fewer."""
    labels = F.filter(F.split(col(host), r"\."), lambda x: x != "")
    return F.when(F.size(labels) >= 2, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(col(host))


def is_non_operator_host(host: Column | str) -> Column:
    """Whether a host belongs to a portal or platform; false for an empty one."""
    plain = F.regexp_replace(F.split_part(F.lower(F.coalesce(col(host), F.lit(""))), F.lit(":"), F.lit(1)), r"^www\.", "")
    return (plain != "") & (registrable_domain(plain).isin(NON_OPERATOR_HOSTS) | plain.rlike(PORTAL_HOST))


def domain_of(url: Column | str) -> Column:
    """Host of a URL without `www.`; null if there is none or if it is a portal's."""
    host = F.replace(authority(url), F.lit("www."), F.lit(""))
    return F.when((host != "") & ~is_non_operator_host(host), host)


def is_same_host(a: Column | str, b: Column | str) -> Column:
    x, y = (F.regexp_replace(authority(u), r"^www\.", "") for u in (a, b))
    return (x != "") & (x == y)


def absolute_http(c: Column | str) -> Column:
    return F.coalesce(col(c).rlike(r"^(?i:https?)://[^/?#\s]+"), F.lit(False))


def url_encode_path(c: Column | str) -> Column:
    """Percent encoding in which a space is %20."""
    return F.replace(F.url_encode(col(c)), F.lit("+"), F.lit("%20"))


def pretty_phone(c: Column | str) -> Column:
    """`+234 803 000 0000` for a national number; other numbers as they are; under seven digits null."""
    phone = normalise_phone(c)
    digits = F.regexp_replace(phone, r"\D", "")
    spaced = F.regexp_replace(phone, r"^\+234(\d{3})(\d{3})(\d{4})$", r"+234 $1 $2 $3")
    return F.when(F.length(digits) >= 7, spaced)


def tel_href(c: Column | str) -> Column:
    plain = F.regexp_replace(normalise_phone(c), r"[^\d+]", "")
    return F.when(F.length(F.regexp_replace(plain, r"\D", "")) >= 7, F.concat(F.lit("tel:"), plain))


def whatsapp_href(c: Column | str) -> Column:
    digits = F.regexp_replace(normalise_phone(c), r"\D", "")
    return F.when(F.length(digits) >= 7, F.concat(F.lit("https://wa.me/"), digits))


def sanitise_contact(phone: Column | str, email: Column | str, website: Column | str, instagram: Column | str) -> Column:
    """A struct of the four channels: phone normalised, email lower-cased, website minus one trailing `/`, handle minus `@`."""
    return F.struct(
        normalise_phone(phone).alias("phone"),
        F.lower(blank_to_null(email)).alias("email"),
        F.regexp_replace(blank_to_null(website), "/$", "").alias("website"),
        F.regexp_replace(blank_to_null(instagram), "^@", "").alias("instagram"),
    )


def contact_route(phone: Column | str, website: Column | str, email: Column | str) -> Column:
    """How a published place is reached: phone, else website, else email, else NONE, as a struct of kind and href."""
    has = lambda c: F.coalesce(col(c) != "", F.lit(False))
    route = lambda kind, href: F.struct(F.lit(kind).alias("kind"), href.alias("href"))
    return (
        F.when(has(phone), route("PHONE", F.concat(F.lit("tel:"), F.replace(col(phone), F.lit(" "), F.lit("")))))
        .when(has(website), route("WEBSITE", col(website)))
        .when(has(email), route("EMAIL", F.concat(F.lit("mailto:"), col(email))))
        .otherwise(route("NONE", F.lit(None).cast("string")))
    )


def contact_routes(website: Column | str, phone: Column | str, whatsapp: Column | str, source_url: Column | str) -> Column:
    """The routes of a place page in their order, site, phone, WhatsApp, source; the first one is primary."""
    candidates = [("OPERATOR_SITE", F.when(domain_of(website).isNotNull(), col(website))), ("PHONE", tel_href(phone)), ("WHATSAPP", whatsapp_href(whatsapp)), ("SOURCE", blank_to_null(source_url))]
    routes = F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), h.alias("href")) for k, h in candidates]), lambda r: r["href"].isNotNull())
    return F.transform(routes, lambda r, i: F.struct(r["kind"].alias("kind"), r["href"].alias("href"), (i == 0).alias("primary")))


def contact_confidence(website: Column | str, phone: Column | str) -> Column:
    """HIGH with an own site and a phone, MEDIUM with one of them, else LOW."""
    site, number = domain_of(website).isNotNull(), tel_href(phone).isNotNull()
    return F.when(site & number, "HIGH").when(site | number, "MEDIUM").otherwise("LOW")


def best_channel(phone: Column | str, instagram: Column | str, email: Column | str, website: Column | str) -> Column:
    """How to approach an operator; a website alone counts as e-mail."""
    has = lambda c: F.coalesce(col(c) != "", F.lit(False))
    return F.when(has(phone), "PHONE").when(has(instagram), "INSTAGRAM").when(has(email) | has(website), "EMAIL").otherwise("NONE")
