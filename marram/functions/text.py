"""Names, areas, phones and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marram.functions.constants import AREA_ALIASES, CITY_BY_STATE, LEGAL_SUFFIXES, MOBILE_PREFIXES


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str) -> Column:
    """Null for empty and blank strings, else the string trimmed."""
    return F.nullif(F.trim(col(c)), F.lit(""))


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_match(value: Column, table: list[tuple[str, str]], test) -> Column:
    """The result of the first row of an ordered table whose key passes test(value, key); else null."""
    found = F.lit(None).cast("string")
    for key, result in reversed(table):
        found = F.when(test(value, key), F.lit(result)).otherwise(found)
    return found


def title_case(c: Column | str) -> Column:
    """Upper case for each letter that no letter stands before, lower case for the others: `3br o'neil` -> `3Br O'Neil`."""
    parts = F.regexp_extract_all(F.lower(col(c)), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))), "")


def slug(c: Column | str) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), "[^a-z0-9 ]", " "))
    return F.regexp_replace(plain, r"\s+", "-")


def normalise_operator_name(c: Column | str) -> Column:
    """Lower case without punctuation and legal words; all words, if none would be left."""
    plain = F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), r"""[.,'"()\[\]&/-]""", " ")
    words = F.filter(F.split(plain, r"\s+"), lambda w: w != "")
    useful = F.filter(words, lambda w: ~w.isin(LEGAL_SUFFIXES))
    return F.array_join(F.when(F.size(useful) > 0, useful).otherwise(words), " ")


def operator_key(name: Column | str, area: Column | str, state: Column | str) -> Column:
    """state:area:name in lower case, blanks as hyphens."""
    area_slug = F.regexp_replace(F.lower(F.trim(F.coalesce(col(area), F.lit("")))), r"\s+", "-")
    return F.concat_ws(":", F.lower(F.coalesce(col(state), F.lit(""))), area_slug, F.replace(normalise_operator_name(name), F.lit(" "), F.lit("-")))


def normalise_phone(c: Column | str) -> Column:
    """`+234` and ten digits for the three national spellings; other numbers trimmed; empty is null."""
    raw = F.nullif(col(c), F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(raw, r"[^\d+]", ""), r"^\++", "")
    return (
        F.when(bare.rlike(r"^234\d{10}$"), F.concat(F.lit("+"), bare))
        .when(bare.rlike(r"^0\d{10}$"), F.concat(F.lit("+234"), F.substr(bare, F.lit(2))))
        .when(bare.rlike(r"^\d{10}$"), F.concat(F.lit("+234"), bare))
        .otherwise(F.trim(raw))
    )


def phone_dedupe_key(c: Column | str) -> Column:
    """The last nine characters of digits and plus signs, if there are as many."""
    digits = F.regexp_replace(col(c), r"[^\d+]", "")
    return F.when(F.length(digits) >= 9, F.right(digits, F.lit(9)))


def is_plausible_mobile(c: Column | str) -> Column:
    phone = F.coalesce(col(c), F.lit(""))
    return phone.startswith("+234") & F.concat(F.lit("0"), F.substr(phone, F.lit(5), F.lit(3))).isin(MOBILE_PREFIXES)


_LOOKUP: dict[str, str] = {}
for _name, _spellings in AREA_ALIASES:
    for _spelling in (_name.lower(), *_spellings):
        _LOOKUP[_spelling] = _name


def _area_key(c: Column) -> Column:
    cleaned = F.trim(F.split_part(c, F.lit(","), F.lit(1)))
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(cleaned), "[^a-z0-9 ]", " "), r"\s+", " "))


def _lookup_map() -> Column:
    return F.create_map(*[F.lit(x) for pair in _LOOKUP.items() for x in pair])


def canonical_area(c: Column | str, longest: bool = False) -> Column:
    """The canonical name of an area: an exact spelling's, else that of the first spelling in table order that it starts
    with (longest=True: of the longest), else its text before the first comma in title case. Empty is null."""
    raw = F.nullif(col(c), F.lit(""))
    key = _area_key(raw)
    spellings = sorted(_LOOKUP, key=lambda s: -len(s)) if longest else list(_LOOKUP)
    starts = F.get(F.filter(F.array(*[F.lit(s) for s in spellings]), lambda s: F.startswith(key, s)), F.lit(0))
    found = F.coalesce(F.try_element_at(_lookup_map(), key), F.try_element_at(_lookup_map(), starts))
    return F.when(raw.isNotNull(), F.coalesce(found, title_case(F.trim(F.split_part(raw, F.lit(","), F.lit(1))))))


def is_known_area(c: Column | str) -> Column:
    raw = F.coalesce(col(c), F.lit(""))
    return (raw != "") & _area_key(raw).isin(list(_LOOKUP))


def city_for_state(c: Column | str) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in CITY_BY_STATE.items() for x in pair]), col(c))


def stable_id(prefix: str, *parts: Column | str) -> Column:
    """prefix_ and 24 hexadecimal digits that the parts decide; a null part counts as empty."""
    joined = F.concat_ws("\x1f", *[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(joined, 256), 1, 24))


def json_int(document: Column | str, field: str) -> Column:
    """An integer field of a JSON document; null where it is missing, empty or no integer."""
    return F.nullif(F.get_json_object(col(document), f"$.{field}"), F.lit("")).try_cast("int")
