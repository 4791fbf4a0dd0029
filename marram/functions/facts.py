"""Short texts and labels made of facts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marram.functions.money import round_half_up
from marram.functions.text import blank_to_null, col

# Title documents, their labels and risks.
TITLE_DOCUMENTS = [
    ("C_OF_O", "Certificate of Occupancy", "low"),
    ("GOVERNORS_CONSENT", "Governor's Consent", "medium"),
    ("DEED_OF_ASSIGNMENT", "Deed of Assignment", "medium"),
    ("EXCISION_GAZETTE", "Excision & Gazette", "medium"),
    ("RIGHT_OF_OCCUPANCY", "Right of Occupancy", "medium"),
    ("FREEHOLD", "Freehold", "medium"),
    ("REGISTERED_DEED", "Registered Deed", "medium"),
    ("UNREGISTERED", "Unregistered", "high"),
    ("NOT_DISCLOSED", "Not disclosed", "unknown"),
]


def _table(values: list[tuple[str, str]]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values for x in pair])


def title_label(c: Column | str) -> Column:
    return F.try_element_at(_table([(k, label) for k, label, _ in TITLE_DOCUMENTS]), col(c))


def title_risk(c: Column | str) -> Column:
    return F.try_element_at(_table([(k, risk) for k, _, risk in TITLE_DOCUMENTS]), col(c))


def parse_title_documents(c: Column | str) -> Column:
    """The known title documents of a comma-separated list, in its order; empty for null."""
    parts = F.transform(F.split(F.coalesce(col(c), F.lit("")), ","), lambda p: F.upper(F.trim(p)))
    return F.filter(parts, lambda p: p.isin([k for k, _, _ in TITLE_DOCUMENTS]))


def describe_factually(bedrooms: Column | str, property_type: Column | str, area: Column | str, city: Column | str) -> Column:
    """`3-bedroom flat, Ikeja` for a listing without a name; facts that are missing are left out, and without any it is a Shortlet."""
    rooms = F.when(col(bedrooms) > 0, F.concat(col(bedrooms).cast("string"), F.lit("-bedroom")))
    kind = F.replace(F.lower(F.nullif(col(property_type), F.lit(""))), F.lit("_"), F.lit(" "))
    base = F.coalesce(F.nullif(F.concat_ws(" ", rooms, kind), F.lit("")), F.lit("Shortlet"))
    return F.concat_ws(", ", base, F.coalesce(blank_to_null(area), blank_to_null(city)))


def price_movement_note(previous: Column | str, current: Column | str, movements: Column | str, least_percent: int = 5) -> Column:
    """A sentence on the last price movement; null where it is smaller than least_percent or there is none."""
    percent = F.when(col(previous) > 0, round_half_up((col(current) - col(previous)) / col(previous) * 100))
    times = F.when(col(movements) > 1, F.concat(F.lit(" "), col(movements).cast("string"), F.lit(" times"))).otherwise("")
    note = F.concat(F.lit("Advertised rate "), F.when(percent < 0, "cut").otherwise("raised"), F.lit(" "), F.abs(percent).cast("string"), F.lit("%"), times, F.lit(" since we began tracking."))
    return F.when(F.abs(percent) >= least_percent, note)
