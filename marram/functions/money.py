"""Money in kobo: longs, rounded as integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marram.functions.constants import LEAST_NAIRA, MOST_NAIRA, PRICE_BANDS
from marram.functions.text import col


def int_div(a: Column, b: Column | int) -> Column:
    """Floor of a / b for longs and a positive b."""
    b = F.lit(b) if isinstance(b, int) else b
    return F.call_function("div", a - F.pmod(a, b), b)


def apply_bps(amount: Column | str, bps: Column | str) -> Column:
    """amount * bps / 10,000, halves rounded up."""
    return int_div(col(amount).cast("long") * col(bps) + 5_000, F.lit(10_000).cast("long"))


def clamp_kobo(amount: Column | str, least: Column | str, most: Column | str) -> Column:
    """amount within [least, most]; a null bound is none."""
    return F.least(F.greatest(col(amount), col(least)), col(most))


def round_to_step(amount: Column | str, step: Column | str) -> Column:
    """amount to the nearest multiple of step, halves up; a step up to 1 changes nothing."""
    amount, step = col(amount), col(step).cast("long")
    return F.when(step <= 1, amount).otherwise(int_div(2 * amount + step, 2 * step) * step)


def to_kobo(naira: Column | str) -> Column:
    """Naira, as a number, in kobo, halves up."""
    return F.floor(col(naira) * 100 + 0.5).cast("long")


def format_naira(kobo: Column | str) -> Column:
    """Sign, symbol, grouped naira and two digits of kobo."""
    kobo = col(kobo)
    whole = F.format_number(int_div(F.abs(kobo), 100), 0)
    return F.concat(F.when(kobo < 0, "-").otherwise(""), F.lit("₦"), whole, F.lit("."), F.lpad(F.pmod(F.abs(kobo), F.lit(100)).cast("string"), 2, "0"))


def plausible_price_kobo(kobo: Column | str) -> Column:
    return F.when(col(kobo).between(LEAST_NAIRA * 100, MOST_NAIRA * 100), col(kobo))


def price_bands(kobo: Column | str) -> Column:
    """The ids of the bands that an amount lies in: two at a shared end."""
    kobo = col(kobo)
    tests = [F.when((kobo >= low) & (F.lit(True) if high is None else kobo <= high), F.lit(name)) for name, low, high in PRICE_BANDS]
    return F.array_compact(F.array(*tests))


def in_price_band(kobo: Column | str, band: str) -> Column:
    low, high = next((low, high) for name, low, high in PRICE_BANDS if name == band)
    return (col(kobo) >= low) & (F.lit(True) if high is None else col(kobo) <= high)


def round_half_up(value: Column) -> Column:
    """Nearest long, halves toward plus infinity."""
    return F.floor(value + 0.5).cast("long")


def price_change_percent(previous: Column | str, current: Column | str) -> Column:
    """Change in percent with one decimal, 0 from a price of 0. Exact ties are rounded away from zero."""
    previous, current = col(previous), col(current)
    exact = (current - previous).cast("decimal(20,0)") * 100 / F.nullif(previous, F.lit(0)).cast("decimal(20,0)")
    return F.when(previous == 0, F.lit(0.0)).otherwise(F.round(exact, 1).cast("double"))


def price_direction(previous: Column | str, current: Column | str) -> Column:
    return F.when(col(current) < col(previous), "cut").otherwise("rise")


def effective_nightly_rate(base: Column | str, overrides: Column | str) -> Column:
    """The greatest of the base rate and the overrides of a map by night."""
    return F.greatest(col(base), F.array_max(F.map_values(col(overrides))))
