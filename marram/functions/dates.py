"""Calendar dates, half-open stays [check-in, check-out) and retention."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marram.functions.constants import HOLD_MINUTES, RETENTION_DAYS
from marram.functions.text import col


def iso_date(c: Column | str) -> Column:
    """The date of a `YYYY-MM-DD` string; null for other strings and for days that don't exist."""
    return F.when(col(c).rlike(r"^\d{4}-\d{2}-\d{2}$"), col(c).try_cast("date"))


def to_utc(c: Column | str) -> Column:
    """An instant from a string; one without an offset is read as UTC, the session's time zone."""
    return col(c).try_cast("timestamp")


def nights_between(check_in: Column | str, check_out: Column | str) -> Column:
    """Nights of a stay; null if check-out isn't after check-in."""
    n = F.datediff(col(check_out), col(check_in))
    return F.when(n > 0, n)


def each_night(check_in: Column | str, check_out: Column | str) -> Column:
    """The nights of a stay, check-out excluded; an empty array if there is none."""
    empty = F.array().cast("array<date>")
    return F.when(col(check_out) > col(check_in), F.sequence(col(check_in), F.date_sub(col(check_out), 1))).otherwise(empty)


def ranges_overlap(in_a: Column | str, out_a: Column | str, in_b: Column | str, out_b: Column | str) -> Column:
    return (col(in_a) < col(out_b)) & (col(in_b) < col(out_a))


def days_on_market(first_seen: Column | str, today: Column | str) -> Column:
    return F.greatest(F.lit(0), F.datediff(col(today), col(first_seen)))


def retention_expiry(observed_at: Column | str, days: int = RETENTION_DAYS) -> Column:
    return col(observed_at) + F.expr(f"interval {days} days")


def is_retention_expired(retain_until: Column | str, now: Column | str) -> Column:
    return col(retain_until) <= col(now)


def hold_expiry(now: Column | str, minutes: int = HOLD_MINUTES) -> Column:
    if minutes <= 0:
        raise ValueError("a hold lasts a positive time")
    return col(now) + F.expr(f"interval {minutes} minutes")
