"""Small numeric and label expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(value: Column, digits: int = 0) -> Column:
    """Round half towards plus infinity."""
    return F.floor(value * 10**digits + F.lit(0.5)) / F.lit(float(10**digits))


def half_up_long(value: Column) -> Column:
    return F.floor(value + F.lit(0.5)).cast("long")


def clamp(value: Column, least: Column | float, most: Column | float) -> Column:
    low = least if isinstance(least, Column) else F.lit(least)
    high = most if isinstance(most, Column) else F.lit(most)
    return F.least(F.greatest(value, low), high)


def at_least_zero(value: Column) -> Column:
    return F.greatest(F.coalesce(value, F.lit(0)), F.lit(0))


def prompt_tokens(fresh: Column, hit: Column, write: Column) -> Column:
    """Whole prompt on the wire: fresh, cache-read and cache-written tokens."""
    return at_least_zero(fresh) + at_least_zero(hit) + at_least_zero(write)


def context_percent(total: Column, window: Column) -> Column:
    """Share of the window in percent; 0 where either is missing or not positive."""
    bad = total.isNull() | window.isNull() | F.isnan(total.cast("double")) | F.isnan(window.cast("double")) | (total <= 0) | (window <= 0)
    return F.when(bad, F.lit(0.0)).otherwise(total.cast("double") / window * 100)


def safe_label(value: Column, fallback: str) -> Column:
    """A metric label of harmless characters, or the fallback."""
    return F.when(value.rlike(r"\A[A-Za-z0-9_./:@+-]{1,160}\z"), value).otherwise(F.lit(fallback))
