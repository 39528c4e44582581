"""Number functions: blank or malformed input is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_number(x: Column) -> Column:
    """A number with an optional pound sign and thousands commas; anything else is null."""
    t = F.regexp_replace(F.trim(F.coalesce(x.cast("string"), F.lit(""))), "[£,]", "")
    return F.when(t.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"), t.try_cast("double"))


def first_number(x: Column) -> Column:
    """The first run of digits, with commas and a decimal part."""
    return F.regexp_replace(F.regexp_extract(F.coalesce(x, F.lit("")), r"([0-9][0-9,]*(\.[0-9]+)?)", 1), ",", "").try_cast("double")


def desks(x: Column) -> Column:
    """The upper bound of a range of desks. A spreadsheet's date for such a range (YYYY-MM-DD) gives its larger part."""
    t = F.trim(F.coalesce(x, F.lit("")))
    date = r"^[0-9]{4}-([0-9]{2})-([0-9]{2})"
    span = r"([0-9]+) *[-–?] *([0-9]+)"
    part = lambda p, i: F.regexp_extract(t, p, i).try_cast("int")
    return F.when(t.rlike(date), F.greatest(part(date, 1), part(date, 2))).when(t.rlike(span), F.greatest(part(span, 1), part(span, 2))).otherwise(F.regexp_extract(t, "([0-9]+)", 1).try_cast("int"))


def cents(x: Column) -> Column:
    """Rounded half up to two digits, by plain arithmetic on the double, so that every engine agrees."""
    return F.floor(x * 100 + 0.5) / 100


def price_pair(size: Column, pcm: Column, psf: Column) -> Column:
    """struct(pcm, psf): the missing one of a monthly and a square-foot price from the other; zero counts as missing."""
    s, m, f = (F.when(x != 0, x) for x in (size, pcm, psf))
    return F.struct(F.when(m.isNull() & f.isNotNull() & s.isNotNull(), cents(f * s / 12)).otherwise(pcm).alias("pcm"), F.when(f.isNull() & m.isNotNull() & s.isNotNull(), cents(m * 12 / s)).otherwise(psf).alias("psf"))


def tolerant_equal(a: Column, b: Column, share: float = 0.02, least: float = 1.0) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(least), F.abs(a) * share)


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    r = F.radians
    h = F.pow(F.sin(r(lat2 - lat1) / 2), 2) + F.cos(r(lat1)) * F.cos(r(lat2)) * F.pow(F.sin(r(lng2 - lng1) / 2), 2)
    return 2 * 6371 * F.asin(F.sqrt(F.least(h, F.lit(1.0))))
