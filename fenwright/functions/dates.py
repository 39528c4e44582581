"""Dates from headers, metadata and file names. Impossible dates are null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _date(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


def header_date(x: Column) -> Column:
    """The day of an RFC 2822 date in its own offset."""
    part = lambda i: F.regexp_extract(F.coalesce(x, F.lit("")), r"([0-9]{1,2}) ([A-Z][a-z]{2}) ([0-9]{4})", i)
    return F.when(part(3) != "", F.try_to_date(F.concat_ws(" ", part(1), part(2), part(3)), "d MMM yyyy"))


def pdf_date(x: Column) -> Column:
    digits = F.regexp_extract(F.coalesce(x, F.lit("")), r"^D?:?([0-9]{8})", 1)
    return F.when(digits != "", F.try_to_date(digits, "yyyyMMdd"))


def filename_date(x: Column, fallback_year: Column) -> Column:
    """Shapes in order: YYYY-MM-DD, DD-MM-YYYY, `14th July 2026`, `14th July`, `July 2026`."""
    t = F.coalesce(x, F.lit(""))
    got = lambda p, i: F.regexp_extract(t, p, i)
    iso, european = r"([0-9]{4})[-_.]([0-9]{2})[-_.]([0-9]{2})", r"(?:^|[^0-9])([0-9]{1,2})[-_.]([0-9]{1,2})[-_.]([0-9]{4})"
    named, month_only = r"([0-9]{1,2})(?:st|nd|rd|th)? ([A-Z][a-z]{2})[a-z]*(?: ([0-9]{4}))?", r"([A-Z][a-z]{2})[a-z]* ([0-9]{4})"
    year = F.when(got(named, 3) != "", got(named, 3)).otherwise(fallback_year.cast("string"))
    return F.coalesce(
        F.when(got(iso, 1) != "", _date(got(iso, 1), got(iso, 2), got(iso, 3))),
        F.when(got(european, 1) != "", _date(got(european, 3), got(european, 2), got(european, 1))),
        F.when(got(named, 1) != "", F.try_to_date(F.concat_ws(" ", got(named, 1), got(named, 2), year), "d MMM yyyy")),
        F.when(got(month_only, 1) != "", F.try_to_date(F.concat_ws(" ", F.lit("1"), got(month_only, 1), got(month_only, 2)), "d MMM yyyy")),
    )


def source_date(header: Column, metadata: Column, filename: Column, year: Column, today: Column) -> Column:
    """ISO text of the first that is known: header, metadata, file name, today."""
    return F.date_format(F.coalesce(header_date(header), pdf_date(metadata), F.try_to_date(metadata), filename_date(filename, year), today), "yyyy-MM-dd")


def quota_reset(now: Column, quota_zone: str = "America/Los_Angeles", shown_zone: str = "Europe/London") -> Column:
    """The next midnight of the quota's zone, as local time of another one."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(quota_zone), now)
    midnight = F.date_add(F.to_date(local), 1).cast("timestamp_ntz")
    return F.convert_timezone(F.lit(quota_zone), F.lit(shown_zone), midnight)
