"""Times from text, zones by name, whole months between times."""

from __future__ import annotations

from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant(text: Column) -> Column:
    """A UTC time (no zone) from ISO text, whose zone is UTC if it names none, or from epoch milliseconds; null for others."""
    number = text.try_cast("bigint")
    zoned = text.rlike(r"(?i)(Z|[+-][0-9]{2}(:?[0-9]{2})?)$") & text.contains("T")
    iso = F.convert_timezone(F.current_timezone(), F.lit("UTC"), text.try_cast("timestamp").cast("timestamp_ntz"))
    return F.when(number.isNotNull(), F.timestamp_millis(number).cast("timestamp_ntz")).when(zoned, iso).otherwise(text.try_cast("timestamp_ntz"))


def zone_of(name: str, fallback: bool = True) -> str:
    """The name of a time zone or an offset such as +08:00; an unknown name is UTC, or an error without fallback."""
    if len(name) == 6 and name[0] in "+-" and name[3] == ":" and (name[1:3] + name[4:]).isdigit():
        return name
    try:
        return ZoneInfo(name).key
    except (ZoneInfoNotFoundError, ValueError, OSError):
        if not fallback:
            raise ValueError(f"no such time zone: {name}") from None
        return "UTC"


def months_apart(a: Column, b: Column, zone: str = "UTC") -> Column:
    """Whole months from a to b (negative if b is before a) in a zone; both are UTC times without zone."""
    local = lambda t: F.convert_timezone(F.lit("UTC"), F.lit(zone), t)
    a, b = local(a), local(b)
    months = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
    there = a + F.make_ym_interval(F.lit(0), months)
    return (months - F.when((months > 0) & (there > b), 1).when((months < 0) & (there < b), -1).otherwise(0)).cast("int")


def proctime() -> Column:
    """The time at which a query, or a micro-batch of a stream, began."""
    return F.current_timestamp()
