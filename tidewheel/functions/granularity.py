"""Time granularities as column functions, and driver-side rules about them."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of granularities and the ISO periods they stand for, from fine to coarse.
PERIODS = {
    "SECOND": "PT1S",
    "MINUTE": "PT1M",
    "FIVE_MINUTE": "PT5M",
    "TEN_MINUTE": "PT10M",
    "FIFTEEN_MINUTE": "PT15M",
    "THIRTY_MINUTE": "PT30M",
    "HOUR": "PT1H",
    "SIX_HOUR": "PT6H",
    "EIGHT_HOUR": "PT8H",
    "DAY": "P1D",
    "WEEK": "P1W",
    "MONTH": "P1M",
    "QUARTER": "P3M",
    "YEAR": "P1Y",
}
_FIELDS = re.compile(r"P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?$")
US = 1_000_000


@dataclass(frozen=True)
class Granularity:
    """months and microseconds (us) of a period; kind is period, duration, all or none; origin in epoch microseconds."""

    kind: str
    period: str = ""
    months: int = 0
    us: int = 0
    origin: int | None = None
    zone: str = "UTC"

    @classmethod
    def of(cls, text: str, origin: int | None = None, zone: str = "UTC") -> Granularity:
        """From a name, an ISO period, or JSON with a type. In JSON a duration and an origin are milliseconds; an origin may
        be an ISO time instead."""
        if text.lstrip().startswith("{"):
            said = json.loads(text)
            if said["type"] == "duration":
                us = int(said["duration"]) * 1000
                if us <= 0:
                    raise ValueError(f"a duration must be positive: {text}")
                return cls("duration", us=us, origin=_json_origin(said.get("origin", 0)))
            return cls.of(said.get("period") or said["type"].upper(), _json_origin(said.get("origin")), said.get("timeZone", "UTC"))
        name = text.upper()
        if name in ("ALL", "NONE"):
            return cls(name.lower())
        period = PERIODS.get(name, name)
        found = _FIELDS.match(period)
        if not found or period in ("P", "PT"):
            raise ValueError(f"no granularity: {text}")
        y, mo, w, d, h, mi, s = (int(x or 0) for x in found.groups())
        months, us = y * 12 + mo, (((w * 7 + d) * 24 + h) * 3600 + mi * 60 + s) * US
        if not months and not us:
            raise ValueError(f"a period must be positive: {text}")
        return cls("period", period, months, us, origin, zone)

    def rank(self) -> tuple[int, float]:
        return (2, 0) if self.kind == "all" else (0, 0) if self.kind == "none" else (1, self.months * 30.44 * 86400 * US + self.us)

    def is_finer_than(self, other: Granularity) -> bool:
        return self.rank() < other.rank()

    def floor(self, ts: Column) -> Column:
        """The start of the bucket that holds ts (no time zone); the bucket is [floor, floor + period)."""
        if self.kind == "none":
            return F.date_trunc("millisecond", ts).cast("timestamp_ntz")
        if self.kind == "all":
            return F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")
        if self.zone != "UTC":
            local = F.convert_timezone(F.lit("UTC"), F.lit(self.zone), ts)
            return F.convert_timezone(F.lit(self.zone), F.lit("UTC"), Granularity(self.kind, self.period, self.months, self.us, self.origin).floor(local))
        units = {"P1Y": "year", "P3M": "quarter", "P1M": "month", "P1W": "week", "P1D": "day", "PT1H": "hour", "PT1M": "minute", "PT1S": "second"}
        if self.origin is None and self.period in units:
            return F.date_trunc(units[self.period], ts).cast("timestamp_ntz")
        if self.months:
            return self._of_months(ts)
        us = micros(ts)
        return from_micros(us - F.pmod(us - self._base, F.lit(self.us).cast("long")))

    @property
    def _base(self) -> Column:
        """Where the periods are counted from, in epoch microseconds."""
        if self.origin is None and self.period.endswith("W"):
            return micros(F.lit("1970-01-05 00:00:00").cast("timestamp_ntz"))
        return F.lit(self.origin or 0).cast("long")

    @property
    def mean_us(self) -> int:
        return self.months * 2_629_746 * US + self.us

    def _of_months(self, ts: Column) -> Column:
        """For periods of months, and of months and shorter units: the number of periods since the origin is estimated from
        their mean length, and the last start at or before ts is taken of those near it. Months differ from their mean by
        less than four days in all, so the estimate is off by less than the periods looked at."""
        return F.greatest(*[F.when(start <= ts, start) for start in map(self._start, self._near(ts))])

    def _near(self, ts: Column) -> list[Column]:
        about = F.floor((micros(ts) - self._base) / self.mean_us)
        return [about + i for i in range(-2, 3)]

    def _start(self, n: Column) -> Column:
        return from_micros(micros(from_micros(self._base) + F.make_ym_interval(F.lit(0), (n * self.months).cast("int"))) + n * self.us)

    def number(self, ts: Column) -> Column:
        """For periods of months: the number of the bucket that holds ts, which grows by one from bucket to bucket."""
        local = ts if self.zone == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(self.zone), ts)
        if self.us:
            return F.greatest(*[F.when(self._start(n) <= local, n) for n in self._near(local)])
        # the start of that number is in the calendar month of the time, or before it
        month = lambda t: F.year(t) * 12 + F.month(t)
        n = F.floor((month(local) - month(from_micros(self._base))) / self.months)
        return F.when(self._start(n) > local, n - 1).otherwise(n)

    def start_of(self, number: Column) -> Column:
        """For periods of months: the start of the bucket of that number; start_of(number(ts)) is floor(ts)."""
        start = self._start(number)
        return start if self.zone == "UTC" else F.convert_timezone(F.lit(self.zone), F.lit("UTC"), start)

    def next(self, start: Column) -> Column:
        """The end of a bucket. For a compound period, or months from an origin, it is the start of the bucket that a time
        just behind it falls in."""
        if self.months and (self.us or self.origin is not None):
            near = [self.floor(from_micros(micros(start) + (self.mean_us + day * 86_400 * US))) for day in (-4, 0, 4)]
            return F.least(*[F.when(x > start, x) for x in near])
        if self.kind in ("all", "none"):
            return F.lit("9999-12-31 00:00:00").cast("timestamp_ntz") if self.kind == "all" else start + F.expr("INTERVAL '0.001' SECOND")
        return start + F.make_ym_interval(F.lit(0), F.lit(self.months)) if self.months else from_micros(micros(start) + self.us)

    def is_aligned(self, ts: Column) -> Column:
        return self.floor(ts) == ts


def _json_origin(said: int | str | None) -> int | None:
    if isinstance(said, str):
        at = datetime.fromisoformat(said)
        return round((at.astimezone(timezone.utc) if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp() * US)
    return None if said is None else int(said) * 1000


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def finer_or_equal(limit: Granularity) -> list[Granularity]:
    """Named granularities no coarser than limit, the coarsest first."""
    every = [Granularity.of(n) for n in PERIODS] + [Granularity("all")]
    return [g for g in reversed(every) if not limit.is_finer_than(g)]


def merged(some: list[Granularity]) -> Granularity | None:
    """The granularity that all are, or none."""
    return some[0] if some and all(g == some[0] for g in some) else None


# Path layouts of a time by unit.
LAYOUTS = {
    "default": ["'y='yyyy", "'m='MM", "'d='dd", "'H='HH", "'M='mm", "'S='ss"],
    "hive": ["'dt='yyyy", "-MM", "-dd", "-HH", "-mm", "-ss"],
    "lower": ["yyyy", "MM", "dd", "HH", "mm", "ss"],
}
_DEPTH = ["YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND"]


def path_of(ts: Column, unit: str, layout: str = "default") -> Column:
    parts = LAYOUTS[layout][: _DEPTH.index(unit) + 1]
    return F.date_format(ts, ("" if layout == "hive" else "/").join(parts))


def time_of_path(path: Column, unit: str) -> Column:
    """The time that a path of numbers stands for, to the unit; null if it has too few."""
    n = _DEPTH.index(unit) + 1
    numbers = F.regexp_extract_all(path, F.lit(r"(\d+)"), F.lit(1))
    at = lambda i, other: F.get(numbers, F.lit(i)).cast("int") if i < n else F.lit(other)
    made = F.make_timestamp_ntz(at(0, 1970), at(1, 1), at(2, 1), at(3, 0), at(4, 0), at(5, 0).cast("decimal(16,6)"))
    return F.when(F.size(numbers) >= n, made)


def interval_floor(seconds: Column, step: int) -> Column:
    """seconds / step * step with whole-number division, which goes towards zero."""
    return seconds - seconds % step


def epoch_day(ts: Column, zone: str = "UTC") -> Column:
    """Days from 1970-01-01 to the local date."""
    return F.unix_date(F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)))
