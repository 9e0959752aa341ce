"""Cron schedules: five-field specs as bit masks, and the next slot as a column expression in UTC."""

from __future__ import annotations

import bisect
import datetime
import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = (("minute", 0, 59), ("hour", 0, 23), ("day", 1, 31), ("month", 1, 12), ("weekday", 0, 6))
HORIZON_DAYS, NEAR_DAYS = 9 * 366, 35
EPOCH = datetime.date(1970, 1, 1)


class CronError(ValueError):
    """A spec that is no cron schedule, or has no slot within nine years."""


def parse(spec: str) -> dict[str, tuple[int, bool]]:
    """Field -> (mask, restricted). Lists, ranges, and steps on ``*`` or a range; a step on a single value is refused."""
    parts = spec.split()
    if len(parts) != 5:
        raise CronError(f"five fields are needed: {spec!r}")
    out = {}
    for text, (name, low, high) in zip(parts, FIELDS, strict=True):
        mask = 0
        for term in text.split(","):
            m = re.fullmatch(r"(?:(\*)|(\d+)(?:-(\d+))?)(?:/(\d+))?", term, re.ASCII)
            if not m:
                raise CronError(f"{name}: {term!r} in {spec!r}")
            star, a, b, step = m.groups()
            if step is not None and not star and b is None:
                raise CronError(f"{name}: a step needs * or a range: {term!r}")
            a, b = (low, high) if star else (int(a), int(b if b is not None else a))
            every = int(step) if step is not None else 1
            if not low <= a <= b <= high or every < 1:
                raise CronError(f"{name}: {term!r} is out of range")
            for v in range(a, b + 1, every):
                mask |= 1 << v
        out[name] = (mask, not text.startswith("*"))
    return out


def next_slot(after: Column, spec: str) -> Column:
    """The first matching minute strictly after a timestamp (session time zone UTC); null without one within nine years.

    Where day and weekday are both restricted, either may match. Only days are enumerated, five weeks of them first; hours and minutes of a
    day are constants of the spec.
    """
    f = parse(spec)
    minutes = [h * 60 + m for h in range(24) if f["hour"][0] >> h & 1 for m in range(60) if f["minute"][0] >> m & 1]
    today = after.cast("date")
    slots = F.lit(minutes[0]) if len(minutes) == 1 else None

    def fits(d: Column) -> Column:
        bit = lambda name, v: F.getbit(F.lit(f[name][0]).cast("long"), v) == 1
        day, week = bit("day", F.dayofmonth(d)), bit("weekday", F.dayofweek(d) - 1)
        both = f["day"][1] and f["weekday"][1]
        return bit("month", F.month(d)) & ((day | week) if both else (day & week))

    minute_now = F.hour(after) * 60 + F.minute(after)
    later = F.when(minute_now < minutes[0], F.lit(minutes[0]))
    if slots is None:
        later = F.array_min(F.filter(F.array(*map(F.lit, minutes)), lambda m: m > minute_now))
    within = lambda n: F.get(F.filter(F.sequence(F.date_add(today, 1), F.date_add(today, n)), fits), F.lit(0))
    day = F.coalesce(within(NEAR_DAYS), within(HORIZON_DAYS))  # few specs need the second
    at = lambda d, m: F.timestamp_seconds(F.unix_date(d).cast("long") * 86400 + m.cast("long") * 60)
    return F.when(fits(today) & later.isNotNull(), at(today, later)).otherwise(at(day, F.lit(minutes[0])))


@lru_cache(4096)
def _fields(spec: str) -> tuple[dict[str, tuple[int, bool]], list[int]]:
    f = parse(spec)
    return f, [h * 60 + m for h in range(24) if f["hour"][0] >> h & 1 for m in range(60) if f["minute"][0] >> m & 1]


def next_after(spec: str, nanos: int) -> int:
    """``next_slot`` for one instant (nanoseconds since 1970 in UTC), on the driver or in a Python worker."""
    f, minutes = _fields(spec)
    day, rest = divmod(nanos // 60_000_000_000, 1440)
    first = bisect.bisect_right(minutes, rest)
    for d in range(day, day + HORIZON_DAYS + 1):
        date = EPOCH + datetime.timedelta(days=d)
        on_day, on_week = f["day"][0] >> date.day & 1, f["weekday"][0] >> date.isoweekday() % 7 & 1
        fits = (on_day or on_week) if f["day"][1] and f["weekday"][1] else (on_day and on_week)
        if f["month"][0] >> date.month & 1 and fits and (d > day or first < len(minutes)):
            return (d * 1440 + minutes[first if d == day else 0]) * 60_000_000_000
    raise CronError(f"{spec!r} has no slot within nine years")
