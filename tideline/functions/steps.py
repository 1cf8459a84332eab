"""Calendar step codes: names, seasonal periods, and moving along a calendar."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideline.panel import from_micros, micros

MINUTE = 60_000_000
HOUR = 60 * MINUTE
DAY = 24 * HOUR

# Step code -> (name, seasonal period).
STEPS = {
    "H": ("Hourly", 24),
    "D": ("Daily", 7),
    "W": ("Weekly", 52),
    "M": ("Monthly", 12),
    "MS": ("Monthly", 12),
    "Q": ("Quarterly", 4),
    "QS": ("Quarterly", 4),
    "Y": ("Yearly", 1),
    "YS": ("Yearly", 1),
    "min": ("Minute", 60),
}
FIXED_STEPS = {"min": MINUTE, "H": HOUR, "D": DAY, "W": 7 * DAY}
MONTH_STEPS = {"M": 1, "MS": 1, "Q": 3, "QS": 3, "Y": 12, "YS": 12}


def _lookup(code: Column, table: dict) -> Column:
    entries = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in table.items()))
    return F.when(code.isNotNull(), F.try_element_at(entries, code))


def step_name(code: Column) -> Column:
    named = _lookup(code, {k: name for k, (name, _) in STEPS.items()})
    return F.when(code.isNull(), "Unknown").when(code == "IRREGULAR", "Irregular").otherwise(named)


def step_period(code: Column) -> Column:
    return _lookup(code, {k: period for k, (_, period) in STEPS.items()})


def advance(start: Column, code: Column, count: Column, month_ends: Column | None = None) -> Column:
    """The stamp ``count`` steps after ``start``; with ``month_ends`` on the last day of its month."""
    fixed = _lookup(code, FIXED_STEPS)
    months = _lookup(code, MONTH_STEPS)
    day_part = F.date_trunc("day", start).cast("timestamp_ntz")
    clock = micros(start) - micros(day_part)
    moved = F.add_months(start.cast("date"), (months * count).cast("int"))
    if month_ends is not None:
        moved = F.when(month_ends, F.last_day(moved)).otherwise(moved)
    return F.when(fixed.isNotNull(), from_micros(micros(start) + fixed * count)).otherwise(
        from_micros(micros(moved.cast("timestamp_ntz")) + clock)
    )


def steps_between(start: Column, end: Column, code: Column, month_ends: Column | None = None) -> Column:
    """Whole steps from ``start`` up to at most ``end``."""
    fixed = _lookup(code, FIXED_STEPS)
    months = _lookup(code, MONTH_STEPS)
    apart = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    rough = F.floor(apart / months).cast("long")
    whole = F.when(advance(start, code, rough, month_ends) > end, rough - 1).otherwise(rough)
    return F.when(fixed.isNotNull(), F.floor((micros(end) - micros(start)) / fixed)).otherwise(whole).cast("long")


def calendar_start(stamp: Column, code: Column) -> Column:
    """The first anchor of the calendar at or after a stamp, at its time of day: Sundays for weeks,
    the last day of months, quarters and years (``MS``, ``QS``, ``YS``: the first); other steps have none."""
    day = F.to_date(stamp)
    quarter, year = F.trunc(day, "quarter"), F.trunc(day, "year")
    month = F.trunc(day, "month")
    at_or_after = lambda first, months: F.when(day == first, first).otherwise(F.add_months(first, months))
    anchored = (
        F.when(code == "W", F.date_add(day, F.pmod(1 - F.dayofweek(day), F.lit(7))))
        .when(code == "M", F.last_day(day))
        .when(code == "Q", F.last_day(F.add_months(quarter, 2)))
        .when(code == "Y", F.last_day(F.add_months(year, 11)))
        .when(code == "MS", at_or_after(month, 1))
        .when(code == "QS", at_or_after(quarter, 3))
        .when(code == "YS", at_or_after(year, 12))
        .otherwise(day)
    )
    clock = micros(stamp) - micros(F.date_trunc("day", stamp).cast("timestamp_ntz"))
    return from_micros(micros(anchored.cast("timestamp_ntz")) + clock)


def at_month_ends(code: Column) -> Column:
    """Whether a calendar's anchors are last days of months."""
    return code.isin("M", "Q", "Y")
