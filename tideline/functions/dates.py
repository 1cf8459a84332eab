"""Reading text and numbers as timestamps, as plain column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of a missing entry.
NULL_MARKERS = ["", "nan", "None", "NULL", "null", "NaT"]

# The range Spark documents for timestamps.
FIRST_STAMP, LAST_STAMP = "0001-01-01 00:00:00", "9999-12-31 23:59:59.999999"

EXCEL_EPOCH = "1899-12-30"
DAY_MICROS = 86_400_000_000
# Medians (exclusive bounds) that point at serial days, milliseconds or seconds.
UNIT_RANGES = {"excel": (20_000, 90_000), "ms": (1e11, None), "s": (1e8, 1e11)}


def _try_format(text: Column, pattern: str) -> Column:
    return F.try_to_timestamp(text, F.lit(pattern))


def _in_range(plain: Column) -> Column:
    """The stamp, or NULL outside the years 1 to 9999."""
    first, last = (F.lit(edge).cast("timestamp_ntz") for edge in (FIRST_STAMP, LAST_STAMP))
    return F.when(plain.between(first, last), plain)


def bound(value: Column, make: Callable[[Column], Column]) -> Column:
    """``make`` of a value that is computed once however often ``make`` uses it. The optimizer copies
    a plain expression into every place that names it."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def text_to_time(text: Column, dayfirst: bool = False) -> Column:
    """Mixed date spellings to ``timestamp_ntz``; zoned stamps are shifted to UTC.

    Each value is read month first, and day first where that fails (the other way
    round with ``dayfirst``)."""
    parsed = lambda s: bound(_parsed(s, dayfirst).cast("timestamp_ntz"), _in_range)
    return bound(F.trim(text.cast("string")), lambda s: F.when(~s.isin(NULL_MARKERS), parsed(s)))


def _parsed(s: Column, dayfirst: bool) -> Column:
    """The stamp that a trimmed text spells, by its shape."""
    slashed = F.regexp_replace(s, "[.-]", "/")
    month_first = _try_format(slashed, "M/d/yyyy[ H:mm[:ss]]")
    day_first = _try_format(slashed, "d/M/yyyy[ H:mm[:ss]]")
    numeric_order = [day_first, month_first] if dayfirst else [month_first, day_first]
    worded = F.regexp_replace(s, ",", "")
    return (
        F.when(s.rlike(r"^\d{4}-"), s.try_cast("timestamp"))
        .when(s.rlike(r"^\d{4}$"), _try_format(s, "yyyy"))
        .when(s.rlike(r"^\d{8}$"), _try_format(s, "yyyyMMdd"))
        .when(s.rlike(r"^\d{4}/"), F.regexp_replace(s, "/", "-").try_cast("timestamp"))
        .when(s.rlike(r"^\d{1,2}[/.-]\d{1,2}[/.-]\d{4}"), F.coalesce(*numeric_order))
        .when(
            s.rlike(r"^[A-Za-z]{3,9} \d{1,2},? \d{4}"),
            F.coalesce(_try_format(worded, "MMM d yyyy"), _try_format(worded, "MMMM d yyyy")),
        )
        .when(
            s.rlike(r"^\d{1,2} [A-Za-z]{3,9} \d{4}"),
            F.coalesce(_try_format(s, "d MMM yyyy"), _try_format(s, "d MMMM yyyy")),
        )
    )


def number_to_time(value: Column, unit: str) -> Column:
    """Excel serial days, epoch seconds or epoch milliseconds to ``timestamp_ntz``."""
    v = value.cast("double")
    if unit == "excel":
        epoch = F.unix_micros(F.lit(EXCEL_EPOCH).cast("timestamp"))
        us = F.try_add(F.round(v * F.lit(float(DAY_MICROS))).try_cast("bigint"), epoch)
    else:
        scale = {"s": 1e6, "ms": 1e3}[unit]
        us = F.round(v * F.lit(scale)).try_cast("bigint")
    return _in_range(F.timestamp_micros(us).cast("timestamp_ntz"))
