"""Window features: rolling statistics, lags, differences, calendar parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.split import over_rows, positions, running_sums
from tideline.panel import Panel


CENTRED_ROWS = 250_000  # rows of one series a task may sort for a centred mean: each is entered three times


def _rolling(window: int) -> dict:
    """Trailing statistics, empty until ``window`` known values are in the frame."""

    def gated(aggregate):
        def make(spec):
            frame = spec.rowsBetween(1 - window, Window.currentRow)
            return F.when(F.count("value").over(frame) == window, aggregate("value").over(frame))

        return make

    return {
        f"rolling_mean_{window}": gated(F.avg),
        f"rolling_std_{window}": gated(F.stddev_samp),
        f"rolling_min_{window}": gated(F.min),
        f"rolling_max_{window}": gated(F.max),
    }


def _lags(count: int) -> dict:
    return {f"lag_{i}": (lambda spec, i=i: F.lag("value", i).over(spec)) for i in range(1, count + 1)}


def _difference(lag: int) -> dict:
    return {f"diff_{lag}": lambda spec: F.col("value") - F.lag("value", lag).over(spec)}


def _dates() -> dict:
    ts = F.col("ts")
    return {
        "year": F.year(ts),
        "month": F.month(ts),
        "day": F.dayofmonth(ts),
        "day_of_week": F.weekday(ts),
        "day_of_year": F.dayofyear(ts),
        "quarter": F.quarter(ts),
        "is_weekend": F.weekday(ts) >= 5,
    }


def rolling_stats(panel: Panel, window: int) -> DataFrame:
    return over_rows(panel, window - 1, 0, _rolling(window))


def rolling_band(panel: Panel, window: int) -> DataFrame:
    """Trailing mean with one standard deviation either side."""
    mean, std = F.col(f"rolling_mean_{window}"), F.col(f"rolling_std_{window}")
    return rolling_stats(panel, window).select(
        *panel.keys, "ts", "value", mean.alias("mean"), (mean + std).alias("upper"), (mean - std).alias("lower")
    )


def lag_features(panel: Panel, count: int = 3) -> DataFrame:
    return over_rows(panel, count, 0, _lags(count))


def difference(panel: Panel, lag: int = 1) -> DataFrame:
    """Change against the row ``lag`` places earlier."""
    return over_rows(panel, lag, 0, _difference(lag))


def date_features(panel: Panel) -> DataFrame:
    return panel.df.withColumns(_dates())


def month_averages(panel: Panel) -> DataFrame:
    """Mean by calendar month, across years."""
    return panel.df.groupBy(*panel.keys, F.month("ts").alias("month")).agg(F.avg("value").alias("avg_value"))


def all_features(panel: Panel, lags: int = 3, window: int = 7, diff: int = 1) -> DataFrame:
    """Calendar, lag, rolling and difference features from one sort of each series."""
    windows = {**_lags(lags), **_rolling(window), **_difference(diff)}
    reach = max(lags, window - 1, diff)
    return over_rows(panel, reach, 0, windows).withColumns(_dates())


def centred_mean(panel: Panel, counts: DataFrame) -> DataFrame:
    """Add ``smooth``: the centred rolling mean over ``max(5, n // 25)`` rows.

    ``counts`` gives ``n`` and the mean ``_mean`` per series; sums run on distances from
    the rounded mean, which keeps them small and, for whole numbers, exact. Because the frame
    differs per series, each value is entered where it joins the frame and taken out
    where it leaves, and one running sum gives every frame total. A chunk holds about
    ``CENTRED_ROWS`` of these entries, however long the series is."""
    panel = Panel(panel.df, panel.keys, min(panel.group_rows, CENTRED_ROWS), panel.measure, panel.broadcast_series)
    width = F.greatest(F.lit(5), F.floor(F.col("n") / 25))
    back, ahead = F.floor(width / 2), F.floor((width - 1) / 2)
    counts = counts.withColumn("_mean", F.round("_mean"))
    off = F.col("value") - F.col("_mean")
    entry = lambda at, value, total, count: F.struct(
        at.cast("long").alias("at"), value.alias("own"), total.alias("total"), count.alias("count")
    )
    pos, none = F.col("pos"), F.lit(None).cast("double")
    joins = entry(F.greatest(pos - ahead, F.lit(0)), none, off, F.lit(1))
    leaves = F.when(pos + back + 1 < F.col("n"), entry(pos + back + 1, none, -off, F.lit(-1)))
    centre = entry(pos, F.col("value"), F.lit(0.0), F.lit(0))
    moves = panel.attach(positions(panel, ties=["value"]), counts).select(
        *panel.keys, "n", "_mean", F.inline(F.filter(F.array(joins, leaves, centre), lambda e: e.isNotNull()))
    )
    summed = running_sums(panel.derive(moves), {"_sum": "total", "_rows": "count"}, order="at", per_place=3)
    return summed.where(F.col("own").isNotNull()).select(
        *panel.keys,
        F.col("at").alias("pos"),
        F.col("own").alias("value"),
        (F.col("_mean") + F.col("_sum") / F.col("_rows")).alias("smooth"),
    )
