"""Anomaly flags by z-score, quartile range and moving-average deviation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators.features import rolling_stats
from tideline.operators.regularize import iqr_bounds, zscore
from tideline.panel import Panel


def zscore_anomalies(panel: Panel, threshold: float = 3.0) -> DataFrame:
    """Every row with ``z`` and ``is_anomaly``; no flag where the deviation is zero or undefined."""
    flag = F.coalesce(F.abs("z") > threshold, F.lit(False))
    return zscore(panel).withColumn("is_anomaly", flag)


def iqr_anomalies(panel: Panel) -> DataFrame:
    bounds = iqr_bounds(panel).select(*panel.keys, "lower_bound", "upper_bound")
    outside = (F.col("value") < F.col("lower_bound")) | (F.col("value") > F.col("upper_bound"))
    return panel.attach(panel.df, bounds).withColumn("is_anomaly", F.coalesce(outside, F.lit(False)))


def moving_average_anomalies(panel: Panel, window: int = 7, threshold: float = 2.0) -> DataFrame:
    """Rows further than ``threshold`` deviations from their trailing mean (which includes them)."""
    rolled = rolling_stats(panel, window)
    mean, reach = F.col(f"rolling_mean_{window}"), threshold * F.col(f"rolling_std_{window}")
    outside = (F.col("value") > mean + reach) | (F.col("value") < mean - reach)
    return rolled.select(
        *panel.df.columns,
        mean.alias("moving_avg"),
        (mean + reach).alias("upper_bound"),
        (mean - reach).alias("lower_bound"),
        F.coalesce(outside, F.lit(False)).alias("is_anomaly"),
    )


def count_anomalies(keys: list[str], flagged: DataFrame) -> DataFrame:
    return flagged.groupBy(*keys).agg(
        F.count_if("is_anomaly").alias("anomalies"), F.count("*").alias("points")
    )


def list_anomalies(keys: list[str], flagged: DataFrame) -> DataFrame:
    return flagged.where("is_anomaly").select(*keys, "ts", "value")
