"""Trend, decomposition, seasonality, autocorrelation, stationarity, signal quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.solve import adf_from_sums, lag_products, partial_autocorrelations
from tideline.operators.detect import detect_frequency
from tideline.operators.features import centred_mean
from tideline.operators.quantile import summarise
from tideline.operators.regularize import iqr_bounds
from tideline.operators.split import chunk_arrays, over_rows, positions
from tideline.panel import Panel, Size
from tideline.session import settle

UNKNOWN = "Unknown"


def banded(score: Column, bands: list[tuple[float, str]], rest: str) -> Column:
    """The label of the first band whose lower edge ``score`` reaches."""
    label = F.lit(rest)
    for edge, name in reversed(bands):
        label = F.when(score >= edge, name).otherwise(label)
    return label


def count_known(panel: Panel) -> DataFrame:
    return panel.df.groupBy(*panel.keys).agg(F.count("value").alias("n"))


def detect_trend(panel: Panel) -> DataFrame:
    """Straight-line fit on position: slope, fit, direction, strength, linear or exponential."""
    known = panel.known()
    placed = known.derive(positions(known))
    y, x = F.col("value"), F.col("pos").cast("double")
    log_y = F.when(y > 0, F.ln(y))
    flat = F.var_pop(y) == 0
    fit = summarise(
        placed,
        {
            "n": F.count("*"),
            "slope": F.regr_slope(y, x),
            "intercept": F.regr_intercept(y, x),
            "_r2": F.when(flat, 0.0).otherwise(F.regr_r2(y, x)),
            "_std": F.stddev_pop(y),
            "_positive": F.min(y) > 0,
            "_log_slope": F.regr_slope(log_y, x),
            "_log_intercept": F.regr_intercept(log_y, x),
        },
    )
    straight = y - (F.col("intercept") + F.col("slope") * x)
    curved = y - F.exp(F.col("_log_intercept") + F.col("_log_slope") * x)
    errors = (
        panel.attach(placed.df, fit)
        .groupBy(*panel.keys)
        .agg(F.sqrt(F.avg(straight**2)).alias("_line"), F.sqrt(F.avg(curved**2)).alias("_curve"))
    )
    r2, slope = F.col("_r2"), F.col("slope")
    enough = F.coalesce(F.col("n") >= 10, F.lit(False))
    tolerance = F.col("_std") * 0.0005
    direction = F.when(slope > tolerance, "Increasing").when(slope < -tolerance, "Decreasing").otherwise("Flat")
    strength = banded(r2, [(0.85, "Very Strong"), (0.65, "Strong"), (0.40, "Moderate"), (0.20, "Weak")], "Very Weak")
    curve = F.col("_positive") & (F.col("_curve") < F.col("_line") * 0.90)
    zero = F.lit(0.0)
    return (
        count_known(panel)
        .select(*panel.keys)
        .join(fit.join(errors, panel.keys), panel.keys, "left")
        .select(
            *panel.keys,
            F.when(enough, direction).otherwise(UNKNOWN).alias("trend_direction"),
            F.when(enough, F.when(curve, "Exponential").otherwise("Linear")).otherwise(UNKNOWN).alias("trend_type"),
            F.when(enough, slope).otherwise(zero).alias("slope"),
            F.when(enough, F.col("intercept")).otherwise(zero).alias("intercept"),
            F.when(enough, F.round(r2, 4)).otherwise(zero).alias("r2"),
            F.when(enough, strength).otherwise(UNKNOWN).alias("trend_strength"),
            F.when(enough, F.round(F.greatest(zero, F.least(F.lit(100.0), r2 * 100)), 1))
            .otherwise(zero)
            .alias("trend_confidence"),
        )
    )


# --- decomposition --------------------------------------------------------------


def decompose(panel: Panel, period: int, model: str = "additive") -> DataFrame:
    """Classical decomposition: rows with ``pos, value, trend, seasonal, resid``.

    Multiplicative falls back to additive for series with values at or below zero.
    Series shorter than two periods are left out."""
    known = panel.known()
    keys = panel.keys
    counts = known.df.groupBy(*keys).agg(F.count("*").alias("n"), F.min("value").alias("_min"))
    placed = known.derive(
        panel.attach(positions(known), counts.where(F.col("n") >= 2 * period))
        .withColumn("_ratio", F.lit(model == "multiplicative") & (F.col("_min") > 0))
        .drop("_min")
    )
    half = period // 2

    def moving(spec):
        inner = F.sum("value").over(spec.rowsBetween(-((period - 1) // 2), (period - 1) // 2))
        if period % 2 == 0:
            inner = inner + 0.5 * (F.lag("value", half).over(spec) + F.lead("value", half).over(spec))
        return inner / period

    pos, n = F.col("pos"), F.col("n")
    front, back = F.lit(half), n - 1 - half
    smooth = over_rows(placed, half, half, {"_ma": moving}, order="pos")
    smooth = smooth.withColumn("_ma", F.when(pos.between(front, back), F.col("_ma")))
    # Both ends continue the line through the nearest `period` trend points.
    head = (pos >= front) & (pos < F.least(front + period, back))
    tail = (pos >= F.greatest(front, back - period)) & (pos < back)
    x, ma = pos.cast("double"), F.col("_ma")
    ends = smooth.groupBy(*keys).agg(
        *[
            fit(F.when(side, ma), F.when(side, x)).alias(f"_{name}_{part}")
            for name, side in (("head", head), ("tail", tail))
            for part, fit in (("k", F.regr_slope), ("b", F.regr_intercept))
        ]
    )
    trend = (
        F.when(pos < front, F.col("_head_k") * x + F.col("_head_b"))
        .when(pos > back, F.col("_tail_k") * x + F.col("_tail_b"))
        .otherwise(ma)
    )
    value, ratio = F.col("value"), F.col("_ratio")
    lined = panel.attach(smooth, ends).withColumn("trend", trend).drop("_head_k", "_head_b", "_tail_k", "_tail_b", "_ma")
    lined = lined.withColumns(
        {
            "_phase": (pos % period).cast("int"),
            "_free": F.when(ratio, value / F.col("trend")).otherwise(value - F.col("trend")),
        }
    )
    means = lined.groupBy(*keys, "_phase").agg(F.avg("_free").alias("_m"), F.first("_ratio").alias("_r"))
    centre = F.avg("_m").over(Window.partitionBy(*keys))
    phases = means.withColumn("seasonal", F.when(F.col("_r"), F.col("_m") / centre).otherwise(F.col("_m") - centre))
    placed_phases = phases.select(*keys, "_phase", "seasonal")
    seasonal = F.col("seasonal")
    resid = F.when(ratio, value / seasonal / F.col("trend")).otherwise(value - seasonal - F.col("trend"))
    return panel.attach(lined, placed_phases, "_phase", period).select(
        *keys, "ts", "pos", "value", "trend", "seasonal", resid.alias("resid")
    )


# --- autocorrelation ------------------------------------------------------------


def lagged_sums(panel: Panel, columns: list[str], reach: int, pairs: list[tuple[str, str]]) -> DataFrame:
    """Per series arrays ``<a>_<b>``: the sum of ``a[t] * b[t + k]`` for ``k = 0..reach``.

    Chunks are multiplied inside the executors and only their short sums are
    shuffled, so neither series length nor the number of lags multiplies the data."""
    chunks = chunk_arrays(panel, reach, columns)
    for a, b in pairs:
        chunks = chunks.withColumn(f"{a}_{b}", lag_products(reach)(F.col(a), F.col(b), F.col("own")))
    names = [f"{a}_{b}" for a, b in pairs]
    long = chunks.select(*panel.keys, F.posexplode(F.arrays_zip(*names)).alias("lag", "sums"))
    totals = long.groupBy(*panel.keys, "lag").agg(*[F.sum(f"sums.{n}").alias(n) for n in names])
    packed = totals.groupBy(*panel.keys).agg(F.sort_array(F.collect_list(F.struct("lag", *names))).alias("_lags"))
    return packed.select(*panel.keys, *[F.col(f"_lags.{n}").alias(n) for n in names])


def autocorrelations(panel: Panel, lags: int) -> DataFrame:
    """Per series: ``n`` and the array ``acf`` for lags ``0..lags``."""
    known = panel.known()
    stats = known.df.groupBy(*panel.keys).agg(F.count("*").alias("n"), F.avg("value").alias("_mean"))
    centred = panel.attach(positions(known), stats.drop("n")).withColumn("y", F.col("value") - F.col("_mean"))
    sums = lagged_sums(known.derive(centred), ["y"], lags, [("y", "y")])
    upto = F.slice("y_y", 1, F.least(F.col("n"), F.lit(lags + 1)).cast("int"))
    scaled = F.transform(upto, lambda s: F.when(F.col("y_y")[0] != 0, s / F.col("y_y")[0]))
    return sums.join(stats.drop("_mean"), panel.keys).select(*panel.keys, "n", scaled.alias("acf"))


def acf(panel: Panel, lags: int = 30) -> DataFrame:
    """Rows ``(keys, lag, acf)`` for lags ``0..min(lags, n // 2 - 1)``."""
    found = autocorrelations(panel, lags)
    allowed = F.greatest(F.lit(1), F.least(F.lit(lags), F.floor(F.col("n") / 2) - 1)).cast("int")
    return found.select(*panel.keys, F.posexplode(F.slice("acf", 1, allowed + 1)).alias("lag", "acf"))


def acf_pacf(panel: Panel, lags: int = 30) -> DataFrame:
    """Rows ``(keys, lag, acf, pacf)``; partial values by Durbin-Levinson on the acf array."""
    found = autocorrelations(panel, lags)
    allowed = F.greatest(F.lit(1), F.least(F.lit(lags), F.floor(F.col("n") / 2) - 1)).cast("int")
    cut = found.select(*panel.keys, F.slice("acf", 1, allowed + 1).alias("acf"))
    both = cut.withColumn("pacf", partial_autocorrelations(F.col("acf")))
    return both.select(*panel.keys, F.posexplode(F.arrays_zip("acf", "pacf")).alias("lag", "_v")).select(
        *panel.keys, "lag", "_v.acf", "_v.pacf"
    )


def detect_seasonality(panel: Panel, frequency: DataFrame | None = None) -> DataFrame:
    """Seasonal strength, highest late autocorrelation and label, at the period the
    frequency implies. At most one pass per distinct period (there are seven)."""
    keys = panel.keys
    known = panel.known()
    frequency = settle(detect_frequency(panel)) if frequency is None else frequency
    periods = count_known(panel).join(frequency.select(*keys, "period"), keys, "left")
    usable = periods.where((F.col("n") >= 20) & (F.col("n") >= 2 * F.col("period")))
    present = [r["period"] for r in usable.select("period").distinct().collect()]
    parts = []
    for period in present:
        members = usable.where(F.col("period") == period).select(*keys)
        group = known if len(present) == 1 else known.derive(panel.attach(known.df, members))
        seasonal = decompose(group, period).groupBy(*keys).agg(
            (F.stddev_pop("seasonal") / F.greatest(F.stddev_pop("value"), F.lit(1e-9))).alias("strength")
        )
        reach = F.least(F.lit(3 * period), F.floor(F.col("n") / 2)).cast("int")
        late = F.slice("acf", period + 1, F.greatest(reach - period + 1, F.lit(0)))
        peak = F.array_max(F.transform(late, lambda v: F.abs(v)))
        peaks = autocorrelations(group, 3 * period).select(*keys, peak.alias("peak"))
        parts.append(seasonal.join(peaks, keys))
    if parts:
        measured = parts[0]
        for part in parts[1:]:
            measured = measured.unionByName(part)
        joined = periods.join(measured, keys, "left")
    else:
        nothing = F.lit(None).cast("double")
        joined = periods.withColumns({"strength": nothing, "peak": nothing})
    score = F.col("strength") * 0.6 + F.col("peak") * 0.4
    label = banded(score, [(0.70, "Strong"), (0.45, "Moderate"), (0.25, "Weak")], "None")
    found = F.col("strength").isNotNull() & F.col("peak").isNotNull()
    zero = F.lit(0.0)
    return joined.select(
        *keys,
        F.when(found, label).otherwise(UNKNOWN).alias("seasonality"),
        F.when(F.col("n") >= 20, F.col("period")).alias("seasonal_period"),
        F.when(F.col("strength").isNotNull(), F.round("strength", 3)).otherwise(zero).alias("seasonal_strength"),
        F.when(found, F.round("peak", 3)).otherwise(zero).alias("acf_peak"),
        F.when(found, F.round(F.least(score * 100, F.lit(100.0)), 1)).otherwise(zero).alias("seasonality_confidence"),
    )


# --- stationarity ---------------------------------------------------------------


def adf_sums(panel: Panel) -> DataFrame:
    """What the unit-root regression needs per series: lagged sums and both ends.

    Every entry of the regression's cross-product matrix is a lagged sum over the
    whole series less a few products at its ends, so ``lags + 1`` sums and ``lags``
    border rows replace the series. Constant series have no test and are left out."""
    keys = panel.keys
    known = panel.known()
    stats = known.df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("value").alias("_mean"), (F.max("value") > F.min("value")).alias("_moves")
    )
    stats = stats.where("_moves").drop("_moves")
    placed = positions(known)
    centred = panel.attach(placed, stats).withColumn("y", F.col("value") - F.col("_mean"))
    stepped = over_rows(
        known.derive(centred), 0, 1, {"d": lambda w: F.coalesce(F.lead("y").over(w) - F.col("y"), F.lit(0.0))}, order="pos"
    )
    reach = adf_lags(panel.size.largest) + 2
    rows = known.derive(stepped)
    sums = lagged_sums(rows, ["y", "d"], reach, [("y", "y"), ("y", "d"), ("d", "y"), ("d", "d")])
    item = F.struct("pos", "y", "d")
    border = reach + 2
    ends = rows.df.groupBy(*keys).agg(
        F.first("n").alias("n"),
        F.sum("y").alias("sum_y"),
        F.sum("d").alias("sum_d"),
        F.sort_array(F.collect_list(F.when(F.col("pos") < border, item))).alias("_head"),
        F.sort_array(F.collect_list(F.when(F.col("pos") >= F.col("n") - border, item))).alias("_tail"),
    )
    ends = ends.select(
        *keys,
        "n",
        "sum_y",
        "sum_d",
        *[F.col(f"_{side}.{c}").alias(f"{side}_{c}") for side in ("head", "tail") for c in ("y", "d")],
    )
    return sums.join(ends, keys)


def adf_lags(n: int) -> int:
    """Largest lag tried for ``n`` points."""
    import math

    return int(math.ceil(12.0 * (max(n, 1) / 100.0) ** 0.25))


def unit_root_test(panel: Panel, least: int = 10) -> DataFrame:
    """The bare test on the levels: ``adf_statistic, p_value, stationary`` from ``least`` points on."""
    keys = panel.keys
    known = panel.known()
    tested = adf_sums(known).where(F.col("n") >= least).select(*keys, adf_from_sums().alias("_t"))
    return tested.where(F.col("_t.p_value").isNotNull()).select(
        *keys,
        F.round("_t.statistic", 4).alias("adf_statistic"),
        F.round("_t.p_value", 4).alias("p_value"),
        (F.col("_t.p_value") < 0.05).alias("stationary"),
    )


def check_stationarity(panel: Panel) -> DataFrame:
    """Augmented Dickey-Fuller test (constant, lag by AIC) and the differencing it asks for."""
    keys = panel.keys
    levels = panel.known()
    first = over_rows(levels, 1, 0, {"_change": lambda w: F.col("value") - F.lag("value").over(w)})
    # Levels and changes are tested together, as two series told apart by one more key.
    both = first.select(
        *keys,
        "ts",
        F.inline(
            F.array(
                F.struct(F.lit(0).alias("_changed"), F.col("value").alias("value")),
                F.struct(F.lit(1).alias("_changed"), F.col("_change").alias("value")),
            )
        ),
    )
    size = levels.size
    pair = levels.derive(both, size=Size(2 * size.series, size.largest), keys=[*keys, "_changed"])
    tests = adf_sums(pair).select(*keys, "_changed", adf_from_sums().alias("_t"))
    of = lambda changed, field: F.max(F.when(F.col("_changed") == changed, F.col(f"_t.{field}")))
    wide = tests.groupBy(*keys).agg(
        of(0, "statistic").alias("_s0"), of(0, "p_value").alias("_p0"), of(1, "p_value").alias("_p1")
    )
    joined = count_known(panel).join(wide, keys, "left")
    usable = (F.col("n") >= 20) & F.col("_p0").isNotNull()
    stationary = F.coalesce(usable & (F.col("_p0") < 0.05), F.lit(False))
    failed = usable & ~stationary & F.col("_p1").isNull()
    d = F.when(stationary, 0).when(usable & (F.col("_p1") >= 0.05), 2).otherwise(1)
    settled = usable & ~failed
    said = F.when(stationary, "Series is stationary.").otherwise("Series requires differencing.")
    return joined.select(
        *keys,
        stationary.alias("stationary"),
        F.when(usable, F.round("_p0", 5)).alias("p_value"),
        d.alias("recommended_d"),
        F.when(settled, F.round((1 - F.col("_p0")) * 100, 1)).otherwise(0.0).alias("confidence"),
        F.when(settled, said).otherwise(UNKNOWN).alias("interpretation"),
        F.when(settled, F.round("_s0", 4)).alias("adf_statistic"),
    )


# --- signal quality and the merged report ---------------------------------------


def signal_quality(panel: Panel) -> DataFrame:
    """Missing and outlier share, noise, signal, and the quality bands they give."""
    keys = panel.keys
    known = panel.known()
    bounds = iqr_bounds(known, {"n": F.count("*"), "_mean": F.avg("value")})
    flagged = panel.attach(known.df, bounds)
    outside = (F.col("value") < F.col("lower_bound")) | (F.col("value") > F.col("upper_bound"))
    outliers = flagged.groupBy(*keys).agg((F.avg(outside.cast("double")) * 100).alias("_out"))
    smooth = centred_mean(known, bounds.select(*keys, "n", "_mean"))
    spread = smooth.groupBy(*keys).agg(
        F.stddev_pop(F.col("value") - F.col("smooth")).alias("_noise"),
        F.stddev_pop("smooth").alias("_signal"),
        F.count("*").alias("_n"),
    )
    missing = panel.df.groupBy(*keys).agg((F.avg(F.col("value").isNull().cast("double")) * 100).alias("_missing"))
    snr = F.col("_signal") / F.greatest(F.col("_noise"), F.lit(1e-9))
    penalty = F.when(snr < 1, 30.0).when(snr < 2, 15.0).otherwise(0.0)
    score = F.greatest(F.lit(0.0), 100 - F.col("_missing") * 0.6 - F.col("_out") * 0.8 - penalty)
    quality = banded(score, [(90, "Excellent"), (75, "Good"), (60, "Fair"), (40, "Poor")], "Very Poor")
    difficulty = banded(score, [(90, "Easy"), (70, "Moderate"), (50, "Hard")], "Very Hard")
    enough = F.coalesce(F.col("_n") >= 10, F.lit(False))
    number = lambda c, digits: F.when(enough, F.round(c, digits)).otherwise(F.lit(0.0))
    return (
        missing.join(outliers, keys, "left")
        .join(spread, keys, "left")
        .select(
            *keys,
            number(F.col("_noise"), 3).alias("noise_level"),
            number(F.col("_signal"), 3).alias("signal_strength"),
            number(snr, 3).alias("signal_to_noise_ratio"),
            number(F.col("_missing"), 2).alias("missing_percent"),
            number(F.col("_out"), 2).alias("outlier_percent"),
            F.when(enough, quality).otherwise(UNKNOWN).alias("data_quality"),
            F.when(enough, difficulty).otherwise(UNKNOWN).alias("forecast_difficulty"),
            number(score, 1).alias("quality_confidence"),
        )
    )


def analyze_series(panel: Panel) -> DataFrame:
    """Trend, seasonality and quality merged, with a model recommendation and a readiness grade."""
    keys = panel.keys
    frequency = settle(detect_frequency(panel))
    merged = (
        detect_trend(panel)
        .join(detect_seasonality(panel, frequency), keys)
        .join(signal_quality(panel), keys)
        .join(frequency.select(*keys, "frequency"), keys, "left")
    )
    trend, season = F.col("trend_strength"), F.col("seasonality")
    strong_trend = trend.isin("Strong", "Very Strong")
    rules = [
        ((season == "Strong") & strong_trend, "SARIMA", "Strong trend and strong seasonality detected."),
        (
            (season == "Strong") & trend.isin("Weak", "Very Weak"),
            "Exponential Smoothing",
            "Seasonality dominates the series.",
        ),
        (strong_trend & (season == "None"), "ARIMA", "Strong trend with little seasonality."),
        (
            F.col("frequency").isin("Hourly", "Daily", "Weekly", "Monthly"),
            "Prophet",
            "Regular calendar frequency detected.",
        ),
    ]
    model, why = F.lit("ARIMA"), F.lit(None).cast("string")
    for rule, name, reason in reversed(rules):
        model, why = F.when(rule, name).otherwise(model), F.when(rule, reason).otherwise(why)
    snr = F.col("signal_to_noise_ratio")
    noisy = F.when(snr < 1, "High noise detected; forecast confidence may be lower.")
    penalty = F.when(snr < 1, 25.0).when(snr < 2, 10.0).otherwise(0.0)
    score = F.greatest(
        F.lit(0.0), 100 - F.col("missing_percent") * 0.5 - F.col("outlier_percent") * 0.7 - penalty
    )
    grade = banded(score, [(90, "A+"), (80, "A"), (70, "B"), (60, "C")], "Needs Improvement")
    return merged.withColumns(
        {
            "confidence": F.col("quality_confidence"),
            "recommended_model": model,
            "recommendation_reason": F.concat_ws(" ", why, noisy),
            "forecast_readiness": F.round(score, 1),
            "forecast_grade": grade,
        }
    )
