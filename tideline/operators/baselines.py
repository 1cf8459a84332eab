"""Split, metrics, naive and moving-average forecasts, leaderboard, future dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.steps import STEPS, advance, at_month_ends, calendar_start
from tideline.operators.detect import detect_frequency
from tideline.operators.split import positions
from tideline.panel import Panel

# Training order, which also settles ties on the leaderboard.
MODELS = ["Naive", "Moving Average", "ARIMA", "SARIMA", "Holt-Winters"]
ALIASES = {"Exponential Smoothing": "Holt-Winters"}


def model_name(name: str) -> str:
    name = ALIASES.get(name, name)
    if name not in MODELS:
        raise ValueError(f"unknown model: {name}")
    return name


def test_share(n: Column) -> Column:
    return (
        F.when(n < 100, F.lit(0.30)).when(n < 1000, F.lit(0.20)).when(n < 10000, F.lit(0.15)).otherwise(F.lit(0.10))
    ).cast("double")


def split_train_test(panel: Panel) -> Panel:
    """Rows with ``pos``, ``n``, ``n_train`` and ``is_train``; the test part is the end of the series."""
    counts = panel.df.groupBy(*panel.keys).agg(F.count("*").alias("n"))
    n_train = F.floor(F.col("n") * (F.lit(1.0) - test_share(F.col("n")))).cast("long")
    counts = counts.withColumn("n_train", n_train)
    rows = panel.attach(positions(panel), counts)
    return panel.derive(rows.withColumn("is_train", F.col("pos") < F.col("n_train")))


def metrics(forecasts: DataFrame, by: list[str]) -> DataFrame:
    """MAE, RMSE, MAPE and R2 of columns ``value`` (actual) and ``yhat``."""
    y, e = F.col("value"), F.col("value") - F.col("yhat")
    raw = forecasts.groupBy(*by).agg(
        F.avg(F.abs(e)).alias("_mae"),
        F.avg(e**2).alias("_mse"),
        F.avg(F.abs(e / F.greatest(F.abs(y), F.lit(1e-9)))).alias("_mape"),
        F.var_pop(y).alias("_var"),
    )
    r2 = F.when(F.col("_var") > 0, 1 - F.col("_mse") / F.col("_var")).when(F.col("_mse") == 0, 1.0).otherwise(0.0)
    return raw.select(
        *by,
        F.round("_mae", 4).alias("mae"),
        F.round(F.sqrt("_mse"), 4).alias("rmse"),
        F.round(F.col("_mape") * 100, 2).alias("mape"),
        F.round(r2, 4).alias("r2"),
    )


def safe_mape(forecasts: DataFrame, by: list[str]) -> DataFrame:
    """MAPE over rows whose actual is not zero; NULL where there is none."""
    y = F.col("value")
    error = F.when(y != 0, F.abs((y - F.col("yhat")) / y))
    return forecasts.groupBy(*by).agg((F.avg(error) * 100).alias("safe_mape"))


def _tail_window(n: Column) -> Column:
    return F.least(F.lit(10), F.greatest(F.lit(3), F.floor(n / 10)))


def constant_levels(rows: DataFrame, keys: list[str], length: str) -> DataFrame:
    """Last value and mean of the last few values over the first ``length`` rows of each series."""
    n = F.col(length)
    used = rows.where(F.col("pos") < n)
    tail = F.when(F.col("pos") >= n - _tail_window(n), F.col("value"))
    return used.groupBy(*keys).agg(
        F.max_by("value", "pos").alias("Naive"), F.avg(tail).alias("Moving Average")
    )


def _stack(levels: DataFrame, keys: list[str], models: list[str]) -> DataFrame:
    entries = [F.struct(F.lit(m).alias("model"), F.col(f"`{m}`").alias("yhat")) for m in models]
    return levels.select(*keys, F.inline(F.array(*entries)))


def baseline_forecasts(split: Panel, models: list[str] = MODELS[:2]) -> DataFrame:
    """Test rows ``(keys, model, ts, value, yhat)`` of the constant models.

    Per series there are two rows of levels, so the test rows only meet a small table."""
    keys = split.keys
    levels = constant_levels(split.df, keys, "n_train")
    tests = split.attach(split.df.where(~F.col("is_train")), levels)
    stacked = _stack(tests.select(*keys, "ts", "value", *[f"`{m}`" for m in models]), [*keys, "ts", "value"], models)
    return stacked.select(*keys, "model", "ts", "value", "yhat")


def leaderboard(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Rank per metric (ties share the least rank), their sum, and the final place.

    At most one row per model and series; a missing metric ranks last."""
    worst = {"rmse": "inf", "mae": "inf", "mape": "inf", "r2": "-inf"}
    rows = scores.withColumns({c: F.coalesce(F.col(c), F.lit(float(v))) for c, v in worst.items()})
    per = Window.partitionBy(*keys)
    ranks = {
        f"{c}_rank": F.rank().over(per.orderBy(F.desc(c) if c == "r2" else F.asc(c))) for c in worst
    }
    rows = rows.withColumns(ranks)
    total = F.col("rmse_rank") + F.col("mae_rank") + F.col("mape_rank") + F.col("r2_rank")
    known = F.array_position(F.array(*[F.lit(m) for m in MODELS]), F.col("model"))
    ordinal = F.when(known > 0, known).otherwise(len(MODELS) + 1)
    rows = rows.withColumn("overall_score", total)
    place = F.row_number().over(per.orderBy("overall_score", ordinal, "model"))
    return rows.withColumn("place", place)


def best_models(board: DataFrame, keys: list[str]) -> DataFrame:
    return board.where(F.col("place") == 1).select(*keys, F.col("model").alias("best_model"))


def future_dates(panel: Panel, steps: int, frequency: DataFrame | None = None, anchor: str = "first") -> DataFrame:
    """``steps`` stamps after the last one of each series; irregular series step by days.

    ``anchor="calendar"`` steps from the first anchor at or after the last stamp (which is not among
    the stamps): on Sundays, and on the last day of months, quarters and years."""
    if anchor not in ("first", "calendar"):
        raise ValueError(f"no such anchor: {anchor}")
    frequency = detect_frequency(panel) if frequency is None else frequency
    code = F.when(F.col("code").isin(list(STEPS)), F.col("code")).otherwise("D")
    each = F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step")
    ahead = frequency.select(*panel.keys, "last_ts", "month_ends", code.alias("_code"), each)
    if anchor == "calendar":
        start = calendar_start(F.col("last_ts"), F.col("_code"))
        ahead = ahead.withColumns({"last_ts": start, "month_ends": at_month_ends(F.col("_code"))})
    stamp = advance(F.col("last_ts"), F.col("_code"), F.col("step"), F.col("month_ends"))
    return ahead.select(*panel.keys, "step", stamp.alias("ts"))


def baseline_future(panel: Panel, steps: int, models: list[str] = MODELS[:2], dates: DataFrame | None = None) -> DataFrame:
    """Constant forecasts on future dates, without bounds."""
    keys = panel.keys
    known = panel.known()
    counts = known.df.groupBy(*keys).agg(F.count("*").alias("n"))
    levels = constant_levels(panel.attach(positions(known), counts), keys, "n")
    dates = future_dates(panel, steps) if dates is None else dates
    none = F.lit(None).cast("double")
    return (
        dates.join(_stack(levels, keys, models), keys)
        .withColumnRenamed("yhat", "forecast")
        .select(*keys, "model", "step", "ts", "forecast", none.alias("lower"), none.alias("upper"))
    )
