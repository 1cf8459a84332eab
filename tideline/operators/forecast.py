"""Training, choosing and applying forecasting models over a panel."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators.baselines import (
    MODELS,
    baseline_forecasts,
    baseline_future,
    best_models,
    future_dates,
    leaderboard,
    metrics,
    model_name,
    split_train_test,
)
from tideline.operators.detect import detect_frequency
from tideline.operators.fits import BUILT_IN, ORDER, Registry, future_forecasts, train_forecasts
from tideline.operators.regularize import MODEL_ROWS, prepare_forecast, stride, thin
from tideline.operators.stats import analyze_series, check_stationarity, detect_seasonality, detect_trend
from tideline.panel import Panel
from tideline.session import settle

CONSTANT = MODELS[:2]


def known_model(name: str, registry: Registry = BUILT_IN) -> str:
    """A model of the registry or a constant one; other names are an error."""
    return name if name in registry.trainers else model_name(name)


def model_facts(panel: Panel) -> DataFrame:
    """Per series what the models ask for: differencing, season and trend."""
    keys = panel.keys
    return (
        check_stationarity(panel)
        .select(*keys, "recommended_d")
        .join(detect_seasonality(panel).select(*keys, "seasonal_period", "seasonality"), keys)
        .join(detect_trend(panel).select(*keys, "trend_direction"), keys)
    )


def thinned_season(facts: DataFrame, split: Panel) -> DataFrame:
    """Facts with the season counted in the rows thinning leaves; none where the stride does not divide it."""
    strides = split.df.groupBy(*split.keys).agg(stride(F.count("*")).alias("_stride"))
    step, season = F.col("_stride"), F.col("seasonal_period")
    left = F.when((season % step == 0) & (season >= 2 * step), season / step)
    kind = facts.schema["seasonal_period"].dataType
    return facts.join(strides, split.keys).select(
        *split.keys,
        "recommended_d",
        F.when(step == 1, season).otherwise(left).cast(kind).alias("seasonal_period"),
        F.when((step == 1) | left.isNotNull(), F.col("seasonality")).otherwise("None").alias("seasonality"),
        "trend_direction",
    )


def train_models(split: Panel, models: list[str] = MODELS, registry: Registry = BUILT_IN) -> DataFrame:
    """Test forecasts of all chosen models in one table; failures carry their reason.

    Fitted models see every ``stride``-th row of a very long series, constant ones all rows."""
    models = [known_model(m, registry) for m in models]
    constant = [m for m in models if m in CONSTANT]
    fitted = [m for m in models if m not in CONSTANT]
    parts = []
    if constant:
        blanks = [F.lit(None).cast("int").alias(c) for c in ORDER]
        parts.append(baseline_forecasts(split, constant).select("*", *blanks, F.lit("ok").alias("status")))
    if fitted:
        train = split.derive(split.df.where("is_train").select(*split.keys, "ts", "value"))
        facts, bounded = model_facts(train), split
        if split.size.largest > MODEL_ROWS:
            facts = thinned_season(facts, split)
            bounded = split.derive(settle(thin(split).df), keep_size=False)
        facts = settle(facts)
        parts += [train_forecasts(bounded, facts, m, registry) for m in fitted]
    if not parts:
        return train_models(split, list(CONSTANT)[:1]).where("false")
    return reduce(DataFrame.unionByName, parts)


def score_models(forecasts: DataFrame, keys: list[str]) -> DataFrame:
    return leaderboard(metrics(forecasts.where("status = 'ok'"), [*keys, "model"]), keys)


@dataclass(frozen=True)
class Forecast:
    """What a run yields: prepared rows, the train/test split, test forecasts, leaderboard, reports."""

    panel: Panel
    split: Panel
    forecasts: DataFrame
    board: DataFrame
    best: DataFrame
    report: DataFrame
    skipped: DataFrame


def run_forecast(
    panel: Panel,
    tiebreak: str,
    models: list[str] = MODELS,
    dedup_values: bool = False,
    registry: Registry = BUILT_IN,
) -> Forecast:
    """Prepare, split, train, rank. The split and the fits are written once and read by every later step."""
    prepared = prepare_forecast(panel, tiebreak, dedup_values)
    split = split_train_test(prepared.panel)
    split = split.derive(settle(split.df))
    forecasts = train_models(split, models, registry)
    if any(known_model(m, registry) not in CONSTANT for m in models):
        forecasts = settle(forecasts)
    board = score_models(forecasts, panel.keys)
    rows = split.derive(split.df.select(*panel.keys, "ts", "value"))
    return Forecast(
        rows, split, forecasts, board, best_models(board, panel.keys), prepared.report, prepared.skipped
    )


def future_forecast(
    panel: Panel,
    steps: int,
    models: list[str] | None = None,
    chosen: DataFrame | None = None,
    level: float = 0.95,
    registry: Registry = BUILT_IN,
) -> DataFrame:
    """Future rows ``(keys, model, step, ts, forecast, lower, upper, status)``.

    Either for every model in ``models``, or for the model ``chosen`` names per
    series (``keys, best_model``): then each series is refitted by its own model only."""
    keys = panel.keys
    panel = panel.known()
    every = list(dict.fromkeys([*MODELS, *registry.forecasters]))
    models = every if models is None else [known_model(m, registry) for m in models]
    dates = future_dates(panel, steps)
    facts, parts = None, []

    def members(model: str) -> Panel:
        if chosen is None:
            return panel
        return panel.derive(panel.attach(panel.df, chosen.where(F.col("best_model") == model).select(*keys)))

    if chosen is not None:
        present = {r["best_model"] for r in chosen.select("best_model").distinct().collect()}
        models = [m for m in models if m in present]
    for model in models:
        if model in CONSTANT:
            parts.append(baseline_future(members(model), steps, [model], dates).withColumn("status", F.lit("ok")))
            continue
        if facts is None:
            facts = settle(model_facts(panel))
        fitted = future_forecasts(members(model), facts, model, steps, level, registry)
        parts.append(
            fitted.join(dates, [*keys, "step"]).select(
                *keys, "model", "step", "ts", "forecast", "lower", "upper", "status"
            )
        )
    if not parts:  # no series, or none with a model to its name
        return future_forecast(panel, steps, list(CONSTANT)[:1]).where("false")
    return reduce(DataFrame.unionByName, parts)


def export_table(future: DataFrame, keys: list[str]) -> DataFrame:
    """The forecast as exported: Date, Forecast, Lower_CI, Upper_CI."""
    return future.select(
        *keys,
        F.col("ts").alias("Date"),
        F.col("forecast").alias("Forecast"),
        F.col("lower").alias("Lower_CI"),
        F.col("upper").alias("Upper_CI"),
    )


def summary(result: Forecast, dataset_type: str) -> DataFrame:
    """One row per series: data set type, frequency, chosen model, readiness and reason."""
    keys = result.panel.keys
    series = analyze_series(result.panel).select(*keys, "frequency", "forecast_readiness", "forecast_grade")
    reason = F.concat(F.lit("Best model selected from training results: "), F.col("best_model"), F.lit("."))
    return series.join(result.best, keys).select(
        *keys,
        F.lit(dataset_type).alias("dataset_type"),
        "frequency",
        F.col("best_model").alias("recommended_model"),
        "forecast_readiness",
        "forecast_grade",
        reason.alias("recommendation_reason"),
    )
