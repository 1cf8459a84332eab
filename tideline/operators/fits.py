"""ARIMA, seasonal ARIMA and Holt-Winters, one task per series and group of candidates.

Training thins series of 100,000 rows and more. Forecasts fit all rows: shorter series by the exact
likelihood, longer ones in stretches that run side by side (``functions/recursion.py``), and ARIMA
models of series too long for one task in chunks over many (``longfits.py``)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.fitting import Fit, HoltWinters, fit_arima, fit_long, fit_sarima
from tideline.operators.longfits import Job, fit_panel
from tideline.operators.regularize import MODEL_ROWS, thin
from tideline.operators.split import positions
from tideline.panel import Panel
from tideline.session import settle

SARIMA_ROWS = 30
SMOOTHING_ROWS = 20
DEFAULT_PERIOD = 12
LONG_ROWS = 2 * MODEL_ROWS  # from here on a task fits a series in stretches

ORDER = ["p", "d", "q", "seasonal_p", "seasonal_d", "seasonal_q", "m"]
ORDER_SCHEMA = ", ".join(f"{c} int" for c in ORDER)


def arima_grid(n: int, d: int) -> list[tuple[int, int]]:
    """Candidate ``(p, q)``, fewer for longer series."""
    top = 3 if n < 1000 else 2 if n < 10000 else 1
    return [(p, q) for p in range(top + 1) for q in range(top + 1) if p or d or q]


def sarima_grid(n: int, d: int) -> list[tuple[int, int, int, int]]:
    """Candidate ``(p, q, P, Q)``, fewer for longer series."""
    top = 2 if n < 1000 else 1
    seasonal_q = 1 if n < 10000 else 0
    every = range(top + 1)
    return [
        (p, q, sp, sq)
        for p in every
        for q in every
        for sp in range(2)
        for sq in range(seasonal_q + 1)
        if p or d or q or sp or sq
    ]


@dataclass(frozen=True)
class Grid:
    """A trainer that tries candidates, which different tasks may share: ``candidates(row, n)`` and
    ``fit(row, y, candidates)``."""

    candidates: Callable
    fit: Callable

    def share(self, row, n: int, lane: int, lanes: int) -> list[tuple[int, tuple]]:
        """The candidates of a lane with their places in the grid; like sizes go together."""
        ranked = sorted(enumerate(self.candidates(row, n)), key=lambda c: (max(c[1]), c[0]))
        return ranked[len(ranked) * lane // lanes : len(ranked) * (lane + 1) // lanes]

    def __call__(self, row, y: np.ndarray, actual: np.ndarray):
        _, _, order, predicted = self.on_test(row, y, actual, 0, 1)
        return order, predicted

    def on_test(self, row, y: np.ndarray, actual: np.ndarray, lane: int, lanes: int):
        """Error, place, order and forecast of the lane's candidate with the least test RMSE
        rounded to four digits; the first in the grid wins ties. None for a lane without candidates."""
        shared = self.share(row, len(y), lane, lanes)
        if not shared:
            return None
        places = {c: i for i, c in shared}
        best = None
        for fit in self.fit(row, y, [c for _, c in shared]):
            predicted = fit.forecast(len(actual))
            error = round(float(np.sqrt(np.mean((predicted - actual) ** 2))), 4)
            place = places[_candidate(fit.order, len(shared[0][1]))]
            if np.isfinite(error) and (best is None or (error, place) < best[:2]):
                best = (error, place, fit.order, predicted)
        if best is None:
            raise ValueError("no candidate could be fitted")
        return best


def _candidate(order: tuple, length: int) -> tuple:
    p, _, q, sp, _, sq, _ = order
    return (p, q) if length == 2 else (p, q, sp, sq)


def _arima_candidates(row, n: int) -> list:
    return arima_grid(n, int(row["recommended_d"]))


def _fit_arima(row, y: np.ndarray, candidates: list) -> list[Fit]:
    return fit_arima(y, int(row["recommended_d"]), candidates)


def _sarima_candidates(row, n: int) -> list:
    if n < SARIMA_ROWS:
        raise ValueError("fewer than 30 points")
    if not row["seasonal_period"] >= 2:
        raise ValueError("no seasonal period")
    return sarima_grid(n, int(row["recommended_d"]))


def _fit_sarima(row, y: np.ndarray, candidates: list) -> list[Fit]:
    return fit_sarima(y, int(row["recommended_d"]), int(row["seasonal_period"]), candidates)


def _season_length(row, seasonal: bool, n: int) -> int:
    if not seasonal:
        return 0
    known = row["seasonal_period"]
    period = int(known) if known == known and known is not None else DEFAULT_PERIOD
    if period < 2 or n < 2 * period:
        raise ValueError("fewer than two seasons")
    return period


def _train_smoothing(row, y, actual):
    if len(y) < SMOOTHING_ROWS:
        raise ValueError("fewer than 20 points")
    season = _season_length(row, row["seasonality"] in ("Moderate", "Strong"), len(y))
    fit = HoltWinters(y, row["trend_direction"] != "Flat", season)
    return (None,) * 6 + (season or None,), fit.forecast(len(actual))


TRAINERS: dict[str, Callable] = {
    "ARIMA": Grid(_arima_candidates, _fit_arima),
    "SARIMA": Grid(_sarima_candidates, _fit_sarima),
    "Holt-Winters": _train_smoothing,
}


def _future_orders(model: str, row) -> tuple[int, list[tuple], int]:
    """Differencing, candidates and season of a forecast on the whole series."""
    d = int(row["recommended_d"])
    if model == "ARIMA":
        return d, [(p, q) for p in range(4) for q in range(4) if p or d or q], 0
    known = row["seasonal_period"]
    m = int(known) if known == known and known is not None else DEFAULT_PERIOD
    if m < 2:
        raise ValueError("no seasonal period")
    return d, [(1, 1, 1, 1)], m


def _chosen(fits: list[Fit], steps: int, level: float):
    """Order, forecast and half widths of the fit with the least AIC."""
    fits = [f for f in fits if np.isfinite(f.aic)]
    if not fits:
        raise ValueError("no candidate could be fitted")
    best = min(fits, key=lambda f: f.aic)
    return best.order, best.forecast(steps), best.interval(steps, level)


def _future_arima(row, y, steps, level):
    d, grid, _ = _future_orders("ARIMA", row)
    return _chosen(fit_arima(y, d, grid) if len(y) < LONG_ROWS else fit_long(y, d, grid), steps, level)


def _future_sarima(row, y, steps, level):
    d, grid, m = _future_orders("SARIMA", row)
    return _chosen(fit_sarima(y, d, m, grid) if len(y) < LONG_ROWS else fit_long(y, d, grid, m), steps, level)


def _future_smoothing(row, y, steps, level):
    season = _season_length(row, row["seasonality"] != "None", len(y))
    fit = HoltWinters(y, row["trend_direction"] != "Flat", season)
    return (None,) * 6 + (season or None,), fit.forecast(steps), np.full(steps, np.nan)


FORECASTERS: dict[str, Callable] = {
    "ARIMA": _future_arima,
    "SARIMA": _future_sarima,
    "Holt-Winters": _future_smoothing,
}


@dataclass(frozen=True)
class Registry:
    """The fitted models by name."""

    trainers: dict[str, Callable]
    forecasters: dict[str, Callable]

    def with_model(self, name: str, trainer: Callable, forecaster: Callable) -> Registry:
        """A registry with one more model: ``trainer(row, y, actual) -> (order, predicted)`` and
        ``forecaster(row, y, steps, level) -> (order, forecast, half_width)``."""
        return Registry({**self.trainers, name: trainer}, {**self.forecasters, name: forecaster})


BUILT_IN = Registry(TRAINERS, FORECASTERS)


def _key_schema(panel: Panel) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in panel.df.schema.fields}
    return ", ".join(f"`{k}` {kinds[k]}" for k in panel.keys)


def recent(panel: Panel, limit: int = MODEL_ROWS) -> DataFrame:
    """Rows ``(keys, ts, value, _cut)``: of series with ``2 * limit`` rows or more the last ``limit``.

    The latest rows keep the series' own step, so a forecast stays on its calendar."""
    rows = panel.derive(panel.df.select(*panel.keys, "ts", "value"))
    if panel.size.largest < 2 * limit:
        return rows.df.withColumn("_cut", F.lit(False))
    n = F.col("_n")
    counts = rows.df.groupBy(*panel.keys).agg(F.count("*").alias("_n"))
    placed = panel.attach(positions(rows, "_pos"), counts).withColumn("_cut", n >= 2 * limit)
    return placed.where(~F.col("_cut") | (F.col("_pos") >= n - limit)).drop("_n", "_pos")


def lanes_for(panel: Panel, most: int = 16) -> int:
    """Tasks that share a series' candidates: as many as keep the cores busy with the series there are."""
    cores = panel.df.sparkSession.sparkContext.defaultParallelism
    return max(1, min(most, -(-cores // max(panel.size.series, 1))))


def train_forecasts(split: Panel, facts: DataFrame, model: str, registry: Registry = BUILT_IN, lanes: int | None = None) -> DataFrame:
    """Test rows of one model with its order; a failed fit is one row with the reason as ``status``.

    ``facts`` holds per series what the model asks for: differencing, season, trend. The candidates of a
    grid are shared among ``lanes`` tasks per series (by default by the cores there are)."""
    if split.size.largest >= 2 * MODEL_ROWS:
        split = thin(split)
    keys, train = split.keys, registry.trainers[model]
    wanted = ["recommended_d", "seasonal_period", "seasonality", "trend_direction"]
    rows = split.attach(split.df.select(*keys, "ts", "value", "is_train"), facts.select(*keys, *wanted))
    lanes = 1 if not isinstance(train, Grid) else lanes or lanes_for(split)
    names = [*keys, "model", "ts", "value", "yhat", *ORDER, "status"]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ts")
        first = group.iloc[0]
        tests = group[~group["is_train"]]
        error, place, lane = None, 0, int(first["_lane"])
        try:
            actual = tests["value"].to_numpy(float)
            fitted = group.loc[group["is_train"], "value"].to_numpy(float)
            if lanes == 1:
                order, predicted = train(first, fitted, actual)
            else:
                found = train.on_test(first, fitted, actual, lane, lanes)
                if found is None:
                    return pd.DataFrame(columns=[*names, "_lane", "_error", "_place"])
                error, place, order, predicted = found
            out = pd.DataFrame({"ts": tests["ts"], "value": actual, "yhat": predicted, "status": "ok"})
        except (ValueError, ArithmeticError, np.linalg.LinAlgError) as failure:
            order = (None,) * 7
            out = pd.DataFrame({"ts": [pd.NaT], "value": [np.nan], "yhat": [np.nan], "status": [f"failed: {failure}"]})
        for name, part in zip(ORDER, order):
            out[name] = pd.array([part] * len(out), dtype="Int32")
        for key in keys:
            out[key] = first[key]
        out = out.assign(model=model, _lane=lane, _error=np.nan if error is None else error, _place=place)
        return out[[*names, "_lane", "_error", "_place"]]

    schema = f"{_key_schema(split)}, model string, ts timestamp_ntz, value double, yhat double, {ORDER_SCHEMA}, status string"
    schema += ", _lane int, _error double, _place int"
    rows = rows.withColumn("_lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    done = rows.groupBy(*keys, "_lane").applyInPandas(run, schema)
    if lanes > 1:  # the best of the lanes; lanes without a fit stand last (NaN is the greatest number)
        done = settle(done)
        heads = done.groupBy(*keys).agg(F.min(F.struct("_error", "_place", "_lane")).alias("_best"))
        heads = heads.select(*keys, F.col("_best._lane").alias("_chosen"))
        done = split.attach(done, heads).where("_lane = _chosen")
    return done.select(*names)


def _huge(panel: Panel) -> DataFrame | None:
    """Keys of the series too long for one task."""
    if panel.size.largest < 2 * panel.group_rows:
        return None
    counts = panel.df.groupBy(*panel.keys).agg(F.count("*").alias("_n"))
    return settle(counts.where(F.col("_n") >= 2 * panel.group_rows).select(*panel.keys))


def _huge_forecasts(panel: Panel, huge: DataFrame, facts: DataFrame, model: str, steps: int, level: float, schema: str) -> DataFrame:
    """Forecasts of the named series, fitted chunk by chunk. Their number is at most the rows over
    ``2 * group_rows``, so their facts and forecasts fit the driver."""
    rows, jobs = [], {}
    blank = (None,) * 7

    def failed(key: tuple, why: object) -> list[tuple]:
        return [(*key, model, step, None, None, None, *blank, f"failed: {why}") for step in range(1, steps + 1)]

    for fact in huge.join(facts, panel.keys).collect():
        key = tuple(fact[k] for k in panel.keys)
        try:
            jobs[key] = Job(*_future_orders(model, fact))
        except ValueError as why:
            rows += failed(key, why)
    for key, fits in fit_panel(panel, jobs).items() if jobs else ():
        try:
            order, forecast, half = _chosen(fits, steps, level)
        except ValueError as why:
            rows += failed(key, why)
            continue
        order = [int(o) for o in order]
        rows += [(*key, model, i + 1, float(f), float(f - h), float(f + h), *order, "ok") for i, (f, h) in enumerate(zip(forecast, half))]
    return panel.df.sparkSession.createDataFrame(rows, schema)


def future_forecasts(
    panel: Panel, facts: DataFrame, model: str, steps: int, level: float = 0.95, registry: Registry = BUILT_IN
) -> DataFrame:
    """Rows ``(keys, model, step, forecast, lower, upper, order, status)`` from a fit on the whole series.

    Series too long for one task are fitted in chunks by the ARIMA models; the others take their
    ``recent`` rows, as many as a task holds, and ``status`` says so."""
    keys, predict = panel.keys, registry.forecasters[model]
    wanted = ["recommended_d", "seasonal_period", "seasonality", "trend_direction"]
    schema = (
        f"{_key_schema(panel)}, model string, step int, forecast double, lower double, upper double, "
        f"{ORDER_SCHEMA}, status string"
    )
    huge = _huge(panel) if predict in (_future_arima, _future_sarima) else None
    if huge is None:
        source = recent(panel, panel.group_rows)
    else:
        source = panel.df.join(F.broadcast(huge), keys, "left_anti").select(*keys, "ts", "value", F.lit(False).alias("_cut"))
    rows = panel.attach(source, facts.select(*keys, *wanted))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ts")
        first = group.iloc[0]
        try:
            order, forecast, half = predict(first, group["value"].to_numpy(float), steps, level)
            status = f"fitted on the last {len(group)} rows" if first["_cut"] else "ok"
        except (ValueError, ArithmeticError, np.linalg.LinAlgError) as error:
            order, status = (None,) * 7, f"failed: {error}"
            forecast = half = np.full(steps, np.nan)
        out = pd.DataFrame({"step": np.arange(1, steps + 1), "forecast": forecast})
        out["lower"], out["upper"] = out["forecast"] - half, out["forecast"] + half
        for name, part in zip(ORDER, order):
            out[name] = pd.array([part] * len(out), dtype="Int32")
        for key in keys:
            out[key] = first[key]
        return out.assign(model=model, status=status)[
            [*keys, "model", "step", "forecast", "lower", "upper", *ORDER, "status"]
        ]

    fitted = rows.groupBy(*keys).applyInPandas(run, schema)
    if huge is not None:
        fitted = fitted.unionByName(_huge_forecasts(panel, huge, facts, model, steps, level, schema))
    blank = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return fitted.select(
        *keys, "model", "step", blank("forecast"), blank("lower"), blank("upper"), *ORDER, "status"
    )
