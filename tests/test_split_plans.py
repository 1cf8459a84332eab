"""Cutting a series into chunks must not change any result."""

import numpy as np
import pandas as pd
import pytest
from series import ar1, frame, panel, rows, season, walk

from tideline.operators import anomaly, baselines, detect, features, stats
from tideline.operators import regularize as reg
from tideline.operators.quantile import summarise
from tideline.operators.split import positions
from tideline.panel import Panel

SERIES = {"long": walk(240), "short": season(31, 7), "tiny": np.array([3.0, 1.0, 2.0])}

OPERATORS = {
    "positions": positions,
    "rolling": lambda p: features.rolling_stats(p, 7),
    "all_features": features.all_features,
    "forward_fill": lambda p: reg.forward_fill(p, then_backward=True),
    "backward_fill": reg.backward_fill,
    "interpolate_time": reg.interpolate_time,
    "interpolate_position": reg.interpolate_position,
    "median_fill": lambda p: reg.fill_constant(p, "median"),
    "iqr": anomaly.iqr_anomalies,
    "moving_average": anomaly.moving_average_anomalies,
    "frequency": detect.detect_frequency,
    "trend": stats.detect_trend,
    "decompose": lambda p: stats.decompose(p, 6),
    "acf": lambda p: stats.acf(p, 20),
    "quality": stats.signal_quality,
    "seasonality": stats.detect_seasonality,
    "stationarity": stats.check_stationarity,
    "split": lambda p: baselines.split_train_test(p).df,
    "thin": lambda p: reg.thin(p, 50).df,
    "resample": lambda p: reg.resample_mean(p, "week"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_chunks_change_nothing(spark, name):
    operator = OPERATORS[name]
    natural = panel(spark, SERIES, holes=9)
    cut = panel(spark, SERIES, group_rows=40, holes=9)
    assert not natural.split and cut.split
    assert rows(operator(natural)) == rows(operator(cut))


def test_salted_join_gives_the_broadcast_result(spark):
    natural = panel(spark, SERIES)
    salted = Panel(natural.df, natural.keys, natural.group_rows, None, broadcast_series=1)
    assert rows(reg.zscore(natural)) == rows(reg.zscore(salted))


def test_crowded_stamps_are_cut_again(spark):
    """Almost all rows fall into one time bin; positions must still be exact."""
    early = pd.date_range("2020-01-01", periods=400, freq="s")
    stamps = early.append(pd.DatetimeIndex(["2024-01-01"]))
    pdf = pd.DataFrame({"k": "a", "ts": stamps, "value": np.arange(401.0)})
    placed = positions(panel(spark, pdf, group_rows=30)).collect()
    assert all(r["pos"] == int(r["value"]) for r in placed) and len(placed) == 401


@pytest.mark.parametrize("n", [1, 2, 5, 37, 500])
def test_selected_quantiles_match_numpy(spark, n):
    values = np.round(np.random.default_rng(n).exponential(size=n), 2)
    cut = panel(spark, {"a": values, "b": np.arange(60.0)}, group_rows=20)
    found = summarise(cut, {}, {"q1": 0.25, "q2": 0.5, "q3": 0.75, "lo": 0.0, "hi": 1.0}).where("k = 'a'").first()
    expected = np.quantile(values, [0.25, 0.5, 0.75, 0, 1])
    assert np.allclose([found[c] for c in ("q1", "q2", "q3", "lo", "hi")], expected)


def test_bracketed_quantiles_match_numpy(spark, monkeypatch):
    """A small sketch forces the bracket path that hot series take."""
    from tideline.operators import quantile

    monkeypatch.setattr(quantile, "SKETCH_ACCURACY", 100)
    values = np.random.default_rng(5).lognormal(size=5000)
    cut = panel(spark, {"a": values}, group_rows=1000)
    found = summarise(cut, {}, {"q1": 0.25, "q2": 0.5, "q3": 0.9}).first()
    assert np.allclose([found["q1"], found["q2"], found["q3"]], np.quantile(values, [0.25, 0.5, 0.9]))


def test_cleaning_in_chunks(spark):
    pdf = frame({"a": ar1(200, 0.5), "b": walk(50)})
    pdf["tie"] = range(len(pdf))
    pdf = pdf[pdf.index % 5 != 1]
    twice = pd.concat([pdf, pdf[pdf.index % 7 == 0].assign(value=-1.0, tie=10_000)])
    natural = reg.clean(panel(spark, twice, extra=["tie"]), "tie")
    cut = reg.clean(panel(spark, twice, group_rows=25, extra=["tie"]), "tie")
    columns = ["k", "ts", "value", "observed"]
    assert rows(natural.panel.df.select(*columns)) == rows(cut.panel.df.select(*columns))
    assert rows(natural.report) == rows(cut.report)
    assert natural.panel.df.where("value = -1").count() == 0
