import math

import numpy as np
import pytest
from series import ar1, panel, season, walk

from tideline.operators import forest, stats
from tideline.functions.solve import unit_root_p_value


def direct_adf(y: np.ndarray):
    """The regression done directly on the series."""
    most = min(len(y) // 2 - 2, math.ceil(12 * (len(y) / 100) ** 0.25))
    change = np.diff(y)

    def fit(lags, start):
        target = change[start:]
        columns = [y[start:-1], np.ones(len(target))]
        columns += [change[start - k : len(change) - k] for k in range(1, lags + 1)]
        x = np.column_stack(columns)
        beta = np.linalg.lstsq(x, target, rcond=None)[0]
        left = target - x @ beta
        return x, beta, left @ left, len(target)

    def aic(lags):
        _, _, rss, n = fit(lags, most)
        return n * (math.log(2 * math.pi * rss / n) + 1) + 2 * (lags + 2)

    best = min(range(most + 1), key=aic)
    x, beta, rss, n = fit(best, best)
    return beta[0] / math.sqrt(rss / (n - best - 2) * np.linalg.inv(x.T @ x)[0, 0])


SERIES = {
    "noise": ar1(300, 0.0),
    "ar": ar1(260, 0.7),
    "walk": walk(300),
    "double": np.cumsum(walk(300) - 1000),
    "small": ar1(24, 0.3, seed=9),
}


def test_stationarity_matches_direct_regression(spark):
    found = {r["k"]: r for r in stats.check_stationarity(panel(spark, SERIES)).collect()}
    for k, y in SERIES.items():
        assert found[k]["adf_statistic"] == pytest.approx(direct_adf(y), abs=2e-4), k
    assert [found[k]["recommended_d"] for k in ("noise", "ar", "walk", "double")] == [0, 0, 1, 2]


def test_short_or_constant_series_get_the_default(spark):
    found = stats.check_stationarity(panel(spark, {"short": walk(12), "flat": np.full(40, 2.3)})).collect()
    assert all(r["recommended_d"] == 1 and r["p_value"] is None and r["interpretation"] == "Unknown" for r in found)


def test_p_value_at_published_critical_values():
    # MacKinnon's asymptotic 1, 5 and 10 percent points, constant only.
    for tau, p in ((-3.43035, 0.01), (-2.86154, 0.05), (-2.56677, 0.10)):
        assert unit_root_p_value(tau) == pytest.approx(p, abs=0.002)


@pytest.mark.parametrize("period", [7, 12])
@pytest.mark.parametrize("model", ["additive", "multiplicative"])
def test_decomposition_adds_up(spark, period, model):
    y = season(4 * period + 3, period, slope=0.3) + 20
    found = stats.decompose(panel(spark, {"a": y}), period, model).toPandas()
    parts = found["trend"], found["seasonal"], found["resid"]
    whole = sum(parts) if model == "additive" else np.prod(parts, axis=0)
    assert np.allclose(whole, found["value"])
    assert found["trend"].notna().all()


def test_decomposition_edges(spark):
    p = panel(spark, {"exact": season(24, 12), "less": season(23, 12), "negative": season(40, 12) - 60})
    found = stats.decompose(p, 12, "multiplicative").toPandas()
    assert set(found["k"]) == {"exact", "negative"}
    negative = found[found["k"] == "negative"]
    assert np.allclose(negative["trend"] + negative["seasonal"] + negative["resid"], negative["value"])


def test_autocorrelation_matches_numpy(spark):
    y = ar1(120, 0.6)
    found = stats.acf_pacf(panel(spark, {"a": y}), 10).orderBy("lag").toPandas()
    c = y - y.mean()
    expected = [c[: len(c) - k] @ c[k:] / (c @ c) for k in range(11)]
    assert np.allclose(found["acf"], expected)
    for k in (1, 2, 5, 10):
        corr = np.array([[expected[abs(i - j)] for j in range(k)] for i in range(k)])
        assert found["pacf"][k] == pytest.approx(np.linalg.solve(corr, expected[1 : k + 1])[-1])


def test_seasonality_labels(spark):
    found = {r["k"]: r for r in stats.detect_seasonality(panel(spark, {"s": season(200, 7), "n": ar1(200, 0), "x": walk(10)})).collect()}
    assert found["s"]["seasonality"] == "Strong" and found["s"]["seasonal_period"] == 7
    assert found["n"]["seasonality"] == "None"
    assert found["x"]["seasonality"] == "Unknown" and found["x"]["seasonal_period"] is None


def test_trend_labels(spark):
    t = np.arange(60)
    found = {
        r["k"]: r
        for r in stats.detect_trend(
            panel(spark, {"up": 3 + 2.0 * t, "exp": np.exp(t / 8), "flat": np.full(60, 4.0), "few": 1.0 * t[:9]})
        ).collect()
    }
    assert (found["up"]["trend_direction"], found["up"]["trend_type"], found["up"]["r2"]) == ("Increasing", "Linear", 1.0)
    assert found["exp"]["trend_type"] == "Exponential"
    assert (found["flat"]["trend_direction"], found["flat"]["r2"]) == ("Flat", 0.0)
    assert found["few"]["trend_direction"] == "Unknown"


def test_forest_finds_planted_outliers(spark):
    y = np.random.default_rng(4).normal(size=1000)
    y[[100, 400, 700]] = [25.0, -30.0, 40.0]
    flagged = forest.forest_anomalies(panel(spark, {"a": y}), 0.01).toPandas()
    assert flagged["is_anomaly"].sum() <= 10
    assert flagged[flagged["value"].abs() > 20]["is_anomaly"].all()
    assert flagged["score"].between(0, 1).all()


def test_forest_keeps_missing_values(spark):
    y = np.random.default_rng(4).normal(size=300)
    y[::10] = np.nan
    p = panel(spark, {"a": y})
    kept = forest.drop_outliers_forest(p, 0.05)
    assert kept.where("value is null").count() == 30
    assert 250 <= kept.where("value is not null").count() <= 262


@pytest.mark.parametrize("n", [40, 3000])
def test_forest_scores_equal_a_direct_look_up(spark, monkeypatch, n):
    monkeypatch.setattr(forest, "PIECE_ROWS", 500)
    monkeypatch.setattr(forest, "POOL", 10**9 if n == 40 else 400)  # whole series in the pool, and a part
    y = np.round(np.random.default_rng(6).normal(size=n), 2)
    frame = panel(spark, {"a": y, "b": y[: n // 2] * 3})
    scored = forest.forest_scores(frame)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in plan
    found = scored.toPandas()
    assert len(found) == n + n // 2 and list(found.columns) == [*frame.df.columns, "score"]
    if n == 40:
        for k, values in (("a", y), ("b", y[: n // 2] * 3)):
            cuts, scores = forest._forest(values)
            own = found[found["k"] == k]
            assert np.array_equal(own["score"], scores[np.searchsorted(cuts, own["value"])])
    else:  # one function per series: equal values score alike, in every piece
        assert found["score"].notna().all() and found.groupby(["k", "value"])["score"].nunique().max() == 1
