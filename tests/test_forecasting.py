import numpy as np
import pytest
from pyspark.sql import functions as F
from series import ar1, frame, panel, season, walk

from tideline.functions import fitting, recursion
from tideline.functions.fitting import HoltWinters, fit_arima, fit_long, fit_sarima
from tideline.operators import baselines, fits, forecast, longfits
from tideline.operators.detect import detect_frequency
from tideline.panel import Panel


def exact_deviance(y, phi, theta, mean):
    """Twice the negative log likelihood of an ARMA(1,1) from its covariance matrix."""
    n = len(y)
    gamma = np.zeros(n)
    gamma[0] = (1 + 2 * phi * theta + theta**2) / (1 - phi**2)
    gamma[1] = phi * gamma[0] + theta
    for k in range(2, n):
        gamma[k] = phi * gamma[k - 1]
    root = np.linalg.cholesky(gamma[np.abs(np.subtract.outer(range(n), range(n)))])
    z = np.linalg.solve(root, y - mean)
    return n * (np.log(2 * np.pi * (z @ z) / n) + 1) + 2 * np.log(np.diag(root)).sum()


def test_arma_is_the_exact_maximum():
    rng = np.random.default_rng(1)
    e = rng.normal(size=300)
    y = np.zeros(300)
    for i in range(1, 300):
        y[i] = 0.6 * y[i - 1] + e[i] + 0.4 * e[i - 1]
    fit = fit_arima(y + 50, 0, [(1, 1)])[0]
    phi, theta = -fit.ar[1], fit.ma[1]
    best = exact_deviance(y + 50, phi, theta, fit.mean)
    assert fit.aic == pytest.approx(best + 2 * 4, abs=1e-3)
    for step in (-0.02, 0.02):
        assert exact_deviance(y + 50, phi + step, theta, fit.mean) > best
        assert exact_deviance(y + 50, phi, theta + step, fit.mean) > best
        assert exact_deviance(y + 50, phi, theta, fit.mean + step) > best


def test_ar1_is_recovered():
    fit = fit_arima(ar1(3000, 0.7), 0, [(1, 0)])[0]
    assert -fit.ar[1] == pytest.approx(0.7, abs=0.05)
    assert fit.forecast(400)[-1] == pytest.approx(fit.mean, abs=1e-3)


def test_random_walk_interval_grows_with_the_root_of_time():
    fit = fit_arima(walk(400), 1, [(0, 0)])[0]
    half = fit.interval(9, 0.95)
    assert half[8] / half[0] == pytest.approx(3.0)
    assert np.allclose(fit.forecast(3), walk(400)[-1])


def test_sarima_and_smoothing_follow_a_season():
    y = season(240, 12, slope=0.5)
    train, test = y[:200], y[200:]
    variance = np.var(test)
    sarima = fit_sarima(train, 1, 12, [(1, 1, 1, 1)])[0]
    smooth = HoltWinters(train, True, 12)
    for predicted in (sarima.forecast(40), smooth.forecast(40)):
        assert 1 - np.mean((predicted - test) ** 2) / variance > 0.9


def test_smoothing_beats_a_coarse_grid():
    y = season(60, 6, slope=0.2)
    best = HoltWinters(y, True, 6).sse
    one = HoltWinters.__new__(HoltWinters)
    one.y, one.trend, one.season = y, True, 6
    grid = np.array([[a, b, c] for a in (-3.0, 0.0, 3.0) for b in (-3.0, 0.0) for c in (-3.0, 0.0)])
    assert best <= (one._errors(grid)[0] ** 2).sum(axis=0).min() + 1e-9


def test_candidate_grids_shrink():
    assert [len(fits.arima_grid(n, 1)) for n in (500, 5000, 20000)] == [16, 9, 4]
    assert len(fits.arima_grid(500, 0)) == 15
    assert [len(fits.sarima_grid(n, 1)) for n in (500, 5000, 20000)] == [36, 16, 8]


def test_run_ranks_all_models_and_survives_a_bad_series(spark):
    pdf = frame({"good": season(120, 12, slope=0.4, noise=0.5), "few": season(30, 12), "tiny": walk(8)}, freq="MS")
    pdf["tie"] = 0
    result = forecast.run_forecast(panel(spark, pdf, extra=["tie"]), "tie")
    board = result.board.toPandas()
    assert set(board[board["k"] == "good"]["model"]) == set(baselines.MODELS)
    best = {r["k"]: r["best_model"] for r in result.best.collect()}
    assert best["good"] in ("SARIMA", "Holt-Winters")
    assert [r["k"] for r in result.skipped.collect()] == ["tiny"]
    failed = result.forecasts.where("status <> 'ok'").select("k", "model", "status").collect()
    assert failed and all(r["k"] == "few" and r["status"].startswith("failed") for r in failed)
    good = result.forecasts.where("k = 'good' and model = 'SARIMA'").toPandas()
    assert 1 - ((good["value"] - good["yhat"]) ** 2).mean() / good["value"].var(ddof=0) > 0.9

    future = forecast.future_forecast(result.panel, 6, chosen=result.best).toPandas()
    assert future.groupby("k")["step"].max().to_dict() == {"good": 6, "few": 6}
    assert set(future[future["k"] == "good"]["model"]) == {best["good"]}
    summary = forecast.summary(result, "Sales Dataset").toPandas()
    assert set(summary["k"]) == {"good", "few"} and (summary["dataset_type"] == "Sales Dataset").all()


def test_future_intervals_widen(spark):
    rows = forecast.future_forecast(panel(spark, {"a": walk(100)}), 5, ["ARIMA", "Naive"]).orderBy("step").toPandas()
    arima = rows[rows["model"] == "ARIMA"]
    width = (arima["upper"] - arima["lower"]).to_numpy()
    assert (width[1:] >= width[:-1]).all() and width[0] > 0
    assert rows[rows["model"] == "Naive"]["lower"].isna().all()


def test_unknown_model_is_an_error(spark):
    with pytest.raises(ValueError, match="Prophet"):
        forecast.future_forecast(panel(spark, {"a": walk(40)}), 3, ["Prophet"])
    assert forecast.known_model("Exponential Smoothing") == "Holt-Winters"


def minutes(spark, n):
    at = F.timestamp_seconds(F.lit(1_700_000_000 // 60 * 60) + F.col("id") * 60).cast("timestamp_ntz")
    wave = (F.col("id") % 60).cast("double")
    return Panel.of(spark.range(n).select(F.lit("a").alias("k"), at.alias("ts"), wave.alias("value"), "id"), "ts", "value", ["k"], ["id"])


def test_a_long_series_keeps_its_calendar(spark):
    n = 120_000
    result = forecast.run_forecast(minutes(spark, n), "id", ["Naive"])
    assert result.panel.df.count() == n
    assert result.report.first()["fit_stride"] == 2
    assert detect_frequency(result.panel).first()["code"] == "min"
    stamps = [r["ts"] for r in forecast.future_forecast(result.panel, 3, ["Naive"]).orderBy("step").collect()]
    last = result.panel.df.agg(F.max("ts")).first()[0]
    assert [(s - last).total_seconds() for s in stamps] == [60, 120, 180]


def test_bounds_of_fits(spark):
    long = minutes(spark, 1000)
    tail = fits.recent(long, 100)
    assert tail.where("_cut").count() == tail.count() == 100
    assert tail.agg(F.max("ts")).first() == long.df.agg(F.max("ts")).first()
    whole = fits.recent(long, 501)
    assert whole.where("not _cut").count() == whole.count() == 1000


def test_a_season_is_counted_in_thinned_rows(spark, monkeypatch):
    monkeypatch.setattr(forecast, "stride", lambda n: F.lit(5))
    schema = "k string, recommended_d int, seasonal_period int, seasonality string, trend_direction string"
    facts = spark.createDataFrame([("a", 1, 60, "Strong", "Flat"), ("b", 0, 7, "Strong", "Flat")], schema)
    split = Panel(spark.createDataFrame([("a",), ("b",)], "k string"), ["k"])
    found = {r["k"]: (r["seasonal_period"], r["seasonality"]) for r in forecast.thinned_season(facts, split).collect()}
    assert found == {"a": (12, "Strong"), "b": (None, "None")}


def test_metrics_edge_cases(spark):
    rows = spark.createDataFrame(
        [("zero", 0.0, 1.0), ("zero", 2.0, 1.0), ("flat", 3.0, 3.0), ("flat", 3.0, 3.0), ("off", 3.0, 4.0)],
        "k string, value double, yhat double",
    )
    scores = {r["k"]: r for r in baselines.metrics(rows, ["k"]).collect()}
    assert scores["zero"]["mape"] > 1e10 and scores["flat"]["r2"] == 1.0 and scores["off"]["r2"] == 0.0
    safe = {r["k"]: r["safe_mape"] for r in baselines.safe_mape(rows, ["k"]).collect()}
    assert safe["zero"] == 50.0
    nothing = baselines.safe_mape(rows.withColumn("value", F.lit(0.0)), ["k"]).collect()
    assert all(r["safe_mape"] is None for r in nothing)


def test_leaderboard_ties_keep_training_order(spark):
    scores = spark.createDataFrame(
        [("a", m, 1.0, 1.0, 1.0, 0.5) for m in ("ARIMA", "Naive", "Moving Average")] + [("a", "SARIMA", None, None, None, None)],
        "k string, model string, rmse double, mae double, mape double, r2 double",
    )
    board = baselines.leaderboard(scores, ["k"]).orderBy("place").collect()
    assert [r["model"] for r in board] == ["Naive", "Moving Average", "ARIMA", "SARIMA"]
    assert board[3]["overall_score"] == 16


def test_lanes_choose_the_same_candidate(spark):
    pdf = frame({"good": season(240, 12, slope=0.4, noise=0.5), "few": season(25, 12)}, freq="MS")
    split = baselines.split_train_test(panel(spark, pdf))
    facts = forecast.model_facts(split.derive(split.df.where("is_train").select(*split.keys, "ts", "value")))
    for model in ("ARIMA", "SARIMA", "Holt-Winters"):
        one, many = (
            fits.train_forecasts(split, facts, model, lanes=n).orderBy("k", "ts").toPandas() for n in (1, 7)
        )
        assert len(one) == len(many) and (one["status"] == many["status"]).all()
        orders = [*fits.ORDER]
        assert one[orders].equals(many[orders])
        assert np.allclose(one["yhat"], many["yhat"], atol=1e-3, equal_nan=True)


def test_a_grid_is_shared_out_whole():
    grid = fits.TRAINERS["SARIMA"]
    row = {"recommended_d": 1, "seasonal_period": 12}
    for lanes in (1, 5, 50):
        shared = [c for lane in range(lanes) for c in grid.share(row, 500, lane, lanes)]
        assert sorted(shared) == list(enumerate(fits.sarima_grid(500, 1)))


def test_lag_errors_are_those_of_one_pass():
    rng = np.random.default_rng(0)
    own, lags, start = rng.normal(size=(1500, 4)), np.array([1, 2, 7, 8, 9]), rng.normal(size=(9, 4))
    ma = 0.2 * rng.normal(size=(5, 4))
    want = np.concatenate([start, np.zeros_like(own)])
    for t in range(len(own)):
        want[9 + t] = own[t] - sum(weight * want[9 + t - lag] for lag, weight in zip(lags, ma))
    errors, end = recursion.lag_errors(own, lags, ma, start)
    assert np.allclose(errors, want[9:], atol=1e-12) and np.allclose(end, want[-9:], atol=1e-12)


def test_long_fits_agree_with_short_ones():
    y = season(3000, 12, slope=0.01, noise=1.0)
    for orders, d, m, short in (([(1, 1, 1, 1), (1, 0, 0, 1)], 1, 12, fit_sarima(y, 1, 12, [(1, 1, 1, 1), (1, 0, 0, 1)], exact=False)),):
        for a, b in zip(fit_long(y, d, orders, m), short):
            assert a.order == b.order and a.aic == pytest.approx(b.aic, abs=1e-6)
            assert np.allclose(a.forecast(24), b.forecast(24), atol=1e-4)
            assert np.allclose(a.interval(24, 0.9), b.interval(24, 0.9), atol=1e-4)
    y = ar1(20_000, 0.7)
    for a, b in zip(fit_long(y, 0, [(1, 0), (1, 1)]), fit_arima(y, 0, [(1, 0), (1, 1)])):
        assert a.order == b.order and np.allclose(a.forecast(5), b.forecast(5), atol=1e-3)


def test_chunks_fit_all_rows_of_a_series(spark):
    y = season(4000, 12, slope=0.01, noise=1.0)
    long = panel(spark, {"a": y, "b": ar1(4000, 0.7)})
    for orders, m in (([(1, 1, 1, 1)], 12), ([(1, 0), (0, 1), (2, 1)], 0)):
        found = longfits.fit_panel(long, {("a",): longfits.Job(1, orders, m), ("b",): longfits.Job(0, orders, m)}, 900)
        for key, d, values in (("a", 1, y), ("b", 0, ar1(4000, 0.7))):
            for a, b in zip(found[key,], fit_long(values, d, orders, m), strict=True):
                assert a.order == b.order and a.aic == pytest.approx(b.aic, abs=1e-4)
                assert np.allclose(a.forecast(24), b.forecast(24), atol=1e-4)


def test_series_beyond_a_task_are_forecast_from_all_rows(spark):
    pdf = frame({"long": ar1(1200, 0.7), "short": ar1(100, 0.5)})
    whole, small = panel(spark, pdf), panel(spark, pdf)
    small.group_rows = 300
    facts = spark.createDataFrame(
        [("long", 0, 7, "Strong", "Flat"), ("short", 0, 7, "Strong", "Flat")],
        "k string, recommended_d int, seasonal_period int, seasonality string, trend_direction string",
    )
    for model in ("ARIMA", "SARIMA"):
        want, got = (fits.future_forecasts(p, facts, model, 4).orderBy("k", "step").toPandas() for p in (whole, small))
        assert (got["status"] == "ok").all() and (got["k"] == want["k"]).all()
        assert np.allclose(got["forecast"], want["forecast"], atol=0.3)
        assert got[got["k"] == "short"].equals(want[want["k"] == "short"])
    cut = fits.future_forecasts(small, facts, "Holt-Winters", 2).where("k = 'long'").first()["status"]
    assert cut == "fitted on the last 300 rows"


def test_smoothing_in_stretches_is_the_sequential_pass():
    for n, m, trend in ((700, 12, True), (1500, 0, True), (1300, 60, False)):
        y = season(n, m or 12, slope=0.02, noise=1.0)
        model = HoltWinters.__new__(HoltWinters)
        model.y, model.trend, model.season = y, trend, m
        u = np.array([[-2.0, -2.0, -2.0], [0.5, -1.0, -3.0]])
        out, (level, slope, seasons) = model._errors(u)
        units = 1 + trend + m
        first = np.concatenate([np.zeros((2, units, 1)), np.broadcast_to(np.eye(units), (2, units, units))], axis=2)
        inputs = np.zeros((n, 1 + units))
        inputs[:, 0] = y
        errors, _ = model._steps(u, inputs, model._states(first))
        for c in range(2):
            start = np.linalg.lstsq(errors[:, c, 1:], -errors[:, c, 0], rcond=1e-10)[0]
            assert np.allclose(out[:, c], errors[:, c] @ np.r_[1.0, start], atol=1e-6)


@pytest.mark.parametrize("params", [[0.5, -0.2, 0.3, 0.1, 0.4, 0.3], [0, 0, 0.4, 0, 0, 0.6], [0.6, 0, 0, 0, 0.5, 0], [0.3, 0.2, -0.4, 0.2, -0.5, -0.7]])
def test_seasonal_likelihood_is_that_of_the_whole_covariance(params):
    m, n, reach = 5, 60, 3000
    ar, ma = (x[:, 0] for x in fitting._seasonal_terms(np.array([params])))
    phi, theta = np.zeros(m + 3), np.eye(1, m + 3)[0]
    for lag, a, b in zip((1, 2, m, m + 1, m + 2), ar, ma):
        phi[lag] += a
        theta[lag] += b
    impulse = np.zeros(reach)
    for k in range(reach):
        back = min(k, m + 2)
        impulse[k] = (theta[k] if k < m + 3 else 0.0) + phi[1 : back + 1] @ impulse[k - back : k][::-1]
    gamma = np.array([impulse[: reach - k] @ impulse[k:] for k in range(n)])
    root = np.linalg.cholesky(gamma[np.abs(np.subtract.outer(range(n), range(n)))])
    w = np.random.default_rng(1).normal(size=n)
    z = np.linalg.solve(root, w)
    want = 2 * np.log(np.diag(root)).sum() + z @ z
    errors, variances = fitting._seasonal_innovations(w, m, np.array([params]))
    assert np.log(variances).sum() + (errors**2 / variances).sum() == pytest.approx(want, abs=1e-8)


def test_seasonal_maximum_is_no_worse_than_its_neighbours():
    y = season(300, 12, slope=0.1, noise=1.0)
    fit = fit_sarima(y, 1, 12, [(1, 1, 1, 1)])[0]
    least = fit_sarima(y, 1, 12, [(1, 1, 1, 1)], exact=False)[0]
    w = fitting._difference(y, 1, 1, 12)

    def deviance(params):
        errors, variances = fitting._seasonal_innovations(w, 12, np.array([params]))
        n = len(w)
        return n * (np.log(2 * np.pi * (errors**2 / variances).sum() / n) + 1) + np.log(variances).sum()

    b1 = fit.ma[1]
    best = fit.aic - 2 * 5
    assert np.isfinite(best) and np.isfinite(b1)
    start = fitting._seasonal_parameters(fitting._seasonal_start(np.array([[0.1, 0, -0.5, 0, 0.1, -0.5]])))[0]
    assert best <= deviance(start) + 1e-6
    assert np.allclose(fit.forecast(12), least.forecast(12), atol=3.0)
