"""Inputs on which the natural and the chunked plan once differed, or rows were lost."""

import datetime as dt

import pytest
from series import rows

from tideline.operators import anomaly, detect, features, forecast
from tideline.operators import regularize as reg
from tideline.panel import Panel
from tideline.session import shared_dir

DAY = dt.timedelta(days=1)
START = dt.datetime(2024, 1, 1)


def panel_of(spark, data, group_rows=2_000_000):
    df = spark.createDataFrame(data, "k string, ts timestamp_ntz, value double, row_id long")
    return Panel.of(df, "ts", "value", ["k"], ["row_id"], group_rows)


def daily(n, skip=()):
    return [("a", START + i * DAY, None if i in skip else float(i % 7), i) for i in range(n)]


@pytest.mark.parametrize("group_rows", [7, 25, 40])
def test_rows_off_the_grid_open_no_stamp_twice(spark, group_rows):
    data = daily(60, skip=(5, 31))
    data[25] = ("a", START + 25 * DAY + dt.timedelta(hours=6), 9.0, 25)
    natural = reg.clean(panel_of(spark, data), "row_id").panel.df
    cut = reg.clean(panel_of(spark, data, group_rows), "row_id").panel.df
    assert cut.count() == cut.select("ts").distinct().count() == 60
    assert rows(natural.drop("pos")) == rows(cut.drop("pos"))


@pytest.mark.parametrize("group_rows", [7, 25, 40])
def test_rows_without_a_stamp_stay(spark, group_rows):
    data = daily(59) + [("a", None, 2.0, 99)]
    for operator in (lambda p: features.rolling_stats(p, 3), reg.forward_fill, reg.interpolate_position):
        natural, cut = (operator(panel_of(spark, data, g)) for g in (2_000_000, group_rows))
        assert cut.count() == 60
        assert rows(natural) == rows(cut)


@pytest.mark.parametrize("group_rows", [7, 25])
def test_series_without_values_stay(spark, group_rows):
    data = daily(60) + [("b", START + i * DAY, None, 100 + i) for i in range(60)]
    for operator in (anomaly.iqr_anomalies, lambda p: reg.fill_constant(p, "median")):
        natural, cut = (operator(panel_of(spark, data, g)) for g in (2_000_000, group_rows))
        assert cut.count() == 120
        assert rows(natural) == rows(cut)


def test_a_missing_tie_break_comes_last_but_keeps_its_value(spark):
    data = [("a", START, 1.0, None), ("a", START + DAY, 5.0, None), ("a", START + DAY, 6.0, 3)]
    kept = reg.first_per_stamp(panel_of(spark, data), "row_id").df.orderBy("ts").collect()
    assert [r.value for r in kept] == [1.0, 6.0]


def test_text_and_numeric_stamps_are_read(spark):
    texts = [("a", "2024-01-01", 1.0), ("a", "03/01/2024", 2.0), ("a", "nothing", 3.0), ("a", None, 4.0)]
    panel = Panel.of(spark.createDataFrame(texts, "k string, at string, value double"), "at", "value", ["k"])
    assert panel.df.where("ts is null").count() == 2
    assert reg.drop_unparsed(panel).df.count() == 2
    seconds = [("a", 1_700_000_000 + 60 * i, float(i)) for i in range(5)]
    panel = Panel.of(spark.createDataFrame(seconds, "k string, at long, value double"), "at", "value", ["k"])
    assert panel.df.agg({"ts": "min"}).first()[0] == dt.datetime(2023, 11, 14, 22, 13, 20)


def test_numbers_mostly_out_of_range_are_no_stamps(spark):
    far = 1e13  # as days beyond any calendar
    values = [60_000.0] * 20 + [far] * 10
    df = spark.createDataFrame([(v,) for v in values], "t double")
    assert detect.to_datetime(df, "t").where("t is not null").count() == 0
    assert detect.to_datetime(df.where("t < 100000"), "t").where("t is not null").count() == 20


def test_decimals_count_as_numbers(spark):
    df = spark.createDataFrame([(1, "a")], "x int, n string").selectExpr("cast(x as decimal(12,2)) price", "n")
    assert detect.numeric_columns(df) == ["price"]


def test_no_chosen_series_gives_no_rows(spark):
    panel = panel_of(spark, daily(40))
    panel = panel.derive(panel.df.drop("row_id"))
    chosen = spark.createDataFrame([], "k string, best_model string")
    out = forecast.future_forecast(panel, 3, chosen=chosen)
    assert out.count() == 0
    assert {"model", "step", "ts", "forecast", "status"} <= set(out.columns)


def test_a_cluster_must_name_a_shared_folder():
    class Context:
        master = "spark://host"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default=None):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())
