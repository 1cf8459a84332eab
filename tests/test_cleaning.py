import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from series import frame, panel, rows, season

from tideline.operators import detect, features, schema
from tideline.operators import regularize as reg
from tideline.operators.baselines import future_dates, split_train_test
from tideline.operators.split import open_range
from tideline.panel import Panel
from tideline.sources import files


def code(spark, stamps):
    pdf = pd.DataFrame({"k": "a", "ts": pd.DatetimeIndex(stamps), "value": 1.0})
    return detect.detect_frequency(panel(spark, pdf)).first()


@pytest.mark.parametrize(
    "freq,expected,period",
    [
        ("D", "D", 7),
        ("min", "min", 60),
        ("MS", "MS", 12),
        ("h", "H", 24),
        ("15min", "H", 24),
        ("2D", "W", 52),
        ("14D", "IRREGULAR", None),
        ("W-MON", "W", 52),
        ("ME", "M", 12),
        ("QS", "Q", 4),
        ("YS", "Y", 1),
    ],
)
def test_frequency_of_grids(spark, freq, expected, period):
    found = code(spark, pd.date_range("2021-01-01", periods=30, freq=freq))
    assert (found["code"], found["period"]) == (expected, period)
    assert (found["median_gap"] is None) == (freq in ("D", "min", "MS"))


def test_two_points_have_no_frequency(spark):
    found = code(spark, pd.date_range("2021-01-01", periods=2))
    assert (found["code"], found["frequency"]) == (None, "Unknown")


def test_month_end_grid_keeps_month_ends(spark):
    stamps = pd.DatetimeIndex(["2024-01-31", "2024-02-29", "2024-04-30", "2024-05-31", "2024-06-30"])
    pdf = pd.DataFrame({"k": "a", "ts": stamps, "value": 1.0})
    grid = reg.to_grid(panel(spark, pdf))
    found = [r["ts"] for r in grid.panel.df.orderBy("ts").collect()]
    assert found == [dt.datetime(2024, m, d) for m, d in ((1, 31), (2, 29), (3, 31), (4, 30), (5, 31), (6, 30))]
    ahead = future_dates(panel(spark, pdf), 2).orderBy("step").collect()
    assert [r["ts"] for r in ahead] == [dt.datetime(2024, 7, 31), dt.datetime(2024, 8, 31)]


def test_month_ends_from_a_short_month_stay_on_the_grid(spark):
    pdf = pd.DataFrame({"k": "a", "ts": pd.date_range("2023-02-28", periods=14, freq="ME"), "value": 1.0, "tie": 0})
    report = reg.clean(panel(spark, pdf, extra=["tie"]), "tie").report.first()
    assert (report["off_grid_rows"], report["missing_dates_filled"], report["final_rows"]) == (0, 0, 14)


def test_a_long_gap_is_opened_in_blocks(spark):
    stamps = list(pd.date_range("2024-01-01", periods=50, freq="min")) + [pd.Timestamp("2024-05-30")]
    pdf = pd.DataFrame({"k": "a", "ts": stamps, "value": 1.0})
    grid = reg.to_grid(panel(spark, pdf)).panel.df
    assert (grid.count(), grid.select("ts").distinct().count()) == (150 * 24 + 1, 150 * 24 + 1)
    wide = open_range(spark.createDataFrame([(3, 150_002), (None, None)], "a long, b long"), F.col("a"), F.col("b"), "at")
    assert (wide.count(), wide.agg(F.countDistinct("at")).first()[0]) == (150_001, 150_000)


def test_off_grid_rows_are_counted(spark):
    stamps = list(pd.date_range("2024-01-01", periods=10)) + [pd.Timestamp("2024-01-03 07:00")]
    pdf = pd.DataFrame({"k": "a", "ts": stamps, "value": 1.0, "tie": 0})
    grid = reg.clean(panel(spark, pdf, extra=["tie"]), "tie")
    report = grid.report.first()
    assert (report["off_grid_rows"], report["final_rows"], report["missing_dates_filled"]) == (1, 10, 0)


def test_interpolation_keeps_observed_and_fills_ends(spark):
    values = np.array([np.nan, 1.0, np.nan, np.nan, 4.0, np.nan])
    p = panel(spark, {"a": values})
    by_time = [r["value"] for r in reg.interpolate_time(p).orderBy("ts").collect()]
    assert by_time == [1.0, 1.0, 2.0, 3.0, 4.0, 4.0]
    by_row = [r["value"] for r in reg.interpolate_position(p).orderBy("ts").collect()]
    assert by_row == [None, 1.0, 2.0, 3.0, 4.0, 4.0]


def test_all_missing_and_single_value(spark):
    p = panel(spark, {"none": np.full(5, np.nan), "one": np.array([np.nan, 7.0, np.nan])})
    filled = reg.interpolate_time(p).orderBy("k", "ts").collect()
    assert [r["value"] for r in filled] == [None] * 5 + [7.0] * 3


def test_value_deduplication_is_opt_in(spark):
    pdf = pd.DataFrame({"k": "a", "ts": pd.date_range("2024-01-01", periods=4), "value": [1.0, 2.0, 1.0, 3.0], "tie": 0})
    assert reg.clean(panel(spark, pdf, extra=["tie"]), "tie").panel.df.count() == 4
    once = reg.clean(panel(spark, pdf, extra=["tie"]), "tie", dedup_values=True)
    assert once.panel.df.count() == 3 and once.report.first()["final_rows"] == 3


def test_zscore_of_constant_series(spark):
    from tideline.operators.anomaly import zscore_anomalies

    flagged = zscore_anomalies(panel(spark, {"flat": np.full(12, 5.0)}))
    assert flagged.where("is_anomaly or z is not null").count() == 0


def test_resample_keeps_empty_buckets(spark):
    stamps = pd.DatetimeIndex(["2024-01-15", "2024-04-02"])
    pdf = pd.DataFrame({"k": "a", "ts": stamps, "value": [1.0, 2.0]})
    found = reg.resample_mean(panel(spark, pdf), "month").orderBy("ts").collect()
    assert [(r["ts"].date().isoformat(), r["value"]) for r in found] == [
        ("2024-01-31", 1.0), ("2024-02-29", None), ("2024-03-31", None), ("2024-04-30", 2.0),
    ]


def test_ninety_points_split(spark):
    first = split_train_test(panel(spark, {"a": np.arange(90.0)})).df.first()
    assert first["n_train"] == 62


def test_rolling_matches_pandas(spark):
    pdf = frame({"a": season(60, 7), "b": season(25, 5)})
    pdf.loc[pdf.index % 11 == 0, "value"] = np.nan
    found = features.rolling_stats(panel(spark, pdf), 4).toPandas().sort_values(["k", "ts"]).reset_index(drop=True)
    pdf = pdf.sort_values(["k", "ts"]).reset_index(drop=True)
    for name in ("mean", "std", "min", "max"):
        expected = getattr(pdf.groupby("k")["value"].rolling(4), name)().reset_index(drop=True)
        assert np.allclose(found[f"rolling_{name}_4"].astype(float), expected, equal_nan=True), name


@pytest.mark.parametrize("n", [10, 130, 155])
def test_centred_mean_matches_pandas(spark, n):
    from pyspark.sql import functions as F

    y = season(n, 7)
    p = panel(spark, {"a": y})
    counts = p.df.groupBy("k").agg(F.count("*").alias("n"), F.avg("value").alias("_mean"))
    found = features.centred_mean(p, counts).orderBy("pos").toPandas()["smooth"]
    expected = pd.Series(y).rolling(max(5, n // 25), center=True, min_periods=1).mean()
    assert np.allclose(found, expected)


def test_results_do_not_depend_on_partitions(spark):
    p = panel(spark, {"a": season(80, 7)}, holes=6)
    other = p.derive(p.df.repartition(1))
    assert rows(reg.interpolate_time(p)) == rows(reg.interpolate_time(other))


def test_target_names_match_by_substring(spark):
    df = spark.createDataFrame(
        [(float(i), float(i % 3), i, i) for i in range(30)], "humidity double, discount double, user_id long, l_orderkey long"
    )
    scores = {r["column"]: r["score"] for r in detect.score_target_columns(df).collect()}
    assert set(scores) == {"discount", "l_orderkey"}
    assert scores["discount"] == 40 + 20 + 15 and scores["l_orderkey"] == 20 + 15 + 15 + 10


def test_narrow_bounds_are_exclusive(spark):
    df = spark.createDataFrame([(126, 127, -127, -128)], "a int, b int, c int, d int")
    advice = {r["column"]: r["recommended_type"] for r in schema.narrow_profile(df).collect()}
    assert advice == {"a": "tinyint", "b": "smallint", "c": "tinyint", "d": "smallint"}
    assert schema.narrow_types(df).schema["a"].dataType.simpleString() == "tinyint"


def test_zoned_and_marked_texts(spark):
    texts = ["2024-03-01T10:00:00+02:00", "03/02/2024", "13/02/2024", " NaT ", "", "Mar 5, 2024", "20240506", "1995", "5", "12.5"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, d string")
    found = [r["d"] for r in detect.to_datetime(df, "d").orderBy("i").collect()]
    assert found == [
        dt.datetime(2024, 3, 1, 8), dt.datetime(2024, 3, 2), dt.datetime(2024, 2, 13), None, None,
        dt.datetime(2024, 3, 5), dt.datetime(2024, 5, 6), dt.datetime(1995, 1, 1), None, None,
    ]
    first = [r["d"] for r in detect.to_datetime(df, "d", dayfirst=True).orderBy("i").collect()]
    assert first[1] == dt.datetime(2024, 2, 3)


def test_empty_and_structured(spark):
    empty = spark.createDataFrame([], "a int, b string")
    assert schema.is_structured(empty).first()["structured"] is False
    sparse = spark.createDataFrame([(None, None)] * 19 + [(1, None)], "a int, b string")
    assert schema.is_structured(sparse).first()["structured"] is False


def test_rows_without_a_key_stay(spark):
    pdf = frame({"a": season(30, 7)}).assign(k=[None if i % 3 == 0 else "a" for i in range(30)])
    p = Panel.of(spark.createDataFrame(pdf), "ts", "value", ["k"])
    counts = {r["k"]: r["n"] for r in reg.zscore(p).groupBy("k").agg(F.count("*").alias("n")).collect()}
    assert counts == {"a": 20, "(none)": 10}


def test_text_files_lose_only_bad_bytes(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"good \xff\xfe text\nsecond line" + b"x" * 12_000)
    row = files.text_preview(files.read_text(spark, str(tmp_path))).first()
    assert row["value"].startswith("good  text\nsecond line") and len(row["preview"]) == 10_000


def test_single_series_plans_have_no_cross_join(spark):
    from tideline.operators.stats import analyze_series

    df = spark.createDataFrame(frame({"a": season(90, 7)}))
    for rows_per_task in (1000, 20):
        plan = analyze_series(Panel.of(df, "ts", "value", group_rows=rows_per_task))._jdf.queryExecution().executedPlan()
        assert "CartesianProduct" not in plan.toString() and "NestedLoop" not in plan.toString()


def test_panel_without_keys(spark):
    df = spark.createDataFrame(frame({"a": season(40, 7)}))
    found = detect.detect_frequency(Panel.of(df, "ts", "value")).first()
    assert found["code"] == "D"


def test_a_text_stamp_is_parsed_once_per_use(spark):
    from tideline.functions.dates import text_to_time

    df = spark.createDataFrame([("2024-01-05 10:00:00",), ("5 Mar 2024",), ("none of it",), (" NaT ",), (None,)], "t string")
    read = df.select(text_to_time(F.col("t")).alias("at")).where("at is not null").groupBy("at").count()
    plan = read._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("rlike") <= 14  # seven shapes, in the filter and in the projection
    assert sorted(str(r["at"]) for r in read.collect()) == ["2024-01-05 10:00:00", "2024-03-05 00:00:00"]


def test_calendar_grid_starts_at_the_next_anchor(spark):
    import pandas as pd

    parts = {
        "mondays": pd.date_range("2024-01-01", periods=12, freq="7D"),
        "quarter_starts": pd.date_range("2020-01-01", periods=9, freq="QS"),
        "year_ends": pd.date_range("2015-12-31", periods=6, freq="YE"),
        "one_anchor_late": pd.DatetimeIndex(["2024-02-10", "2024-03-10", "2024-04-30", "2024-05-31"]),
    }
    pdf = pd.concat([pd.DataFrame({"k": k, "ts": v, "value": range(len(v))}) for k, v in parts.items()])
    panel_ = Panel.of(spark.createDataFrame(pdf), "ts", "value", ["k"])
    grid = reg.to_grid(panel_, anchor="calendar")
    rows = grid.panel.df.orderBy("k", "ts").toPandas()
    codes = {"mondays": "W-SUN", "quarter_starts": "QE", "year_ends": "YE", "one_anchor_late": "ME"}
    report = grid.report.toPandas().set_index("k")
    for k, stamps in parts.items():
        want = pd.date_range(stamps.min(), stamps.max(), freq=codes[k])
        got = rows[rows["k"] == k]
        assert got["ts"].tolist() == list(want)
        assert got["observed"].tolist() == [t in stamps for t in want]
        assert report.loc[k, "final_rows"] == len(want) and report.loc[k, "off_grid_rows"] == sum(t not in want for t in stamps)
