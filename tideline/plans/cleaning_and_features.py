"""Queries over cleaning, resampling, filling, outliers, thinning and window features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators import anomaly, features, forest
from tideline.operators import regularize as reg
from tideline.panel import Panel
from tideline.plans import sql, tables
from tideline.plans.catalog import ORACLE, query
from tideline.plans.tables import six


def _rows(df: DataFrame) -> DataFrame:
    return df.select("k", "ts", *six("value"))


@query("WITH" + tables.DIRTY_ORDERS + "SELECT k, ts, value, o_orderkey FROM d WHERE ts IS NOT NULL")
def drop_unparsed_stamps(spark: SparkSession, folder: str) -> DataFrame:
    return reg.drop_unparsed(tables.dirty_orders(spark, folder)).df


@query(sql.with_(tables.DIRTY_ORDERS, sql.UNIQUE_ORDERS, select="SELECT k, ts, value FROM p"))
def drop_repeated_stamps(spark: SparkSession, folder: str) -> DataFrame:
    panel = reg.drop_unparsed(tables.dirty_orders(spark, folder))
    return reg.first_per_stamp(panel, "o_orderkey").df.select("k", "ts", "value")


@query(sql.with_(tables.PRIORITY_DAILY, select="SELECT k, ts, value FROM p ORDER BY k, ts"))
def sort_chronologically(spark: SparkSession, folder: str) -> DataFrame:
    return reg.chronological(tables.priority_daily(spark, folder))


@query(sql.with_(tables.PRIORITY_DAILY, sql.GRID, select="SELECT k, ts, value, observed FROM grid"))
def fill_missing_days(spark: SparkSession, folder: str) -> DataFrame:
    return reg.to_grid(tables.priority_daily(spark, folder)).panel.df


@query(
    sql.with_(
        tables.SUPPLIER_MONTHLY,
        "x AS (SELECT k, min(ts) AS lo, max(ts) AS hi FROM p GROUP BY k)",
        "c AS (SELECT k, unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS ts FROM x)",
        select="SELECT c.k, c.ts, p.value, p.k IS NOT NULL AS observed FROM c LEFT JOIN p ON p.k = c.k AND p.ts = c.ts",
    )
)
def fill_missing_months(spark: SparkSession, folder: str) -> DataFrame:
    """Months without a delivery are put in empty."""
    return reg.to_grid(tables.supplier_monthly(spark, folder)).panel.df


_ON_CALENDAR = "SELECT c.k, c.ts, p.value, p.k IS NOT NULL AS observed FROM c LEFT JOIN p ON p.k = c.k AND p.ts = c.ts"


@query(
    sql.with_(
        tables.SUPPLIER_WEEKLY,
        "x AS (SELECT k, min(ts) AS lo, max(ts) AS hi FROM p GROUP BY k)",
        "c AS (SELECT k, unnest(generate_series(lo + to_days(CAST((7 - dayofweek(lo)) % 7 AS INTEGER)), hi, INTERVAL 7 DAY)) AS ts FROM x)",
        select=_ON_CALENDAR,
    )
)
def fill_calendar_weeks(spark: SparkSession, folder: str) -> DataFrame:
    """Weeks end on Sundays: rows of another day leave their week empty."""
    return reg.to_grid(tables.supplier_weekly(spark, folder), anchor="calendar").panel.df


@query(
    sql.with_(
        tables.MID_MONTH,
        "x AS (SELECT k, min(ts) AS lo, max(ts) AS hi FROM p GROUP BY k)",
        "m AS (SELECT k, lo, hi, unnest(generate_series(date_trunc('month', lo)::TIMESTAMP, hi, INTERVAL 1 MONTH)) AS mo FROM x)",
        "c AS (SELECT k, last_day(mo)::TIMESTAMP AS ts FROM m WHERE last_day(mo)::TIMESTAMP BETWEEN lo AND hi)",
        select=_ON_CALENDAR,
    )
)
def fill_calendar_months(spark: SparkSession, folder: str) -> DataFrame:
    """Months end on their last day: rows of another day leave their month empty."""
    return reg.to_grid(tables.mid_month(spark, folder), anchor="calendar").panel.df


@query(
    sql.with_(
        tables.GAPPY_DAILY, sql.GRID, sql.TIME_FILL, select="SELECT k, ts, round(value, 6) AS value FROM filled"
    )
)
def interpolate_by_time(spark: SparkSession, folder: str) -> DataFrame:
    grid = reg.to_grid(tables.gappy_daily(spark, folder)).panel
    return _rows(reg.interpolate_time(grid))


_FILLS = """
w AS (SELECT k, ts, value,
       last_value(value IGNORE NULLS) OVER (PARTITION BY k ORDER BY ts) AS pv,
       first_value(value IGNORE NULLS) OVER
           (PARTITION BY k ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv
       FROM p)"""


@query(sql.with_(tables.GAPPY_HOURLY, _FILLS, select="SELECT k, ts, coalesce(pv, nv) AS value FROM w"))
def fill_forward_then_back(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(reg.forward_fill(tables.gappy_hourly(spark, folder), then_backward=True))


@query(sql.with_(tables.GAPPY_HOURLY, _FILLS, select="SELECT k, ts, pv AS value FROM w"))
def fill_forward(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(reg.forward_fill(tables.gappy_hourly(spark, folder)))


@query(sql.with_(tables.GAPPY_HOURLY, _FILLS, select="SELECT k, ts, nv AS value FROM w"))
def fill_backward(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(reg.backward_fill(tables.gappy_hourly(spark, folder)))


@query(
    sql.with_(
        tables.GAPPY_HOURLY,
        "r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts) AS i FROM p)",
        """n AS (SELECT *, last_value(value IGNORE NULLS) OVER back AS pv,
             last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER back AS pi,
             first_value(value IGNORE NULLS) OVER ahead AS nv,
             first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER ahead AS ni
             FROM r WINDOW back AS (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING),
             ahead AS (PARTITION BY k ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""",
        select="""SELECT k, ts, round(coalesce(value, pv + (i - pi)::DOUBLE / nullif(ni - pi, 0) * (nv - pv),
        CASE WHEN nv IS NULL THEN pv END), 6) AS value FROM n""",
    )
)
def interpolate_by_row(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(reg.interpolate_position(tables.gappy_hourly(spark, folder)))


def _constant_sql(centre: str) -> str:
    return sql.with_(
        tables.GAPPY_HOURLY,
        f"m AS (SELECT k, {centre} AS fill FROM p GROUP BY k)",
        select="SELECT k, ts, round(coalesce(value, fill), 6) AS value FROM p JOIN m USING (k)",
    )


@query(_constant_sql("avg(value)"))
def fill_mean(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(reg.fill_constant(tables.gappy_hourly(spark, folder), "mean"))


@query(_constant_sql("quantile_cont(value, 0.5)"))
def fill_median(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(reg.fill_constant(tables.gappy_hourly(spark, folder), "median"))


@query(sql.with_(tables.EVENT_RAW, select="SELECT k, min(ts) AS ts, value FROM p GROUP BY k, value"))
def drop_repeated_values(spark: SparkSession, folder: str) -> DataFrame:
    return reg.first_per_value(tables.event_raw(spark, folder))


_REPORT = """
raw AS (SELECT k, count(*) AS original_rows, count(ts) AS stamped FROM d GROUP BY k),
rep AS (SELECT k, count(*) AS final_rows, sum(observed::INT) AS kept, count(value) AS known FROM grid GROUP BY k),
uni AS (SELECT k, count(*) AS unique_rows FROM p GROUP BY k)"""


@query(
    sql.with_(
        tables.DIRTY_ORDERS,
        sql.UNIQUE_ORDERS,
        sql.GRID,
        _REPORT,
        select="""SELECT k, original_rows, original_rows - stamped AS rows_removed,
        stamped - unique_rows AS duplicates_removed, (final_rows - kept)::BIGINT AS missing_dates_filled,
        final_rows - known AS missing_values_filled, (unique_rows - kept)::BIGINT AS off_grid_rows,
        final_rows, frequency FROM raw JOIN rep USING (k) JOIN uni USING (k) JOIN frequency USING (k)""",
    )
)
def cleaning_report(spark: SparkSession, folder: str) -> DataFrame:
    return reg.clean(tables.dirty_orders(spark, folder), "o_orderkey").report


_CLEANED = [tables.DIRTY_ORDERS, sql.UNIQUE_ORDERS, sql.GRID, sql.TIME_FILL]


@query(sql.with_(*_CLEANED, select="SELECT k, ts, round(value, 6) AS value, observed FROM filled"))
def clean_series(spark: SparkSession, folder: str) -> DataFrame:
    return _cleaned(tables.dirty_orders(spark, folder))


@query(ORACLE["clean_series"])
def clean_series_in_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return _cleaned(tables.in_chunks(tables.dirty_orders(spark, folder)))


def _cleaned(panel: Panel) -> DataFrame:
    return reg.clean(panel, "o_orderkey").panel.df.select("k", "ts", *six("value"), "observed")


@query(
    sql.with_(
        *_CLEANED, sql.SPLIT, select="SELECT k, ts, round(value, 6) AS value FROM split"
    )
)
def prepare_for_forecast(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(reg.prepare_forecast(tables.dirty_orders(spark, folder), "o_orderkey").panel.df)


def _resample_sql(fixture: str, label: str, step: str) -> str:
    """Bucket labels, the full run of labels per series, and the means laid on it."""
    return sql.with_(
        fixture,
        f"m AS (SELECT k, ({label})::TIMESTAMP AS b, avg(value) AS value FROM p GROUP BY 1, 2)",
        "x AS (SELECT k, min(b) AS lo, max(b) AS hi FROM m GROUP BY k)",
        f"c AS (SELECT k, {step} AS b FROM x)",
        select="SELECT c.k, c.b AS ts, round(m.value, 6) AS value FROM c LEFT JOIN m ON m.k = c.k AND m.b = c.b",
    )


def _last_days(months: int) -> str:
    run = f"generate_series(lo + INTERVAL 1 DAY, hi + INTERVAL 1 DAY, INTERVAL {months} MONTH)"
    return f"unnest(list_transform({run}, lambda d: d - INTERVAL 1 DAY))"


_BUCKETS = {
    "day": ("date_trunc('day', ts)", "unnest(generate_series(lo, hi, INTERVAL 1 DAY))"),
    "week": ("date_trunc('week', ts) + INTERVAL 6 DAY", "unnest(generate_series(lo, hi, INTERVAL 7 DAY))"),
    "month": ("last_day(ts)", _last_days(1)),
    "quarter": ("date_trunc('quarter', ts) + INTERVAL 3 MONTH - INTERVAL 1 DAY", _last_days(3)),
    "year": ("date_trunc('year', ts) + INTERVAL 1 YEAR - INTERVAL 1 DAY", _last_days(12)),
}


def _register_resample(unit: str, fixture: str, make) -> None:
    label, step = _BUCKETS[unit]

    @query(_resample_sql(fixture, label, step), name=f"resample_{unit}")
    def resample(spark: SparkSession, folder: str) -> DataFrame:
        return _rows(reg.resample_mean(make(spark, folder), unit))


_register_resample("day", tables.EVENT_RAW, tables.event_raw)
for _unit in ("week", "month", "quarter", "year"):
    _register_resample(_unit, tables.PRIORITY_DAILY, tables.priority_daily)


@query(
    sql.with_(
        tables.GAPPY_HOURLY,
        "z AS (SELECT k, avg(value) AS m, nullif(stddev_samp(value), 0) AS s FROM p GROUP BY k)",
        select="SELECT k, ts, value FROM p JOIN z USING (k) WHERE abs((value - m) / s) < 2.0",
    )
)
def drop_outliers_by_zscore(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(reg.drop_outliers_zscore(tables.gappy_hourly(spark, folder), 2.0))


_IQR = """
b AS (SELECT k, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM p GROUP BY k),
i AS (SELECT p.*, q1 - 1.5 * (q3 - q1) AS lower_bound, q3 + 1.5 * (q3 - q1) AS upper_bound FROM p JOIN b USING (k))"""


@query(
    sql.with_(
        tables.GAPPY_HOURLY, _IQR, select="SELECT k, ts, value FROM i WHERE value BETWEEN lower_bound AND upper_bound"
    )
)
def drop_outliers_by_iqr(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(reg.drop_outliers_iqr(tables.gappy_hourly(spark, folder)))


@query()
def drop_outliers_by_forest(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(forest.drop_outliers_forest(tables.gappy_hourly(spark, folder)))


_THIN_LIMIT = 500


@query(
    sql.with_(
        tables.EVENT_RAW,
        """r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts) - 1 AS pos,
           count(*) OVER (PARTITION BY k) AS n FROM p)""",
        select=f"""SELECT k, ts, value FROM r
        WHERE pos % (CASE WHEN n > {_THIN_LIMIT} THEN n // {_THIN_LIMIT} ELSE 1 END) = 0""",
    )
)
def thin_long_series(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(reg.thin(tables.event_raw(spark, folder), _THIN_LIMIT).df)


@query(
    sql.with_(
        tables.EVENT_RAW,
        "m AS (SELECT k, date_trunc('day', ts)::TIMESTAMP AS b, avg(value) AS value FROM p GROUP BY 1, 2)",
        "x AS (SELECT k, min(b) AS lo, max(b) AS hi FROM m GROUP BY k)",
        "c AS (SELECT k, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS b FROM x)",
        "j AS (SELECT c.k, c.b AS ts, m.value FROM c LEFT JOIN m ON m.k = c.k AND m.b = c.b)",
        "y AS (SELECT k, ts, last_value(value IGNORE NULLS) OVER (PARTITION BY k ORDER BY ts) AS value FROM j)",
        "z AS (SELECT k, avg(value) AS m, stddev_samp(value) AS s FROM y GROUP BY k)",
        select="SELECT k, ts, round(value, 6) AS value FROM y JOIN z USING (k) WHERE abs((value - m) / s) < 1.5",
    )
)
def preprocess_options(spark: SparkSession, folder: str) -> DataFrame:
    """Daily means, forward fill, then z-score outliers."""
    return _rows(reg.preprocess(tables.event_raw(spark, folder), "day", "ffill", "zscore", 1.5))


@query(ORACLE["preprocess_options"])
def preprocess_raw_table(spark: SparkSession, folder: str) -> DataFrame:
    """The same from a raw table whose stamps are texts and whose numbers are wide."""
    events = tables.table(spark, folder, "events")
    raw = events.select(
        F.col("event_type").alias("k"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"),
        F.round(F.col("value") * 100).cast("long").alias("cents"),
    )
    return _rows(reg.preprocess_table(raw, "at", "cents", ["k"], resample="day", fill="ffill", outliers="zscore", threshold=1.5))


@query(
    sql.with_(
        *_CLEANED, sql.SPLIT,
        select="""SELECT k, count(*) AS rows, min(ts) AS start, max(ts) AS end,
        CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000) AS BIGINT) AS total_days FROM split GROUP BY k""",
    )
)
def prepared_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Size and span of the prepared series."""
    prepared = reg.prepare_forecast(tables.dirty_orders(spark, folder), "o_orderkey")
    return prepared.metadata().select("k", "rows", "start", "end", "total_days")


# --- window features ------------------------------------------------------------


def _gated(aggregate: str, window: int) -> str:
    return f"CASE WHEN count(value) OVER f = {window} THEN round({aggregate}(value) OVER f, 6) END"


def _rolling_sql(fixture: str, window: int, select: str) -> str:
    return sql.with_(
        fixture,
        f"""r AS (SELECT k, ts, value, {_gated("avg", window)} AS m, {_gated("stddev_samp", window)} AS s,
        {_gated("min", window)} AS lo, {_gated("max", window)} AS hi FROM p
        WINDOW f AS (PARTITION BY k ORDER BY ts ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW))""",
        select=select,
    )


@query(
    _rolling_sql(
        tables.EVENT_RAW,
        7,
        """SELECT k, ts, value, m AS rolling_mean_7, s AS rolling_std_7, lo AS rolling_min_7, hi AS rolling_max_7
        FROM r""",
    )
)
def rolling_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return _rolled(tables.event_raw(spark, folder))


@query(ORACLE["rolling_statistics"])
def rolling_statistics_in_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return _rolled(tables.in_chunks(tables.event_raw(spark, folder)))


def _rolled(panel: Panel) -> DataFrame:
    return features.rolling_stats(panel, 7).select(
        "k", "ts", "value", *six("rolling_mean_7", "rolling_std_7", "rolling_min_7", "rolling_max_7")
    )


@query(
    sql.with_(
        tables.GAPPY_DAILY,
        """r AS (SELECT k, ts, value, CASE WHEN count(value) OVER f = 5 THEN avg(value) OVER f END AS m,
        CASE WHEN count(value) OVER f = 5 THEN stddev_samp(value) OVER f END AS s FROM p
        WINDOW f AS (PARTITION BY k ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))""",
        select="""SELECT k, ts, value, round(m, 4) AS mean, round(m + s, 4) AS upper, round(m - s, 4) AS lower
        FROM r""",
    )
)
def rolling_mean_band(spark: SparkSession, folder: str) -> DataFrame:
    band = features.rolling_band(tables.gappy_daily(spark, folder), 5)
    return band.select("k", "ts", "value", *[F.round(c, 4).alias(c) for c in ("mean", "upper", "lower")])


@query(
    sql.with_(
        tables.EVENT_RAW,
        sql.NUMBERED,
        "q AS (SELECT k, greatest(5, count(*) // 25) AS w FROM v GROUP BY k)",
        select="""SELECT k, pos, value, round(avg(value) OVER (PARTITION BY k ORDER BY pos
        ROWS BETWEEN (w // 2) PRECEDING AND ((w - 1) // 2) FOLLOWING), 8) AS smooth FROM v JOIN q USING (k)""",
    )
)
def centred_rolling_mean(spark: SparkSession, folder: str) -> DataFrame:
    panel = tables.event_raw(spark, folder)
    counts = panel.df.groupBy("k").agg(F.count("*").alias("n"), F.avg("value").alias("_mean"))
    return features.centred_mean(panel, counts).select("k", "pos", "value", F.round("smooth", 8).alias("smooth"))


@query(
    sql.with_(
        tables.PRIORITY_DAILY,
        select="""SELECT k, ts, value, lag(value, 1) OVER w AS lag_1, lag(value, 2) OVER w AS lag_2,
        lag(value, 3) OVER w AS lag_3 FROM p WINDOW w AS (PARTITION BY k ORDER BY ts)""",
    )
)
def lagged_values(spark: SparkSession, folder: str) -> DataFrame:
    return features.lag_features(tables.priority_daily(spark, folder), 3)


@query(
    sql.with_(
        tables.PRIORITY_DAILY,
        select="""SELECT k, ts, value, round(value - lag(value, 2) OVER (PARTITION BY k ORDER BY ts), 6) AS diff_2
        FROM p""",
    )
)
def lagged_difference(spark: SparkSession, folder: str) -> DataFrame:
    return features.difference(tables.priority_daily(spark, folder), 2).select("k", "ts", "value", *six("diff_2"))


_CALENDAR = """year(ts) AS year, month(ts) AS month, day(ts) AS day, isodow(ts) - 1 AS day_of_week,
        dayofyear(ts) AS day_of_year, quarter(ts) AS quarter, isodow(ts) >= 6 AS is_weekend"""


@query(sql.with_(tables.EVENT_HOURLY, select=f"SELECT k, ts, value, {_CALENDAR} FROM p"))
def calendar_features(spark: SparkSession, folder: str) -> DataFrame:
    return features.date_features(tables.event_hourly(spark, folder))


@query(
    sql.with_(
        tables.PRIORITY_DAILY,
        select="SELECT k, month(ts) AS month, round(avg(value), 6) AS avg_value FROM p GROUP BY 1, 2",
    )
)
def month_of_year_averages(spark: SparkSession, folder: str) -> DataFrame:
    return features.month_averages(tables.priority_daily(spark, folder)).select("k", "month", *six("avg_value"))


@query(
    sql.with_(
        tables.EVENT_HOURLY,
        select=f"""SELECT k, ts, value, lag(value, 1) OVER w AS lag_1, lag(value, 2) OVER w AS lag_2,
        lag(value, 3) OVER w AS lag_3, round(value - lag(value, 1) OVER w, 6) AS diff_1,
        {_gated("avg", 7)} AS rolling_mean_7, {_gated("stddev_samp", 7)} AS rolling_std_7,
        {_gated("min", 7)} AS rolling_min_7, {_gated("max", 7)} AS rolling_max_7, {_CALENDAR} FROM p
        WINDOW w AS (PARTITION BY k ORDER BY ts),
               f AS (PARTITION BY k ORDER BY ts ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
    )
)
def joined_features(spark: SparkSession, folder: str) -> DataFrame:
    joined = features.all_features(tables.event_hourly(spark, folder), lags=3, window=7, diff=1)
    exact = ["rolling_mean_7", "rolling_std_7", "rolling_min_7", "rolling_max_7", "diff_1"]
    return joined.select(*[c for c in joined.columns if c not in exact], *six(*exact))


# --- anomalies ------------------------------------------------------------------


@query(
    sql.with_(
        tables.EVENT_RAW,
        "z AS (SELECT k, avg(value) AS m, nullif(stddev_samp(value), 0) AS s FROM p GROUP BY k)",
        select="""SELECT k, ts, value, round((value - m) / s, 6) AS z,
        coalesce(abs((value - m) / s) > 3.0, FALSE) AS is_anomaly FROM p JOIN z USING (k)""",
    )
)
def zscore_flags(spark: SparkSession, folder: str) -> DataFrame:
    flagged = anomaly.zscore_anomalies(tables.event_raw(spark, folder))
    return flagged.select("k", "ts", "value", *six("z"), "is_anomaly")


@query(
    sql.with_(
        tables.EVENT_RAW,
        _IQR,
        select="""SELECT k, ts, value, round(lower_bound, 6) AS lower_bound, round(upper_bound, 6) AS upper_bound,
        value < lower_bound OR value > upper_bound AS is_anomaly FROM i""",
    )
)
def iqr_flags(spark: SparkSession, folder: str) -> DataFrame:
    return _outside_iqr(tables.event_raw(spark, folder))


@query(ORACLE["iqr_flags"])
def iqr_flags_in_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return _outside_iqr(tables.in_chunks(tables.event_raw(spark, folder)))


def _outside_iqr(panel: Panel) -> DataFrame:
    return anomaly.iqr_anomalies(panel).select("k", "ts", "value", *six("lower_bound", "upper_bound"), "is_anomaly")


@query()
def forest_flags(spark: SparkSession, folder: str) -> DataFrame:
    flagged = forest.forest_anomalies(tables.event_raw(spark, folder))
    return flagged.select("k", "ts", "value", *six("score"), "is_anomaly")


_DEVIATION = """
r AS (SELECT k, ts, value, CASE WHEN count(value) OVER f = 7 THEN avg(value) OVER f END AS m,
             CASE WHEN count(value) OVER f = 7 THEN 2.0 * stddev_samp(value) OVER f END AS s
      FROM p WINDOW f AS (PARTITION BY k ORDER BY ts ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))"""


@query(
    sql.with_(
        tables.EVENT_RAW,
        _DEVIATION,
        select="""SELECT k, ts, value, round(m, 6) AS moving_avg, round(m + s, 6) AS upper_bound,
        round(m - s, 6) AS lower_bound, coalesce(value > m + s OR value < m - s, FALSE) AS is_anomaly FROM r""",
    )
)
def moving_average_flags(spark: SparkSession, folder: str) -> DataFrame:
    flagged = anomaly.moving_average_anomalies(tables.event_raw(spark, folder))
    return flagged.select("k", "ts", "value", *six("moving_avg", "upper_bound", "lower_bound"), "is_anomaly")


@query(
    sql.with_(
        tables.EVENT_RAW,
        _IQR,
        select="""SELECT k, count(*) FILTER (value < lower_bound OR value > upper_bound) AS anomalies,
        count(*) AS points FROM i GROUP BY k""",
    )
)
def anomaly_counts(spark: SparkSession, folder: str) -> DataFrame:
    panel = tables.event_raw(spark, folder)
    return anomaly.count_anomalies(panel.keys, anomaly.iqr_anomalies(panel))


@query(
    sql.with_(
        tables.EVENT_RAW, _DEVIATION, select="SELECT k, ts, value FROM r WHERE value > m + s OR value < m - s"
    )
)
def anomaly_listing(spark: SparkSession, folder: str) -> DataFrame:
    panel = tables.event_raw(spark, folder)
    return anomaly.list_anomalies(panel.keys, anomaly.moving_average_anomalies(panel))
