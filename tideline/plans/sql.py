"""Shared pieces of the oracle statements. Every piece reads ``p(k, ts, value)``."""

from __future__ import annotations

NUMBERED = """
v AS (SELECT k, ts, value, row_number() OVER (PARTITION BY k ORDER BY ts) - 1 AS pos,
             count(*) OVER (PARTITION BY k) AS n
      FROM p WHERE value IS NOT NULL)"""

FREQUENCY = """
g AS (SELECT k, ts, (epoch_us(ts) - epoch_us(lag(ts) OVER w))::DOUBLE AS gap,
             (year(ts) * 12 + month(ts)) - lag(year(ts) * 12 + month(ts)) OVER w AS months
      FROM p WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY k ORDER BY ts)),
h AS (SELECT k, count(*) AS n, min(gap) AS least, max(gap) AS most, quantile_cont(gap, 0.5) AS med,
             max(day(ts)) = 1 AND min(months) = 1 AND max(months) = 1
             AND max(epoch_us(ts) % 86400000000) = min(epoch_us(ts) % 86400000000) AS month_grid,
             min(ts) AS first_ts, max(ts) AS last_ts
      FROM g GROUP BY k),
e AS (SELECT *, CASE WHEN n < 3 THEN NULL
             WHEN least = 60e6 AND most = 60e6 THEN 'min'
             WHEN least = 86400e6 AND most = 86400e6 THEN 'D'
             WHEN month_grid THEN 'MS' END AS exact
      FROM h),
f AS (SELECT k, n AS points, first_ts, last_ts, exact,
             CASE WHEN n < 3 THEN NULL
             WHEN exact IS NOT NULL THEN exact
             WHEN med <= 1.1 * 3600e6 THEN 'H'
             WHEN med <= 1.5 * 86400e6 THEN 'D'
             WHEN med <= 8 * 86400e6 THEN 'W'
             WHEN med BETWEEN 27 * 86400e6 AND 32 * 86400e6 THEN 'M'
             WHEN med BETWEEN 80 * 86400e6 AND 100 * 86400e6 THEN 'Q'
             WHEN med BETWEEN 360 * 86400e6 AND 370 * 86400e6 THEN 'Y'
             ELSE 'IRREGULAR' END AS code,
             CASE WHEN n >= 3 AND exact IS NULL THEN med / 1e6 END AS median_gap
      FROM e),
frequency AS (SELECT *, CASE code WHEN 'H' THEN 'Hourly' WHEN 'D' THEN 'Daily' WHEN 'W' THEN 'Weekly'
                    WHEN 'M' THEN 'Monthly' WHEN 'MS' THEN 'Monthly' WHEN 'Q' THEN 'Quarterly'
                    WHEN 'Y' THEN 'Yearly' WHEN 'min' THEN 'Minute' WHEN 'IRREGULAR' THEN 'Irregular'
                    ELSE 'Unknown' END AS frequency,
             CASE code WHEN 'H' THEN 24 WHEN 'D' THEN 7 WHEN 'W' THEN 52 WHEN 'M' THEN 12 WHEN 'MS' THEN 12
                    WHEN 'Q' THEN 4 WHEN 'Y' THEN 1 WHEN 'min' THEN 60 END AS period
      FROM f)"""

TREND = """
t1 AS (SELECT k, max(n) AS n, regr_slope(value, pos) AS slope, regr_intercept(value, pos) AS intercept,
              CASE WHEN var_pop(value) = 0 THEN 0 ELSE regr_r2(value, pos) END AS r2,
              stddev_pop(value) AS sd, min(value) > 0 AS positive,
              regr_slope(CASE WHEN value > 0 THEN ln(value) END, pos) AS ls,
              regr_intercept(CASE WHEN value > 0 THEN ln(value) END, pos) AS li
       FROM v GROUP BY k),
t2 AS (SELECT v.k, sqrt(avg((value - (intercept + slope * pos)) ** 2)) AS line,
              sqrt(avg((value - exp(li + ls * pos)) ** 2)) AS curve
       FROM v JOIN t1 USING (k) GROUP BY v.k),
trend AS (SELECT k,
       CASE WHEN n < 10 THEN 'Unknown' WHEN slope > sd * 0.0005 THEN 'Increasing'
            WHEN slope < -sd * 0.0005 THEN 'Decreasing' ELSE 'Flat' END AS trend_direction,
       CASE WHEN n < 10 THEN 'Unknown' WHEN positive AND curve < line * 0.9 THEN 'Exponential'
            ELSE 'Linear' END AS trend_type,
       CASE WHEN n < 10 THEN 0 ELSE slope END AS slope, CASE WHEN n < 10 THEN 0 ELSE intercept END AS intercept,
       CASE WHEN n < 10 THEN 0 ELSE round(r2, 4) END AS r2,
       CASE WHEN n < 10 THEN 'Unknown' WHEN r2 >= 0.85 THEN 'Very Strong' WHEN r2 >= 0.65 THEN 'Strong'
            WHEN r2 >= 0.40 THEN 'Moderate' WHEN r2 >= 0.20 THEN 'Weak' ELSE 'Very Weak' END AS trend_strength,
       CASE WHEN n < 10 THEN 0 ELSE round(greatest(0, least(100, r2 * 100)), 1) END AS trend_confidence
       FROM t1 JOIN t2 USING (k))"""


def decomposition(period: int | None = None, multiplicative: bool = False) -> str:
    """Classical decomposition into ``dec(k, ts, pos, value, trend, seasonal, resid)``;
    without a period each series takes that of its frequency."""
    ratio = "(min(value) OVER (PARTITION BY k)) > 0" if multiplicative else "FALSE"
    source = f"(SELECT *, {period}::BIGINT AS period FROM v)" if period else "v JOIN frequency USING (k)"
    head = "pos >= half AND pos < least(half + period, n - 1 - half)"
    tail = "pos >= greatest(half, n - 1 - half - period) AND pos < n - 1 - half"
    return f"""
d0 AS (SELECT k, ts, value, pos, n, period, period // 2 AS half, {ratio} AS ratio FROM {source}
       WHERE n >= 2 * period),
d1 AS (SELECT *, CASE WHEN pos BETWEEN half AND n - 1 - half THEN
             (sum(value) OVER (w ROWS BETWEEN ((period - 1) // 2) PRECEDING AND ((period - 1) // 2) FOLLOWING)
              + CASE WHEN period % 2 = 0
                     THEN 0.5 * (lag(value, half) OVER w + lead(value, half) OVER w) ELSE 0 END) / period END AS ma
       FROM d0 WINDOW w AS (PARTITION BY k ORDER BY pos)),
d2 AS (SELECT k, regr_slope(ma, pos) FILTER ({head}) AS hk, regr_intercept(ma, pos) FILTER ({head}) AS hb,
       regr_slope(ma, pos) FILTER ({tail}) AS tk, regr_intercept(ma, pos) FILTER ({tail}) AS tb
       FROM d1 GROUP BY k),
d3 AS (SELECT d1.*, CASE WHEN pos < half THEN hk * pos + hb WHEN pos > n - 1 - half THEN tk * pos + tb
             ELSE ma END AS trend
       FROM d1 JOIN d2 USING (k)),
d4 AS (SELECT k, pos % period AS phase, avg(CASE WHEN ratio THEN value / trend ELSE value - trend END) AS m
       FROM d3 GROUP BY 1, 2),
d5 AS (SELECT k, phase, m, avg(m) OVER (PARTITION BY k) AS c FROM d4),
d6 AS (SELECT d3.*, CASE WHEN ratio THEN m / c ELSE m - c END AS seasonal
       FROM d3 JOIN d5 ON d3.k = d5.k AND d3.pos % d3.period = d5.phase),
dec AS (SELECT k, ts, pos, value, trend, seasonal,
             CASE WHEN ratio THEN value / seasonal / trend ELSE value - seasonal - trend END AS resid
       FROM d6)"""


def autocorrelation(lags: int | None = None) -> str:
    """Lags ``0..lags``, or three periods of each series' frequency."""
    wanted = (
        f"(SELECT DISTINCT k, unnest(range(0, {lags + 1})) AS lag FROM v)"
        if lags
        else "(SELECT k, unnest(range(0, 3 * period + 1)) AS lag FROM frequency)"
    )
    return f"""
c0 AS (SELECT k, pos, n, value - avg(value) OVER (PARTITION BY k) AS y FROM v),
c1 AS (SELECT a.k, any_value(a.n) AS n, l.lag, sum(a.y * b.y) AS s
       FROM {wanted} l JOIN c0 a ON a.k = l.k JOIN c0 b ON a.k = b.k AND b.pos = a.pos + l.lag
       GROUP BY a.k, l.lag),
ac AS (SELECT k, n, lag, s / max(CASE WHEN lag = 0 THEN s END) OVER (PARTITION BY k) AS acf FROM c1)"""


# Needs ``frequency``, and ``dec`` and ``ac`` at the period of each series.
SEASONALITY = """
s1 AS (SELECT k, stddev_pop(seasonal) / greatest(stddev_pop(value), 1e-9) AS strength FROM dec GROUP BY k),
s2 AS (SELECT k, max(abs(acf)) AS peak FROM ac JOIN (SELECT k, period FROM frequency) USING (k)
       WHERE lag BETWEEN period AND least(3 * period, n // 2) GROUP BY k),
s3 AS (SELECT k, strength, peak, strength * 0.6 + peak * 0.4 AS score FROM s1 JOIN s2 USING (k)),
season AS (SELECT f.k,
       CASE WHEN score IS NULL THEN 'Unknown' WHEN score >= 0.70 THEN 'Strong' WHEN score >= 0.45 THEN 'Moderate'
            WHEN score >= 0.25 THEN 'Weak' ELSE 'None' END AS seasonality,
       CASE WHEN f.points >= 20 THEN period END AS seasonal_period,
       coalesce(round(strength, 3), 0) AS seasonal_strength, coalesce(round(peak, 3), 0) AS acf_peak,
       coalesce(round(least(score * 100, 100), 1), 0) AS seasonality_confidence
       FROM frequency f LEFT JOIN s3 ON f.k = s3.k)"""


QUALITY = """
q0 AS (SELECT k, greatest(5, count(*) // 25) AS w, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
       FROM v GROUP BY k),
q1 AS (SELECT v.k, value, n, avg(CASE WHEN value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)
                          THEN 100.0 ELSE 0 END) OVER (PARTITION BY v.k) AS outliers,
              avg(value) OVER (PARTITION BY v.k ORDER BY pos
                          ROWS BETWEEN (w // 2) PRECEDING AND ((w - 1) // 2) FOLLOWING) AS smooth
       FROM v JOIN q0 USING (k)),
q2 AS (SELECT k, max(n) AS n, max(outliers) AS outliers, stddev_pop(value - smooth) AS noise,
              stddev_pop(smooth) AS signal
       FROM q1 GROUP BY k),
q3 AS (SELECT k, avg(CASE WHEN value IS NULL THEN 100.0 ELSE 0 END) AS missing FROM p GROUP BY k),
q4 AS (SELECT *, signal / greatest(noise, 1e-9) AS snr FROM q2 JOIN q3 USING (k)),
q5 AS (SELECT *, greatest(0, 100 - missing * 0.6 - outliers * 0.8
                     - CASE WHEN snr < 1 THEN 30 WHEN snr < 2 THEN 15 ELSE 0 END) AS score FROM q4),
quality AS (SELECT k, round(noise, 3) AS noise_level, round(signal, 3) AS signal_strength,
       round(snr, 3) AS signal_to_noise_ratio, round(missing, 2) AS missing_percent,
       round(outliers, 2) AS outlier_percent,
       CASE WHEN score >= 90 THEN 'Excellent' WHEN score >= 75 THEN 'Good' WHEN score >= 60 THEN 'Fair'
            WHEN score >= 40 THEN 'Poor' ELSE 'Very Poor' END AS data_quality,
       CASE WHEN score >= 90 THEN 'Easy' WHEN score >= 70 THEN 'Moderate' WHEN score >= 50 THEN 'Hard'
            ELSE 'Very Hard' END AS forecast_difficulty,
       round(score, 1) AS quality_confidence
       FROM q5)"""

ANALYSIS = """
a1 AS (SELECT *, greatest(0, 100 - missing_percent * 0.5 - outlier_percent * 0.7
                 - CASE WHEN signal_to_noise_ratio < 1 THEN 25 WHEN signal_to_noise_ratio < 2 THEN 10 ELSE 0 END)
              AS ready
       FROM trend JOIN season USING (k) JOIN quality USING (k) JOIN (SELECT k, frequency FROM frequency) USING (k)),
analysis AS (SELECT * EXCLUDE (ready), quality_confidence AS confidence,
       CASE WHEN seasonality = 'Strong' AND trend_strength IN ('Strong', 'Very Strong') THEN 'SARIMA'
            WHEN seasonality = 'Strong' AND trend_strength IN ('Weak', 'Very Weak') THEN 'Exponential Smoothing'
            WHEN trend_strength IN ('Strong', 'Very Strong') AND seasonality = 'None' THEN 'ARIMA'
            WHEN frequency IN ('Hourly', 'Daily', 'Weekly', 'Monthly') THEN 'Prophet'
            ELSE 'ARIMA' END AS recommended_model,
       concat_ws(' ',
            CASE WHEN seasonality = 'Strong' AND trend_strength IN ('Strong', 'Very Strong')
                      THEN 'Strong trend and strong seasonality detected.'
                 WHEN seasonality = 'Strong' AND trend_strength IN ('Weak', 'Very Weak')
                      THEN 'Seasonality dominates the series.'
                 WHEN trend_strength IN ('Strong', 'Very Strong') AND seasonality = 'None'
                      THEN 'Strong trend with little seasonality.'
                 WHEN frequency IN ('Hourly', 'Daily', 'Weekly', 'Monthly')
                      THEN 'Regular calendar frequency detected.' END,
            CASE WHEN signal_to_noise_ratio < 1
                      THEN 'High noise detected; forecast confidence may be lower.' END) AS recommendation_reason,
       round(ready, 1) AS forecast_readiness,
       CASE WHEN ready >= 90 THEN 'A+' WHEN ready >= 80 THEN 'A' WHEN ready >= 70 THEN 'B'
            WHEN ready >= 60 THEN 'C' ELSE 'Needs Improvement' END AS forecast_grade
       FROM a1)"""

# Lays series on the calendar of their frequency; ``p`` holds unique stamps.
STEP = """CASE code WHEN 'min' THEN INTERVAL 1 MINUTE WHEN 'H' THEN INTERVAL 1 HOUR WHEN 'D' THEN INTERVAL 1 DAY
             WHEN 'W' THEN INTERVAL 7 DAY WHEN 'M' THEN INTERVAL 1 MONTH WHEN 'MS' THEN INTERVAL 1 MONTH
             WHEN 'Q' THEN INTERVAL 3 MONTH WHEN 'Y' THEN INTERVAL 1 YEAR END"""

GRID = FREQUENCY + f""",
c AS (SELECT k, unnest(generate_series(first_ts, last_ts, {STEP})) AS ts
      FROM frequency WHERE code IS NOT NULL AND code <> 'IRREGULAR'
      UNION ALL SELECT k, ts FROM p JOIN frequency USING (k) WHERE code IS NULL OR code = 'IRREGULAR'),
grid AS (SELECT c.k, c.ts, p.value, p.k IS NOT NULL AS observed
         FROM c LEFT JOIN p ON p.k = c.k AND p.ts = c.ts)"""

TIME_FILL = """
near AS (SELECT *, epoch_us(ts) AS us,
       last_value(value IGNORE NULLS) OVER back AS pv,
       last_value(CASE WHEN value IS NOT NULL THEN epoch_us(ts) END IGNORE NULLS) OVER back AS pt,
       first_value(value IGNORE NULLS) OVER ahead AS nv,
       first_value(CASE WHEN value IS NOT NULL THEN epoch_us(ts) END IGNORE NULLS) OVER ahead AS nt
       FROM grid
       WINDOW back AS (PARTITION BY k ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
              ahead AS (PARTITION BY k ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (SELECT k, ts, observed,
       coalesce(value, pv + (us - pt)::DOUBLE / nullif(nt - pt, 0) * (nv - pv), pv, nv) AS value
       FROM near)"""

UNIQUE_ORDERS = """
p AS (SELECT k, ts, arg_min(struct_pack(value := value), o_orderkey).value AS value
      FROM d WHERE ts IS NOT NULL GROUP BY k, ts)"""

# Train/test split of ``filled``, with the constant forecasts and their scores.
SPLIT = """
s AS (SELECT k, ts, value, row_number() OVER (PARTITION BY k ORDER BY ts) - 1 AS pos,
             count(*) OVER (PARTITION BY k) AS n FROM filled WHERE value IS NOT NULL),
split AS (SELECT *, floor(n * (1.0::DOUBLE - CASE WHEN n < 100 THEN 0.30::DOUBLE WHEN n < 1000 THEN 0.20::DOUBLE
                 WHEN n < 10000 THEN 0.15::DOUBLE ELSE 0.10::DOUBLE END))::BIGINT AS n_train
          FROM s WHERE n >= 20)"""

BASELINES = """
lv AS (SELECT k, arg_max(value, pos) AS naive,
              avg(value) FILTER (pos >= n_train - least(10, greatest(3, n_train // 10))) AS average
       FROM split WHERE pos < n_train GROUP BY k),
fc AS (SELECT k, 'Naive' AS model, ts, value, naive AS yhat FROM split JOIN lv USING (k) WHERE pos >= n_train
       UNION ALL
       SELECT k, 'Moving Average', ts, value, average FROM split JOIN lv USING (k) WHERE pos >= n_train)"""

SCORES = """
m0 AS (SELECT k, model, avg(abs(value - yhat)) AS mae, avg((value - yhat) ** 2) AS mse,
              avg(abs((value - yhat) / greatest(abs(value), 1e-9))) AS mape, var_pop(value) AS var
       FROM fc GROUP BY k, model),
scores AS (SELECT k, model, round(mae, 4) AS mae, round(sqrt(mse), 4) AS rmse, round(mape * 100, 2) AS mape,
              round(CASE WHEN var > 0 THEN 1 - mse / var WHEN mse = 0 THEN 1 ELSE 0 END, 4) AS r2
       FROM m0)"""

BOARD = """
b0 AS (SELECT *, rank() OVER (PARTITION BY k ORDER BY rmse) AS rmse_rank,
              rank() OVER (PARTITION BY k ORDER BY mae) AS mae_rank,
              rank() OVER (PARTITION BY k ORDER BY mape) AS mape_rank,
              rank() OVER (PARTITION BY k ORDER BY r2 DESC) AS r2_rank FROM scores),
b1 AS (SELECT *, rmse_rank + mae_rank + mape_rank + r2_rank AS overall_score FROM b0),
board AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY overall_score,
              CASE model WHEN 'Naive' THEN 1 ELSE 2 END) AS place FROM b1)"""


def with_(*pieces: str, select: str) -> str:
    return "WITH " + ",".join(pieces) + "\n" + select


def _eliminated(name: str, columns: str) -> str:
    """Cross products of a regression's columns, and what is left of them after each column in turn
    is regressed out: ``{name}(k, z, lag, rows, p, g)`` with ``p - 1`` columns out.

    ``{name}_in(k, z, n, ys, ds, lag)`` holds levels and changes; row ``t`` explains the change after
    level ``t`` and runs from ``lag`` to ``n - 2``. ``columns`` gives column ``c``, the last is explained."""
    return f"""
{name}_c AS (SELECT k, z, lag, n - 1 - lag AS rows, c, {columns} AS vec
    FROM {name}_in, unnest(range(0, lag + 3)) AS t(c)),
{name}_g AS (SELECT a.k, a.z, a.lag, a.rows, a.c, list(list_inner_product(a.vec, b.vec) ORDER BY b.c) AS line
    FROM {name}_c a JOIN {name}_c b ON a.k = b.k AND a.z = b.z GROUP BY ALL),
{name} AS (SELECT k, z, lag, rows, 1::BIGINT AS p, list(line ORDER BY c) AS g FROM {name}_g GROUP BY k, z, lag, rows
    UNION ALL SELECT k, z, lag, rows, p + 1, list_transform(g, lambda line: list_transform(line,
        lambda v, c: v - line[p] * g[p][c] / g[p][p])) FROM {name} WHERE p <= lag + 2)"""


_LEVEL, _ONE = "list_slice(ys, lag + 1, n - 1)", "list_transform(range(0, n - 1 - lag), lambda x: 1.0::DOUBLE)"
_CHANGE = "list_slice(ds, lag + 1 - ({0}), n - 1 - ({0}))"

# The augmented Dickey-Fuller regression of ``series(k, z, i, value)``: lag by AIC over common rows,
# then the statistic with the level regressed last. The normal integral is Simpson's sum.
UNIT_ROOT = f"""
u_0 AS (SELECT k, z, count(*) AS n, avg(value) AS m, list(value ORDER BY i) AS y FROM series
        GROUP BY k, z HAVING max(value) > min(value)),
u_in AS (SELECT k, z, n, list_transform(y, lambda x: x - m) AS ys,
        list_transform(range(1, n), lambda i: (y[i + 1] - y[i])::DOUBLE) AS ds,
        least(n // 2 - 2, ceil(12.0 * (n / 100.0) ** 0.25)::BIGINT) AS lag FROM u_0),
{_eliminated("u", f"CASE WHEN c = 0 THEN {_LEVEL} WHEN c = 1 THEN {_ONE} WHEN c < lag + 2 THEN {_CHANGE.format('c - 1')} ELSE {_CHANGE.format('0')} END").strip()},
aic AS (SELECT k, z, p - 3 AS best, g[lag + 3][lag + 3] AS rss, rows * (ln(2 * pi() * rss / rows) + 1) + 2 * (p - 1) AS aic
        FROM u WHERE p >= 3 AND g[lag + 3][lag + 3] > 0),
w_in AS (SELECT k, z, n, ys, ds, best AS lag FROM u_in JOIN (SELECT k, z, arg_min(best, aic) AS best FROM aic GROUP BY k, z) USING (k, z)),
{_eliminated("w", f"CASE WHEN c = 0 THEN {_ONE} WHEN c <= lag THEN {_CHANGE.format('c')} WHEN c = lag + 1 THEN {_LEVEL} ELSE {_CHANGE.format('0')} END").strip()},
w_end AS (SELECT k, z, g[p][p] AS yy, g[p][p + 1] AS yd, (g[p + 1][p + 1] - yd * yd / yy) / (rows - lag - 2) / yy AS variance
        FROM w WHERE p = lag + 2 AND rows > lag + 2),
w_t AS (SELECT k, z, yd / yy / sqrt(variance) AS t,
        CASE WHEN t <= -1.61 THEN 2.1659 + 1.4412 * t + 0.038269 * t * t
             ELSE 1.7339 + 0.93202 * t - 0.12745 * t * t - 0.010368 * t * t * t END AS x,
        (x + 12) / 2000 AS h FROM w_end WHERE variance > 0),
unit_root AS (SELECT k, z, t AS statistic, CASE WHEN t > 2.74 THEN 1.0 WHEN t < -18.83 THEN 0.0
        ELSE h / 3 / sqrt(2 * pi()) * list_sum(list_transform(range(0, 2001),
            lambda j: CASE WHEN j IN (0, 2000) THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END * exp(-((j * h - 12) ** 2) / 2))) END AS pv
        FROM w_t)"""

# Levels and, as a second series, their changes.
LEVELS_AND_CHANGES = """
series AS (SELECT k, 0 AS z, pos AS i, value::DOUBLE AS value FROM v UNION ALL
    SELECT k, 1, pos, change::DOUBLE FROM (SELECT k, pos, value - lag(value) OVER (PARTITION BY k ORDER BY pos) AS change FROM v)
    WHERE change IS NOT NULL)"""

STATIONARITY = """
tested AS (SELECT c.k, n, a.statistic, a.pv AS p0, b.pv AS p1, n >= 20 AND p0 IS NOT NULL AS usable,
        coalesce(usable AND p0 < 0.05, FALSE) AS stationary, usable AND NOT (usable AND NOT stationary AND p1 IS NULL) AS settled
    FROM (SELECT k, count(value) AS n FROM p GROUP BY k) c
    LEFT JOIN unit_root a ON a.k = c.k AND a.z = 0 LEFT JOIN unit_root b ON b.k = c.k AND b.z = 1),
stationarity AS (SELECT k, stationary, CASE WHEN usable THEN round(p0, 5) END AS p_value,
        CASE WHEN stationary THEN 0 WHEN usable AND p1 >= 0.05 THEN 2 ELSE 1 END AS recommended_d,
        CASE WHEN settled THEN round((1 - p0) * 100, 1) ELSE 0 END AS confidence,
        CASE WHEN NOT settled THEN 'Unknown' WHEN stationary THEN 'Series is stationary.'
             ELSE 'Series requires differencing.' END AS interpretation,
        CASE WHEN settled THEN round(statistic, 4) END AS adf_statistic FROM tested)"""
