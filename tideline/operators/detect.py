"""Finding the time column, the target column and the frequency of each series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.dates import UNIT_RANGES, number_to_time, text_to_time
from tideline.functions.steps import DAY, HOUR, MINUTE, step_name, step_period
from tideline.operators.distinct import column_counts, exact_counts, unpivot
from tideline.operators.quantile import summarise
from tideline.operators.split import over_rows
from tideline.panel import Panel, micros, number

# Words that mark a time column, in order of preference.
TIME_WORDS = [
    "date", "datetime", "timestamp", "time", "day", "month", "year", "created_at", "updated_at",
    "order_date", "invoice_date", "transaction_date", "purchase_date", "sales_date", "weather_date",
    "observation_date", "observation_time", "measurement_time", "recorded_at", "event_time",
    "event_date", "log_time", "log_date", "dt",
]

# Words that favour a target column, and words that rule one out.
TARGET_WORDS = [
    "sales", "revenue", "profit", "price", "temperature", "temp", "humidity", "rain", "rainfall",
    "wind", "pressure", "load", "demand", "consumption", "power", "energy", "traffic", "count",
    "volume", "production", "stock", "close", "open", "high", "low", "cases", "patients",
]
IGNORED_WORDS = ["id", "index", "serial", "zipcode", "postal", "pin", "phone", "mobile"]


def numeric_columns(df: DataFrame) -> list[str]:
    kinds = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def _beyond(value: Column, mark: float) -> Column:
    """Whether the median of a group exceeds ``mark``, without ranking anything: rows up to the
    mark are counted, and where the two middle values lie on either side of it, they are the
    greatest value up to the mark and the least one beyond."""
    over = value > mark
    n, upto = F.count(value), F.count(F.when(~over, value))
    below, above = F.floor((n - 1) / 2), F.ceil((n - 1) / 2)
    left, right = F.max(F.when(~over, value)), F.min(F.when(over, value))
    middle = left + (right - left) / 2 > mark
    return (n > 0) & F.when(upto <= below, True).when(upto > above, False).otherwise(middle)


def column_units(df: DataFrame, columns: list[str]) -> dict[str, str | None]:
    """The numeric reading each column's median points at, if over 80 % of all rows parse in it.

    Medians are only held against the marks of the readings, so the rows stay where they are."""
    long = unpivot(df, {c: number(F.col(c)) for c in columns})
    value = F.col("value")
    facts = []
    for unit, (low, high) in UNIT_RANGES.items():
        meant = _beyond(value, low) if high is None else _beyond(value, low) & _beyond(-value, -high)
        facts += [meant.alias(f"meant_{unit}"), F.avg(number_to_time(value, unit).isNotNull().cast("double")).alias(f"parsed_{unit}")]
    found = long.groupBy("column").agg(*facts).collect()  # one row per column
    return {r["column"]: next((u for u in UNIT_RANGES if r[f"meant_{u}"] and r[f"parsed_{u}"] > 0.80), None) for r in found}


def time_expressions(df: DataFrame, columns: list[str] | None = None, dayfirst: bool = False) -> dict[str, Column]:
    """How to read each column as time. One row per numeric column reaches the driver."""
    columns = df.columns if columns is None else columns
    numeric = [c for c in numeric_columns(df) if c in columns]
    units = column_units(df, numeric) if numeric else {}
    exprs = {}
    for field in df.schema.fields:
        if field.name not in columns:
            continue
        col, kind = F.col(field.name), field.dataType
        if isinstance(kind, (T.TimestampNTZType, T.TimestampType, T.DateType)):
            exprs[field.name] = col.cast("timestamp_ntz")
        elif field.name in units:
            unit = units[field.name]
            whole = not isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType))
            as_text = text_to_time(col.cast("string")) if whole else F.lit(None).cast("timestamp_ntz")
            exprs[field.name] = number_to_time(col, unit) if unit else as_text
        elif isinstance(kind, T.StringType):
            exprs[field.name] = text_to_time(col, dayfirst)
    return exprs


def to_datetime(df: DataFrame, column: str, name: str | None = None, dayfirst: bool = False) -> DataFrame:
    """Read one column of any type as ``timestamp_ntz``."""
    return df.withColumn(name or column, time_expressions(df, [column], dayfirst)[column])


def score_time_columns(df: DataFrame, exact: bool = False) -> DataFrame:
    """One row per column: parsed share, distinct stamps, score and whether it is chosen.

    Scores use distinct stamps up to 100, and these are exact; larger counts are estimates
    unless ``exact`` asks for counting them all."""
    exprs, numeric = time_expressions(df), numeric_columns(df)
    counts = exact_counts(df, exprs) if exact else column_counts(df, exprs, upto=100)
    per_column = counts.select(
        "ordinal", "column", (F.col("filled") / F.col("rows")).alias("rate"), F.col("distinct_values").alias("distinct_stamps")
    )
    word_rank = F.lit(None).cast("int")
    for rank, word in reversed(list(enumerate(TIME_WORDS))):
        word_rank = F.when(F.lower("column").contains(word), rank).otherwise(word_rank)
    scored = per_column.withColumns(
        {
            "word_rank": word_rank,
            "score": F.col("rate") * 100 + F.least("distinct_stamps", F.lit(100)) * 0.05,
        }
    )
    # By name first, then by score, then any numeric column that parses.
    tier = (
        F.when(F.col("word_rank").isNotNull() & (F.col("rate") >= 0.60), 1)
        .when(F.col("score") >= 60, 2)
        .when(F.col("column").isin(numeric) & (F.col("rate") >= 0.80), 3)
    )
    within = F.when(tier == 1, F.col("word_rank").cast("double")).when(tier == 2, -F.col("score")).otherwise(0.0)
    best = Window.orderBy(tier.asc_nulls_last(), within, "ordinal")
    ranked = scored.withColumns({"_tier": tier, "_rank": F.row_number().over(best)})
    return ranked.select(
        "column",
        "rate",
        "distinct_stamps",
        "score",
        ((F.col("_rank") == 1) & F.col("_tier").isNotNull()).alias("chosen"),
    )


def detect_datetime_column(df: DataFrame) -> str | None:
    row = score_time_columns(df).where("chosen").first()
    return row["column"] if row else None


def score_target_columns(df: DataFrame) -> DataFrame:
    """Numeric columns ranked as forecasting targets: ``column, score, rank``.

    The spread is above zero exactly when two values differ, so no variance pass is needed."""
    columns = [c for c in numeric_columns(df) if not any(w in c.lower() for w in IGNORED_WORDS)]
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, score double, rank int")
    favoured = [c for c in columns if any(w in c.lower() for w in TARGET_WORDS)]
    distinct = F.col("distinct_values")
    score = (
        F.when(F.col("column").isin(favoured), 40).otherwise(0)
        + (1 - (F.col("rows") - F.col("filled")) / F.col("rows")) * 20
        + F.when(distinct > 1, 15).otherwise(0)
        + F.when(distinct / F.col("rows") > 0.30, 15).otherwise(0)
        + F.when(distinct > 20, 10).otherwise(0)
    )
    counts = column_counts(df, {c: number(F.col(c)) for c in columns}, upto=20, shares=(0.30,))
    scored = counts.withColumn("score", F.round(score.cast("double"), 2))
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "ordinal"))
    return scored.select("column", "score", rank.alias("rank"))


def detect_target_column(df: DataFrame) -> str | None:
    row = score_target_columns(df).where("rank = 1").first()
    return row["column"] if row else None


def detect_frequency(panel: Panel) -> DataFrame:
    """Per series: ``code, frequency, period, median_gap`` (seconds), first and last stamp,
    and whether every stamp is the last day of a month.

    Exact minute, day and month-start grids are recognised first; otherwise the
    median gap is banded. Exact grids report no gap."""
    stamped = panel.derive(panel.df.where(F.col("ts").isNotNull()))
    gapped = over_rows(stamped, 1, 0, {"_before": lambda w: F.lag("ts").over(w)})
    month = lambda c: F.year(c) * 12 + F.month(c)
    gapped = gapped.withColumns(
        {
            "_gap": (micros("ts") - micros("_before")).cast("double"),
            "_months": month("ts") - month("_before"),
            "_clock": micros("ts") - micros(F.date_trunc("day", "ts").cast("timestamp_ntz")),
        }
    )
    stats = summarise(
        stamped.derive(gapped),
        {
            "_n": F.count("*"),
            "_least": F.min("_gap"),
            "_most": F.max("_gap"),
            "_month_starts": F.max(F.dayofmonth("ts")) == 1,
            "_clocks": F.max("_clock") - F.min("_clock"),
            "_month_step": F.when(F.min("_months") == F.max("_months"), F.min("_months")),
            "month_ends": F.min(F.last_day("ts") == F.col("ts").cast("date")),
            "first_ts": F.min("ts"),
            "last_ts": F.max("ts"),
        },
        {"_median": 0.5},
        "_gap",
    )
    median = F.col("_median")
    every = lambda width: (F.col("_least") == width) & (F.col("_most") == width)
    month_grid = F.col("_month_starts") & (F.col("_month_step") == 1) & (F.col("_clocks") == 0)
    exact = F.when(every(MINUTE), "min").when(every(DAY), "D").when(month_grid, "MS")
    banded = (
        F.when(median <= 1.1 * HOUR, "H")
        .when(median <= 1.5 * DAY, "D")
        .when(median <= 8 * DAY, "W")
        .when(median.between(27 * DAY, 32 * DAY), "M")
        .when(median.between(80 * DAY, 100 * DAY), "Q")
        .when(median.between(360 * DAY, 370 * DAY), "Y")
        .otherwise("IRREGULAR")
    )
    enough = F.col("_n") >= 3
    code = F.when(enough, F.coalesce(exact, banded))
    seconds = F.when(enough & exact.isNull(), median / 1e6)
    return stats.select(
        *panel.keys,
        code.alias("code"),
        step_name(code).alias("frequency"),
        step_period(code).alias("period"),
        seconds.alias("median_gap"),
        "month_ends",
        "first_ts",
        "last_ts",
    )
