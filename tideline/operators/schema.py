"""Structure checks, column profiles, type advice and table summaries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.dates import text_to_time
from tideline.operators.detect import (
    detect_datetime_column,
    detect_target_column,
    numeric_columns,
    time_expressions,
)
from tideline.operators.distinct import column_counts, unpivot
from tideline.operators.quantile import summarise
from tideline.operators.stats import analyze_series
from tideline.panel import Panel, number, only_series

# The first group with a word in any column name names the data set.
DATASET_TYPES = [
    ("Weather Dataset", ["temp", "humidity", "wind", "rain", "pressure"]),
    ("Sales Dataset", ["sales", "revenue", "profit"]),
    ("Stock Market Dataset", ["close", "open", "volume", "stock"]),
    ("IoT Dataset", ["sensor", "iot", "device"]),
    ("Energy Dataset", ["power", "load", "energy"]),
    ("Traffic Dataset", ["traffic", "vehicle"]),
]
GENERIC_DATASET = "Generic Time Series"
MISSING = "MISSING_VALUE"

INTEGERS = [("tinyint", 1 << 7), ("smallint", 1 << 15), ("int", 1 << 31)]


def columns_of(df: DataFrame, kind: str) -> list[str]:
    """Column names by type class: ``number``, ``datetime`` or ``text``."""
    if kind == "number":
        return numeric_columns(df)
    wanted = {"datetime": (T.TimestampNTZType, T.TimestampType, T.DateType), "text": (T.StringType,)}[kind]
    return [f.name for f in df.schema.fields if isinstance(f.dataType, wanted)]


def _integers(df: DataFrame) -> list[str]:
    kinds = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def _floats(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]


def _missing(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    col = F.col(name)
    return col.isNull() | F.isnan(col) if isinstance(kind, (T.DoubleType, T.FloatType)) else col.isNull()


def narrow_profile(df: DataFrame) -> DataFrame:
    """Recommended type per column: ``column, current_type, recommended_type, is_category``.

    Integers take the narrowest type whose bounds they stay strictly inside; doubles
    become floats when equal to six decimals; texts with under half as many distinct
    values as rows are marked as categories."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    texts = columns_of(df, "text")
    aggregates = [F.count("*").alias("n")]
    for c in _integers(df):
        aggregates += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
    for c in _floats(df):
        same = F.round(c, 6) == F.round(F.col(c).cast("float").cast("double"), 6)
        aggregates.append(F.min(F.coalesce(same, F.lit(False))).alias(f"same_{c}"))
    stats = df.agg(*aggregates)
    entries = []
    for i, (c, kind) in enumerate(kinds.items()):
        best = F.lit(kind)
        if c in _integers(df):
            for name, bound in reversed(INTEGERS):
                fits = (F.col(f"min_{c}") > -bound) & (F.col(f"max_{c}") < bound - 1)
                best = F.when(fits, name).otherwise(best)
        elif c in _floats(df):
            best = F.when(F.col(f"same_{c}"), "float").otherwise(best)
        entries.append(
            F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column"), F.lit(kind).alias("current_type"), best.alias("recommended_type"), "n")
        )
    advice = stats.select(F.inline(F.array(*entries)))
    if not texts:
        return advice.select("column", "current_type", "recommended_type", F.lit(False).alias("is_category"))
    counts = column_counts(df, {c: F.col(c) for c in texts}, shares=(0.5,))
    distinct = counts.select("column", "distinct_values")
    return advice.join(distinct, "column", "left").select(
        "column",
        "current_type",
        "recommended_type",
        F.coalesce(F.col("distinct_values") / F.col("n") < 0.5, F.lit(False)).alias("is_category"),
    )


def narrow_types(df: DataFrame, floats: bool = False) -> DataFrame:
    """Apply the integer advice (and the float advice on request). One row per column is read."""
    advice = {r["column"]: r["recommended_type"] for r in narrow_profile(df).collect()}
    changed = {
        c: F.col(c).cast(t)
        for c, t in advice.items()
        if t != df.schema[c].dataType.simpleString() and (floats or t != "float")
    }
    return df.withColumns(changed) if changed else df


def force_narrow(df: DataFrame) -> DataFrame:
    """Doubles to float and bigints to int without asking; what does not fit becomes NULL
    and is counted in ``overflowed``."""
    wide = [f.name for f in df.schema.fields if isinstance(f.dataType, T.LongType)]
    narrow = {c: F.col(c).try_cast("int") for c in wide}
    lost = F.lit(0)
    for c in wide:
        lost = lost + (F.col(c).isNotNull() & narrow[c].isNull()).cast("int")
    return df.withColumns({"overflowed": lost, **narrow, **{c: F.col(c).cast("float") for c in _floats(df)}})


def convert_types(df: DataFrame, share: float = 0.9) -> DataFrame:
    """Texts that parse as time in at least ``share`` of rows become timestamps; integers narrow."""
    texts = columns_of(df, "text")
    changed = {}
    if texts:
        rates = df.agg(*[F.avg(text_to_time(F.col(c)).isNotNull().cast("double")).alias(c) for c in texts]).first()
        changed = {c: text_to_time(F.col(c)) for c in texts if (rates[c] or 0) >= share}
    bounds = _integers(df)
    if bounds:
        limits = df.agg(*[F.struct(F.min(c).alias("a"), F.max(c).alias("b")).alias(c) for c in bounds]).first()
        for c in bounds:
            low, high = limits[c]
            fits = [t for t, edge in INTEGERS if low is not None and -edge <= low and high <= edge - 1]
            if fits and fits[0] != df.schema[c].dataType.simpleString():
                changed[c] = F.col(c).cast(fits[0])
    return df.withColumns(changed) if changed else df


def is_structured(df: DataFrame) -> DataFrame:
    """One row: ``rows, columns, filled_cells, structured``."""
    width = len(df.columns)
    filled = F.lit(0)
    for c in df.columns:
        filled = filled + F.count(F.when(~_missing(df, c), 1))
    counts = df.agg(F.count("*").alias("rows"), filled.alias("filled_cells"))
    cells = F.col("rows") * width
    enough = (F.col("filled_cells") > 0) & (F.col("filled_cells") / F.nullif(cells, F.lit(0)) >= 0.1)
    return counts.select(
        "rows",
        F.lit(width).alias("columns"),
        "filled_cells",
        F.coalesce(enough, F.lit(False)).alias("structured"),
    )


def repair_structure(df: DataFrame, order: str) -> DataFrame:
    """Drop empty rows and columns, promote the fullest row (earliest on ties) to header,
    fill the gaps. ``order`` is the column giving the row order; it is kept."""
    body = [c for c in df.columns if c != order]
    seen = df.agg(*[F.count(c).alias(c) for c in body]).first()
    body = [c for c in body if seen[c]]
    filled = F.lit(0)
    for c in body:
        filled = filled + F.col(c).isNotNull().cast("int")
    rows = df.select(order, *[F.col(c).cast("string").alias(c) for c in body]).withColumn("_filled", filled)
    rows = rows.where("_filled > 0")
    header = rows.agg(F.min_by(F.struct("_filled", order, *body), F.struct(-F.col("_filled"), F.col(order))).alias("h")).first()
    fill = {c: F.coalesce(c, F.lit(MISSING)) for c in body}
    names = {}
    if header and header["h"] and header["h"]["_filled"] > 1:
        rows = rows.where(F.col(order) != F.lit(header["h"][order]))
        names = {c: re.sub(r"\W+", "_", header["h"][c] or MISSING).strip("_") for c in body}
    else:
        names = {c: re.sub(r"\W+", "_", c).strip("_") for c in body}
    return rows.select(order, *[fill[c].alias(names[c]) for c in body])


def column_summary(df: DataFrame, samples: int = 5) -> DataFrame:
    """Per column: type, distinct and missing counts, and the smallest values (as text)."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    long = unpivot(df, {c: F.when(~_missing(df, c), F.col(c).cast("string")) for c in df.columns})
    counted = long.groupBy("ordinal", "column", "value").agg(F.count("*").alias("c"))
    totals = counted.groupBy("ordinal", "column").agg(
        F.count("value").alias("unique_values"),
        F.sum(F.when(F.col("value").isNull(), F.col("c")).otherwise(0)).alias("missing_values"),
    )
    least = Window.partitionBy("ordinal", "column").orderBy("value")
    first = (
        counted.where(F.col("value").isNotNull())
        .withColumn("_r", F.row_number().over(least))
        .where(F.col("_r") <= samples)
        .groupBy("ordinal", "column")
        .agg(F.array_join(F.sort_array(F.collect_list("value")), "|").alias("sample_values"))
    )
    kind = F.col("column")
    named = F.create_map(*[x for c, k in kinds.items() for x in (F.lit(c), F.lit(k))])[kind]
    return totals.join(first, ["ordinal", "column"], "left").select(
        "column", named.alias("type"), "unique_values", "missing_values", "sample_values"
    )


def dataset_type(df: DataFrame) -> str:
    names = " ".join(df.columns).lower()
    return next((label for label, words in DATASET_TYPES if any(w in names for w in words)), GENERIC_DATASET)


def table_basics(df: DataFrame, date_column: str | None = None) -> DataFrame:
    """One row: size, missing share, repeated rows, numeric columns, time span, data set type."""
    date_column = date_column or detect_datetime_column(df)
    stamp = time_expressions(df, [date_column])[date_column] if date_column else F.lit(None).cast("timestamp_ntz")
    missing = F.lit(0)
    for c in df.columns:
        missing = missing + _missing(df, c).cast("int")
    # One partial aggregate per distinct row; repeated rows are what is left over.
    distinct = df.groupBy(*df.columns).agg(F.count("*").alias("_c")).withColumns({"_missing": missing, "_at": stamp})
    width, numeric = len(df.columns), numeric_columns(df)
    totals = distinct.agg(
        F.sum("_c").alias("rows"),
        (F.sum("_c") - F.count("*")).alias("duplicate_rows"),
        F.sum(F.col("_missing") * F.col("_c")).alias("_missing"),
        F.min("_at").alias("start_date"),
        F.max("_at").alias("end_date"),
    )
    share = F.col("_missing") / F.greatest(F.col("rows") * width, F.lit(1)) * 100
    days = F.floor((F.unix_micros(F.col("end_date").cast("timestamp")) - F.unix_micros(F.col("start_date").cast("timestamp"))) / 86_400_000_000)
    return totals.select(
        "rows",
        F.lit(width).alias("columns"),
        F.round(share.cast("double"), 2).alias("missing_percent"),
        "duplicate_rows",
        F.lit(",".join(numeric)).alias("numeric_columns"),
        F.lit(date_column).alias("date_column"),
        F.lit(dataset_type(df)).alias("dataset_type"),
        "start_date",
        "end_date",
        days.alias("total_days"),
    )


def describe(panel: Panel) -> DataFrame:
    return summarise(
        panel,
        {
            "count": F.count("value"),
            "mean": F.avg("value"),
            "std": F.stddev_samp("value"),
            "min": F.min("value"),
            "max": F.max("value"),
        },
        {"q25": 0.25, "q50": 0.5, "q75": 0.75},
    )


def overview(panel: Panel) -> DataFrame:
    """Points, missing values, first and last stamp per series."""
    return panel.df.groupBy(*panel.keys).agg(
        F.count("*").alias("points"),
        F.count(F.when(F.col("value").isNull(), 1)).alias("missing"),
        F.min("ts").alias("min_date"),
        F.max("ts").alias("max_date"),
    )


def project(df: DataFrame, ts: str | None = None, value: str | None = None, keys=()) -> Panel:
    """The panel of a table; unnamed columns are the first of their type class."""
    ts = ts or next(iter(columns_of(df, "datetime")))
    value = value or next(c for c in columns_of(df, "number") if c not in keys)
    return Panel.of(df, ts, value, keys)


def to_numbers(df: DataFrame, column: str) -> DataFrame:
    """Read a column as numbers and drop what is none."""
    return df.withColumn(column, number(F.col(column))).where(F.col(column).isNotNull())


def analyze_dataset(df: DataFrame, date_column: str | None = None, target: str | None = None) -> DataFrame:
    """One row: table basics with the series report of the chosen (or detected) columns."""
    date_column = date_column or detect_datetime_column(df)
    target = target or detect_target_column(df)
    basics = table_basics(df, date_column).withColumn("target_column", F.lit(target))
    if not date_column or not target:
        return basics
    stamped = df.withColumn("_ts", time_expressions(df, [date_column])[date_column])
    series = analyze_series(Panel.of(stamped, "_ts", target))
    joined = basics.withColumn("series", only_series("rows"))
    joined = joined.withColumnRenamed("missing_percent", "table_missing_percent")
    return joined.join(series, "series").drop("series")
