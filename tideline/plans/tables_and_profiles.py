"""Queries over sources, schema, profiles, time parsing and column detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.dates import DAY_MICROS, EXCEL_EPOCH
from tideline.operators import chunks, detect, schema
from tideline.operators.features import date_features
from tideline.operators.regularize import too_short
from tideline.panel import Panel, number
from tideline.plans import sql, tables
from tideline.plans.catalog import query
from tideline.plans.tables import table
from tideline.session import scratch_path
from tideline.sources import files

ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def _orders_csv(spark: SparkSession, folder: str) -> str:
    return files.export_csv(table(spark, folder, "orders"), scratch_path(spark, "orders-csv"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def load_csv_typed(spark: SparkSession, folder: str) -> DataFrame:
    return files.read_table(spark, _orders_csv(spark, folder))


@query(
    "SELECT o_orderkey::VARCHAR AS o_orderkey, o_custkey::VARCHAR AS o_custkey, o_orderstatus, "
    "o_totalprice::VARCHAR AS o_totalprice, "
    "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') AS o_orderdate, o_orderpriority FROM orders"
)
def load_csv_strings(spark: SparkSession, folder: str) -> DataFrame:
    return files.read_strings(spark, _orders_csv(spark, folder))


@query("SELECT * FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 10000")
def preview_rows(spark: SparkSession, folder: str) -> DataFrame:
    return files.preview(table(spark, folder, "orders"), ["o_orderdate", "o_orderkey"])


@query("SELECT doc_id, substring(text, 1, 10000) AS preview, length(text) AS chars FROM documents")
def preview_text(spark: SparkSession, folder: str) -> DataFrame:
    documents = files.text_preview(table(spark, folder, "documents"), "text")
    return documents.select("doc_id", "preview", F.length("text").alias("chars"))


@query(
    """SELECT sum(length(text) + 1)::BIGINT AS chars, sum(len(string_split(text, chr(10))))::BIGINT AS lines
    FROM documents"""
)
def read_text_files(spark: SparkSession, folder: str) -> DataFrame:
    """Texts written as files of a thousand documents, read back whole and counted."""
    path = scratch_path(spark, "documents-text")
    table(spark, folder, "documents").select("text").write.option("maxRecordsPerFile", 1000).text(path)
    breaks = F.length("value") - F.length(F.replace("value", F.lit("\n")))
    return files.read_text(spark, path).agg(F.sum(F.length("value")).alias("chars"), F.sum(breaks).alias("lines"))


@query(
    sql.with_(
        tables.PRIORITY_DAILY,
        select="""SELECT k, ts, value, year(ts) AS year, month(ts) AS month, day(ts) AS day,
        isodow(ts) - 1 AS day_of_week, dayofyear(ts) AS day_of_year, quarter(ts) AS quarter,
        isodow(ts) >= 6 AS is_weekend FROM p""",
    )
)
def export_features_csv(spark: SparkSession, folder: str) -> DataFrame:
    features = date_features(tables.priority_daily(spark, folder))
    return files.read_table(spark, files.export_csv(features, scratch_path(spark, "features-csv")))


@query("SELECT o_orderdate AS ts, o_orderkey::DOUBLE AS value FROM orders")
def project_by_type(spark: SparkSession, folder: str) -> DataFrame:
    return schema.project(table(spark, folder, "orders")).df.select("ts", "value")


@query(
    "SELECT o_orderkey, o_totalprice AS reading FROM orders WHERE o_orderkey % 9 <> 0 AND o_orderkey % 7 <> 0"
)
def coerce_numbers(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    text = F.when(key % 9 == 0, "n/a").when(key % 7 != 0, F.col("o_totalprice").cast("string"))
    return schema.to_numbers(table(spark, folder, "orders").select("o_orderkey", text.alias("reading")), "reading")


@query(
    """SELECT o_custkey AS k, count(o_totalprice) AS points, 'fewer than 20 points' AS reason
    FROM orders GROUP BY 1 HAVING count(o_totalprice) < 20"""
)
def short_series(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").withColumnRenamed("o_custkey", "k")
    return too_short(Panel.of(orders, "o_orderdate", "o_totalprice", ["k"]))


@query(
    "SELECT *, o_orderdate + INTERVAL 3 HOUR AS placed, o_custkey % 100 AS small FROM orders"
)
def convert_column_types(spark: SparkSession, folder: str) -> DataFrame:
    placed = F.date_format(F.col("o_orderdate") + F.expr("interval 3 hours"), "yyyy-MM-dd HH:mm:ss")
    raw = table(spark, folder, "orders").withColumns({"placed": placed, "small": F.col("o_custkey") % 100})
    return schema.convert_types(raw)


_LINE_KINDS = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
    "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
    "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
}


def _advice_sql() -> str:
    parts = []
    for column, kind in _LINE_KINDS.items():
        best, category = f"CASE WHEN count(*) >= 0 THEN '{kind}' END", "FALSE"
        if kind in ("bigint", "int"):
            best = f"""CASE WHEN min({column}) > -128 AND max({column}) < 127 THEN 'tinyint'
                WHEN min({column}) > -32768 AND max({column}) < 32767 THEN 'smallint'
                WHEN min({column}) > -2147483648 AND max({column}) < 2147483647 THEN 'int' ELSE '{kind}' END"""
        elif kind == "double":
            best = f"""CASE WHEN bool_and(coalesce(round({column}, 6) = round({column}::FLOAT::DOUBLE, 6), FALSE))
                THEN 'float' ELSE 'double' END"""
        elif kind == "string":
            category = f"count(DISTINCT {column})::DOUBLE / count(*) < 0.5"
        parts.append(
            f"SELECT '{column}' AS \"column\", '{kind}' AS current_type, {best} AS recommended_type, "
            f"{category} AS is_category FROM lineitem"
        )
    return "\nUNION ALL\n".join(parts)


@query(_advice_sql())
def type_advice(spark: SparkSession, folder: str) -> DataFrame:
    return schema.narrow_profile(table(spark, folder, "lineitem"))


@query(
    """SELECT l_orderkey::INTEGER AS l_orderkey, l_partkey::INTEGER AS l_partkey, l_suppkey::INTEGER AS l_suppkey,
    l_linenumber, l_returnflag, l_linestatus, l_shipdate, round(l_quantity::FLOAT::DOUBLE, 2) AS l_quantity,
    round(l_extendedprice::FLOAT::DOUBLE, 1) AS l_extendedprice, round(l_discount::FLOAT::DOUBLE, 4) AS l_discount,
    round(l_tax::FLOAT::DOUBLE, 4) AS l_tax, TRY_CAST(l_orderkey * 100000 AS INTEGER) AS narrow,
    (TRY_CAST(l_orderkey * 100000 AS INTEGER) IS NULL)::INTEGER AS overflowed FROM lineitem"""
)
def force_narrow_types(spark: SparkSession, folder: str) -> DataFrame:
    """The whole table, with a column that overflows; floats are compared to a few digits."""
    forced = schema.force_narrow(
        table(spark, folder, "lineitem").withColumn("narrow", F.col("l_orderkey") * 100000)
    )
    digits = {"l_quantity": 2, "l_extendedprice": 1, "l_discount": 4, "l_tax": 4}
    return forced.withColumns({c: F.round(F.col(c).cast("double"), d) for c, d in digits.items()})


@query(
    """SELECT count(*) AS rows, 6 AS columns, count(o_orderkey) + count(o_custkey) + count(o_orderstatus)
    + count(o_totalprice) + count(o_orderdate) + count(o_orderpriority) AS filled_cells,
    count(*) > 0 AS structured FROM orders"""
)
def structure_check(spark: SparkSession, folder: str) -> DataFrame:
    return schema.is_structured(table(spark, folder, "orders"))


# A table whose header sits in the data: row 1 is full and holds the names, every
# fourth row is empty, one column is empty, and each other row has a gap.
@query(
    """SELECT o_orderkey AS row_no,
    CASE WHEN o_orderkey % 4 = 2 THEN 'MISSING_VALUE' ELSE o_custkey::VARCHAR END AS customer_no,
    CASE WHEN o_orderkey % 4 = 3 THEN 'MISSING_VALUE' ELSE o_orderstatus END AS "status",
    CASE WHEN o_orderkey % 4 = 1 THEN 'MISSING_VALUE' ELSE o_orderpriority END AS priority_class
    FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderkey <> 1"""
)
def repair_untidy(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")

    def cell(header: str, value, gap: int):
        return F.when(key == 1, header).when((key % 4 != 0) & (key % 4 != gap), value)

    untidy = table(spark, folder, "orders").select(
        key.alias("row_no"),
        cell("customer no.", F.col("o_custkey").cast("string"), 2).alias("_c0"),
        cell("status", F.col("o_orderstatus"), 3).alias("_c1"),
        F.lit(None).cast("string").alias("_c2"),
        cell("priority/class", F.col("o_orderpriority"), 1).alias("_c3"),
    )
    return schema.repair_structure(untidy, "row_no")


def _summary_sql() -> str:
    kinds = {
        "o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
        "o_orderdate": "timestamp_ntz", "o_orderpriority": "string",
    }
    return "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS "column", '{t}' AS type, (SELECT count(DISTINCT {c}) FROM orders) AS unique_values,
        (SELECT count(*) - count({c}) FROM orders) AS missing_values,
        (SELECT string_agg(s, '|' ORDER BY s) FROM
            (SELECT DISTINCT {c}::VARCHAR AS s FROM orders ORDER BY s LIMIT 5)) AS sample_values"""
        for c, t in kinds.items()
    )


@query(_summary_sql())
def summarise_columns(spark: SparkSession, folder: str) -> DataFrame:
    return schema.column_summary(table(spark, folder, "orders"))


@query(
    """SELECT count(*) AS rows, 6 AS columns,
    round(sum((o_totalprice IS NULL)::INT) / (count(*) * 6.0) * 100, 2) AS missing_percent,
    count(*) - count(DISTINCT (o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority))
    AS duplicate_rows, 'o_orderkey,o_custkey,o_totalprice' AS numeric_columns, 'o_orderdate' AS date_column,
    'Generic Time Series' AS dataset_type, min(o_orderdate) AS start_date, max(o_orderdate) AS end_date,
    floor((epoch_us(max(o_orderdate)) - epoch_us(min(o_orderdate))) / 86400000000)::BIGINT AS total_days
    FROM (SELECT * REPLACE (CASE WHEN o_orderkey % 17 <> 0 THEN o_totalprice END AS o_totalprice) FROM orders)"""
)
def dataset_basics(spark: SparkSession, folder: str) -> DataFrame:
    price = F.when(F.col("o_orderkey") % 17 != 0, F.col("o_totalprice"))
    return schema.table_basics(table(spark, folder, "orders").withColumn("o_totalprice", price))


@query(
    sql.with_(
        tables.EVENT_RAW,
        select="""SELECT k, count(value) AS "count", round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
        min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.25), 6) AS q25,
        round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75
        FROM p GROUP BY k""",
    )
)
def describe_series(spark: SparkSession, folder: str) -> DataFrame:
    described = schema.describe(tables.event_raw(spark, folder))
    return described.select("k", "count", "min", "max", *tables.six("mean", "std", "q25", "q50", "q75"))


@query(
    sql.with_(
        tables.GAPPY_DAILY,
        select="""SELECT k, count(*) AS points, count(*) - count(value) AS missing, min(ts) AS min_date,
        max(ts) AS max_date FROM p GROUP BY k""",
    )
)
def series_overview(spark: SparkSession, folder: str) -> DataFrame:
    return schema.overview(tables.gappy_daily(spark, folder))


@query("SELECT event_id, ts - INTERVAL 2 HOUR AS ts FROM events")
def strip_zone(spark: SparkSession, folder: str) -> DataFrame:
    """Stamps written with an offset of two hours become plain UTC stamps."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    zoned = F.concat(stamp, F.lit("+02:00")).cast("timestamp")
    return detect.to_datetime(table(spark, folder, "events").select("event_id", zoned.alias("ts")), "ts")


@query("SELECT o_orderkey, o_orderdate AS seconds, o_orderdate AS millis, o_orderdate AS excel FROM orders")
def parse_numeric_time(spark: SparkSession, folder: str) -> DataFrame:
    us = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit(EXCEL_EPOCH).cast("date"))
    df = table(spark, folder, "orders").select(
        "o_orderkey",
        (us / 1_000_000).cast("bigint").alias("seconds"),
        (us / 1000).cast("bigint").alias("millis"),
        (days + (us % DAY_MICROS) / DAY_MICROS).alias("excel"),
    )
    exprs = detect.time_expressions(df, ["seconds", "millis", "excel"])
    return df.withColumns(exprs)


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN NULL
    WHEN o_orderkey % 5 = 2 AND day(o_orderdate) <= 12
        THEN make_timestamp(year(o_orderdate), day(o_orderdate), month(o_orderdate), 0, 0, 0)
    ELSE o_orderdate END AS placed FROM orders"""
)
def parse_text_time(spark: SparkSession, folder: str) -> DataFrame:
    """Five spellings in one column: month-first is tried first, value by value."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    text = (
        F.when(key % 50 == 0, F.when(key % 100 == 0, "NULL").otherwise(" "))
        .when(key % 5 == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(key % 5 == 1, F.date_format(day, "MM/dd/yyyy"))
        .when(key % 5 == 2, F.date_format(day, "dd/MM/yyyy"))
        .when(key % 5 == 3, F.date_format(day, "MMM d, yyyy"))
        .otherwise(F.concat(F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
    )
    return detect.to_datetime(table(spark, folder, "orders").select("o_orderkey", text.alias("placed")), "placed")


def _time_scores_sql() -> str:
    def year(c: str) -> str:
        median = f"(SELECT median({c}) FROM orders)"
        return f"""CASE WHEN {median} > 20000 AND {median} < 90000
            THEN CASE WHEN {c} <= 2958465 THEN TIMESTAMP '1899-12-30' + to_days({c}::INT) END
            WHEN {c} BETWEEN 1000 AND 9999 THEN make_timestamp({c}, 1, 1, 0, 0, 0) END"""

    columns = {
        "o_orderkey": year("o_orderkey"),
        "o_custkey": year("o_custkey"),
        "o_orderstatus": "NULL::TIMESTAMP",
        "o_totalprice": "NULL::TIMESTAMP",
        "o_orderdate": "o_orderdate",
        "o_orderpriority": "NULL::TIMESTAMP",
    }
    parts = "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS "column", avg((({e}) IS NOT NULL)::INT) AS rate, count(DISTINCT {e}) AS distinct_stamps,
        '{c}' = 'o_orderdate' AS chosen FROM orders"""
        for c, e in columns.items()
    )
    return f"""SELECT "column", round(rate, 6) AS rate, distinct_stamps,
    round(rate * 100 + least(distinct_stamps, 100) * 0.05, 6) AS score, chosen FROM ({parts})"""


@query(_time_scores_sql())
def find_time_column(spark: SparkSession, folder: str) -> DataFrame:
    scores = detect.score_time_columns(table(spark, folder, "orders"), exact=True)
    return scores.select("column", "distinct_stamps", "chosen", *tables.six("rate", "score"))


def _target_sql(columns: list[str], source: str, favoured: set[str]) -> str:
    parts = "\nUNION ALL\n".join(
        f"""SELECT {i} AS ordinal, '{c}' AS "column", round({40 if c in favoured else 0}
        + (1 - (count(*) - count({c}))::DOUBLE / count(*)) * 20 + CASE WHEN var_samp({c}) > 0 THEN 15 ELSE 0 END
        + CASE WHEN count(DISTINCT {c})::DOUBLE / count(*) > 0.30 THEN 15 ELSE 0 END
        + CASE WHEN count(DISTINCT {c}) > 20 THEN 10 ELSE 0 END, 2) AS score FROM {source}"""
        for i, c in enumerate(columns)
    )
    return f"""SELECT "column", score, row_number() OVER (ORDER BY score DESC, ordinal) AS rank FROM ({parts})"""


_LINE_NUMBERS = [c for c, t in _LINE_KINDS.items() if t in ("bigint", "int", "double")]


@query(_target_sql(_LINE_NUMBERS, "lineitem", {"l_extendedprice", "l_discount"}))
def rank_target_columns(spark: SparkSession, folder: str) -> DataFrame:
    return detect.score_target_columns(table(spark, folder, "lineitem"))


@query(
    f"""SELECT "column", score FROM ({_target_sql(["o_orderkey", "o_custkey", "o_totalprice"],
    "(SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 17 <> 0 THEN o_totalprice END AS o_totalprice FROM orders)",
    {"o_totalprice"})}) WHERE rank = 1"""
)
def find_target_column(spark: SparkSession, folder: str) -> DataFrame:
    price = F.when(F.col("o_orderkey") % 17 != 0, F.col("o_totalprice"))
    scores = detect.score_target_columns(table(spark, folder, "orders").withColumn("o_totalprice", price))
    return scores.where("rank = 1").select("column", "score")


def _frequency_sql() -> str:
    select = "k, code, frequency, period, round(median_gap, 6) AS median_gap, first_ts, last_ts FROM frequency"
    parts = [
        f"""SELECT * FROM ({sql.with_(fixture, sql.FREQUENCY, select=f"SELECT '{name}' AS fixture, {select}")})"""
        for name, fixture in (
            ("daily", tables.PRIORITY_DAILY),
            ("monthly", tables.PRIORITY_MONTHLY),
            ("hourly", tables.EVENT_HOURLY),
            ("raw", tables.EVENT_RAW),
        )
    ]
    return "\nUNION ALL\n".join(parts)


@query(_frequency_sql())
def find_frequency(spark: SparkSession, folder: str) -> DataFrame:
    parts = {
        "daily": tables.priority_daily,
        "monthly": tables.priority_monthly,
        "hourly": tables.event_hourly,
        "raw": tables.event_raw,
    }
    found = [
        detect.detect_frequency(make(spark, folder)).select(
            F.lit(name).alias("fixture"), "k", "code", "frequency", "period", *tables.six("median_gap"), "first_ts", "last_ts"
        )
        for name, make in parts.items()
    ]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


@query(
    """SELECT l_returnflag, count(*) AS items, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
    FROM lineitem GROUP BY 1"""
)
def map_row_chunks(spark: SparkSession, folder: str) -> DataFrame:
    def revenue(chunk):
        return chunk.assign(revenue=chunk["l_extendedprice"] * (1 - chunk["l_discount"]))[["l_returnflag", "revenue"]]

    lines = table(spark, folder, "lineitem").select("l_returnflag", "l_extendedprice", "l_discount")
    priced = chunks.map_chunks(lines, revenue, "l_returnflag string, revenue double")
    return priced.groupBy("l_returnflag").agg(
        F.count("*").alias("items"), F.round(F.sum(number(F.col("revenue"))), 2).alias("revenue")
    )


@query(
    """SELECT count(*) AS lines, sum(length(whole))::BIGINT AS chars,
    sum(length(whole) - length(replace(whole, chr(65533), '')))::BIGINT AS replacement_chars
    FROM (SELECT coalesce(text, '') || CASE WHEN doc_id % 3 = 0 THEN chr(65533) ELSE '' END AS whole FROM documents)"""
)
def read_damaged_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Texts written with bad bytes and with genuine replacement characters: only the bad bytes go."""
    path = scratch_path(spark, "damaged-text")
    text = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(" "))
    genuine = F.when(F.col("doc_id") % 3 == 0, files.REPLACEMENT).otherwise("")
    bad = F.unhex(F.when(F.col("doc_id") % 2 == 0, "FFC3").otherwise("E282"))
    raw = F.concat(bad, F.concat(text, genuine).cast("binary"), bad).cast("string")
    table(spark, folder, "documents").select(raw.alias("value")).write.text(path)
    value = F.col("value")
    kept = F.length(value) - F.length(F.replace(value, F.lit(files.REPLACEMENT), F.lit("")))
    return files.read_lines(spark, path).agg(
        F.count("*").alias("lines"), F.sum(F.length(value)).alias("chars"), F.sum(kept).cast("long").alias("replacement_chars")
    )


@query("SELECT sum(l_quantity) AS quantity, count(*) AS rows FROM lineitem")
def chunk_totals(spark: SparkSession, folder: str) -> DataFrame:
    """A number from every chunk of rows, added up."""
    lines = table(spark, folder, "lineitem").select("l_quantity")
    found = chunks.chunk_results(lines, lambda chunk: float(chunk["l_quantity"].sum()), "double", 50_000)
    return found.agg(F.sum("result").alias("quantity"), F.sum("rows").alias("rows"))
