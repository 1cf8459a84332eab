"""The series the registered queries run on, in Spark and as SQL.

Each fixture is a rule over whole tables; the SQL twin is a common table expression
``p(k, ts, value)`` that the oracle statements start from. Values are whole (units, cents), so sums and
means are exact in both engines and need no tolerance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.panel import Panel
from tideline.session import configure


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _panel(df: DataFrame) -> Panel:
    return Panel.of(df, "ts", "value", ["k"])


CHUNK_ROWS = 150  # of the queries that repeat an operator with every series cut


def in_chunks(panel: Panel) -> Panel:
    """The panel with its series cut into small chunks, to hold that plan against the same oracle."""
    return Panel(panel.df, panel.keys, CHUNK_ROWS)


def priority_daily(spark: SparkSession, folder: str) -> Panel:
    """Daily revenue per order priority; has gaps."""
    orders = table(spark, folder, "orders")
    revenue = F.sum(F.floor("o_totalprice").cast("double")).alias("value")
    return _panel(orders.groupBy(F.col("o_orderpriority").alias("k"), F.col("o_orderdate").alias("ts")).agg(revenue))


PRIORITY_DAILY = """
p AS (SELECT o_orderpriority AS k, o_orderdate AS ts, sum(floor(o_totalprice)) AS value
      FROM orders GROUP BY 1, 2)"""


def gappy_daily(spark: SparkSession, folder: str) -> Panel:
    """As ``priority_daily`` with values missing on days divisible by seven."""
    panel = priority_daily(spark, folder)
    hole = F.dayofyear("ts") % 7 == 0
    return panel.derive(panel.df.withColumn("value", F.when(~hole, F.col("value"))))


GAPPY_DAILY = """
p AS (SELECT o_orderpriority AS k, o_orderdate AS ts,
             CASE WHEN dayofyear(o_orderdate) % 7 <> 0 THEN sum(floor(o_totalprice)) END AS value
      FROM orders GROUP BY 1, 2)"""


def priority_monthly(spark: SparkSession, folder: str) -> Panel:
    """Monthly revenue per order priority."""
    orders = table(spark, folder, "orders")
    month = F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("ts")
    revenue = F.sum(F.floor("o_totalprice").cast("double")).alias("value")
    return _panel(orders.groupBy(F.col("o_orderpriority").alias("k"), month).agg(revenue))


PRIORITY_MONTHLY = """
p AS (SELECT o_orderpriority AS k, date_trunc('month', o_orderdate)::TIMESTAMP AS ts,
             sum(floor(o_totalprice)) AS value
      FROM orders GROUP BY 1, 2)"""


def supplier_monthly(spark: SparkSession, folder: str) -> Panel:
    """Monthly quantity per supplier; some months have no delivery."""
    lines = table(spark, folder, "lineitem")
    month = F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("ts")
    return _panel(lines.groupBy(F.col("l_suppkey").alias("k"), month).agg(F.sum("l_quantity").alias("value")))


SUPPLIER_MONTHLY = """
p AS (SELECT l_suppkey AS k, date_trunc('month', l_shipdate)::TIMESTAMP AS ts, sum(l_quantity) AS value
      FROM lineitem GROUP BY 1, 2)"""


def supplier_weekly(spark: SparkSession, folder: str) -> Panel:
    """Weekly quantity per supplier, labelled by Sunday or (odd suppliers) by Monday; some weeks are missing."""
    lines = table(spark, folder, "lineitem")
    monday = F.date_trunc("week", "l_shipdate").cast("timestamp_ntz")
    label = F.when(F.col("l_suppkey") % 2 == 0, monday + F.expr("INTERVAL 6 DAYS")).otherwise(monday)
    return _panel(lines.groupBy(F.col("l_suppkey").alias("k"), label.alias("ts")).agg(F.sum("l_quantity").alias("value")))


SUPPLIER_WEEKLY = """
p AS (SELECT l_suppkey AS k,
             date_trunc('week', l_shipdate)::TIMESTAMP + CASE WHEN l_suppkey % 2 = 0 THEN INTERVAL 6 DAY ELSE INTERVAL 0 DAY END AS ts,
             sum(l_quantity) AS value
      FROM lineitem GROUP BY 1, 2)"""


def mid_month(spark: SparkSession, folder: str) -> Panel:
    """Monthly revenue per order priority, labelled by the fifteenth, or (the first priorities) by the last day of the month."""
    orders = table(spark, folder, "orders")
    day = F.when(F.col("o_orderpriority") < "3", F.last_day("o_orderdate")).otherwise(F.date_add(F.trunc("o_orderdate", "month"), 14))
    revenue = F.sum(F.floor("o_totalprice").cast("double")).alias("value")
    return _panel(orders.groupBy(F.col("o_orderpriority").alias("k"), day.cast("timestamp_ntz").alias("ts")).agg(revenue))


MID_MONTH = """
p AS (SELECT o_orderpriority AS k,
             CASE WHEN o_orderpriority < '3' THEN last_day(o_orderdate)::TIMESTAMP
                  ELSE date_trunc('month', o_orderdate)::TIMESTAMP + INTERVAL 14 DAY END AS ts,
             sum(floor(o_totalprice)) AS value
      FROM orders GROUP BY 1, 2)"""


def event_hourly(spark: SparkSession, folder: str) -> Panel:
    """Hourly value totals per event type; has gaps."""
    events = table(spark, folder, "events")
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")
    total = F.sum(F.round(F.col("value") * 100)).alias("value")
    return _panel(events.groupBy(F.col("event_type").alias("k"), hour).agg(total))


EVENT_HOURLY = """
p AS (SELECT event_type AS k, date_trunc('hour', ts)::TIMESTAMP AS ts, sum(round(value * 100)) AS value
      FROM events GROUP BY 1, 2)"""


def gappy_hourly(spark: SparkSession, folder: str) -> Panel:
    """As ``event_hourly`` with values missing in hours divisible by five."""
    panel = event_hourly(spark, folder)
    return panel.derive(panel.df.withColumn("value", F.when(F.hour("ts") % 5 != 0, F.col("value"))))


GAPPY_HOURLY = """
p AS (SELECT event_type AS k, date_trunc('hour', ts)::TIMESTAMP AS ts,
             CASE WHEN hour(date_trunc('hour', ts)::TIMESTAMP) % 5 <> 0 THEN sum(round(value * 100)) END AS value
      FROM events GROUP BY 1, 2)"""


def running_excess(spark: SparkSession, folder: str) -> Panel:
    """Running total of what each hour of an event type brings above or below its usual: a walk."""
    hourly = event_hourly(spark, folder)
    usual = F.floor(F.avg("value").over(Window.partitionBy("k")))
    over = hourly.df.withColumn("value", F.col("value") - usual)
    return hourly.derive(over.withColumn("value", F.sum("value").over(Window.partitionBy("k").orderBy("ts"))))


RUNNING_EXCESS = EVENT_HOURLY.replace("p AS", "h0 AS", 1) + """,
h1 AS (SELECT k, ts, value - floor(avg(value) OVER (PARTITION BY k)) AS value FROM h0),
p AS (SELECT k, ts, sum(value) OVER (PARTITION BY k ORDER BY ts) AS value FROM h1)"""


def event_raw(spark: SparkSession, folder: str) -> Panel:
    """Every event as it is, per event type; irregular stamps."""
    events = table(spark, folder, "events").withColumnRenamed("event_type", "k")
    return Panel.of(events.withColumn("value", F.round(F.col("value") * 100)), "ts", "value", ["k"])


EVENT_RAW = """
p AS (SELECT event_type AS k, ts, round(value * 100) AS value FROM events)"""


def dirty_orders(spark: SparkSession, folder: str) -> Panel:
    """Single orders with stamps as text: repeated, unreadable and missing ones by rule."""
    orders = table(spark, folder, "orders")
    written = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    df = orders.select(
        F.col("o_orderpriority").alias("k"),
        F.when(F.col("o_orderkey") % 50 != 0, written).otherwise("no date").alias("ts"),
        F.when(F.col("o_orderkey") % 17 != 0, F.col("o_totalprice")).alias("value"),
        "o_orderkey",
    )
    return Panel.of(df, "ts", "value", ["k"], ["o_orderkey"])


DIRTY_ORDERS = """
d AS (SELECT o_orderpriority AS k,
             CASE WHEN o_orderkey % 50 <> 0 THEN o_orderdate END AS ts,
             CASE WHEN o_orderkey % 17 <> 0 THEN o_totalprice END AS value,
             o_orderkey
      FROM orders)"""


def six(*names: str) -> list[Column]:
    """Columns rounded to six decimals, the precision results are compared at."""
    return [F.round(n, 6).alias(n) for n in names]
