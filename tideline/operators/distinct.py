"""Distinct counts of many columns: sketches for all, exact counts where a decision needs them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K = 12  # a sketch holds 2 ** LG_K registers of a byte
ERROR = 1.04 / math.sqrt(2**LG_K)  # standard error of an estimate, relative
MARGIN = 6 * ERROR  # an estimate is further off with a chance below 1e-8
LANES = 64  # sketches of a column are united in this many tasks before the last one


def unpivot(df: DataFrame, columns: dict[str, Column], name: str = "value") -> DataFrame:
    """Columns to rows ``(ordinal, column, <name>)``; all expressions share one type."""
    entries = [
        F.struct(F.lit(i).alias("ordinal"), F.lit(label).alias("column"), expr.alias(name))
        for i, (label, expr) in enumerate(columns.items())
    ]
    return df.select(F.inline(F.array(*entries)))


def exact_counts(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``ordinal, column, rows, filled, distinct_values``, grouped by value so that no column is one task."""
    counted = unpivot(df, columns).groupBy("ordinal", "column", "value").agg(F.count("*").alias("c"))
    return counted.groupBy("ordinal", "column").agg(
        F.sum("c").alias("rows"),
        F.sum(F.when(F.col("value").isNotNull(), F.col("c")).otherwise(0)).alias("filled"),
        F.count("value").alias("distinct_values"),
    )


def estimates(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``exact_counts`` with estimated distinct values, in one aggregate: what is shuffled is a
    sketch of 4 KB at most per column and task, whatever the number of rows."""
    hashes = {c: F.when(e.isNotNull(), F.xxhash64(e)) for c, e in columns.items()}
    lanes = unpivot(df, hashes).withColumn("_lane", F.spark_partition_id() % LANES)
    keys = ["ordinal", "column"]
    pieces = lanes.groupBy(*keys, "_lane").agg(
        F.count("*").alias("rows"), F.count("value").alias("filled"), F.hll_sketch_agg("value", F.lit(LG_K)).alias("_sketch")
    )
    return pieces.groupBy(*keys).agg(
        F.sum("rows").alias("rows"),
        F.sum("filled").alias("filled"),
        F.hll_sketch_estimate(F.hll_union_agg("_sketch")).alias("distinct_values"),
    )


def column_counts(df: DataFrame, columns: dict[str, Column], upto: int = 0, shares: tuple[float, ...] = ()) -> DataFrame:
    """``ordinal, column, rows, filled, distinct_values`` per column, fit for decisions.

    Distinct counts up to ``upto`` are exact, and every count lies on the right side of each
    share of the rows in ``shares``. Columns whose estimate is clear of these marks keep it;
    only the others are counted by value. One row per column reaches the driver."""
    found = {r["column"]: r.asDict() for r in estimates(df, columns).collect()} if columns else {}

    def unclear(fact: dict) -> bool:
        low, high = fact["distinct_values"] * (1 - MARGIN), fact["distinct_values"] * (1 + MARGIN)
        return fact["filled"] > 0 and (low <= upto or any(low <= s * fact["rows"] <= high for s in shares))

    close = {c: columns[c] for c, fact in found.items() if unclear(fact)}
    if close:
        for r in exact_counts(df, close).collect():
            found[r["column"]]["distinct_values"] = r["distinct_values"]
    for fact in found.values():
        fact["distinct_values"] = min(fact["distinct_values"], fact["filled"])
    return _local(df, found)


def _local(df: DataFrame, found: dict[str, dict]) -> DataFrame:
    """The facts as a frame. An empty table has no facts: no rows."""
    names = ("rows", "filled", "distinct_values")
    rows = [
        F.struct(F.lit(f["ordinal"]).alias("ordinal"), F.lit(c).alias("column"), *[F.lit(f[n]).cast("long").alias(n) for n in names])
        for c, f in found.items()
    ]
    one = df.sparkSession.range(1)
    if rows:
        return one.select(F.inline(F.array(*rows)))
    return one.where("false").select(
        F.lit(0).alias("ordinal"), F.lit("").alias("column"), *[F.lit(0).cast("long").alias(n) for n in names]
    )
