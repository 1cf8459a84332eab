"""Counts and medians of columns decided without moving the rows."""

import statistics

import pytest
from pyspark.sql import functions as F

from tideline.operators import detect, schema
from tideline.operators.distinct import column_counts, estimates, exact_counts


def frame(spark, n=6000):
    return spark.range(n).select(
        F.col("id").cast("double").alias("all"),
        (F.col("id") % 100).cast("double").alias("hundred"),
        (F.col("id") % 101).cast("double").alias("more"),
        F.when(F.col("id") % 2 == 0, F.floor(F.col("id") * 0.3)).cast("double").alias("near"),
        F.lit(None).cast("double").alias("none"),
    )


def test_counts_are_exact_near_marks_and_close_elsewhere(spark):
    df = frame(spark)
    columns = {c: F.col(c) for c in df.columns}
    exact = {r["column"]: r for r in exact_counts(df, columns).collect()}
    found = {r["column"]: r for r in column_counts(df, columns, upto=100, shares=(0.30,)).collect()}
    assert {c: r.distinct_values for c, r in exact.items()} == {"all": 6000, "hundred": 100, "more": 101, "near": 1800, "none": 0}
    assert {c: (r.rows, r.filled) for c, r in found.items()} == {c: (r.rows, r.filled) for c, r in exact.items()}
    for c in ("hundred", "more", "near", "none"):
        assert found[c].distinct_values == exact[c].distinct_values
    assert found["all"].distinct_values == pytest.approx(6000, rel=0.1)


def test_no_rows_and_no_columns_give_no_facts(spark):
    df = frame(spark)
    assert column_counts(df.limit(0), {"all": F.col("all")}).count() == 0
    assert column_counts(df, {}).columns == ["ordinal", "column", "rows", "filled", "distinct_values"]
    assert column_counts(df, {}).count() == 0
    assert schema.narrow_profile(spark.createDataFrame([], "a string, b int")).where("is_category").count() == 0


def test_a_sketch_replaces_the_shuffled_values(spark):
    plan = estimates(frame(spark), {"all": F.col("all")})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Exchange hashpartitioning(ordinal" in plan
    assert "xxhash64" in plan.split("Exchange")[-1]


@pytest.mark.parametrize(
    "values",
    [
        [20_000.0], [20_000.5], [89_999.0, 90_000.0], [89_999.0, 90_001.0], [89_999.0, 90_001.5], [19_999.0, 20_002.0],
        [19_999.0, 20_001.0], [1e8, 1e8 + 2], [1e11], [1e11 + 1, 2e11], [1e11 - 5, 1e11 + 1], [5.0, 45_000.0, 45_000.0], [1.7e9, 3.0, None, 1.8e9],
    ],
)
def test_medians_are_held_against_marks_without_ranking(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    v = F.col("v")
    facts = {}
    for unit, (low, high) in detect.UNIT_RANGES.items():
        facts[unit] = detect._beyond(v, low) if high is None else detect._beyond(v, low) & detect._beyond(-v, -high)
    got = df.agg(*[c.alias(u) for u, c in facts.items()]).first().asDict()
    median = statistics.median(x for x in values if x is not None)
    assert got == {u: low < median < (high or float("inf")) for u, (low, high) in detect.UNIT_RANGES.items()}


def test_target_scores_equal_those_of_exact_counts(spark):
    df = frame(spark)
    scores = {r["column"]: r["score"] for r in detect.score_target_columns(df).collect()}
    assert scores == {"all": 60.0, "hundred": 45.0, "more": 45.0, "near": 35.0, "none": 0.0}
