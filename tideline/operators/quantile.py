"""Exact per-series quantiles (linear interpolation at ``(n - 1) * q``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.panel import Panel

SKETCH_ACCURACY = 100_000


def summarise(
    panel: Panel,
    aggregates: dict[str, Column],
    quantiles: dict[str, float] | None = None,
    value: str = "value",
) -> DataFrame:
    """One row per series with the given aggregates and exact quantiles of ``value``."""
    quantiles = quantiles or {}
    if not quantiles or not panel.split:
        exact = [F.percentile(value, q).alias(name) for name, q in quantiles.items()]
        return panel.df.groupBy(*panel.keys).agg(*[c.alias(n) for n, c in aggregates.items()], *exact)
    cuts = selected_quantiles(panel, quantiles, value)
    if aggregates:
        plain = panel.df.groupBy(*panel.keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    else:
        plain = panel.df.select(*panel.keys).distinct()  # series without a value keep their row
    return plain.join(cuts, panel.keys, "left")


def selected_quantiles(panel: Panel, quantiles: dict[str, float], value: str = "value") -> DataFrame:
    """Quantiles of series too long for one task.

    A bounded sketch brackets each quantile; only rows inside a bracket (a few per
    100,000) are ranked, with the rows below the bracket counted in. The bracket is
    wider than the error the sketch guarantees, so the result is exact. Series that
    are small against the sketch are ranked whole."""
    keys, names, probs = panel.keys, list(quantiles), list(quantiles.values())
    margin = 3.0 / SKETCH_ACCURACY
    rows = panel.df.select(*keys, F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull())
    low = F.percentile_approx("v", F.array(*[F.lit(max(0.0, p - margin)) for p in probs]), SKETCH_ACCURACY)
    high = F.percentile_approx("v", F.array(*[F.lit(min(1.0, p + margin)) for p in probs]), SKETCH_ACCURACY)
    sketch = rows.groupBy(*keys).agg(F.count("*").alias("n"), low.alias("lo"), high.alias("hi"))
    whole = F.col("n") <= SKETCH_ACCURACY
    tagged = panel.attach(rows, sketch)
    lo = [F.when(whole | F.lit(p <= margin), F.lit(float("-inf"))).otherwise(F.col("lo")[i]) for i, p in enumerate(probs)]
    hi = [F.when(whole | F.lit(p >= 1 - margin), F.lit(float("inf"))).otherwise(F.col("hi")[i]) for i, p in enumerate(probs)]
    below = tagged.groupBy(*keys).agg(
        F.first("n").alias("n"), F.array(*[F.sum((F.col("v") < b).cast("long")) for b in lo]).alias("below")
    )
    hits = F.array(*[F.when((F.col("v") >= a) & (F.col("v") <= b), F.lit(i)) for i, (a, b) in enumerate(zip(lo, hi))])
    counted = (
        tagged.select(*keys, "v", F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("i"))
        .groupBy(*keys, "i", "v")
        .agg(F.count("*").alias("c"))
    )
    upto = Window.partitionBy(*keys, "i").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prob = F.element_at(F.array(*[F.lit(p) for p in probs]), F.col("i") + 1)
    ranked = (
        counted.withColumn("upto", F.sum("c").over(upto))
        .join(below, keys)
        .withColumn("end", F.col("below")[F.col("i")] + F.col("upto"))
        .withColumn("start", F.col("end") - F.col("c"))
        .withColumn("rank", (F.col("n") - 1) * prob)
    )

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("start") <= rank) & (rank < F.col("end")), F.col("v")))

    picked = ranked.groupBy(*keys, "i").agg(
        at(F.floor("rank")).alias("a"), at(F.ceil("rank")).alias("b"), F.first("rank").alias("rank")
    )
    between = F.col("a") + (F.col("rank") - F.floor("rank")) * (F.col("b") - F.col("a"))
    return picked.groupBy(*keys).agg(
        *[F.max(F.when(F.col("i") == i, between)).alias(name) for i, name in enumerate(names)]
    )
