"""Isolation forest on the value column (Liu, Ting and Zhou, 2008).

Trees see samples of at most 256 rows, so a bounded pool per series is enough to
grow them. A forest over one variable is a step function of that variable: its steps
are sorted among the rows, and each row takes the score of the step it meets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.quantile import summarise
from tideline.panel import Panel

TREES = 100
SAMPLE = 256
SEED = 42
POOL = TREES * SAMPLE
PIECE_ROWS = 1_000_000  # rows sorted among one copy of a series' steps


def _path_excess(n):
    """Average depth of an unfinished node with ``n`` rows."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2)
    full = 2 * (np.log(safe - 1) + np.euler_gamma) - 2 * (safe - 1) / safe
    return np.where(n > 2, full, np.where(n == 2, 1.0, 0.0))


def _grow(sample: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """One tree as a step function: cut points, and path length left of each (and beyond)."""
    sample = np.sort(sample)
    limit = int(np.ceil(np.log2(max(len(sample), 2))))
    cuts, depths, todo = [], [], [(0, len(sample), 0, np.inf)]
    while todo:
        lo, hi, depth, right_edge = todo.pop()
        if depth < limit and hi - lo > 1 and sample[lo] < sample[hi - 1]:
            cut = rng.uniform(sample[lo], sample[hi - 1])
            mid = int(np.searchsorted(sample, cut, side="right"))
            todo.append((mid, hi, depth + 1, right_edge))
            todo.append((lo, mid, depth + 1, cut))
        else:
            cuts.append(right_edge)
            depths.append(depth + float(_path_excess(hi - lo)))
    return np.array(cuts), np.array(depths)


def _forest(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cut points and anomaly scores of the whole forest; the last cut is infinite."""
    rng = np.random.default_rng(SEED)
    values = np.sort(values)
    size = min(SAMPLE, len(values))
    trees = [_grow(rng.choice(values, size, replace=False), rng) for _ in range(TREES)]
    cuts = np.unique(np.concatenate([c for c, _ in trees]))
    paths = sum(d[np.searchsorted(c, cuts)] for c, d in trees) / TREES
    scale = float(_path_excess(size)) or 1.0
    return cuts, 2.0 ** (-paths / scale)


def forest_scores(panel: Panel) -> DataFrame:
    """Known rows with their anomaly ``score``."""
    keys = panel.keys
    known = panel.known()
    counts = known.df.groupBy(*keys).agg(F.count("*").alias("_n"))
    sized = known.attach(known.df, counts)
    # Rows drawn by the hash of their content: a uniform pool, the same on every run.
    draw = F.pmod(F.xxhash64(F.lit(SEED), "ts", "value"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    pool = sized.where(draw < F.lit(2.0 * POOL) / F.col("_n")).select(*keys, "_n", "value")

    key_fields = [f for f in panel.df.schema.fields if f.name in keys]
    model_schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in key_fields])

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        values, n = group["value"].to_numpy(), int(group["_n"].iloc[0])
        cuts, scores = _forest(values)
        if len(values) == n:  # no other values to come: steps between them are of no use
            seen = np.unique(values)
            cuts, scores = seen, scores[np.searchsorted(cuts, seen)]
        return pd.DataFrame({**{k: [group[k].iloc[0]] for k in keys}, "_n": [n], "cuts": [cuts], "scores": [scores]})

    models = pool.groupBy(*keys).applyInPandas(grow, f"{model_schema}, _n long, cuts array<double>, scores array<double>")
    # Long series are scored in pieces, each with its own copy of the steps. No series has more
    # steps than rows, so the rows at most double.
    pieces = F.greatest(F.lit(1), F.ceil(F.col("_n") / PIECE_ROWS)).cast("int")
    columns = [f"`{c}`" for c in panel.df.columns]
    rows = sized.select(
        *keys, F.pmod(F.xxhash64("ts", "value"), pieces).cast("int").alias("_piece"), F.col("value").alias("_at"),
        F.struct(*columns).alias("_row"), F.lit(None).cast("double").alias("score"),
    )
    steps = models.select(
        *keys, "cuts", "scores", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("_piece")
    ).select(*keys, "_piece", F.inline(F.arrays_zip("cuts", "scores")))
    steps = steps.select(
        *keys, "_piece", F.col("cuts").alias("_at"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), F.col("scores").alias("score")
    )
    # In falling order, steps first: the last step met is the first cut not below the value.
    falling = Window.partitionBy(*keys, "_piece").orderBy(F.desc("_at"), F.col("_row").isNotNull())
    met = F.last("score", ignorenulls=True).over(falling.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.unionByName(steps).withColumn("score", met).where(F.col("_row").isNotNull()).select("_row.*", "score")


def forest_anomalies(panel: Panel, contamination: float = 0.05) -> DataFrame:
    """Known rows with ``score`` and ``is_anomaly``: the top ``contamination`` share of scores."""
    scored = panel.derive(forest_scores(panel))
    cut = summarise(scored, {}, {"_cut": 1 - contamination}, "score")
    flag = F.col("score") > F.col("_cut")
    return panel.attach(scored.df, cut).withColumn("is_anomaly", flag).drop("_cut")


def drop_outliers_forest(panel: Panel, contamination: float = 0.05) -> DataFrame:
    """Rows the forest does not flag; rows without a value stay."""
    kept = forest_anomalies(panel, contamination).where(~F.col("is_anomaly")).select(*panel.df.columns)
    unknown = panel.df.where(F.col("value").isNull() | F.col("ts").isNull())
    return kept.unionByName(unknown)
