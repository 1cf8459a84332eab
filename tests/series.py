"""Small generated series used by several tests."""

from __future__ import annotations

import numpy as np
import pandas as pd

from tideline.panel import GROUP_ROWS, Panel


def ar1(n: int, phi: float, seed: int = 0) -> np.ndarray:
    noise = np.random.default_rng(seed).normal(size=n)
    y = np.zeros(n)
    for i in range(1, n):
        y[i] = phi * y[i - 1] + noise[i]
    return y + 100


def walk(n: int, seed: int = 1) -> np.ndarray:
    return np.cumsum(np.random.default_rng(seed).normal(size=n)) + 1000


def season(n: int, period: int, slope: float = 0.0, noise: float = 1.0, seed: int = 2) -> np.ndarray:
    t = np.arange(n)
    return 50 + slope * t + 10 * np.sin(2 * np.pi * t / period) + noise * np.random.default_rng(seed).normal(size=n)


def frame(series: dict[str, np.ndarray], freq: str = "D", start: str = "2020-01-01") -> pd.DataFrame:
    parts = [
        pd.DataFrame({"k": k, "ts": pd.date_range(start, periods=len(v), freq=freq), "value": v})
        for k, v in series.items()
    ]
    return pd.concat(parts, ignore_index=True)


def panel(spark, series, group_rows: int = GROUP_ROWS, freq: str = "D", holes: int = 0, extra=()) -> Panel:
    pdf = series if isinstance(series, pd.DataFrame) else frame(series, freq)
    if holes:
        pdf = pdf.assign(value=pdf["value"].where(np.arange(len(pdf)) % holes != 0))
    df = spark.createDataFrame(pdf.sample(frac=1, random_state=3)).repartition(5)
    return Panel.of(df, "ts", "value", ["k"], extra, group_rows)


def rows(df, digits: int = 7):
    """Rows as sorted tuples with rounded numbers, for comparison."""

    def plain(v):
        if isinstance(v, float):
            return None if np.isnan(v) else round(v, digits) + 0.0
        if isinstance(v, (list, np.ndarray)):
            return tuple(plain(x) for x in v)
        return v

    columns = sorted(df.columns)
    return sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
