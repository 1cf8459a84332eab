"""The centred mean of long series: in pieces of bounded size, with the same results."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from series import panel, rows, season, walk

from tideline.operators import features, split

SERIES = {"long": np.round(walk(2400)), "short": np.round(season(31, 7)), "tiny": np.array([3.0, 1.0, 2.0])}


def centred(p):
    counts = p.df.groupBy("k").agg(F.count("*").alias("n"), F.avg("value").alias("_mean"))
    return features.centred_mean(p, counts)


def direct(values):
    width = max(5, len(values) // 25)
    return [values[max(0, i - width // 2) : i + (width - 1) // 2 + 1].mean() for i in range(len(values))]


@pytest.mark.parametrize("holes", [0, 9])
def test_chunks_do_not_change_the_centred_mean(spark, monkeypatch, holes):
    monkeypatch.setattr(split, "TASK_ROWS", 100)
    natural, cut = panel(spark, SERIES, holes=holes), panel(spark, SERIES, group_rows=40, holes=holes)
    got = rows(centred(natural))
    assert got == rows(centred(cut))
    if not holes:
        want = {(k, i): m for k, v in SERIES.items() for i, m in enumerate(direct(v))}
        assert all(abs(smooth - want[k, pos]) < 1e-6 for k, pos, smooth, _ in got) and len(got) == len(want)


def test_no_task_takes_a_share_that_grows_with_the_series(spark, monkeypatch):
    monkeypatch.setattr(split, "TASK_ROWS", 100, raising=False)
    monkeypatch.setattr(features, "CENTRED_ROWS", 100, raising=False)
    most = []
    for n in (2000, 6000):
        done = centred(panel(spark, {"a": np.arange(float(n)), "b": np.arange(50.0)}, freq="h"))
        loads = [r["count"] for r in done.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(loads) == n + 50
        most.append(max(loads))
    assert max(most) <= 400  # of 100 entries, 34 rows, each: a dozen chunks by chance at most


def test_rows_of_one_stamp_are_numbered_alike_each_time(spark, monkeypatch):
    monkeypatch.setattr(split, "TASK_ROWS", 50)
    values = np.random.default_rng(3).integers(0, 1000, 900).astype(float)
    stamps = np.repeat(pd.date_range("2020-01-01", periods=150, freq="D"), 6)
    pdf = pd.DataFrame({"k": "a", "ts": stamps, "value": values})
    want = direct(pdf.sort_values(["ts", "value"])["value"].to_numpy())
    got = {r.pos: r.smooth for r in centred(panel(spark, pdf, group_rows=60)).collect()}
    assert len(got) == 900 and all(abs(got[i] - m) < 1e-6 for i, m in enumerate(want))
