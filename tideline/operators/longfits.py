"""ARIMA and seasonal ARIMA on series of any length, all rows, many tasks.

A series lies in chunks of consecutive rows. Every step of the search takes two jobs over all chunks
of all long series: one gives the errors each chunk leaves behind when it starts from none; the
driver follows them along the chunks (a few numbers a chunk); the other adds up the normal
equations of the chunks from their right starting errors. Only these sums reach the driver."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.fitting import BUMP, Fit, arima_family, descend, fits_of, named_orders, sarima_family
from tideline.functions.recursion import Family, ends, moved, series_sums
from tideline.operators.split import positions
from tideline.panel import Panel
from tideline.session import settle

CHUNK_ROWS = 200_000  # rows of a series in one task
MOST_CHUNKS = 1_000  # chunks a series is cut into at most


class Job:
    """One long series to fit: its order, its candidates and what differencing takes off its front."""

    def __init__(self, d: int, orders: list[tuple], m: int = 0):
        self.d, self.orders, self.m, self.seasonal = d, orders, m, m > 0
        self.family: Family = sarima_family(orders, m) if self.seasonal else arima_family(orders, d == 0)
        self.lost = d * (1 + m) if self.seasonal else d
        self.centre, self.scale = 0.0, 1.0

    def rows(self, values: np.ndarray, first: int) -> tuple[np.ndarray, int]:
        """A chunk's differenced rows behind ``deepest`` rows of context, and the place of the first."""
        w = values
        for _ in range(self.d if self.seasonal else 0):
            w = w[self.m :] - w[: -self.m]
        w = np.diff(w, self.d)
        w = (w - self.centre) / self.scale
        deepest = self.family.deepest
        if first == 0:
            return np.concatenate([np.zeros(deepest), w]), 0
        return w, first - self.lost  # the context before the chunk is what differencing and lags take


def chunk_table(panel: Panel, context: int, chunk_rows: int) -> DataFrame:
    """``keys, chunk, first, values``: consecutive rows of each series, each chunk but the first
    behind the last ``context`` values before it; ``first`` is the place of its own first row."""
    placed = positions(panel.derive(panel.df.select(*panel.keys, "ts", "value")))
    chunk = F.expr(f"pos div {chunk_rows}")
    copies = F.array(chunk, F.when(F.col("pos") % chunk_rows >= chunk_rows - context, chunk + 1))
    rows = placed.select(*panel.keys, F.explode(F.filter(copies, lambda c: c.isNotNull())).alias("chunk"), "pos", "value")
    chunks = rows.groupBy(*panel.keys, "chunk").agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("rows"))  # bounded by the chunk
    chunks = chunks.withColumn("first", F.col("chunk") * chunk_rows).filter(F.element_at("rows", -1).pos >= F.col("first"))
    return chunks.select(*panel.keys, F.col("chunk").cast("int").alias("chunk"), "first", F.col("rows.value").alias("values"))


def _packed(value) -> bytes:
    out = io.BytesIO()
    np.savez(out, *value)
    return out.getvalue()


def _unpacked(data: bytes) -> list[np.ndarray]:
    found = np.load(io.BytesIO(data))
    return [found[name] for name in found.files]


def per_chunk(chunks: DataFrame, work: Callable[[int, int, int, np.ndarray], tuple]) -> dict[int, list[tuple]]:
    """``work(series, chunk, first, values)`` of every chunk as ``{series: [result by chunk]}``; the
    results are a few small arrays each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                sid, chunk, first = (batch.column(c)[i].as_py() for c in ("sid", "chunk", "first"))
                values = batch.column("values")[i].values.to_numpy(zero_copy_only=False)
                with np.errstate(all="ignore"):
                    result = _packed(work(sid, chunk, first, values))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([sid], pa.int32()), pa.array([chunk], pa.int32()), pa.array([result], pa.binary())], ["sid", "chunk", "result"]
                )

    found: dict[int, list[tuple]] = {}
    rows = chunks.mapInArrow(run, "sid int, chunk int, result binary").collect()
    for row in sorted(rows, key=lambda r: (r["sid"], r["chunk"])):
        found.setdefault(row["sid"], []).append(_unpacked(bytes(row["result"])))
    return found


def fit_chunks(chunks: DataFrame, jobs: list[Job]) -> list[list[Fit]]:
    """The fits of each job, in the order of its candidates. ``chunks(sid, chunk, first, values)``
    (a stored table) holds the series of job ``sid``."""
    facts = per_chunk(chunks, lambda sid, chunk, first, values: _facts(jobs[sid], first, values))
    steps, counts, tails = [], [], []
    for sid, job in enumerate(jobs):
        n, total, squares = (sum(float(f[0][i]) for f in facts[sid]) for i in range(3))
        mean = total / n
        job.centre = mean if job.d == 0 and not job.seasonal else 0.0
        job.scale = float(np.sqrt(max(squares / n - mean**2, 0.0))) or 1.0
        steps.append([int(f[0][0]) for f in facts[sid]])
        counts.append(int(n))
        tails.append(facts[sid][-1][1])
    lanes = np.cumsum([0] + [len(j.orders) for j in jobs])
    part = lambda at, sid: at[lanes[sid] : lanes[sid + 1]]

    def starts(at) -> tuple[dict, list]:
        """The errors before each chunk, and behind each series."""
        left = per_chunk(chunks, lambda sid, chunk, first, values: (ends(jobs[sid].family, *_swap(jobs[sid].rows(values, first), part(at, sid))),))
        before, behind = {}, []
        for sid, job in enumerate(jobs):
            state = np.zeros_like(left[sid][0][0])
            for chunk, (own,) in enumerate(left[sid]):
                before[sid, chunk] = state
                state = own + moved(job.family, part(at, sid), BUMP, steps[sid][chunk], state)
            behind.append(state)
        return before, behind

    def evaluate(at):
        before, _ = starts(at)

        def work(sid, chunk, first, values):
            job = jobs[sid]
            rows, place = job.rows(values, first)
            sums, _ = series_sums(job.family, rows, part(at, sid), BUMP, place, before[sid, chunk])
            return sums

        found = per_chunk(chunks, work)
        sums = [[sum(c[i] for c in found[sid]) for i in range(3)] for sid in range(len(jobs))]
        return tuple(np.concatenate([s[i] for s in sums]) for i in range(3))

    free = np.concatenate([j.family.free for j in jobs])
    params, cost = descend(evaluate, np.full(free.shape, 0.1), free)
    _, behind = starts(params)
    out = []
    for sid, job in enumerate(jobs):
        last = behind[sid][:, :: free.shape[1] + 1]
        names = named_orders(job.orders, job.d, job.m)
        out.append(fits_of(job.family, names, part(params, sid), part(cost, sid), counts[sid], job.scale, job.centre, tails[sid], lambda i, last=last: last[:, i]))
    return out


def _swap(rows: tuple[np.ndarray, int], at: np.ndarray) -> tuple:
    return rows[0], at, BUMP, rows[1]


def _facts(job: Job, first: int, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows after differencing with their sum and sum of squares, and the chunk's last values."""
    rows, _ = job.rows(values, first)
    own = rows[job.family.deepest :]
    keep = job.family.deepest + job.lost + 1
    return np.array([len(own), own.sum(), (own**2).sum()]), values[-keep:]


def fit_panel(panel: Panel, jobs: dict[tuple, Job], chunk_rows: int = CHUNK_ROWS) -> dict[tuple, list[Fit]]:
    """The fits of the named series of a panel. ``jobs`` has an entry per long series, so their number is
    bounded by the rows over the length from which a series counts as long."""
    keys, names = panel.keys, list(jobs)
    spark = panel.df.sparkSession
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in panel.df.select(*keys).schema.fields)
    known = spark.createDataFrame([(*k, i) for i, k in enumerate(names)], f"{kinds}, sid int")
    chunk_rows = max(chunk_rows, -(-panel.size.largest // MOST_CHUNKS))
    context = max(j.family.deepest + j.lost for j in jobs.values())
    members = panel.derive(panel.df.join(F.broadcast(known.select(*keys)), keys))
    chunks = chunk_table(members, context, chunk_rows).join(F.broadcast(known), keys)
    # each chunk keeps the context its own model asks for
    need = F.lit(0)
    for i, k in enumerate(names):
        need = F.when(F.col("sid") == i, jobs[k].family.deepest + jobs[k].lost).otherwise(need)
    spare = F.when(F.col("chunk") > 0, F.lit(context) - need).otherwise(0)
    cut = chunks.withColumn("spare", spare).selectExpr("sid", "chunk", "first", "slice(values, spare + 1, size(values) - spare) as values")
    chunks = settle(cut)
    return dict(zip(names, fit_chunks(chunks, [jobs[k] for k in names])))
