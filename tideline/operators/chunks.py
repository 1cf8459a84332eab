"""User functions over chunks of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_ROWS = 10_000


def chunked(batches: Iterator[pd.DataFrame], chunk_rows: int) -> Iterator[pd.DataFrame]:
    """Consecutive rows in chunks of ``chunk_rows``, however they arrive; the last may be shorter."""
    if chunk_rows < 1:
        raise ValueError("chunk_rows must be positive")
    held: list[pd.DataFrame] = []
    rows = 0
    for batch in batches:
        while rows + len(batch) >= chunk_rows:
            cut = chunk_rows - rows
            yield pd.concat([*held, batch.iloc[:cut]], ignore_index=True)
            held, rows, batch = [], 0, batch.iloc[cut:]
        if len(batch):
            held.append(batch)
            rows += len(batch)
    if rows:
        yield pd.concat(held, ignore_index=True)


def map_chunks(
    df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Apply ``fn`` to chunks of ``chunk_rows`` rows and stack the results. Chunks are cut within
    partitions, so only a partition's last chunk is shorter."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return map(fn, chunked(batches, chunk_rows))

    return df.mapInPandas(run, schema)


def chunk_results(df: DataFrame, fn: Callable[[pd.DataFrame], Any], kind: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """What ``fn`` returns for each chunk, a value of the type ``kind``: rows ``(partition, chunk, rows, result)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for i, part in enumerate(chunked(batches, chunk_rows)):
            place = int(part["_partition"].iat[0])
            result = fn(part.drop(columns="_partition"))
            yield pd.DataFrame({"partition": [place], "chunk": [i], "rows": [len(part)], "result": [result]})

    return df.withColumn("_partition", F.spark_partition_id()).mapInPandas(run, f"partition int, chunk int, rows long, result {kind}")
