"""Shared pieces of the text operators: whole texts through Arrow, skew-free lookups, tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.session import scratch_path


SLICE = 512  # rows of an Arrow batch worked on at once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the whole ``text`` (null: empty); other columns play no part."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: later readers neither
    compute it again nor need the executors that made it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def per_text(docs: DataFrame, make: Callable[[], Callable[[str], tuple]], schema: str) -> DataFrame:
    """One row ``doc_id, *values`` per document. ``make`` runs once per task and
    returns the function of a text; rows are handled one by one, so memory follows
    the Arrow batch and not the partition."""
    names = [part.strip().split(" ")[0] for part in schema.split(",")]
    source = texts(docs)
    full = f"doc_id long, {schema}"
    kinds = _arrow_types(source, full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make()
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                rows = [score(text.as_py()) for text in batch.column("text")]
                arrays = [batch.column("doc_id")] + [pa.array(list(c), kinds[i + 1]) for i, c in enumerate(zip(*rows))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *names])

    return source.mapInArrow(run, full)


def keep_texts(docs: DataFrame, make: Callable[[], Callable[[str], bool]]) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose whole text (null: empty) passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = make()
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                yield batch.filter(pa.array([keep(t.as_py() or "") for t in batch.column("text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def change_texts(docs: DataFrame, make: Callable[[], Callable[[str], str]]) -> DataFrame:
    """The rows of ``docs`` with another text (null stays null), all other columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = make()
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                i = batch.schema.get_field_index("text")
                texts_ = [None if t is None else change(t) for t in (t.as_py() for t in batch.column(i))]
                yield batch.set_column(i, batch.schema.field(i), pa.array(texts_, batch.schema.field(i).type))

    return docs.mapInArrow(run, docs.schema)


def without(docs: DataFrame, dropped: DataFrame, few: int = 1_000_000) -> DataFrame:
    """``docs`` without the ids of ``dropped(doc_id)`` (a stored table). Up to ``few`` ids
    are broadcast, so the texts stay where they are; more meet them in a shuffle."""
    small = dropped.count() <= few
    return docs.join(F.broadcast(dropped) if small else dropped, "doc_id", "left_anti")


def _arrow_types(df: DataFrame, schema: str) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema)).types


def look_up(frame: DataFrame, facts: DataFrame, on: list[str], heat: str, hot_rows: int = 1_000_000) -> DataFrame:
    """``frame`` joined with ``facts`` (one row per key; ``heat``: rows of ``frame``
    with that key).

    Keys of ``hot_rows`` rows and more are at most ``rows / hot_rows``: that slice is
    broadcast, so no task gathers a hot key. All other keys meet in a shuffle.
    """
    facts = facts.withColumn("_hot", F.col(heat) >= hot_rows)
    hot = facts.filter("_hot").drop("_hot", heat)
    cold = facts.filter(~F.col("_hot")).drop("_hot", heat)
    return frame.join(F.broadcast(hot), on).unionByName(frame.join(cold, on))


def held_out() -> Column:
    """Rows never learned from: crc32 of the id's text divisible by five."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
