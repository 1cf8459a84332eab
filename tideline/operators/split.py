"""Exact ordered operations on series of any length.

A series longer than ``Panel.group_rows`` is cut into chunks of consecutive rows:

* positions: rows are counted per time bin, the running count of the bins gives
  every bin its offset, and rows are numbered inside their bin only;
* bounded frames: rows near a chunk border are copied to the neighbour chunk, so
  each frame is complete inside one chunk;
* unbounded frames: one summary row per chunk is carried along the series.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tideline.panel import Panel, micros

BINS_PER_CHUNK = 16
TASK_ROWS = 250_000  # rows that one task sorts on average: its memory must not follow the input


def in_pieces(df: DataFrame, rows: int, on: list[str]) -> DataFrame:
    """``df`` of that many rows, dealt out by the columns ``on`` into so many pieces that none is
    large. Their number is fixed: adaptive plans merge pieces by compressed bytes, not by rows."""
    return df.repartition(max(1, -(-rows // TASK_ROWS)), *on)


def positions(panel: Panel, name: str = "pos", ties: Sequence[str] = ()) -> DataFrame:
    """Add the 0-based position of each row inside its series, ordered by ``ts``.

    Stamps must be unique inside a series (true after cleaning); rows without a stamp
    come first, in a time bin of their own. Where they are not, ``ties`` orders the rows of
    a long series, which may be numbered twice and must come out the same."""
    if not panel.split:
        return panel.df.withColumn(name, (F.row_number().over(panel.window) - 1).cast("long"))

    keys = panel.keys
    depth = len(keys)
    bin_name, inner_name, offset_name = f"_bin{depth}", f"_inner{depth}", f"_offset{depth}"
    span = panel.df.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.min(micros("ts")).alias("_lo"), F.max(micros("ts")).alias("_hi")
    )
    wanted = F.greatest(F.lit(1), F.ceil(F.col("_n") * BINS_PER_CHUNK / F.lit(panel.group_rows)))
    wanted = F.when(F.col("_n") <= panel.group_rows, 1).otherwise(wanted)
    width = F.floor((F.col("_hi") - F.col("_lo")) / wanted).cast("long") + 1
    rows = (
        panel.attach(panel.df, span)
        .withColumn(bin_name, F.coalesce(F.floor((micros("ts") - F.col("_lo")) / width).cast("long"), F.lit(-1)))
        .drop("_n", "_lo", "_hi")
    )
    by_bin = Panel(rows, [*keys, bin_name], panel.group_rows, broadcast_series=panel.broadcast_series)
    bins = rows.groupBy(*keys, bin_name).agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*keys).orderBy(bin_name).rowsBetween(Window.unboundedPreceding, -1)
    offsets = bins.select(*keys, bin_name, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias(offset_name))
    # A bin can still be too full when stamps crowd together: cut it again the same way.
    if by_bin.split and by_bin.size.largest < panel.size.largest:
        numbered = positions(by_bin, inner_name, ties)
    else:
        inner = Window.partitionBy(*keys, bin_name).orderBy("ts", *ties)
        dealt = in_pieces(rows, by_bin.measure.rows, [*keys, bin_name])
        numbered = dealt.withColumn(inner_name, (F.row_number().over(inner) - 1).cast("long"))
    return (
        numbered.join(offsets, [*keys, bin_name])
        .withColumn(name, (F.col(offset_name) + F.col(inner_name)).cast("long"))
        .drop(offset_name, inner_name, bin_name)
    )


def open_range(df: DataFrame, first: Column, last: Column, name: str, block: int = 65_536) -> DataFrame:
    """One row per integer from ``first`` to ``last``, opened in blocks so that no array grows
    with the range. An unknown range gives one row without a number."""
    blocks = F.when(first.isNotNull(), F.sequence(F.lit(0).cast("long"), F.floor((last - first) / block).cast("long")))
    start = first + F.col("_block") * block
    run = F.sequence(start, F.least(start + block - 1, last))
    return df.withColumn("_block", F.explode_outer(blocks)).withColumn(name, F.explode_outer(run)).drop("_block")


def over_rows(
    panel: Panel,
    before: int,
    after: int,
    columns: dict[str, Callable[[WindowSpec], Column]],
    order: str = "ts",
) -> DataFrame:
    """Add window columns whose frames reach at most ``before`` / ``after`` rows away.

    ``order="pos"`` says the rows already carry a gapless position column ``pos``."""
    if not panel.split:
        window = Window.partitionBy(*panel.keys).orderBy(order)
        return panel.df.withColumns({name: make(window) for name, make in columns.items()})

    has_pos = "pos" in panel.df.columns
    rows = panel.df if has_pos else positions(panel)
    chunk_rows = max(panel.group_rows, before + after + 1)
    chunk = F.floor(F.col("pos") / chunk_rows).cast("long")
    offset = F.col("pos") - chunk * chunk_rows
    copies = F.filter(
        F.array(
            chunk,
            F.when(offset >= chunk_rows - before, chunk + 1),
            F.when(offset < after, chunk - 1),
        ),
        lambda c: c.isNotNull(),
    )
    spread = rows.withColumn("_chunk", F.explode(copies))
    window = Window.partitionBy(*panel.keys, "_chunk").orderBy("pos")
    done = spread.withColumns({name: make(window) for name, make in columns.items()})
    return done.where(F.col("_chunk") == chunk).drop("_chunk", *([] if has_pos else ["pos"]))


def running_sums(panel: Panel, sums: dict[str, str], order: str = "pos", per_place: int = 1) -> DataFrame:
    """Add running totals ``{new column: summed column}`` along an integer column.

    Rows that share a place all get the total up to and including that place; about
    ``per_place`` of them do, so a chunk is as many places shorter."""
    keys = panel.keys
    upto = (Window.unboundedPreceding, Window.currentRow)
    if not panel.split:
        window = Window.partitionBy(*keys).orderBy(order).rangeBetween(*upto)
        return panel.df.withColumns({new: F.sum(old).over(window) for new, old in sums.items()})

    places = max(1, panel.group_rows // per_place)
    rows = panel.df.withColumn("_chunk", F.floor(F.col(order) / places).cast("long"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order).rangeBetween(*upto)
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "_chunk").agg(*[F.sum(old).alias(f"_t_{new}") for new, old in sums.items()])
    carried = totals.select(
        *keys,
        "_chunk",
        *[F.coalesce(F.sum(f"_t_{new}").over(earlier), F.lit(0)).alias(f"_c_{new}") for new in sums],
    )
    dealt = in_pieces(rows, panel.measure.rows * per_place, [*keys, "_chunk"])
    own = dealt.withColumns({new: F.sum(old).over(inside) for new, old in sums.items()})
    return (
        panel.attach(own, carried, "_chunk", panel.size.largest // places + 1)
        .withColumns({new: F.col(f"_c_{new}") + F.col(new) for new in sums})
        .drop("_chunk", *[f"_c_{new}" for new in sums])
    )


def _both_ways(partition: WindowSpec, order: str, until: int = Window.currentRow) -> tuple[WindowSpec, WindowSpec]:
    """Everything up to a row, forwards and backwards. Looking ahead is done in falling
    order: a frame that only grows costs one step per row, one that shrinks restarts."""
    forwards = partition.orderBy(order).rowsBetween(Window.unboundedPreceding, until)
    backwards = partition.orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, until)
    return forwards, backwards


def nearest_known(panel: Panel, axis: str, order: str = "ts") -> DataFrame:
    """Add ``_prev`` and ``_next``: the nearest row at or before / at or after with a
    value, as ``struct(at, value)`` where ``at`` is the column ``axis``."""
    keys = panel.keys
    here = F.when(F.col("value").isNotNull(), F.struct(F.col(axis).alias("at"), F.col("value").alias("value")))
    if not panel.split:
        back, ahead = _both_ways(Window.partitionBy(*keys), order)
        return panel.df.withColumns(
            {"_prev": F.last(here, ignorenulls=True).over(back), "_next": F.last(here, ignorenulls=True).over(ahead)}
        )

    has_pos = "pos" in panel.df.columns
    rows = (panel.df if has_pos else positions(panel)).withColumn("_here", here)
    rows = rows.withColumn("_chunk", F.floor(F.col("pos") / panel.group_rows).cast("long"))
    at = F.when(F.col("_here").isNotNull(), F.col("pos"))
    ends = rows.groupBy(*keys, "_chunk").agg(
        F.min_by("_here", at).alias("_first"), F.max_by("_here", at).alias("_last")
    )
    before, after = _both_ways(Window.partitionBy(*keys), "_chunk", -1)
    carried = ends.select(
        *keys,
        "_chunk",
        F.last("_last", ignorenulls=True).over(before).alias("_before"),
        F.last("_first", ignorenulls=True).over(after).alias("_after"),
    )
    back, ahead = _both_ways(Window.partitionBy(*keys, "_chunk"), "pos")
    return (
        rows.join(carried, [*keys, "_chunk"])
        .withColumns(
            {
                "_prev": F.coalesce(F.last("_here", ignorenulls=True).over(back), "_before"),
                "_next": F.coalesce(F.last("_here", ignorenulls=True).over(ahead), "_after"),
            }
        )
        .drop("_here", "_chunk", "_before", "_after", *([] if has_pos else ["pos"]))
    )


def chunk_arrays(panel: Panel, reach: int, columns: list[str], chunk_rows: int = 8192) -> DataFrame:
    """One row per ``(keys, chunk)`` with the chunk's rows as arrays, in order.

    Rows must carry ``pos``. ``own`` counts the chunk's own rows; behind them follow
    up to ``reach`` rows of the next chunk, so products of rows at most ``reach``
    apart can be formed inside the chunk. An array never exceeds
    ``chunk_rows + reach`` entries, however long the series is."""
    chunk_rows = max(chunk_rows, reach + 1)
    chunk = F.floor(F.col("pos") / chunk_rows).cast("long")
    offset = F.col("pos") - chunk * chunk_rows
    copies = F.filter(
        F.array(chunk, F.when((offset < reach) & (chunk > 0), chunk - 1)), lambda c: c.isNotNull()
    )
    item = F.struct(F.col("pos").alias("pos"), *[F.col(c).cast("double").alias(c) for c in columns])
    spread = panel.df.select(*panel.keys, F.explode(copies).alias("_chunk"), chunk.alias("_home"), item.alias("_item"))
    packed = spread.groupBy(*panel.keys, "_chunk").agg(
        F.sort_array(F.collect_list("_item")).alias("_items"),
        F.sum((F.col("_home") == F.col("_chunk")).cast("int")).alias("own"),
    )
    return packed.select(
        *panel.keys, "_chunk", "own", *[F.col(f"_items.{c}").alias(c) for c in columns]
    )
