"""The panel: rows ``(keys..., ts, value)`` plus a measured size.

Every ordered operator has two exact plans. When the largest series fits in one
task the natural ``Window.partitionBy(keys)`` plan is used. Otherwise the series
are cut into chunks (``operators/split.py``), so a key that holds a third of all
rows is spread over many tasks. The choice rests on one measured pair of numbers,
taken once per panel and handed on to panels derived from it.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.dates import text_to_time

GROUP_ROWS = 2_000_000  # rows of one series a single task may sort
BROADCAST_SERIES = 100_000  # rows of a per-series table that may be broadcast
NO_KEY = "(none)"
SALTS = 64  # pieces a series is cut into when a per-series table is too big for that


@dataclass(frozen=True)
class Size:
    series: int
    largest: int


def only_series(of: Column | str) -> Column:
    """The key of a table that is one single series: always 0, but tied to a column, so
    joins on it stay equi-joins instead of being folded into cross joins."""
    return F.hash(of).bitwiseAND(F.lit(0))


class Measure:
    """The size of a frame's series, counted on first use and shared by derived panels."""

    def __init__(self, df: DataFrame, keys: list[str], size: Size | None = None):
        self.df, self.keys, self._size = df, keys, size
        self._rows: int | None = None

    @property
    def size(self) -> Size:
        if self._size is None:
            row = (
                self.df.groupBy(*self.keys)
                .agg(F.count("*").alias("n"))
                .agg(F.count("*").alias("series"), F.max("n").alias("largest"), F.sum("n").alias("rows"))
                .first()
            )
            self._size, self._rows = Size(row["series"], row["largest"] or 0), row["rows"] or 0
        return self._size

    @property
    def rows(self) -> int:
        """All rows: counted along with the size, or alone where the size was handed in."""
        if self.size and self._rows is None:
            self._rows = self.df.count()
        return self._rows


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch of a timestamp without zone (session zone UTC)."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(col.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us.cast("bigint")).cast("timestamp_ntz")


def number(col: Column) -> Column:
    """A double, with NaN and text that is no number turned into NULL."""
    as_double = col.try_cast("double")
    return F.when(~F.isnan(as_double), as_double)


def read_stamp(df: DataFrame, name: str) -> Column:
    """A column of any type as a stamp; the unit of numbers follows from the whole column."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return text_to_time(F.col(name))
    if isinstance(kind, T.NumericType):
        from tideline.operators.detect import time_expressions

        return time_expressions(df, [name])[name]
    return F.col(name).cast("timestamp_ntz")


class Panel:
    """A frame with key columns, a time column ``ts`` and a value column ``value``."""

    def __init__(
        self,
        df: DataFrame,
        keys: Iterable[str],
        group_rows: int = GROUP_ROWS,
        measure: Measure | None = None,
        broadcast_series: int = BROADCAST_SERIES,
    ):
        self.df = df
        self.keys = list(keys)
        self.group_rows = group_rows
        self.broadcast_series = broadcast_series
        self.measure = measure or Measure(df, self.keys)

    @classmethod
    def of(
        cls,
        df: DataFrame,
        ts: str,
        value: str,
        keys: Iterable[str] = (),
        extra: Iterable[str] = (),
        group_rows: int = GROUP_ROWS,
    ) -> Panel:
        """Project to the panel columns; without keys the whole table is series 0.

        Texts and numbers are read as stamps; what does not parse is a NULL stamp.

        Rows without a text key form a series of their own, ``(none)``; rows that lack
        any other key belong to no series and are left out."""
        names = list(keys)
        texts = [k for k in names if isinstance(df.schema[k].dataType, T.StringType)]
        others = [k for k in names if k not in texts]
        df = df.dropna(subset=others) if others else df
        key_cols = [F.coalesce(k, F.lit(NO_KEY)).alias(k) if k in texts else F.col(k) for k in names]
        key_cols = key_cols or [only_series(ts).alias("series")]
        columns = [
            *key_cols,
            read_stamp(df, ts).alias("ts"),
            number(F.col(value)).alias("value"),
            *[F.col(c) for c in extra],
        ]
        return cls(df.select(*columns), names or ["series"], group_rows)

    def derive(
        self, df: DataFrame, keep_size: bool = True, size: Size | None = None, keys: Iterable[str] | None = None
    ) -> Panel:
        """A panel over another frame. ``keep_size`` when no series gains rows: the
        parent's count then stands as the upper bound and is taken at most once."""
        names = self.keys if keys is None else list(keys)
        measure = self.measure if keep_size and size is None else Measure(df, names, size)
        return Panel(df, names, self.group_rows, measure, self.broadcast_series)

    @property
    def size(self) -> Size:
        return self.measure.size

    @property
    def split(self) -> bool:
        """True when some series is too long for one task."""
        return self.size.largest > self.group_rows

    @property
    def window(self):
        return Window.partitionBy(*self.keys).orderBy("ts")

    def known(self) -> Panel:
        """Only rows with both a stamp and a value."""
        return self.derive(self.df.where(F.col("ts").isNotNull() & F.col("value").isNotNull()))

    def attach(
        self, df: DataFrame, per_series: DataFrame, also: str | None = None, copies: int = 1
    ) -> DataFrame:
        """Join narrow rows, one per series, onto many rows per series.

        ``also`` is a further join column with at most ``copies`` values per series. The
        number of series is measured, so the broadcast is bounded. Beyond the bound both
        sides are salted, so the rows of a hot series never meet in one task."""
        on = [*self.keys, also] if also else self.keys
        if self.size.series * copies <= self.broadcast_series:
            return df.join(F.broadcast(per_series), on)
        salt = F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int")
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        return (
            df.withColumn("_salt", salt)
            .join(per_series.withColumn("_salt", salts), [*on, "_salt"])
            .drop("_salt")
        )
