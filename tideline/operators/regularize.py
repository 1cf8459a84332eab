"""Cleaning to a regular grid, resampling, filling, outlier removal and thinning."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.steps import STEPS, advance, at_month_ends, calendar_start, steps_between
from tideline.operators.detect import detect_frequency
from tideline.operators.quantile import summarise
from tideline.operators.split import nearest_known, open_range, over_rows, positions
from tideline.panel import Panel, Size, micros
from tideline.session import settle

MODEL_ROWS = 50_000
PLOT_ROWS = 10_000
FORECAST_ROWS = 20


def drop_unparsed(panel: Panel) -> Panel:
    return panel.derive(panel.df.where(F.col("ts").isNotNull()))


def first_per_stamp(panel: Panel, tiebreak: str) -> Panel:
    """One row per stamp: the one with the least ``tiebreak`` (input order stands for it)."""
    rest = [c for c in panel.df.columns if c not in (*panel.keys, "ts")]
    order = F.struct(F.col(tiebreak).isNull(), F.col(tiebreak))  # rows without a tie-break come last
    kept = panel.df.groupBy(*panel.keys, "ts").agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return panel.derive(kept.select(*panel.keys, "ts", "_row.*"))


def chronological(panel: Panel, partitions: int | None = None) -> DataFrame:
    """Rows in key and time order: range partitions, each sorted, no single-task sort."""
    by = [*panel.keys, "ts"]
    parts = [partitions] if partitions else []
    return panel.df.repartitionByRange(*parts, *by).sortWithinPartitions(*by)


@dataclass(frozen=True)
class Grid:
    """A panel laid on its own calendar, with the numbers of the move per series."""

    panel: Panel
    report: DataFrame


def to_grid(panel: Panel, frequency: DataFrame | None = None, anchor: str = "first") -> Grid:
    """Lay unique stamps on the grid that starts at the first stamp, or with ``anchor="calendar"``
    at the first Sunday or end of month, quarter or year from there on.

    The frequency (one row per series) is settled first, which also gives the size of
    the grid. Each row then emits the empty stamps up to the next row, so no calendar table is
    built and nothing is joined. Rows off the grid are dropped and counted. Series
    without a step keep their rows. Where rows carry ``pos`` it becomes the place on
    the grid, so later steps need not number the rows again."""
    keys = panel.keys
    frequency = settle(detect_frequency(panel) if frequency is None else frequency)
    panel, frequency = _anchored(panel, frequency, anchor)
    steps = frequency.select(*keys, "code", "frequency", "month_ends", "first_ts", "last_ts")
    code, first, final, ends = F.col("code"), F.col("first_ts"), F.col("last_ts"), F.col("month_ends")
    stepped = code.isin(list(STEPS))
    longest = frequency.where(stepped).agg(F.max(steps_between(first, final, code, ends))).first()[0]
    size = Size(panel.size.series, max(panel.size.largest, (longest or 0) + 1))
    place = F.when(stepped, steps_between(first, F.col("ts"), code, ends))
    rows = panel.attach(panel.df, steps).withColumn("_place", place)
    on_grid = (F.col("_place") >= 0) & (advance(first, code, F.col("_place"), ends) == F.col("ts"))
    on_grid = ~stepped | code.isNull() | on_grid
    last = F.when(stepped, F.greatest(steps_between(first, final, code, ends), F.lit(-1)))
    rows = rows.withColumns({"_on": on_grid, "_last": last})

    per_series = rows.groupBy(*keys).agg(
        F.first("frequency").alias("frequency"),
        F.sum((~F.col("_seed")).cast("long")).alias("_rows"),
        F.sum((F.col("_on") & ~F.col("_seed")).cast("long")).alias("_kept"),
        F.sum((F.col("_on") & F.col("value").isNotNull()).cast("long")).alias("_known"),
        F.first("_last").alias("_last"),
    )
    grid_rows = F.coalesce(F.col("_last") + 1, F.col("_rows"))
    report = per_series.select(
        *keys,
        (F.col("_rows") - F.col("_kept")).alias("off_grid_rows"),
        (grid_rows - F.col("_kept")).alias("missing_dates_filled"),
        F.when(F.col("_known") > 0, grid_rows - F.col("_known")).otherwise(0).alias("missing_values_filled"),
        grid_rows.alias("final_rows"),
        "frequency",
    )

    # without the rows off the grid ``pos`` has gaps, so the rest is numbered anew where needed
    kept = panel.derive(rows.where("_on").drop("_on").withColumnsRenamed({"pos": "_was"}))
    spaced = over_rows(kept, 0, 1, {"_following": lambda w: F.lead("_place").over(w)})
    until = F.coalesce(F.col("_following"), F.col("_last") + 1) - 1
    opened = open_range(spaced, F.col("_place"), until, "_at")
    own = F.col("_at").isNull() | (F.col("_at") == F.col("_place"))
    stamp = F.when(own, F.col("ts")).otherwise(advance(first, code, F.col("_at"), ends))
    placed = [F.coalesce("_at", "_was").alias("pos")] if "pos" in panel.df.columns else []
    filled = opened.select(
        *keys, stamp.alias("ts"), F.when(own, F.col("value")).alias("value"), (own & ~F.col("_seed")).alias("observed"), *placed
    )
    return Grid(panel.derive(filled, size=size), report)


def _anchored(panel: Panel, frequency: DataFrame, anchor: str) -> tuple[Panel, DataFrame]:
    """The panel and its frequency with the grid's start. A series without a row at the start of
    its calendar gets an empty one there (``_seed``), from which the grid opens."""
    if anchor not in ("first", "calendar"):
        raise ValueError(f"no such anchor: {anchor}")
    rows = panel.df.withColumn("_seed", F.lit(False))
    if anchor == "first":
        return panel.derive(rows), frequency
    code = F.col("code")
    start = F.when(code.isin(list(STEPS)), calendar_start(F.col("first_ts"), code)).otherwise(F.col("first_ts"))
    frequency = frequency.withColumns({"first_ts": start, "month_ends": at_month_ends(code)})
    starts = frequency.where(code.isin(list(STEPS)) & (F.col("first_ts") <= F.col("last_ts"))).select(*panel.keys, "first_ts")
    there = panel.attach(rows, starts).groupBy(*panel.keys, "first_ts").agg(F.max(F.col("ts") == F.col("first_ts")).alias("_there"))
    seeds = there.where(~F.col("_there")).select(*panel.keys, F.col("first_ts").alias("ts"), F.lit(True).alias("_seed"))
    more = Size(panel.size.series, panel.size.largest + 1)
    return panel.derive(rows.unionByName(seeds, allowMissingColumns=True), size=more), frequency


def interpolate_time(panel: Panel) -> DataFrame:
    """Linear in time between known values; both ends take the nearest known value."""
    near = nearest_known(panel.derive(panel.df.withColumn("_us", micros("ts"))), "_us")
    return _between(near, F.col("_us"), fill_ends=True).drop("_us", "_prev", "_next")


def interpolate_position(panel: Panel) -> DataFrame:
    """Linear by row; leading gaps stay empty, trailing gaps take the last value."""
    placed = panel.derive(positions(panel))
    near = nearest_known(placed, "pos")
    return _between(near, F.col("pos"), fill_ends=False).drop("pos", "_prev", "_next")


def _between(near: DataFrame, at: Column, fill_ends: bool) -> DataFrame:
    prev, nxt = F.col("_prev"), F.col("_next")
    share = (at - prev["at"]) / (nxt["at"] - prev["at"])
    inner = F.when(nxt["at"] > prev["at"], prev["value"] + share * (nxt["value"] - prev["value"]))
    ends = [prev["value"], nxt["value"]] if fill_ends else [F.when(nxt.isNull(), prev["value"])]
    return near.withColumn("value", F.coalesce(F.col("value"), inner, *ends))


def forward_fill(panel: Panel, then_backward: bool = False) -> DataFrame:
    near = nearest_known(panel, "ts")
    rest = [F.col("_next.value")] if then_backward else []
    return near.withColumn("value", F.coalesce(F.col("_prev.value"), *rest)).drop("_prev", "_next")


def backward_fill(panel: Panel) -> DataFrame:
    return nearest_known(panel, "ts").withColumn("value", F.col("_next.value")).drop("_prev", "_next")


def fill_constant(panel: Panel, how: str) -> DataFrame:
    """Fill with the mean or the median of the series."""
    if how == "mean":
        centre = summarise(panel, {"_fill": F.avg("value")})
    else:
        centre = summarise(panel, {}, {"_fill": 0.5})
    return panel.attach(panel.df, centre).withColumn("value", F.coalesce("value", "_fill")).drop("_fill")


FILLS = {
    "ffill": forward_fill,
    "bfill": backward_fill,
    "linear": interpolate_position,
    "time": interpolate_time,
    "mean": lambda p: fill_constant(p, "mean"),
    "median": lambda p: fill_constant(p, "median"),
}


def first_per_value(panel: Panel) -> DataFrame:
    """Keep the earliest row of each distinct value (opt-in: it breaks the grid)."""
    rest = [c for c in panel.df.columns if c not in (*panel.keys, "value")]
    kept = panel.df.groupBy(*panel.keys, "value").agg(F.min_by(F.struct(*rest), "ts").alias("_row"))
    return kept.select(*panel.keys, "_row.*", "value").select(*panel.df.columns)


def clean(panel: Panel, tiebreak: str, dedup_values: bool = False) -> Grid:
    """Drop bad and repeated stamps, lay on a grid, interpolate; with a report per series."""
    keys = panel.keys
    raw = panel.df.groupBy(*keys).agg(
        F.count("*").alias("original_rows"), F.count("ts").alias("_stamped")
    )
    unique = first_per_stamp(drop_unparsed(panel), tiebreak)
    unique = unique.derive(unique.df.select(*keys, "ts", "value"))
    # Read three times below: for the frequency, the report and the grid.
    unique = unique.derive(settle(positions(unique) if unique.split else unique.df))
    grid = to_grid(unique)
    filled = grid.panel.derive(interpolate_time(grid.panel))
    if dedup_values:
        filled = filled.derive(first_per_value(filled.derive(filled.df.drop("pos"))))
    report = raw.join(grid.report, keys, "left")
    kept_rows = F.col("final_rows") - F.col("missing_dates_filled") + F.col("off_grid_rows")
    final = F.col("final_rows")
    if dedup_values:
        final = F.col("_unique_values")
        report = report.join(filled.df.groupBy(*keys).agg(F.count("*").alias("_unique_values")), keys, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    report = report.select(
        *keys,
        "original_rows",
        (F.col("original_rows") - F.col("_stamped")).alias("rows_removed"),
        zero(F.col("_stamped") - kept_rows).alias("duplicates_removed"),
        zero(F.col("missing_dates_filled")).alias("missing_dates_filled"),
        zero(F.col("missing_values_filled")).alias("missing_values_filled"),
        zero(F.col("off_grid_rows")).alias("off_grid_rows"),
        zero(final).alias("final_rows"),
        F.coalesce("frequency", F.lit("Unknown")).alias("frequency"),
    )
    return Grid(filled, report)


# --- resampling -----------------------------------------------------------------


def bucket_end(ts: Column, unit: str) -> Column:
    """The label of the bucket a stamp falls in: the day, or the last day of the
    week (Sunday), month, quarter or year."""
    day = ts.cast("date")
    label = {
        "day": day,
        "week": F.date_add(F.date_trunc("week", ts).cast("date"), 6),
        "month": F.last_day(day),
        "quarter": F.last_day(F.add_months(F.date_trunc("quarter", ts).cast("date"), 2)),
        "year": F.last_day(F.add_months(F.date_trunc("year", ts).cast("date"), 11)),
    }[unit]
    return label.cast("timestamp_ntz")


def resample_mean(panel: Panel, unit: str) -> DataFrame:
    """Mean per bucket; buckets without rows are kept, empty."""
    keys = panel.keys
    means = (
        panel.df.where(F.col("ts").isNotNull())
        .groupBy(*keys, bucket_end(F.col("ts"), unit).alias("ts"))
        .agg(F.avg("value").alias("value"))
    )
    buckets = panel.derive(means)
    ahead = over_rows(buckets, 0, 1, {"_following": lambda w: F.lead("ts").over(w)})
    months = {"month": 1, "quarter": 3, "year": 12}
    if unit in months:
        step = F.expr(f"interval {months[unit]} month")
        starts = lambda c: F.add_months(F.last_day(c.cast("date")), 0)
        first, stop = F.date_add(starts(F.col("ts")), 1), F.date_add(starts(F.col("_following")), 1)
        # Step over first-of-month dates, then go back one day to the label.
        run = F.transform(F.sequence(first, stop, step), lambda d: F.date_add(d, -1).cast("timestamp_ntz"))
    else:
        step = F.expr(f"interval {1 if unit == 'day' else 7} day")
        run = F.sequence(F.col("ts"), F.col("_following"), step)
    run = F.when(F.col("_following").isNull(), F.array("ts")).otherwise(F.slice(run, 1, F.size(run) - 1))
    opened = ahead.withColumn("_at", F.explode(run))
    return opened.select(
        *keys, F.col("_at").alias("ts"), F.when(F.col("_at") == F.col("ts"), F.col("value")).alias("value")
    )


# --- outliers -------------------------------------------------------------------


def zscore(panel: Panel) -> DataFrame:
    """Add ``z`` (sample deviation); NULL where the deviation is zero or undefined."""
    stats = summarise(panel, {"_mean": F.avg("value"), "_std": F.stddev_samp("value")})
    spread = F.when(F.col("_std") > 0, F.col("_std"))
    return panel.attach(panel.df, stats).withColumn("z", (F.col("value") - F.col("_mean")) / spread).drop("_mean", "_std")


def iqr_bounds(panel: Panel, extra: dict[str, Column] | None = None) -> DataFrame:
    quartiles = summarise(panel, extra or {}, {"q1": 0.25, "q3": 0.75})
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    return quartiles.withColumns({"lower_bound": F.col("q1") - reach, "upper_bound": F.col("q3") + reach})


def drop_outliers_zscore(panel: Panel, threshold: float = 3.0) -> DataFrame:
    return zscore(panel).where(F.abs("z") < threshold).drop("z")


def drop_outliers_iqr(panel: Panel) -> DataFrame:
    bounds = iqr_bounds(panel).select(*panel.keys, "lower_bound", "upper_bound")
    inside = F.col("value").between(F.col("lower_bound"), F.col("upper_bound"))
    return panel.attach(panel.df, bounds).where(inside).drop("lower_bound", "upper_bound")


# --- thinning and composites ----------------------------------------------------


def stride(n: Column, limit: int = MODEL_ROWS) -> Column:
    """Every how many-th row of a series of ``n`` rows thinning keeps."""
    return F.when(n > limit, F.floor(n / limit)).otherwise(1).cast("int")


def thin(panel: Panel, limit: int = MODEL_ROWS) -> Panel:
    """Keep every ``n // limit``-th row of series longer than ``limit``."""
    if panel.size.largest <= limit:
        return panel
    counts = panel.df.groupBy(*panel.keys).agg(F.count("*").alias("_n"))
    rows = panel.attach(positions(panel, "_pos"), counts).where(F.col("_pos") % stride(F.col("_n"), limit) == 0)
    return panel.derive(rows.drop("_n", "_pos"), keep_size=False)


def too_short(panel: Panel, least: int = FORECAST_ROWS) -> DataFrame:
    """Series below a minimum size, with the reason."""
    counts = panel.df.groupBy(*panel.keys).agg(F.count("value").alias("points"))
    reason = F.concat(F.lit("fewer than "), F.lit(str(least)), F.lit(" points"))
    return counts.where(F.col("points") < least).withColumn("reason", reason)


def long_enough(panel: Panel, least: int = FORECAST_ROWS) -> Panel:
    counts = panel.df.groupBy(*panel.keys).agg(F.count("value").alias("_points"))
    keep = counts.where(F.col("_points") >= least).select(*panel.keys)
    return panel.derive(panel.attach(panel.df, keep))


@dataclass(frozen=True)
class Prepared:
    panel: Panel
    report: DataFrame
    skipped: DataFrame

    def metadata(self) -> DataFrame:
        """Per series: rows, first and last stamp, days between, and the whole analysis (trend, season,
        quality, frequency, recommended model, readiness)."""
        from tideline.operators.stats import analyze_series

        keys = self.panel.keys
        first, final = F.min("ts"), F.max("ts")
        days = F.datediff(final.cast("date"), first.cast("date"))
        clock = lambda c: micros(c) - micros(F.date_trunc("day", c).cast("timestamp_ntz"))
        whole = days - F.when(clock(final) < clock(first), 1).otherwise(0)
        span = self.panel.df.groupBy(*keys).agg(
            F.count("*").alias("rows"), first.alias("start"), final.alias("end"), whole.cast("long").alias("total_days")
        )
        return span.join(analyze_series(self.panel), keys)


def prepare_forecast(panel: Panel, tiebreak: str, dedup_values: bool = False, thin_to: int | None = None) -> Prepared:
    """Clean, keep known values, set short series aside.

    No row is thinned away here unless ``thin_to`` asks for it: only fits train on every
    ``fit_stride``-th row (in the report). The result is written once: every model,
    statistic and score reads it again."""
    cleaned = clean(panel, tiebreak, dedup_values)
    known = cleaned.panel.derive(cleaned.panel.df.select(*panel.keys, "ts", "value")).known()
    if thin_to is not None:
        known = thin(known, thin_to)
    known = known.derive(settle(known.df))
    report = cleaned.report.withColumn("fit_stride", stride(F.col("final_rows")))
    return Prepared(long_enough(known), report, too_short(known))


def preprocess(
    panel: Panel,
    resample: str | None = None,
    fill: str | None = None,
    outliers: str | None = None,
    threshold: float = 3.0,
    contamination: float = 0.05,
) -> DataFrame:
    """Resampling, filling and outlier removal in one call, each optional."""
    if resample:
        panel = panel.derive(resample_mean(panel, resample), keep_size=False)
    if fill:
        panel = panel.derive(FILLS[fill](panel))
    if outliers == "zscore":
        return drop_outliers_zscore(panel, threshold)
    if outliers == "iqr":
        return drop_outliers_iqr(panel)
    if outliers == "forest":
        from tideline.operators.forest import drop_outliers_forest

        return drop_outliers_forest(panel, contamination)
    return panel.df


def preprocess_table(
    df: DataFrame, ts: str, value: str, keys: list[str] | tuple[str, ...] = (), extra: list[str] | tuple[str, ...] = (), **options
) -> DataFrame:
    """``preprocess`` of a raw table: texts that are times become stamps and integers narrow first."""
    from tideline.operators.schema import convert_types

    return preprocess(Panel.of(convert_types(df), ts, value, keys, extra), **options)
