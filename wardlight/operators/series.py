"""Irregular event series into per-entity statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import US_PER_HOUR, hours_between, micros
from ..session import durable
from .ordered import grouped_quantiles
from .temporal import bin_index

HOUR = "hour_us"
# A series this dense inside one hour gets its median by ranks instead of an in-task buffer.
DENSE_ROWS = 100_000


def _observed_hours(df: DataFrame, keys: Sequence[str], ts: str, value: str) -> DataFrame:
    """One row per key and observed hour, plus the whole series' extent.

    The hourly mean is map-side combined, so the windows behind it only see as many rows per key as
    the series has hours.
    """
    us = micros(ts)
    hourly = (
        df.where(F.col(value).isNotNull() & F.col(ts).isNotNull())
        .groupBy(*keys, (F.floor(us / F.lit(float(US_PER_HOUR))) * US_PER_HOUR).alias(HOUR))
        .agg(F.avg(value).alias("value"), F.count("*").alias("__n"), F.min(us).alias("__lo"), F.max(us).alias("__hi"))
    )
    w = Window.partitionBy(*keys)
    return (
        hourly.withColumn("__rows", F.sum("__n").over(w))
        .withColumn("__first", F.min("__lo").over(w))
        .withColumn("__last", F.max("__hi").over(w))
        .withColumn("__next", F.lead(HOUR).over(w.orderBy(HOUR)))
        .withColumn("__short", (F.col("__rows") == 1) | (F.col("__last") - F.col("__first") < US_PER_HOUR))
    )


def _short_rows(df: DataFrame, hours: DataFrame, keys: Sequence[str], ts: str, value: str) -> DataFrame:
    """Raw rows of the series that are too short to resample."""
    short = hours.where("__short").groupBy(*keys).agg(F.min("__first").alias("__first"), F.max("__rows").alias("__rows"))
    return df.where(F.col(value).isNotNull() & F.col(ts).isNotNull()).join(short, list(keys), "inner")


def locf_grid(df: DataFrame, keys: Sequence[str], ts: str, value: str) -> DataFrame:
    """Hourly means from first to last hour, gaps filled with the last one; short series stay raw.

    Columns: keys, ``at_us`` (hour start, or the raw time of a short series), ``value``.
    """
    hours = _observed_hours(df, keys, ts, value)
    stop = F.coalesce(F.col("__next") - US_PER_HOUR, F.col(HOUR))
    long = hours.where(~F.col("__short")).select(
        *keys, F.explode(F.sequence(F.col(HOUR), stop, F.lit(US_PER_HOUR))).alias("at_us"), "value"
    )
    short = _short_rows(df, hours, keys, ts, value).select(*keys, micros(ts).alias("at_us"), F.col(value).alias("value"))
    return long.unionByName(short)


def locf_runs(df: DataFrame, keys: Sequence[str], ts: str, value: str) -> DataFrame:
    """The same series without the grid: each observed hour weighs the hours it is carried over.

    ``x`` counts whole seconds since the series began (its first hour, or first row when short),
    which keeps the sums of squares small.
    """
    return _runs(df, _observed_hours(df, keys, ts, value), keys, ts, value)


def _runs(df: DataFrame, hours: DataFrame, keys: Sequence[str], ts: str, value: str) -> DataFrame:
    origin = F.floor(F.col("__first") / F.lit(float(US_PER_HOUR))) * US_PER_HOUR
    long = hours.where(~F.col("__short")).select(
        *keys,
        ((F.col(HOUR) - origin) / 1e6).alias("x"),
        "value",
        F.coalesce(((F.col("__next") - F.col(HOUR)) / US_PER_HOUR).cast("long"), F.lit(1).cast("long")).alias("w"),
        F.lit(False).alias("dense"),
    )
    short = _short_rows(df, hours, keys, ts, value).select(
        *keys,
        (F.floor(micros(ts) / 1e6) - F.floor(F.col("__first") / 1e6)).cast("double").alias("x"),
        F.col(value).alias("value"),
        F.lit(1).cast("long").alias("w"),
        (F.col("__rows") > DENSE_ROWS).alias("dense"),
    )
    return long.unionByName(short)


def _slope(n: Column, sx: Column, sy: Column, sxx: Column, sxy: Column) -> Column:
    det = n * sxx - sx * sx
    return F.when((n >= 2) & (det != 0), F.try_divide(n * sxy - sx * sy, det))


def locf_stats(df: DataFrame, keys: Sequence[str], ts: str, value: str) -> DataFrame:
    """min, max, avg, median, std, count and slope per second of the carried-forward series."""
    hours = _observed_hours(df, keys, ts, value)
    runs = _runs(df, hours, keys, ts, value)
    w, x, v, step = F.col("w").cast("double"), F.col("x"), F.col("value"), F.lit(3600.0)
    half = w * (w - 1) / 2
    squares = (w - 1) * w * (2 * w - 1) / 6
    sx = w * x + step * half
    sxx = w * x * x + 2 * x * step * half + step * step * squares
    sums = runs.groupBy(*keys).agg(
        F.min(v).alias("v_min"),
        F.max(v).alias("v_max"),
        F.sum("w").alias("v_count"),
        F.sum(w * v).alias("__sy"),
        F.sum(w * v * v).alias("__syy"),
        F.sum(sx).alias("__sx"),
        F.sum(sxx).alias("__sxx"),
        F.sum(sx * v).alias("__sxy"),
        F.percentile(F.when(~F.col("dense"), v), 0.5, F.col("w")).alias("__median"),
    )
    dense = _short_rows(df, hours.where(F.col("__rows") > DENSE_ROWS), keys, ts, value)
    medians = grouped_quantiles(dense, keys, value, {"__dense_median": 0.5})
    n = F.col("v_count").cast("double")
    spread = F.greatest(F.col("__syy") - F.col("__sy") * F.col("__sy") / n, F.lit(0.0))
    return (
        sums.join(medians, list(keys), "left")
        .select(
            *keys, "v_min", "v_max", (F.col("__sy") / n).alias("v_avg"), F.coalesce("__median", "__dense_median").alias("v_median"),
            F.when(n > 1, F.sqrt(F.try_divide(spread, n - 1))).alias("v_std"), "v_count",
            _slope(n, F.col("__sx"), F.col("__sy"), F.col("__sxx"), F.col("__sxy")).alias("v_slope"),
        )
    )


def series_stats(df: DataFrame, keys: Sequence[str], value: str, median: bool = True) -> DataFrame:
    """min, max, avg, median, sample std and count of raw rows."""
    out = df.groupBy(*keys).agg(
        F.min(value).alias("v_min"), F.max(value).alias("v_max"), F.avg(value).alias("v_avg"),
        F.stddev_samp(value).alias("v_std"), F.count(value).alias("v_count"),
    )
    if median:
        out = out.join(grouped_quantiles(df, keys, value, {"v_median": 0.5}), list(keys), "left")
    return out


def last_value(df: DataFrame, keys: Sequence[str], ts: str, value: str) -> DataFrame:
    """Last non-null value and, separately, the last time."""
    return df.where(F.col(ts).isNotNull()).groupBy(*keys).agg(
        F.max(F.when(F.col(value).isNotNull(), F.struct(F.col(ts), F.col(value))))[value].alias("v_last"),
        F.max(ts).alias("v_last_time"),
    )


def slope(df: DataFrame, keys: Sequence[str], ts: str, value: str) -> DataFrame:
    """Least-squares slope of value over whole seconds; null below two points."""
    points = df.where(F.col(value).isNotNull() & F.col(ts).isNotNull())
    seconds = F.floor(micros(ts) / 1e6).cast("double")
    return points.groupBy(*keys).agg(
        F.when(F.count("*") >= 2, F.regr_slope(F.col(value), seconds)).alias("v_slope"), F.count("*").alias("v_count")
    )


def window_counts(
    events: DataFrame, cutoffs: DataFrame, on: str, keys: Sequence[str], ts: str, cutoff: str,
    hours: Sequence[int] = (24, 48), bounded: bool = False,
) -> DataFrame:
    """Rows within the last h hours before the cut-off, numeric or not."""
    gap = hours_between(cutoff, ts)

    def near(h: int) -> Column:
        return ((gap >= 0) & (gap <= h)) if bounded else gap <= h

    return events.join(cutoffs, on, "inner").groupBy(*keys).agg(*[F.count_if(near(h)).alias(f"n_{h}h") for h in hours])


def wide_stats(stats: DataFrame, id_col: str, concept: str, concepts: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Long per-concept statistics to one row per entity; the value list is always explicit."""
    return stats.groupBy(id_col).agg(
        *[F.max(F.when(F.col(concept) == c, F.col(m))).alias(f"{c}_{m}") for c in concepts for m in measures]
    )


def stats_with_default(
    df: DataFrame, id_col: str, concept: str, ts: str, value: str, concepts: Sequence[str], missing: float, population: bool
) -> DataFrame:
    """Wide min/max/mean/last/count/measured without resampling; absent concepts get ``missing``.

    ``population`` selects the population standard deviation and adds median and std (serving form).
    """
    rows = df.where(F.col(concept).isin(list(concepts)) & F.col(value).isNotNull())
    aggs = [
        F.min(value).alias("Min"), F.max(value).alias("Max"), F.avg(value).alias("Mean"),
        F.max(F.struct(F.col(ts), F.col(value)))[value].alias("Last"), F.count(value).alias("Count"),
    ]
    measures = ["Min", "Max", "Mean", "Last", "Count"]
    if population:
        aggs.append(F.stddev_pop(value).alias("Std"))
        measures.append("Std")
    long = rows.groupBy(id_col, concept).agg(*aggs)
    if population:
        long = long.join(grouped_quantiles(rows, [id_col, concept], value, {"Median": 0.5}), [id_col, concept], "left")
        measures.append("Median")
    long = long.withColumn("Measured", F.when(F.col("Count") > 0, 1).otherwise(0))
    wide = wide_stats(long, id_col, concept, concepts, [*measures, "Measured"])
    flags = [f"{c}_{m}" for c in concepts for m in ("Count", "Measured")]
    return wide.fillna(0, subset=flags).fillna(missing, subset=[f"{c}_{m}" for c in concepts for m in measures if m != "Count"])


def fill_population_median(df: DataFrame, concept: str, count: str, stats: Sequence[str]) -> DataFrame:
    """Entities without any measurement of a concept get the cohort median; other nulls stay.

    ``df`` is long: one row per entity and concept, absent ones included with null or 0 count.
    """
    df = durable(df)  # read three times below: the series behind it are worked out once
    long = df.select(concept, F.explode(F.array(*[F.struct(F.lit(s).alias("s"), F.col(s).cast("double").alias("x")) for s in stats])).alias("p"))
    medians = grouped_quantiles(long.select(concept, F.col("p.s").alias("s"), F.col("p.x").alias("x")), [concept, "s"], "x", {"m": 0.5})
    per_concept = medians.groupBy(concept).agg(*[F.max(F.when(F.col("s") == s, F.col("m"))).alias(f"__m_{s}") for s in stats])
    unmeasured = F.col(count).isNull() | (F.col(count) == 0)
    return df.join(per_concept, concept, "left").select(
        *[
            F.when(unmeasured, F.coalesce(F.col(c), F.col(f"__m_{c}"))).otherwise(F.col(c)).alias(c) if c in stats else F.col(c)
            for c in df.columns
        ]
    )


def bin_stats(
    events: DataFrame, cutoffs: DataFrame, on: str, feature: str, ts: str, value: str, cutoff: str,
    window_hours: int = 48, bin_minutes: int = 60,
) -> DataFrame:
    """mean, min, max, std and median per entity, feature and bin of the window before the cut-off."""
    binned = (
        events.join(cutoffs, on, "inner")
        .where(F.col(value).isNotNull())
        .withColumn("bin", bin_index(ts, cutoff, window_hours, bin_minutes))
        .where(F.col("bin").isNotNull())
    )
    keys = [on, feature, "bin"]
    base = binned.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.stddev_samp(value).alias("std")
    )
    return base.join(grouped_quantiles(binned, keys, value, {"median": 0.5}), keys, "left")


def bin_grid(entities: DataFrame, id_col: str, features: Sequence[str], bins: int, feature: str = "feature") -> DataFrame:
    """Every (entity, feature, bin) cell: the row count is fixed by the request, not by the events."""
    cells = F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    per_feature = entities.select(id_col, F.explode(F.array(*[F.lit(f) for f in features])).alias(feature))
    return per_feature.select(id_col, feature, cells)


def carry_bins(grid: DataFrame, id_col: str, feature: str, value: str, bins: str = "bin") -> DataFrame:
    """Carry the last bin forward per entity and feature, then the feature's overall median."""
    w = Window.partitionBy(id_col, feature).orderBy(bins).rowsBetween(Window.unboundedPreceding, 0)
    carried = durable(grid.withColumn(value, F.last(value, ignorenulls=True).over(w)))
    medians = grouped_quantiles(carried, [feature], value, {"__m": 0.5}, few_keys=True)
    return carried.join(medians, feature, "left").withColumn(value, F.coalesce(F.col(value), F.col("__m"))).drop("__m")


def to_tensor(cells: DataFrame, id_col: str, feature: str, value: str, bins: str = "bin") -> DataFrame:
    """Bins x features array per entity, both axes in order; its size is fixed by the grid."""
    rows = cells.groupBy(id_col, bins).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(feature), F.col(value).cast("float").alias("v")))), lambda r: r["v"]).alias("row")
    )
    return rows.groupBy(id_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(bins), F.col("row")))), lambda r: r["row"]).alias("tensor")
    )
