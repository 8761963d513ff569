"""Joins on time: later stays, cut-offs, look-back windows, nearest partner, overlapping intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import US_PER_HOUR, col, hours_between, micros


def without_later(df: DataFrame, subject: str, start: str, end: str) -> DataFrame:
    """Rows whose subject has no row starting after this one ends.

    One maximum per subject answers it, so no pair of rows is ever formed.
    """
    latest = df.groupBy(subject).agg(F.max(start).alias("__latest"))
    joined = df.join(latest, subject, "left")
    return joined.where(F.col("__latest").isNull() | ~(F.col("__latest") > F.col(end)) | F.col(end).isNull()).drop("__latest")


def label_return(df: DataFrame, admission: str, stay: str, start: str, end: str, label: str = "Y") -> DataFrame:
    """1 when another stay of the same admission starts after this stay ends.

    The two latest starts belonging to different stays are enough: the latest one, and for the stay
    that owns it the latest of the others.
    """
    top = df.groupBy(admission).agg(F.max(F.struct(F.col(start).alias("at"), F.col(stay).alias("owner"))).alias("__top"))
    tagged = df.join(top, admission, "left")
    second = tagged.where(F.col(stay) != F.col("__top.owner")).groupBy(admission).agg(F.max(start).alias("__second"))
    best = F.when(F.col(stay) != F.col("__top.owner"), F.col("__top.at")).otherwise(F.col("__second"))
    return tagged.join(second, admission, "left").withColumn(
        label, F.when(best > F.col(end), 1).otherwise(0)
    ).drop("__top", "__second")


def before_cutoff(events: DataFrame, cutoffs: DataFrame, on: str, ts: str, cutoff: str, inclusive: bool = False) -> DataFrame:
    early = F.col(ts) <= F.col(cutoff) if inclusive else F.col(ts) < F.col(cutoff)
    return events.join(cutoffs, on, "inner").where(early)


def lookback_condition(ts: str | Column, cutoff: str | Column, hours: float, bounded: bool = True) -> Column:
    """Event lies at most ``hours`` before the cut-off; unbounded also keeps events after it."""
    gap = hours_between(cutoff, ts)
    near = gap <= hours
    return (gap >= 0) & near if bounded else near


def lookback(events: DataFrame, cutoffs: DataFrame, on: str, ts: str, cutoff: str, hours: float, bounded: bool = True) -> DataFrame:
    return events.join(cutoffs, on, "inner").where(lookback_condition(ts, cutoff, hours, bounded))


def overlapping(
    intervals: DataFrame, cutoffs: DataFrame, on: str, start: str, end: str, cutoff: str, hours: float = 24.0
) -> DataFrame:
    """Intervals touching the closed window [cut-off - hours, cut-off]."""
    lo = F.col(cutoff) - F.expr(f"INTERVAL '{int(hours * 3600)}' SECOND")
    return intervals.join(cutoffs, on, "inner").where((F.col(end) >= lo) & (F.col(start) <= F.col(cutoff)))


def nearest(
    left: DataFrame,
    right: DataFrame,
    on: str,
    left_ts: str,
    right_ts: str,
    right_value: str,
    right_id: str,
    tolerance_seconds: int,
    out_value: str = "match_value",
    out_gap: str = "match_gap_seconds",
) -> DataFrame:
    """Each left row with the closest right row of its entity, at most ``tolerance_seconds`` away.

    Ties go to the earlier right row, then to the smaller id. Both sides are cut into time bins one
    tolerance wide; the last right row of a bin also visits the next bin and the first one the bin
    before, so a single window per (entity, bin) sees every candidate. No pair list is built and an
    entity with very many rows is spread over its bins.
    """
    width = tolerance_seconds * 1_000_000
    us = "__us"
    rows_right = (
        right.where(F.col(right_ts).isNotNull() & F.col(right_value).isNotNull())
        .groupBy(on, micros(right_ts).alias(us))
        .agg(F.min(F.struct(F.col(right_id).alias("i"), F.col(right_value).alias("v"))).alias("__p"))
        .select(on, us, F.struct(F.col(us).alias("t"), F.col("__p.v").alias("v")).alias("__r"))
        .withColumn("__bin", F.floor(F.col(us) / width))
    )
    ends = rows_right.groupBy(on, "__bin").agg(F.max("__r").alias("last"), F.min("__r").alias("first"))
    visit = F.array(
        F.struct((F.col("__bin") + 1).alias("b"), F.col("last").alias("r")),
        F.struct((F.col("__bin") - 1).alias("b"), F.col("first").alias("r")),
    )
    ghosts = ends.select(on, F.explode(visit).alias("g")).select(
        on, F.col("g.r.t").alias(us), F.col("g.r").alias("__r"), F.col("g.b").alias("__bin")
    )
    rows_left = left.withColumn(us, micros(left_ts)).withColumn("__bin", F.floor(F.col(us) / width)).withColumn("__is_left", F.lit(True))
    both = rows_left.unionByName(rows_right.unionByName(ghosts), allowMissingColumns=True)
    w = Window.partitionBy(on, "__bin").orderBy(us)
    upto = w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    after = w.rangeBetween(Window.currentRow, Window.unboundedFollowing)
    seen = (
        both.withColumn("__a", F.max("__r").over(upto))
        .withColumn("__b", F.min("__r").over(after))
        .where(F.col("__is_left"))
        .withColumn("__ga", F.col(us) - F.col("__a.t"))
        .withColumn("__gb", F.col("__b.t") - F.col(us))
    )
    take_a = F.col("__ga").isNotNull() & (F.col("__gb").isNull() | (F.col("__ga") <= F.col("__gb")))
    gap = F.when(take_a, F.col("__ga")).otherwise(F.col("__gb"))
    value = F.when(take_a, F.col("__a.v")).otherwise(F.col("__b.v"))
    return (
        seen.withColumn("__gap", gap).withColumn("__val", value)
        .where(F.col("__gap") <= width)
        .select(*left.columns, F.col("__val").alias(out_value), (F.col("__gap") / 1e6).alias(out_gap))
    )


def pf_ratio(
    pao2: DataFrame, fio2: DataFrame, on: str, left_ts: str, pao2_value: str, right_ts: str, fio2_value: str,
    right_id: str, tolerance_seconds: int = 3600,
) -> DataFrame:
    """Pairs of each PaO2 with its nearest FiO2 (as a fraction, above 0) and their ratio."""
    fraction = fio2.withColumn(
        fio2_value, F.when(F.col(fio2_value) > 1, F.col(fio2_value) / 100).otherwise(F.col(fio2_value))
    )
    pairs = nearest(pao2, fraction, on, left_ts, right_ts, fio2_value, right_id, tolerance_seconds, "fio2", "gap_seconds")
    return pairs.where(F.col("fio2") > 0).withColumn("ratio", F.col(pao2_value) / F.col("fio2"))


def bin_index(ts: str | Column, cutoff: str | Column, window_hours: int, bin_minutes: int) -> Column:
    """0-based bin of an event in the window that ends at the cut-off; null outside it."""
    start = micros(cutoff) - F.lit(window_hours * US_PER_HOUR)
    b = F.floor((micros(ts) - start) / F.lit(bin_minutes * 60e6)).cast("int")
    return F.when((b >= 0) & (b < window_hours * 60 // bin_minutes), b)


def crosswalk(rows: DataFrame, mapping: DataFrame, via: str, to: str) -> DataFrame:
    """Bring rows keyed by one id to another id through a distinct map."""
    return rows.join(mapping.select(via, to).where(F.col(via).isNotNull() & F.col(to).isNotNull()).distinct(), via, "inner")
