"""Data audits: events after the cut-off, class overlap, zero rates, id coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import flag
from .pairs import unpivot


def future_events(events: DataFrame, cutoffs: DataFrame, on: str, ts: str, cutoff: str) -> DataFrame:
    """Per entity: events at or after its cut-off, and all events."""
    return events.join(cutoffs, on, "inner").groupBy(on).agg(F.count_if(F.col(ts) >= F.col(cutoff)).alias("n_future"), F.count("*").alias("n_events"))


def class_overlap(long: DataFrame, feature: str, value: str, label: str, bins: int = 50) -> DataFrame:
    """Shared area of the two classes' histograms over one common grid per feature.

    The ends have one row per feature and go to the rows, which are not shuffled: a feature holds far too many for one task.
    """
    ends = long.where(F.col(value).isNotNull()).groupBy(feature).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    cell = F.least(F.floor(F.try_divide(F.col(value) - F.col("lo"), width)), F.lit(bins - 1))
    cells = long.where(F.col(value).isNotNull()).join(F.broadcast(ends), feature).groupBy(feature, F.coalesce(cell, F.lit(0)).alias("cell")).agg(
        F.sum(flag(F.col(label) == 1)).alias("p"), F.sum(flag(F.col(label) != 1)).alias("n")
    )
    totals = cells.groupBy(feature).agg(F.sum("p").alias("tp"), F.sum("n").alias("tn"))
    # density * width is the share of the class in the cell
    share = F.least(F.try_divide(F.col("p"), F.col("tp").cast("double")), F.try_divide(F.col("n"), F.col("tn").cast("double")))
    return cells.join(totals, feature).groupBy(feature).agg(F.sum(share).alias("overlap"))


def zero_rate(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    row = df.agg(*[F.avg(F.when(F.col(c) == 0, 1.0).otherwise(0.0)).alias(c) for c in columns])
    return unpivot(row, [], columns, "feature", "zero_rate")


def id_coverage(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """How many distinct ids are in both, only the first, only the second source."""
    sides = a.select(on, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(on, F.lit(0).alias("a"), F.lit(1).alias("b")))
    per_id = sides.groupBy(on).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return per_id.agg(
        F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("n_both"), F.count_if(F.col("b") == 0).alias("n_only_first"),
        F.count_if(F.col("a") == 0).alias("n_only_second"),
    )


def quality_report(df: DataFrame, columns: Sequence[str], label: str, importance: DataFrame | None = None) -> DataFrame:
    """Per feature: overlap, zero rate, importance if known, and the frame's size and positive share."""
    size = df.agg(F.count("*").alias("n"), F.avg(F.col(label).cast("double")).alias("p")).first()  # two numbers
    overlap = class_overlap(unpivot(df, [label], columns), "feature", "value", label)
    out = zero_rate(df, columns).join(overlap, "feature", "left")
    if importance is not None:
        out = out.join(importance.select("feature", "importance"), "feature", "left")
    return out.withColumns({"n_rows": F.lit(size["n"]), "positive_share": F.lit(size["p"])})
