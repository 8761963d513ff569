"""Group aggregates on admissions and notes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.exprs import flag, hours_between, substring_count
from .ordered import grouped_quantiles


def active_distinct(active: DataFrame, key: str, what: str) -> DataFrame:
    """Distinct active items per key and an on/off flag."""
    return active.groupBy(key).agg(F.count_distinct(what).alias("n_active")).withColumn("on_any", F.lit(1))


def positives(events: DataFrame, cutoffs: DataFrame, key: str, ts: str, cutoff: str, hours: float = 48) -> DataFrame:
    """All positives of a key with a known cut-off and those in the last hours before it."""
    gap = hours_between(cutoff, ts)
    rows = events.join(cutoffs, key, "inner").where(F.col(cutoff).isNotNull())
    return rows.groupBy(key).agg(F.count("*").alias("n_total"), F.count_if((gap >= 0) & (gap <= hours)).alias("n_recent"))


def ward_hours(transfers: DataFrame, key: str, unit: str, start: str, end: str, icu_units: Sequence[str] = fixed.ICU_UNITS) -> DataFrame:
    """Hours outside intensive care and number of transfers; an unknown unit is not intensive care."""
    is_icu = F.coalesce(F.col(unit).rlike("|".join(icu_units)), F.lit(False))
    return transfers.groupBy(key).agg(
        F.sum(F.when(~is_icu, hours_between(end, start)).otherwise(0.0)).alias("ward_hours"), F.count("*").alias("n_transfers")
    )


def impute_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact median per column for its null cells."""
    from .pairs import unpivot

    med = grouped_quantiles(unpivot(df, [], columns), ["feature"], "value", {"m": 0.5}, few_keys=True)
    # One number per column of the frame comes back to the driver.
    values = {r["feature"]: r["m"] for r in med.collect()}
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(values.get(c))) for c in columns})


def iqr_bounds(long: DataFrame, feature: str, value: str) -> DataFrame:
    q = grouped_quantiles(long, [feature], value, {"q1": 0.25, "q3": 0.75}, few_keys=True)
    iqr = F.col("q3") - F.col("q1")
    return q.select(feature, "q1", "q3", (F.col("q1") - 1.5 * iqr).alias("lo"), (F.col("q3") + 1.5 * iqr).alias("hi"))


def concept_frequency(rows: DataFrame, patient: str, concept: str, min_share: float = 0.0) -> DataFrame:
    """Share of all patients that have each concept."""
    pairs = rows.select(patient, concept).distinct()
    n_all = rows.agg(F.count_distinct(patient).alias("n")).first()["n"]
    freq = pairs.groupBy(concept).agg(F.count("*").alias("n_patients"))
    return freq.withColumn("share", F.col("n_patients") / F.lit(float(max(n_all, 1)))).where(F.col("share") >= min_share)


def pivot_counts(rows: DataFrame, key: str, column: str, values: Sequence[str], binary: bool = False) -> DataFrame:
    """Counts (or 0/1) per listed value, one row per key."""
    n = [F.count_if(F.col(column) == v) for v in values]
    return rows.groupBy(key).agg(*[(F.least(c, F.lit(1)) if binary else c).cast("long").alias(v) for c, v in zip(n, values)])


def majority_value(rows: DataFrame, text: str, code: str, name: str, score: str) -> DataFrame:
    """Most frequent (code, name) per text, smallest pair on ties, and the mean score of that code."""
    known = rows.where(F.col(code).isNotNull())
    counts = known.groupBy(text, code, name).agg(F.count("*").alias("n"))
    best = counts.groupBy(text).agg(F.min(F.struct((-F.col("n")).alias("rank"), F.col(code), F.col(name))).alias("b"))
    means = known.groupBy(text, code).agg(F.avg(score).alias("mean_score"))
    picked = best.select(text, F.col(f"b.{code}").alias(code), F.col(f"b.{name}").alias(name))
    return picked.join(means, [text, code])


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    from pyspark.sql import Window

    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    w = Window.partitionBy(F.lit(1))  # as many rows as classes
    return counts.select(
        label, "n", (F.col("n") / F.sum("n").over(w)).alias("share"), (F.max("n").over(w) / F.min("n").over(w)).alias("imbalance")
    )


def keyword_counts(notes: DataFrame, key: str, text: str, keywords: Sequence[str]) -> DataFrame:
    """Words and substring counts per key, summed over its notes, and counts per word."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    trimmed = F.trim(F.regexp_replace(low, r"\s+", " "))
    words = F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, " ")))
    out = notes.groupBy(key).agg(
        F.sum(words).alias("n_words"), *[F.sum(substring_count(low, k)).alias(f"kw_{k}") for k in keywords]
    )
    return out.withColumns({f"kw_{k}_norm": F.col(f"kw_{k}") / (F.col("n_words") + F.lit(1e-9)) for k in keywords})


def scale_by_max(df: DataFrame, column: str, limit: float = 1.0, factor: float = 100.0) -> DataFrame:
    """Multiply the column when its overall maximum shows it is a fraction (one number visits the driver)."""
    top = df.agg(F.max(column).alias("m")).first()["m"]
    return df.withColumn(column, F.col(column) * F.lit(factor if top is not None and top <= limit else 1.0))
