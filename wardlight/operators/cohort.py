"""Row rules of cohort building and feature frames: coercion, eligibility, flags, schema alignment."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..functions.exprs import col, days_between, flag, hours_between, to_number, to_time, total

AGGREGATES = ("Min", "Max", "Avg", "Std", "Median")
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def coerce_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: to_number(c) for c in cols})


def coerce_timestamp(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: to_time(c) for c in cols})


def standardize_ids(df: DataFrame, exact_ids: bool = False, ids: Sequence[str] = ("subject_id", "hadm_id", "icustay_id")) -> DataFrame:
    """Upper-case id columns. Without ``exact_ids`` any name containing "id" counts."""
    hit = (lambda c: c.lower() in ids) if exact_ids else (lambda c: "id" in c.lower())
    return df.toDF(*[c.upper() if hit(c) else c for c in df.columns])


def normalize_gender(c: str | Column) -> Column:
    low = F.lower(col(c))
    return F.when(low.isin("male", "m"), "M").when(low.isin("female", "f"), "F").otherwise(col(c))


def encode_gender(c: str | Column) -> Column:
    return flag(col(c) == "M")


def age_years(admit: str | Column, birth: str | Column) -> Column:
    return days_between(admit, birth) / F.lit(365.25)


def is_adult(admit: str | Column, birth: str | Column, at_least: int = 18) -> Column:
    """The age is rounded to whole years first, so 17.5 passes."""
    return F.round(age_years(admit, birth), 0) >= at_least


def length_of_stay(admit: str | Column, discharge: str | Column, icu_in: str | Column, icu_out: str | Column, icu_hours: Column | None = None):
    hospital = days_between(discharge, admit)
    icu = icu_hours / F.lit(24.0) if icu_hours is not None else days_between(icu_out, icu_in)
    return hospital, icu


def icu_at_least(icu_in: str | Column, icu_out: str | Column, hours: float = 24) -> Column:
    return hours_between(icu_out, icu_in) >= hours


def survived_stay(death: str | Column, start: str | Column, end: str | Column) -> Column:
    return col(death).isNull() | ~col(death).between(col(start), col(end))


def measured_flags(df: DataFrame, roots: Sequence[str]) -> DataFrame:
    """``{root}_measured`` = 1 when any aggregate of the root is known, 0 also without such columns."""

    def known(root: str) -> Column:
        have = [F.col(f"{root}_{a}") for a in AGGREGATES if f"{root}_{a}" in df.columns]
        return flag(F.coalesce(*[c.cast("string") for c in have]).isNotNull()) if have else F.lit(0)

    return df.withColumns({f"{r}_measured": known(r) for r in roots})


def measured_flags_prefix(df: DataFrame, roots: Sequence[str]) -> DataFrame:
    """Variant that accepts any column starting with the root, whatever its case."""

    def known(root: str) -> Column:
        have = [F.col(c) for c in df.columns if c.lower().startswith(root.lower()) and not c.lower().endswith("_measured")]
        return flag(F.coalesce(*[c.cast("string") for c in have]).isNotNull()) if have else F.lit(0)

    return df.withColumns({f"{r}_measured": known(r) for r in roots})


def select_variables(df: DataFrame, flags: Sequence[str], min_share: float = 0.8) -> list[str]:
    """Flags set in at least ``min_share`` of the rows (one aggregated row comes back to the driver)."""
    shares = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in flags]).first()
    return [c for c in flags if shares[c] is not None and shares[c] >= min_share]


def variable_shares(df: DataFrame, flags: Sequence[str], min_share: float = 0.8) -> DataFrame:
    row = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in flags])
    pairs = row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("share")) for c in flags])).alias("p"))
    return pairs.select("p.variable", "p.share", flag(F.col("p.share") >= min_share).alias("kept"))


def missing_variables(df: DataFrame, roots: Sequence[str]) -> Column:
    """How many variables have no known aggregate in a row."""
    parts = []
    for r in roots:
        have = [F.col(f"{r}_{a}") for a in AGGREGATES if f"{r}_{a}" in df.columns]
        parts.append(flag(F.coalesce(*[c.cast("string") for c in have]).isNull()) if have else F.lit(1))
    return total(parts)


def filter_missing_third(df: DataFrame, roots: Sequence[str]) -> DataFrame:
    return df.where(missing_variables(df, roots) <= F.lit(len(roots) / 3))


def remove_set(df: DataFrame, stay: str, age: str, prior: str, flags: Sequence[str]) -> DataFrame:
    """Stays to take out: minors, earlier readmissions, or more than a third of the flags unmeasured."""

    def unmeasured(c: str) -> Column:
        text = F.lower(F.trim(F.col(c).cast("string")))
        return flag(F.col(c).isNull() | text.isin("", "0", "0.0", "false"))

    too_few = total([unmeasured(c) for c in flags]) > F.lit(len(flags) / 3)
    young = F.coalesce(F.col(age) < 18, F.lit(False))
    again = F.coalesce(F.col(prior) > 0, F.lit(False))
    return df.where(young | again | too_few).select(stay).distinct()


def apply_remove_set(tables: dict[str, DataFrame], remove: DataFrame, stay: str) -> dict[str, DataFrame]:
    return {name: df.join(remove, stay, "left_anti") for name, df in tables.items()}


def drop_leakage(df: DataFrame, named: Sequence[str] = fixed.LEAKING_COLUMNS, parts: Sequence[str] = fixed.LEAKING_PARTS) -> DataFrame:
    bad = [c for c in df.columns if c in named or any(p in c.lower() for p in parts)]
    return df.drop(*bad)


def drop_id_and_time(df: DataFrame, ids: Sequence[str], label: str | None = None) -> DataFrame:
    bad = [c for c in df.columns if c in ids or c == label or "Time" in c or "ChartTime" in c]
    return df.drop(*bad)


def split_modalities(columns: Sequence[str], signatures: Sequence[str] = fixed.TEXT_SIGNATURES) -> tuple[list[str], list[str]]:
    """(text columns, clinical columns)."""
    text = [c for c in columns if any(s in c.lower() for s in signatures)]
    return text, [c for c in columns if c not in text]


def feature_kinds(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(feature, n_distinct, kind): continuous for numeric columns, binary where exactly two values occur.

    Up to three different values are tracked by min, max and "strictly between": enough to tell two
    apart, without a distinct shuffle (only one row of extremes visits the driver). Non-numeric columns with other counts are ``other``.
    """
    cols = list(columns or df.columns)
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)}
    ends = df.agg(*[f(c).alias(f"{c}|{n}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))]).first()
    inner = df.agg(
        *[
            F.max(flag((F.col(c) != F.lit(ends[f"{c}|lo"])) & (F.col(c) != F.lit(ends[f"{c}|hi"])))).alias(f"{c}|in")
            for c in cols
        ]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.when(F.lit(ends[f"{c}|lo"] != ends[f"{c}|hi"]) & (F.col(f"{c}|in") == 0), "binary")
                .otherwise("continuous" if c in numeric else "other").alias("kind"),
            )
            for c in cols
        ]
    )
    return inner.select(F.explode(rows).alias("r")).select("r.*")


def fill_constant(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """Constant per column for null (and NaN) cells."""
    return df.fillna(values)


def align_to_schema(df: DataFrame, features: Sequence[str], default: float | None = 0.0) -> DataFrame:
    """Exactly the listed columns in order: missing ones are added, others dropped."""
    filler = F.lit(default).cast("double")
    return df.select(*[F.col(c) if c in df.columns else filler.alias(c) for c in features])


def dedupe_columns(columns: Sequence[str], suffix: str = "_engineered") -> list[str]:
    """Unique names: a repeated name gets the suffix, further repeats a number."""
    out: list[str] = []
    for c in columns:
        name, k = c, 1
        while name in out:
            name = f"{c}{suffix}" if k == 1 else f"{c}{suffix}{k}"
            k += 1
        out.append(name)
    return out


def filter_notes(
    df: DataFrame, category: str, text: str, error: str | None = None, categories: Sequence[str] | None = None, prefix: str | None = None
) -> DataFrame:
    """Notes of the wanted categories (trimmed) or of a category prefix, with text, not marked as errors."""
    wanted: list[Column] = []
    if categories:
        wanted.append(F.trim(F.col(category)).isin([c.strip() for c in categories]))
    if prefix:
        wanted.append(F.col(category).startswith(prefix))
    keep = reduce(lambda a, b: a | b, wanted) if wanted else F.lit(True)
    keep = keep & F.col(text).isNotNull() & (F.col(text) != "")
    if error:
        keep = keep & F.coalesce(F.trim(F.col(error).cast("string")), F.lit("")).isin("", "0")
    return df.where(keep)


def find_column(columns: Sequence[str], patterns: Sequence[str]) -> str | None:
    """First column holding a pattern together with ``_Mean``, else first holding a pattern."""
    for need in ("_Mean", ""):
        for p in patterns:
            for c in columns:
                if p.lower() in c.lower() and need in c:
                    return c
    return None


def join_feature_sets(base: DataFrame, others: Sequence[DataFrame], on: str, fill: float | None = 0.0, labels: Sequence[str] = ("Y", "LABEL")) -> DataFrame:
    """Inner join with the frames that carry a label, left join with the rest; then fill."""
    def add(left: DataFrame, right: DataFrame) -> DataFrame:
        repeated = [c for c in right.columns if c in left.columns and c != on]
        how = "inner" if any(c in right.columns for c in labels) else "left"
        return left.join(right.drop(*repeated), on, how)

    out = reduce(add, others, base)
    return out if fill is None else out.fillna(fill)


def join_with_suffix(left: DataFrame, right: DataFrame, on: str, suffix: str = "_feat", how: str = "left") -> DataFrame:
    """Join keeping both versions of an overlapping column; the right one gets the suffix."""
    renamed = right.select(*[F.col(c).alias(c + suffix) if c in left.columns and c != on else F.col(c) for c in right.columns])
    return left.join(renamed, on, how)


def add_absent(labels: DataFrame, matrix: DataFrame, on: str) -> DataFrame:
    """Every labelled id gets a row; ids without features are all zero."""
    return labels.select(on).join(matrix, on, "left").fillna(0)
