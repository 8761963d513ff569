"""Scalar column expressions used across operators."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

US_PER_HOUR = 3_600_000_000


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once per row, also inside functions on arrays, where Spark shares nothing."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970 as a long; the session runs in UTC, so zone-less time is safe."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), col(ts))


def hours_between(later: str | Column, earlier: str | Column) -> Column:
    return F.timestamp_diff("MICROSECOND", col(earlier), col(later)) / F.lit(float(US_PER_HOUR))


def days_between(later: str | Column, earlier: str | Column) -> Column:
    return hours_between(later, earlier) / F.lit(24.0)


def safe_div(a: str | Column, b: str | Column) -> Column:
    """a / b, 0 where b is 0."""
    a, b = col(a).cast("double"), col(b).cast("double")
    return F.when(b == 0, F.lit(0.0)).otherwise(F.try_divide(a, b))


def clip(c: str | Column, lo: float, hi: float) -> Column:
    """Clamp to [lo, hi]; null stays null (greatest/least would skip it)."""
    c = col(c)
    return F.when(c.isNotNull(), F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), c)))


def rounded(c: str | Column, digits: int) -> Column:
    """``F.round`` of a double, with the same results.

    ``F.round`` writes every double out in decimal. Below a million, the nearest whole number of steps is known from one product, but for values so
    close to the middle of two steps that the product's error (at most 0.00023 steps) could matter; these and all others are left to ``F.round``.
    """
    if not 0 <= digits <= 6:
        return F.round(c, digits)
    x, scale = col(c), F.lit(float(10**digits))
    steps = x * scale
    sure = (F.abs(x) < F.lit(1e6)) & (F.abs(steps - F.floor(steps) - F.lit(0.5)) > F.lit(0.001))
    return F.when(sure, F.floor(steps + F.lit(0.5)) / scale).otherwise(F.round(x, digits))


def flag(cond: Column) -> Column:
    """0/1 integer of a condition; unknown counts as 0."""
    return F.when(cond, 1).otherwise(0)


def total(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def to_number(c: str | Column) -> Column:
    return col(c).try_cast("double")


def to_time(c: str | Column) -> Column:
    return col(c).try_cast("timestamp_ntz")


def blank_to_null(c: str | Column) -> Column:
    c = col(c)
    return F.when(F.trim(c) != "", c)


def substring_count(text: str | Column, word: str) -> Column:
    """Non-overlapping occurrences of a fixed string."""
    text = col(text)
    gone = F.replace(text, F.lit(word), F.lit(""))
    return F.floor((F.length(text) - F.length(gone)) / len(word)).cast("int")


def hash_rank(*parts: str | Column, seed: int = 42) -> Column:
    """Uniform hexadecimal draw per row that does not depend on partitioning."""
    return F.md5(F.concat_ws("|", *[col(p).cast("string") for p in parts], F.lit(str(seed))))


def hash_bucket(hex_rank: str | Column) -> Column:
    """First three hex digits: 4096 equal slices in rank order."""
    return F.substring(col(hex_rank), 1, 3)


def sql_regex(pattern: str) -> str:
    """Unicode-aware, case-insensitive Java form of a pattern written for Unicode word classes."""
    return "(?iU)" + pattern


def vector_md5(c: str | Column) -> Column:
    """Digest of a whole vector, cut to four digits."""
    return F.md5(F.array_join(F.transform(col(c), lambda x: F.floor(x.cast("double") * 10000).cast("long").cast("string")), ","))


def vector_md5_sql(c: str) -> str:
    """The same in ANSI SQL."""
    return f"md5(array_to_string([CAST(floor(CAST(x AS DOUBLE) * 10000) AS BIGINT) FOR x IN {c}], ','))"
