"""Order-dependent operators that never put one key's rows into one task.

A window over a hot key sorts that key in a single task. Here every ordered group is cut into
buckets that follow the order (days of a time axis, slices of a hash, magnitude classes of a
number); bucket totals are aggregated first (map-side combined), turned into offsets on that small
table, and only then is each bucket numbered on its own.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import col, hash_bucket, hash_rank, micros

BUCKET, CELL = "__bucket", "__cell"
#: cells a crowded magnitude bucket is cut into, and borders of evenly filled buckets
CELLS, BORDERS = 1 << 16, 1024


def day_bucket(ts: str | Column) -> Column:
    return F.floor(micros(ts) / F.lit(86_400e6)).cast("int")


def magnitude_bucket(value: str | Column) -> Column:
    """Integer that grows with the number; about 1 % of relative width per bucket."""
    v = col(value)
    # infinities share the end bucket of the largest doubles: no cast can overflow
    size = F.floor(F.log2(F.least(F.abs(v), F.lit(1.7e308))) * 64).cast("int") + 70_000
    return F.when(v == 0, 0).when(v > 0, size).otherwise(-size)


def prefix_sums(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    sums: Mapping[str, Column],
) -> DataFrame:
    """Inclusive running sums along ``order`` inside each key. ``bucket`` must not decrease along it.

    Rows without a key are a group of their own; rows whose bucket is null (no order value) come last.
    """
    keys = list(keys)
    base = df.withColumn(BUCKET, bucket)
    totals = base.groupBy(*keys, BUCKET).agg(*[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy(F.col(BUCKET).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    grid = [*keys, BUCKET]
    offsets = totals.select(
        *[F.col(k).alias(f"__k_{i}") for i, k in enumerate(grid)],
        *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in sums],
    )
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{i}")) for i, k in enumerate(grid)])
    within = Window.partitionBy(*keys, BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return base.join(offsets, same).select(
        *df.columns, *[(F.coalesce(F.sum(c).over(within), F.lit(0)) + F.col(f"__o_{n}")).alias(n) for n, c in sums.items()]
    )


def positions(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], name: str = "rn") -> DataFrame:
    """1-based position of every row in its key; ``order`` must be total for a stable answer."""
    return prefix_sums(df, keys, bucket, order, {name: F.lit(1).cast("long")})


def hash_positions(df: DataFrame, keys: Sequence[str], id_cols: Sequence[str], seed: int, name: str = "rn") -> DataFrame:
    """Random position of every row in its key, the same on every run and cluster."""
    ranked = df.withColumn("__h", hash_rank(*id_cols, seed=seed))
    out = positions(ranked, keys, hash_bucket("__h"), [F.col("__h"), *[F.col(c) for c in id_cols]], name)
    return out.drop("__h")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each key by map-side combined ``min`` of a struct: nothing is sorted or collected."""
    payload = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in df.columns if c not in set(order) | set(keys)])
    best = df.groupBy(*keys).agg(F.min(payload).alias("__r"))
    return best.select(*[F.col(c) if c in keys else F.col(f"__r.{c}").alias(c) for c in df.columns])


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    payload = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in df.columns if c not in set(order) | set(keys)])
    best = df.groupBy(*keys).agg(F.max(payload).alias("__r"))
    return best.select(*[F.col(c) if c in keys else F.col(f"__r.{c}").alias(c) for c in df.columns])


def top_n_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str = "rn") -> DataFrame:
    """First n rows of each key. Spark trims every map task to n rows per key before the exchange."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)


def grouped_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], weight: str | None = None, few_keys: bool = False
) -> DataFrame:
    """Exact, linearly interpolated quantiles per key, also for keys that hold most of the rows.

    A first pass counts rows per magnitude bucket (map-side combined, a few hundred buckets per key)
    and so learns which buckets hold the wanted ranks. Only rows of those buckets are read further;
    equal values are counted before anything is ordered. A bucket is then cut into ``CELLS`` cells between its own
    least and largest value, and only the cells that hold a wanted rank are ordered, so values crowded
    into one bucket are spread as well. Null keys are a key of their own; null values and NaN count for nothing.

    ``few_keys`` says that the keys are names of features: the wanted buckets, a few per key, then go to the
    rows, so that no task gets all rows of one feature's bucket.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(
        *keys,
        F.col(value).cast("double").alias("__v"),
        (F.col(weight) if weight else F.lit(1)).cast("long").alias("__w"),
        magnitude_bucket(F.col(value).cast("double")).alias(BUCKET),
    )
    wk = Window.partitionBy(*keys)
    before = wk.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    finite = F.when(F.abs("__v") < float("inf"), F.col("__v"))
    shelves = (
        rows.groupBy(*keys, BUCKET)
        .agg(F.sum("__w").alias("__nb"), F.min(finite).alias("__least"), F.max(finite).alias("__most"))
        .withColumn("__start", F.coalesce(F.sum("__nb").over(before), F.lit(0)))
        .withColumn("__total", F.sum("__nb").over(wk))
    )
    ranks = {}
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("__total") - 1)
        ranks[name] = (pos, F.floor(pos), F.ceil(pos))

    def holds(rank: Column, start: Column, size: Column) -> Column:
        return (rank >= start) & (rank < start + size)

    def wanted(start: str, size: str) -> Column:
        return reduce(lambda a, b: a | b, [holds(r, F.col(start), F.col(size)) for _, lo, hi in ranks.values() for r in (lo, hi)])

    grid = [*keys, BUCKET]
    # halves, since the difference of two doubles may overflow
    share = (F.col("__v") / 2 - F.col("__least") / 2) / (F.col("__most") / 2 - F.col("__least") / 2)
    cell = F.when(F.col("__v") == float("inf"), CELLS).when(F.col("__v") == float("-inf"), -1).when(F.col("__most") > F.col("__least"), F.least(F.floor(share * CELLS).cast("int"), F.lit(CELLS - 1)))
    values = (
        _matched(rows, shelves.where(wanted("__start", "__nb")).drop("__nb"), grid, few_keys)
        .groupBy(*grid, "__start", "__total", "__least", "__most", "__v")
        .agg(F.sum("__w").alias("__n"))
        .withColumn(CELL, F.coalesce(cell, F.lit(0)))
    )
    along = Window.partitionBy(*grid).orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)
    cells = (
        values.groupBy(*grid, "__start", "__total", CELL).agg(F.sum("__n").alias("__nc"))
        .withColumn("__at", F.col("__start") + F.coalesce(F.sum("__nc").over(along), F.lit(0)))
        .where(wanted("__at", "__nc"))
    )
    inside = Window.partitionBy(*grid, CELL).orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    placed = _matched(values.select(*grid, CELL, "__v", "__n"), cells.drop("__nc", "__start"), [*grid, CELL], few_keys).withColumn(
        "__s", F.col("__at") + F.coalesce(F.sum("__n").over(inside), F.lit(0))
    )
    aggs = [F.max("__total").alias("__total")]
    for name, (_, lo, hi) in ranks.items():
        aggs += [
            F.max(F.when(holds(lo, F.col("__s"), F.col("__n")), F.col("__v"))).alias(f"__lo_{name}"),
            F.max(F.when(holds(hi, F.col("__s"), F.col("__n")), F.col("__v"))).alias(f"__hi_{name}"),
        ]
    found = placed.groupBy(*keys).agg(*aggs)
    return found.select(
        *keys,
        *[
            F.when(F.col(f"__lo_{name}") == F.col(f"__hi_{name}"), F.col(f"__lo_{name}"))
            .otherwise(F.col(f"__lo_{name}") + (F.col(f"__hi_{name}") - F.col(f"__lo_{name}")) * (pos - lo)).alias(name)
            for name, (pos, lo, _) in ranks.items()
        ],
    )


def _matched(df: DataFrame, table: DataFrame, on: Sequence[str], small: bool = False) -> DataFrame:
    """Inner join on columns of one name, null matching null; a ``small`` table is sent to the rows."""
    renamed = table.select(*[F.col(c).alias(f"__m_{i}") for i, c in enumerate(on)], *[c for c in table.columns if c not in on])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__m_{i}")) for i, c in enumerate(on)])
    return df.join(F.broadcast(renamed) if small else renamed, same).drop(*[f"__m_{i}" for i in range(len(on))])


def border_bucket(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """``df`` with a bucket that grows with ``value``; the buckets of a key hold about equally many rows.

    Borders are approximate percentiles per key (a mergeable sketch), at most ``BORDERS`` numbers; where exactly they lie
    does not matter for what is summed along the buckets.
    """
    keys = list(keys)
    shares = [i / BORDERS for i in range(1, BORDERS)]
    borders = df.groupBy(*keys).agg(F.percentile_approx(F.col(value).cast("double"), shares, 4 * BORDERS).alias("__borders"))
    # one row per key; without keys one value
    joined = _matched(df, borders, keys) if keys else df.withColumn("__borders", borders.scalar())
    v, step = F.col(value).cast("double"), 32
    rough = F.size(F.filter(F.expr(f"transform(sequence({step}, {BORDERS - 1}, {step}), i -> __borders[i - 1])"), lambda b: b <= v)) * step
    fine = F.size(F.filter(F.slice("__borders", rough + 1, F.lit(step)), lambda b: b <= v))
    return joined.withColumn(name, rough + fine).drop("__borders")


def ordered_texts(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str], text: str) -> DataFrame:
    """Long form of a joined text: one row per note with its place in the key. No key is gathered."""
    return positions(df, keys, bucket, [F.col(c) for c in order], "pos").select(*keys, "pos", text)


def joined_texts(long: DataFrame, keys: Sequence[str], text: str, sep: str) -> DataFrame:
    """One row per key: its notes joined in order. The text of a key becomes one value, so it must fit one."""
    notes = F.array_sort(F.collect_list(F.struct("pos", F.col(text).alias("x"))))
    gathered = long.groupBy(*keys).agg(notes.alias("__l"), F.count("*").alias("n_notes"))
    return gathered.select(*keys, "n_notes", F.array_join(F.transform("__l", lambda r: r["x"]), sep).alias(text))
