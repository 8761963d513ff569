"""Exact, repeatable sampling and class weights.

Random order is a hash of the id and a seed, so a row keeps its draw on every cluster. Positions in
a class come from hash slices, never from one sort of the whole class; splits and samples need only the
hash at which a class is cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import clip, flag, hash_rank
from .aggregates import class_distribution
from .ordered import grouped_quantiles, hash_positions


def class_sizes(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("__n"))


def _first_by_hash(df: DataFrame, id_col: str, label: str, seed: int, take: Column, name: str) -> DataFrame:
    """``df`` with ``name``: whether a row is among the first ``take`` of its class in hash order (a column over the class size ``__n``).

    Counts per hash slice tell in which slice the cut of a class falls; only ids of that slice are ranked. Rows then compare their
    hash with the cut of their class, one row per class, so no row of ``df`` is shuffled. Rows that share an id are drawn together.
    """
    draw = hash_rank(id_col, seed=seed)
    light = df.select(F.col(label).alias("__class"), F.col(id_col).alias("__id"), draw.alias("__h"), F.substring(draw, 1, 4).alias("__slice"))
    w = Window.partitionBy("__class")
    slices = light.groupBy("__class", "__slice").agg(F.count("*").alias("__k"))
    slices = slices.select(
        "__class", "__slice", "__k", F.sum("__k").over(w).alias("__n"),
        F.coalesce(F.sum("__k").over(w.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
    )
    cut = slices.withColumn("__take", F.least(take, F.col("__n"))).where("__before < __take and __take <= __before + __k")
    cut = cut.select(F.col("__class").alias("__c"), F.col("__slice").alias("__s"), (F.col("__take") - F.col("__before")).alias("__need"))
    few = light.join(F.broadcast(cut), F.col("__class").eqNullSafe(F.col("__c")) & (F.col("__slice") == F.col("__s")))
    rank = F.row_number().over(Window.partitionBy("__class", "__slice").orderBy("__h", "__id"))
    last = few.withColumn("__rn", rank).where("__rn = __need").select(F.col("__class").alias("__of"), F.struct("__h", "__id").alias("__cut"))
    out = df.withColumn("__draw", F.struct(draw.alias("__h"), F.col(id_col).alias("__id"))).join(F.broadcast(last), F.col(label).eqNullSafe(F.col("__of")), "left")
    return out.select(*df.columns, F.coalesce(F.col("__draw") <= F.col("__cut"), F.lit(False)).alias(name))


def stratified_split(df: DataFrame, id_col: str, label: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``is_test``: exactly floor(share x n) rows of every class; rows without label are one class."""
    out = _first_by_hash(df, id_col, label, seed, F.floor(F.col("__n") * F.lit(test_share)), "__in")
    return out.select(*df.columns, flag(F.col("__in")).alias("is_test"))


def stratified_kfold(df: DataFrame, id_col: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Adds ``fold`` 0..k-1 with class counts that differ by at most one."""
    ranked = hash_positions(df, [label], [id_col], seed)
    return ranked.select(*df.columns, ((F.col("rn") - 1) % k).cast("int").alias("fold"))


def _sizes(df: DataFrame, label: str, minority: int) -> tuple[int, int]:
    counts = {r[label]: r["__n"] for r in class_sizes(df, label).collect()}  # one row per class
    return counts.get(minority, 0), sum(n for c, n in counts.items() if c != minority)


def undersample(df: DataFrame, id_col: str, label: str, ratio: float, seed: int = 42, minority: int = 1) -> DataFrame:
    """All minority rows and exactly floor(minority / ratio) of the rest."""
    n_min, n_maj = _sizes(df, label, minority)
    keep = min(n_maj, int(n_min / ratio + 1e-9))
    return _first_by_hash(df, id_col, label, seed, F.lit(keep), "__in").where((F.col(label) == minority) | F.col("__in")).select(*df.columns)


def oversample(df: DataFrame, id_col: str, label: str, seed: int = 42, minority: int = 1) -> DataFrame:
    """Repeat minority rows up to parity; ``copy`` numbers the repetitions."""
    n_min, n_maj = _sizes(df, label, minority)
    base, extra = divmod(max(n_maj, n_min), n_min) if n_min else (1, 0)
    drawn = _first_by_hash(df, id_col, label, seed, F.lit(extra), "__in")
    copies = F.when(F.col(label) == minority, F.lit(base) + flag(F.col("__in"))).otherwise(1)
    return drawn.select(*df.columns, F.explode(F.sequence(F.lit(1), copies)).alias("copy"))


def class_weights(df: DataFrame, label: str, strategy: str = "balanced", beta: float = 0.9999) -> DataFrame:
    """(label, n, weight) for balanced, sqrt_balanced, inverse_freq or effective_num."""
    w = Window.partitionBy(F.lit(1))  # as many rows as classes
    c = class_distribution(df, label)
    n, total, classes = F.col("n").cast("double"), F.sum("n").over(w).cast("double"), F.count("*").over(w).cast("double")
    balanced = total / (classes * n)
    raw = {
        "balanced": balanced,
        "sqrt_balanced": F.sqrt(balanced),
        "inverse_freq": total / n,
        "effective_num": (1.0 - beta) / (1.0 - F.pow(F.lit(beta), n)),
    }[strategy]
    c = c.withColumn("weight", raw).withColumn("__classes", classes)
    if strategy in ("inverse_freq", "effective_num"):
        c = c.withColumn("weight", F.col("weight") / F.sum("weight").over(w) * F.col("__classes"))
    return c.select(label, "n", "weight")


def false_negative_cost(imbalance: Column, mode: str | float = "auto", severity: float = 1.0) -> Column:
    if mode == "auto":
        return clip(F.ln(imbalance + 1) * severity, 1.5, 10.0)
    if mode == "clinical":
        return F.lit(5.0 * severity)
    return F.lit(float(mode))


def cost_weights(df: DataFrame, label: str, mode: str | float = "auto", severity: float = 1.0, strategy: str | None = "balanced") -> DataFrame:
    """Adds ``weight``: cost of the class times class weight, divided by the overall mean.

    All of it is a function of the class, so the mean needs only the class table.
    """
    w = Window.partitionBy(F.lit(1))  # as many rows as classes
    table = class_weights(df, label, strategy) if strategy else class_distribution(df, label).select(label, "n", F.lit(1.0).alias("weight"))
    imbalance = F.max("n").over(w) / F.min("n").over(w)
    combined = F.when(F.col(label) == 1, false_negative_cost(imbalance, mode, severity)).otherwise(1.0) * F.col("weight")
    table = table.withColumn("__c", combined)
    mean = F.sum(F.col("__c") * F.col("n")).over(w) / F.sum("n").over(w)
    table = table.select(label, (F.col("__c") / mean).alias("weight"))
    return df.join(F.broadcast(table), label)


def cv_weights(df: DataFrame, label: str, beta: float = 0.9999, boost: float = 1.44, severity: float = 1.5) -> DataFrame:
    """Adds ``weight`` = effective-number weight x 1.44, positives also x the imbalance cost."""
    n_pos, n_neg = _sizes(df, label, 1)
    eff = lambda n: F.lit((1 - beta**n) / (1 - beta))
    total = eff(n_pos) + eff(n_neg)
    cost = F.ln(F.lit(n_neg / max(n_pos, 1)) + 1) * severity
    w1, w0 = total / (2 * eff(n_pos)) * cost * boost, total / (2 * eff(n_neg)) * boost
    return df.withColumn("weight", F.when(F.col(label) == 1, w1).otherwise(w0))


def impute_encode(train: DataFrame, df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Train medians for numbers; codes in alphabetical order for categories, null as MISSING, unseen as -1."""
    from .pairs import unpivot

    medians = {}
    if numeric:
        # One number per column comes back to the driver.
        medians = {r["feature"]: r["m"] for r in grouped_quantiles(unpivot(train, [], numeric), ["feature"], "value", {"m": 0.5}, few_keys=True).collect()}
    out = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(medians.get(c))) for c in numeric})
    for c in categorical:
        values = train.select(F.coalesce(F.col(c).cast("string"), F.lit("MISSING")).alias("__v")).distinct()
        codes = values.withColumn("__code", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("__v")) - 1)
        out = out.withColumn("__v", F.coalesce(F.col(c).cast("string"), F.lit("MISSING"))).join(codes, "__v", "left")
        out = out.withColumn(c, F.coalesce("__code", F.lit(-1))).drop("__v", "__code")
    return out
