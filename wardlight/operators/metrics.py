"""Evaluation of scores in [0, 1] against 0/1 labels.

Equal scores are counted first; what runs in order afterwards is one row per distinct score, cut at sampled
borders into slices of about equally many, so that no task orders them all however crowded they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import flag
from .ordered import border_bucket, prefix_sums


def confusion(df: DataFrame, label: str, score: str, threshold: float | Column, keys: Sequence[str] = ()) -> DataFrame:
    hit, y = F.col(score) >= threshold, F.col(label) == 1
    return df.groupBy(*keys).agg(
        F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn"), F.count_if(~hit & ~y).alias("tn")
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    return _ratio(tp, tp + fp), _ratio(tp, tp + fn), _ratio(2 * tp, 2 * tp + fp + fn)


def class_metrics(cm: DataFrame) -> DataFrame:
    """Per-class, macro and weighted precision, recall and F1, accuracy and balanced accuracy from counts."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    p1, r1, f1 = prf(tp, fp, fn)
    p0, r0, f0 = prf(tn, fn, fp)
    n1, n0 = tp + fn, tn + fp
    mean = lambda a, b: (a + b) / 2
    by_size = lambda a, b: _ratio(a * n0 + b * n1, n0 + n1)
    return cm.select(
        *[c for c in cm.columns if c not in ("tp", "fp", "fn", "tn")],
        p0.alias("precision_0"), r0.alias("recall_0"), f0.alias("f1_0"), p1.alias("precision_1"), r1.alias("recall_1"), f1.alias("f1_1"),
        mean(p0, p1).alias("macro_precision"), mean(r0, r1).alias("macro_recall"), mean(f0, f1).alias("macro_f1"),
        by_size(p0, p1).alias("weighted_precision"), by_size(r0, r1).alias("weighted_recall"), by_size(f0, f1).alias("weighted_f1"),
        _ratio(tp + tn, n0 + n1).alias("accuracy"), mean(r0, r1).alias("balanced_accuracy"),
    )


def score_steps(df: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """One row per distinct score: positives, negatives, and both counted from the top (inclusive)."""
    groups = df.where(F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("threshold")).agg(
        F.sum(flag(F.col(label) == 1)).alias("pos"), F.sum(flag(F.col(label) != 1)).alias("neg")
    )
    cut = border_bucket(groups, keys, "threshold", "__slice")
    return prefix_sums(cut, keys, -F.col("__slice"), [F.desc("threshold")], {"tp": F.col("pos"), "fp": F.col("neg")}).drop("__slice")


def _totals(steps: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return steps.groupBy(*keys).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))


def _with_totals(steps: DataFrame) -> DataFrame:
    t = _totals(steps).first()  # two numbers
    return steps.withColumns({"p": F.lit(t["p"] or 0), "n": F.lit(t["n"] or 0)})


def pr_curve(df: DataFrame, label: str, score: str, end_point: bool = True) -> DataFrame:
    """(threshold, precision, recall) at every distinct score, and the closing point (1, 0)."""
    s = _with_totals(score_steps(df, label, score))
    curve = s.select("threshold", _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), _ratio(F.col("tp"), F.col("p")).alias("recall"))
    if end_point:
        last = df.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
        curve = curve.unionByName(last)
    return curve


def auroc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties counted half."""
    s = score_steps(df, label, score)
    above = F.col("tp") - F.col("pos")
    won = F.sum(F.col("neg") * (above + F.col("pos") / 2))
    return s.agg(F.try_divide(won, (F.sum("pos") * F.sum("neg")).cast("double")).alias("auroc"))


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    """Sum of recall gains times precision; the gain at a score is its own positives."""
    s = score_steps(df, label, score)
    gain = F.col("pos") * _ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    return s.agg(F.try_divide(F.sum(gain), F.sum("pos").cast("double")).alias("average_precision"))


def with_f1(curve: DataFrame) -> DataFrame:
    p, r = F.col("precision"), F.col("recall")
    return curve.withColumn("f1", 2 * p * r / (p + r + F.lit(1e-10)))


def best_f1_threshold(df: DataFrame, label: str, score: str) -> DataFrame:
    """Curve point with the best F1, the smallest threshold on ties."""
    c = with_f1(pr_curve(df, label, score, end_point=False))
    best = F.max(F.struct(F.round("f1", 12).alias("r"), (-F.col("threshold")).alias("o"), "threshold", "precision", "recall", "f1"))
    return c.agg(best.alias("b")).select("b.threshold", "b.precision", "b.recall", "b.f1")


def feasible_region(df: DataFrame, label: str, score: str, min_precision: float, min_recall: float) -> DataFrame:
    """Best F1 among the points reaching both minima, else the point closest to them; ``feasible`` tells which."""
    c = with_f1(pr_curve(df, label, score, end_point=False))
    ok = flag((F.col("precision") >= min_precision) & (F.col("recall") >= min_recall))
    gap = F.sqrt(F.pow(F.col("precision") - min_precision, 2) + F.pow(F.col("recall") - min_recall, 2))
    merit = F.round(F.when(ok == 1, F.col("f1")).otherwise(-gap), 12)
    best = F.max(F.struct(ok.alias("feasible"), merit.alias("m"), (-F.col("threshold")).alias("o"), "threshold", "precision", "recall", "f1"))
    return c.agg(best.alias("b")).select("b.feasible", "b.threshold", "b.precision", "b.recall", "b.f1")


def grid(lo: float, hi: float, step: float) -> list[float]:
    n = int(round((hi - lo) / step))
    return [round(lo + i * step, 10) for i in range(n + 1)]


def threshold_table(df: DataFrame, label: str, score: str, thresholds: Sequence[float], fn_cost: float = 1.0) -> DataFrame:
    """Counts and metrics at every grid threshold; those that put all rows in one class are left out.

    ``thresholds`` are evenly spaced. A row is counted once, in the cell between two of them; the
    running sums go over the grid only.
    """
    n_th, lo = len(thresholds), float(thresholds[0])
    step = (float(thresholds[-1]) - lo) / max(n_th - 1, 1) or 1.0
    th = F.array(*[F.lit(float(x)) for x in thresholds])
    # The evenly spaced grid gives the cell by arithmetic; comparing with its own edges settles rounding.
    guess = F.greatest(F.lit(0), F.least(F.lit(n_th), F.floor((F.col(score) - lo) / step).cast("int") + 1))
    low_edge, high_edge = F.get(th, guess - 1), F.get(th, guess)
    passed = guess + F.when(high_edge <= F.col(score), 1).when(low_edge > F.col(score), -1).otherwise(0)
    y = flag(F.col(label) == 1)
    cells = df.where(F.col(score).isNotNull()).groupBy(passed.cast("long").alias("cell")).agg(
        F.sum(y).alias("pos"), F.sum(1 - y).alias("neg")
    )
    zero = F.lit(0).cast("long")
    every = df.sparkSession.range(n_th + 1).select(F.col("id").alias("cell"), zero.alias("pos"), zero.alias("neg"))
    whole = Window.partitionBy(F.lit(1))  # one row per threshold
    down = whole.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0)
    counts = cells.unionByName(every).groupBy("cell").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).select(
        "cell", F.sum("pos").over(down).alias("tp"), F.sum("neg").over(down).alias("fp"),
        F.sum("pos").over(whole).alias("p_all"), F.sum("neg").over(whole).alias("n_all"),
    )
    steps = counts.where("cell > 0").select(
        F.element_at(th, F.col("cell").cast("int")).alias("threshold"), "tp", "fp", (F.col("p_all") - F.col("tp")).alias("fn"), (F.col("n_all") - F.col("fp")).alias("tn"),
    )
    p, r, f1 = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return steps.where((F.col("tp") + F.col("fp") > 0) & (F.col("fn") + F.col("tn") > 0)).select(
        "*", p.alias("precision"), r.alias("recall"), f1.alias("f1"), ((F.col("tp") + F.col("tn")) / n).alias("accuracy"),
        (F.col("fp") + F.col("fn") * F.lit(float(fn_cost))).alias("cost"),
    )


def _merit(strategy: str, minimum: float, target_recall: float) -> list[Column]:
    p, r, f1 = F.col("precision"), F.col("recall"), F.col("f1")
    worst = F.least(p, r, f1)
    enough = flag(worst >= minimum)
    reached = flag(r >= target_recall)
    return {
        "balanced": [enough, F.when(enough == 1, f1).otherwise(worst)],
        "auto": [-F.col("cost")],
        "cost": [-F.col("cost")],
        "recall": [reached, F.when(reached == 1, p).otherwise(r)],
        "min_metric": [enough, F.when(enough == 1, f1).otherwise(worst), f1],
        "min_metric_accuracy": [F.least(p, r, f1, F.col("accuracy"))],
    }.get(strategy, [f1])


def choose_thresholds(table: DataFrame, strategies: Sequence[str], minimum: float = 0.6, target_recall: float = 0.8) -> DataFrame:
    """The chosen grid row per strategy, in one pass over the grid; the lowest threshold wins ties."""

    def best(s: str) -> Column:
        keys = [F.round(m.cast("double"), 12).alias(f"m{i}") for i, m in enumerate(_merit(s, minimum, target_recall))]
        return F.max(F.struct(*keys, (-F.col("threshold")).alias("o"), *table.columns)).alias(f"b_{s}")

    rows = F.array(*[F.struct(F.lit(s).alias("strategy"), *[F.col(f"b_{s}.{c}").alias(c) for c in table.columns]) for s in strategies])
    return table.agg(*[best(s) for s in strategies]).select(F.explode(rows).alias("r")).select("r.*")


def choose_threshold(table: DataFrame, strategy: str = "balanced", minimum: float = 0.6, target_recall: float = 0.8) -> DataFrame:
    return choose_thresholds(table, [strategy], minimum, target_recall).drop("strategy")


def balanced_point(df: DataFrame, label: str, score: str, target: float = 0.7) -> DataFrame:
    """Lowest score at which precision, recall and F1 all reach the target, else the best minimum of the three."""
    c = with_f1(pr_curve(df, label, score, end_point=False)).withColumn("worst", F.least("precision", "recall", "f1"))
    ok = flag(F.col("worst") >= target)
    merit = F.round(F.when(ok == 1, -F.col("threshold")).otherwise(F.col("worst")), 12)
    best = F.max(F.struct(ok.alias("achieved"), merit.alias("m"), (-F.col("threshold")).alias("o"), "threshold", "precision", "recall", "f1", "worst"))
    return c.agg(best.alias("b")).select("b.achieved", "b.threshold", "b.precision", "b.recall", "b.f1", "b.worst")


def cost_metrics(cm: DataFrame, fn_cost: float) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    cost = fp + fn * F.lit(float(fn_cost))
    base = (tp + fn) * F.lit(float(fn_cost))
    return cm.select(
        cost.alias("total_cost"), _ratio(cost, tp + fp + fn + tn).alias("mean_cost"), base.alias("baseline_cost"),
        F.when(base > 0, (base - cost) / base * 100).otherwise(0.0).alias("savings_pct"),
    )


def cv_summary(folds: DataFrame, metric_cols: Sequence[str], target: float = 0.7) -> DataFrame:
    """Mean and population standard deviation per metric, and how many folds reach the target in all."""
    worst = F.least(*[F.col(c) for c in metric_cols])
    return folds.agg(
        *[F.avg(c).alias(f"{c}_mean") for c in metric_cols], *[F.stddev_pop(c).alias(f"{c}_std") for c in metric_cols],
        F.count("*").alias("n_folds"), F.count_if(worst >= target).alias("n_at_target"),
    )
