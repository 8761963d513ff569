"""Evaluation operators; the score of a document is a fixed function of its length."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics
from .registry import Tables, query

SCORED_SQL = """sc AS (SELECT l_orderkey, (l_returnflag = 'R')::INTEGER AS y, round(((l_partkey * 7919 + l_suppkey * 104729 + l_linenumber * 31) % 997 / 997.0 +
  CASE WHEN l_returnflag = 'R' THEN 0.6 ELSE 0.0 END) / 1.6, 6) AS p FROM lineitem)"""
STEP_SQL = f"""{SCORED_SQL}, g AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM sc GROUP BY 1),
c AS (SELECT p AS threshold, pos, neg, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp, sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM g),
curve AS (SELECT threshold, tp / (tp + fp) AS precision, tp / np AS recall FROM c),
cf AS (SELECT *, 2 * precision * recall / (precision + recall + 1e-10) AS f1 FROM curve)"""


def scored(t: Tables):
    li = t("lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")
    y = F.when(F.col("l_returnflag") == "R", 1).otherwise(0)
    base = (F.col("l_partkey") * 7919 + F.col("l_suppkey") * 104729 + F.col("l_linenumber") * 31) % 997 / 997.0
    return li.select("l_orderkey", y.alias("y"), F.round((base + y * 0.6) / 1.6, 6).alias("p"))


def r6(df):
    return df.select(*[F.round(c, 6).alias(c) if dict(df.dtypes)[c] == "double" else F.col(c) for c in df.columns])


CM_SQL = f"""{SCORED_SQL}, cm AS (SELECT count(*) FILTER (WHERE p >= 0.5 AND y = 1) AS tp, count(*) FILTER (WHERE p >= 0.5 AND y = 0) AS fp,
count(*) FILTER (WHERE p < 0.5 AND y = 1) AS fn, count(*) FILTER (WHERE p < 0.5 AND y = 0) AS tn FROM sc)"""


@query("K1_confusion", f"WITH {CM_SQL} SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn FROM cm")
def _(t):
    return metrics.confusion(scored(t), "y", "p", 0.5)


@query("K2_class_metrics", f"""WITH {CM_SQL}, a AS (SELECT *, tp / (tp + fp) AS p1, tp / (tp + fn) AS r1, tn / (tn + fn) AS p0, tn / (tn + fp) AS r0, tp + fn AS n1, tn + fp AS n0 FROM cm),
b AS (SELECT *, 2 * p1 * r1 / (p1 + r1) AS f1, 2 * p0 * r0 / (p0 + r0) AS f0 FROM a)
SELECT round(p0, 6) AS precision_0, round(r0, 6) AS recall_0, round(f0, 6) AS f1_0, round(p1, 6) AS precision_1, round(r1, 6) AS recall_1, round(f1, 6) AS f1_1,
round((p0 + p1) / 2, 6) AS macro_precision, round((r0 + r1) / 2, 6) AS macro_recall, round((f0 + f1) / 2, 6) AS macro_f1,
round((p0 * n0 + p1 * n1) / (n0 + n1), 6) AS weighted_precision, round((r0 * n0 + r1 * n1) / (n0 + n1), 6) AS weighted_recall,
round((f0 * n0 + f1 * n1) / (n0 + n1), 6) AS weighted_f1, round((tp + tn) / (n0 + n1), 6) AS accuracy, round((r0 + r1) / 2, 6) AS balanced_accuracy FROM b""")
def _(t):
    return r6(metrics.class_metrics(metrics.confusion(scored(t), "y", "p", 0.5)))


@query("K3_pr_curve", f"""WITH {STEP_SQL} SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall FROM curve UNION ALL SELECT NULL, 1.0, 0.0""")
def _(t):
    return r6(metrics.pr_curve(scored(t), "y", "p"))


@query("K4_auroc", f"WITH {STEP_SQL} SELECT round(sum(neg * (tp - pos + pos / 2)) / (any_value(np) * any_value(nn)), 6) AS auroc FROM c")
def _(t):
    return r6(metrics.auroc(scored(t), "y", "p"))


@query("K5_average_precision", f"""WITH {STEP_SQL}, l AS (SELECT threshold, precision, recall - lag(recall, 1, 0) OVER (ORDER BY threshold DESC) AS gain FROM curve)
SELECT round(sum(gain * precision), 6) AS average_precision FROM l""")
def _(t):
    return r6(metrics.average_precision(scored(t), "y", "p"))


@query("K6_best_f1_threshold", f"""WITH {STEP_SQL} SELECT round(threshold, 6) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1
FROM cf ORDER BY round(f1, 12) DESC, threshold LIMIT 1""")
def _(t):
    return r6(metrics.best_f1_threshold(scored(t), "y", "p"))


def region_sql(a: float, b: float) -> str:
    return f"""SELECT (precision >= {a} AND recall >= {b})::INTEGER AS feasible, threshold, precision, recall, f1 FROM cf
ORDER BY feasible DESC, round(CASE WHEN precision >= {a} AND recall >= {b} THEN f1 ELSE -sqrt((precision - {a}) ** 2 + (recall - {b}) ** 2) END, 12) DESC, threshold LIMIT 1"""


@query("K7_feasible_region", f"""WITH {STEP_SQL}, a AS ({region_sql(0.5, 0.6)}), b AS ({region_sql(0.97, 0.97)}), u AS (FROM a UNION ALL FROM b)
SELECT feasible, round(threshold, 6) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM u""")
def _(t):
    s = scored(t)
    return r6(metrics.feasible_region(s, "y", "p", 0.5, 0.6).unionByName(metrics.feasible_region(s, "y", "p", 0.97, 0.97)))


def grid_sql(ths, cost) -> str:
    lit = "[" + ", ".join(str(x) for x in ths) + "]::DOUBLE[]"
    return f"""th AS (SELECT unnest({lit}) AS threshold), h AS (SELECT threshold, sum(CASE WHEN p >= threshold THEN y ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN p >= threshold THEN 1 - y ELSE 0 END)::BIGINT AS fp,
sum(CASE WHEN p < threshold THEN y ELSE 0 END)::BIGINT AS fn, sum(CASE WHEN p < threshold THEN 1 - y ELSE 0 END)::BIGINT AS tn FROM sc, th GROUP BY 1),
tt AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1,
(tp + tn) / (tp + fp + fn + tn) AS accuracy, fp + fn * {cost}::DOUBLE AS cost FROM h WHERE tp + fp > 0 AND fn + tn > 0)"""


GRID = metrics.grid(0.05, 0.98, 0.01)
FINE = metrics.grid(0.10, 0.895, 0.005)
WHOLE = metrics.grid(0.01, 0.99, 0.01)
OUT = "threshold, tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(accuracy, 6) AS accuracy, round(cost, 6) AS cost"


@query("K8_threshold_grid", f"""WITH {SCORED_SQL}, {grid_sql(GRID, 4.0)}, pick AS (
(SELECT 'balanced' AS strategy, * FROM tt ORDER BY least(precision, recall, f1) >= 0.6 DESC, round(CASE WHEN least(precision, recall, f1) >= 0.6 THEN f1 ELSE least(precision, recall, f1) END, 12) DESC, threshold LIMIT 1)
UNION ALL (SELECT 'cost', * FROM tt ORDER BY cost, threshold LIMIT 1) UNION ALL (SELECT 'f1', * FROM tt ORDER BY round(f1, 12) DESC, threshold LIMIT 1)
UNION ALL (SELECT 'recall', * FROM tt ORDER BY recall >= 0.8 DESC, round(CASE WHEN recall >= 0.8 THEN precision ELSE recall END, 12) DESC, threshold LIMIT 1)
UNION ALL (SELECT 'grid', * FROM tt)) SELECT strategy, {OUT} FROM pick""")
def _(t):
    table = metrics.threshold_table(scored(t), "y", "p", GRID, 4.0)
    picks = metrics.choose_thresholds(table, ["balanced", "cost", "f1", "recall"])
    return r6(table.withColumn("strategy", F.lit("grid")).unionByName(picks))


@query("K9_min_metric_threshold", f"""WITH {SCORED_SQL}, a AS (WITH {grid_sql(FINE, 1.0)} SELECT 'prf' AS kind, * FROM tt ORDER BY least(precision, recall, f1) >= 0.8 DESC,
round(CASE WHEN least(precision, recall, f1) >= 0.8 THEN f1 ELSE least(precision, recall, f1) END, 12) DESC, round(f1, 12) DESC, threshold LIMIT 1),
b AS (WITH {grid_sql(WHOLE, 1.0)} SELECT 'prfa' AS kind, * FROM tt ORDER BY round(least(precision, recall, f1, accuracy), 12) DESC, threshold LIMIT 1), u AS (FROM a UNION ALL FROM b) SELECT kind, {OUT} FROM u""")
def _(t):
    s = scored(t)
    a = metrics.choose_threshold(metrics.threshold_table(s, "y", "p", FINE), "min_metric", 0.8).withColumn("kind", F.lit("prf"))
    b = metrics.choose_threshold(metrics.threshold_table(s, "y", "p", WHOLE), "min_metric_accuracy").withColumn("kind", F.lit("prfa"))
    return r6(a.unionByName(b))


@query("K9_balanced_point", f"""WITH {STEP_SQL}, w AS (SELECT *, least(precision, recall, f1) AS worst FROM cf)
SELECT (worst >= 0.55)::INTEGER AS achieved, round(threshold, 6) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(worst, 6) AS worst FROM w
ORDER BY w.worst >= 0.55 DESC, round(CASE WHEN w.worst >= 0.55 THEN -w.threshold ELSE w.worst END, 12) DESC, w.threshold LIMIT 1""")
def _(t):
    return r6(metrics.balanced_point(scored(t), "y", "p", 0.55))


@query("K10_cost_metrics", f"""WITH {CM_SQL} SELECT (fp + fn * 4.0)::DOUBLE AS total_cost, round((fp + fn * 4.0) / (tp + fp + fn + tn), 6) AS mean_cost, ((tp + fn) * 4.0)::DOUBLE AS baseline_cost,
round(((tp + fn) * 4.0 - (fp + fn * 4.0)) / ((tp + fn) * 4.0) * 100, 6) AS savings_pct FROM cm""")
def _(t):
    return r6(metrics.cost_metrics(metrics.confusion(scored(t), "y", "p", 0.5), 4.0))


@query("K11_cv_summary", f"""WITH {SCORED_SQL}, cm AS (SELECT l_orderkey % 5 AS fold, sum(CASE WHEN p >= 0.5 THEN y ELSE 0 END) AS tp, sum(CASE WHEN p >= 0.5 THEN 1 - y ELSE 0 END) AS fp,
sum(CASE WHEN p < 0.5 THEN y ELSE 0 END) AS fn FROM sc GROUP BY 1), m AS (SELECT tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1 FROM cm)
SELECT round(avg(precision), 6) AS precision_mean, round(avg(recall), 6) AS recall_mean, round(avg(f1), 6) AS f1_mean, round(stddev_pop(precision), 6) AS precision_std,
round(stddev_pop(recall), 6) AS recall_std, round(stddev_pop(f1), 6) AS f1_std, count(*)::BIGINT AS n_folds, count(*) FILTER (WHERE least(precision, recall, f1) >= 0.5)::BIGINT AS n_at_target FROM m""")
def _(t):
    cm = metrics.confusion(scored(t).withColumn("fold", F.col("l_orderkey") % 5), "y", "p", 0.5, ["fold"])
    p, r, f1 = metrics.prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return r6(metrics.cv_summary(cm.select(p.alias("precision"), r.alias("recall"), f1.alias("f1")), ["precision", "recall", "f1"], 0.5))
