"""Audits on events and lineitems."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, pairs
from .registry import query
from .series_queries import CUT_SQL, cutoffs


@query("L1_future_events_audit", f"WITH {CUT_SQL} SELECT user_id, count(*) FILTER (WHERE ts >= out_ts)::BIGINT AS n_future, count(*)::BIGINT AS n_events FROM events JOIN cut USING (user_id) GROUP BY 1")
def _(t):
    return audit.future_events(t("events", "user_id", "ts"), cutoffs(t), "user_id", "ts", "out_ts")


OVERLAP_SQL = """x AS (SELECT (l_returnflag = 'R')::INTEGER AS y, l_quantity, l_extendedprice, l_discount FROM lineitem),
lg AS (SELECT y, 'l_quantity' AS feature, l_quantity AS v FROM x UNION ALL SELECT y, 'l_extendedprice', l_extendedprice FROM x UNION ALL SELECT y, 'l_discount', l_discount FROM x),
e AS (SELECT feature, min(v) AS lo, max(v) AS hi, sum(y) AS tp, sum(1 - y) AS tn FROM lg GROUP BY 1),
h AS (SELECT feature, least(floor((v - lo) / ((hi - lo) / 50)), 49) AS cell, sum(y) / any_value(tp) AS p, sum(1 - y) / any_value(tn) AS n FROM lg JOIN e USING (feature) GROUP BY 1, 2),
ov AS (SELECT feature, sum(least(p, n)) AS overlap FROM h GROUP BY 1),
zr AS (SELECT feature, avg((v = 0)::INTEGER) AS zero_rate FROM lg GROUP BY 1)"""
COLS = ["l_quantity", "l_extendedprice", "l_discount"]


def labelled(t):
    return t("lineitem", "l_returnflag", *COLS).withColumn("y", F.when(F.col("l_returnflag") == "R", 1).otherwise(0))


@query("L2_class_overlap", f"WITH {OVERLAP_SQL} SELECT feature, round(overlap, 6) AS overlap FROM ov")
def _(t):
    out = audit.class_overlap(pairs.unpivot(labelled(t), ["y"], COLS), "feature", "value", "y")
    return out.select("feature", F.round("overlap", 6).alias("overlap"))


@query("L3_zero_rate", f"WITH {OVERLAP_SQL} SELECT feature, round(zero_rate, 6) AS zero_rate FROM zr")
def _(t):
    return audit.zero_rate(labelled(t), COLS).select("feature", F.round("zero_rate", 6).alias("zero_rate"))


@query("L4_id_coverage", """SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels))::BIGINT AS n_both,
(SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels))::BIGINT AS n_only_first,
(SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents))::BIGINT AS n_only_second""")
def _(t):
    return audit.id_coverage(t("documents", "doc_id"), t("labels", "doc_id"), "doc_id")


@query("L5_quality_report", f"""WITH {OVERLAP_SQL} SELECT feature, round(overlap, 6) AS overlap, round(zero_rate, 6) AS zero_rate, (SELECT count(*) FROM x)::BIGINT AS n_rows,
(SELECT round(avg(y), 6) FROM x) AS positive_share FROM ov JOIN zr USING (feature)""")
def _(t):
    r = audit.quality_report(labelled(t), COLS, "y")
    return r.select("feature", F.round("overlap", 6).alias("overlap"), F.round("zero_rate", 6).alias("zero_rate"), "n_rows", F.round("positive_share", 6).alias("positive_share"))
