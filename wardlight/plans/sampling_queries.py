"""Splits, samples and weights on the labelled documents and on orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sampling
from .registry import query

RANK = "row_number() OVER (PARTITION BY {y} ORDER BY md5({id} || '|{seed}'), {id})"


def rank(y="toxic", id_="doc_id", seed=42):
    return RANK.format(y=y, id=id_, seed=seed)


@query("J4_stratified_split", f"""WITH r AS (SELECT doc_id, toxic, {rank()} AS rn, count(*) OVER (PARTITION BY toxic) AS n FROM labels)
SELECT doc_id, toxic, (rn <= floor(n * 0.2))::INTEGER AS is_test FROM r""")
def _(t):
    return sampling.stratified_split(t("labels", "doc_id", "toxic"), "doc_id", "toxic", 0.2, 42)


@query("J5_stratified_kfold", """WITH o AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(o_orderkey || '|7'), o_orderkey) AS rn FROM orders)
SELECT o_orderkey, o_orderstatus, ((rn - 1) % 5)::INTEGER AS fold FROM o""")
def _(t):
    return sampling.stratified_kfold(t("orders", "o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus", 5, 7)


@query("J6_undersample", f"""WITH r AS (SELECT doc_id, toxic, {rank()} AS rn FROM labels)
SELECT doc_id, toxic FROM r WHERE toxic = 1 OR rn <= floor((SELECT count(*) FROM labels WHERE toxic = 1) / 0.4 + 1e-9)""")
def _(t):
    return sampling.undersample(t("labels", "doc_id", "toxic"), "doc_id", "toxic", 0.4, 42)


@query("J7_oversample", f"""WITH r AS (SELECT doc_id, toxic, {rank()} AS rn FROM labels), n AS (SELECT sum(toxic)::BIGINT AS a, count(*) - sum(toxic)::BIGINT AS b FROM labels)
SELECT doc_id, toxic, unnest(range(1, 1 + CASE WHEN toxic = 1 THEN b // a + CASE WHEN rn <= b % a THEN 1 ELSE 0 END ELSE 1 END))::INTEGER AS copy FROM r, n""")
def _(t):
    return sampling.oversample(t("labels", "doc_id", "toxic"), "doc_id", "toxic", 42)


W_SQL = """c AS (SELECT toxic, count(*)::DOUBLE AS n FROM labels GROUP BY 1), b AS (SELECT toxic, n, sum(n) OVER () AS t, count(*) OVER () AS k FROM c),
w AS (SELECT toxic, n, t / (k * n) AS balanced, sqrt(t / (k * n)) AS sqrt_balanced, t / n / sum(t / n) OVER () * k AS inverse_freq,
  (0.0001 / (1 - pow(0.9999::DOUBLE, n))) / sum(0.0001 / (1 - pow(0.9999::DOUBLE, n))) OVER () * k AS effective_num FROM b)"""


@query("J9_class_weights", f"""WITH {W_SQL} SELECT strategy, toxic, round(weight, 6) AS weight FROM w UNPIVOT (weight FOR strategy IN (balanced, sqrt_balanced, inverse_freq, effective_num))""")
def _(t):
    y = t("labels", "toxic")
    out = None
    for s in ("balanced", "sqrt_balanced", "inverse_freq", "effective_num"):
        one = sampling.class_weights(y, "toxic", s).select(F.lit(s).alias("strategy"), "toxic", F.round("weight", 6).alias("weight"))
        out = one if out is None else out.unionByName(one)
    return out


@query("J10_cost_weights", f"""WITH {W_SQL}, k AS (SELECT toxic, n, balanced * CASE WHEN toxic = 1 THEN greatest(1.5, least(10.0, ln(max(n) OVER () / min(n) OVER () + 1) * 1.2)) ELSE 1.0 END AS c FROM w),
m AS (SELECT toxic, c / (sum(c * n) OVER () / sum(n) OVER ()) AS weight FROM k)
SELECT doc_id, toxic, round(weight, 6) AS weight FROM labels JOIN m USING (toxic)""")
def _(t):
    return sampling.cost_weights(t("labels", "doc_id", "toxic"), "toxic", "auto", 1.2).select("doc_id", "toxic", F.round("weight", 6).alias("weight"))


@query("J11_cv_weights", """WITH n AS (SELECT sum(toxic)::DOUBLE AS n1, count(*)::DOUBLE - sum(toxic) AS n0 FROM labels),
e AS (SELECT *, (1 - pow(0.9999::DOUBLE, n0)) / (1 - 0.9999::DOUBLE) AS e0, (1 - pow(0.9999::DOUBLE, n1)) / (1 - 0.9999::DOUBLE) AS e1 FROM n)
SELECT doc_id, round(CASE WHEN toxic = 1 THEN (e0 + e1) / (2 * e1) * ln(n0 / n1 + 1) * 1.5 * 1.44 ELSE (e0 + e1) / (2 * e0) * 1.44 END, 6) AS weight FROM labels, e""")
def _(t):
    return sampling.cv_weights(t("labels", "doc_id", "toxic"), "toxic").select("doc_id", F.round("weight", 6).alias("weight"))


@query("J12_impute_encode", """WITH tr AS (SELECT * FROM orders WHERE o_orderstatus <> 'P'), m AS (SELECT median(CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END) AS med FROM tr),
v AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS code FROM (SELECT DISTINCT CASE WHEN o_orderkey % 5 = 0 THEN 'MISSING' ELSE o_orderpriority END AS x FROM tr))
SELECT o_orderkey, round(coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END, med), 2) AS price,
coalesce((SELECT code FROM v WHERE x = CASE WHEN o_orderkey % 5 = 0 THEN 'MISSING' WHEN o_orderkey % 11 = 0 THEN 'new' ELSE o_orderpriority END), -1)::INTEGER AS priority FROM orders, m""")
def _(t):
    o = t("orders", "o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    price = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice"))
    missing = F.col("o_orderkey") % 5 == 0
    train = o.where("o_orderstatus <> 'P'").select("o_orderkey", price.alias("price"), F.when(~missing, F.col("o_orderpriority")).alias("priority"))
    raw = F.when(missing, None).when(F.col("o_orderkey") % 11 == 0, "new").otherwise(F.col("o_orderpriority"))
    out = sampling.impute_encode(train, o.select("o_orderkey", price.alias("price"), raw.alias("priority")), ["price"], ["priority"])
    return out.select("o_orderkey", F.round("price", 2).alias("price"), F.col("priority").cast("int"))
