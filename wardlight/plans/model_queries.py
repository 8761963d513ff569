"""Model operators on orders: binned features as terms, scores from shape tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import flag, vector_md5, vector_md5_sql
from ..operators import models
from ..session import durable
from .registry import Tables, query

BINS_SQL = """bn AS (SELECT o_orderkey AS id, 'price' AS term, floor(o_totalprice / 50000)::INTEGER::VARCHAR AS bin, o_totalprice AS value FROM orders
  UNION ALL SELECT o_orderkey, 'priority', substr(o_orderpriority, 1, 1), NULL FROM orders
  UNION ALL SELECT o_orderkey, 'price & priority', floor(o_totalprice / 50000)::INTEGER || '_' || substr(o_orderpriority, 1, 1), NULL FROM orders),
y AS (SELECT o_orderkey AS id, (o_orderstatus = 'F')::INTEGER AS y FROM orders),
shp AS (SELECT (id % 2)::INTEGER AS model, term, bin, (avg(y) - 0.3) * 4 AS score FROM bn JOIN y USING (id) GROUP BY 1, 2, 3),
icp AS (SELECT 0 AS model, -0.3 AS b UNION ALL SELECT 1, -0.1),
lo AS (SELECT id, model, sum(score) AS s FROM bn JOIN shp USING (term, bin) GROUP BY 1, 2),
pr AS (SELECT id, avg(1 / (1 + exp(-(s + b)))) AS p FROM lo JOIN icp USING (model) GROUP BY 1),
ct AS (SELECT id, term, sum(score) / 2 AS c, max(value) AS value FROM bn JOIN shp USING (term, bin) GROUP BY 1, 2),
fc AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(c) DESC, term) AS rk FROM ct WHERE abs(c) > 0.001)"""


def bins(t: Tables):
    price = F.floor(F.col("o_totalprice") / 50000).cast("string")
    prio = F.substring("o_orderpriority", 1, 1)
    none = F.lit(None).cast("double")
    cell = lambda term, b, v: F.struct(F.lit(term).alias("term"), b.alias("bin"), v.alias("value"))
    cells = F.array(cell("price", price, F.col("o_totalprice")), cell("priority", prio, none), cell("price & priority", F.concat_ws("_", price, prio), none))
    return t("orders").select(F.col("o_orderkey").alias("id"), flag(F.col("o_orderstatus") == "F").alias("y"), F.explode(cells).alias("c")).select("id", "y", "c.*")


def shapes(t: Tables):
    s = bins(t).groupBy((F.col("id") % 2).cast("int").alias("model"), "term", "bin").agg(((F.avg("y") - 0.3) * 4).alias("score"))
    base = t.spark.createDataFrame([(0, models.INTERCEPT, "", -0.3), (1, models.INTERCEPT, "", -0.1)], "model int, term string, bin string, score double")
    return s.unionByName(base)


@query("J19_score_ensemble", f"""WITH {BINS_SQL} SELECT id, round(p, 6) AS pred_proba, (p >= 0.5)::INTEGER AS pred_label,
CASE WHEN p < 0.3 THEN 'Low' WHEN p < 0.5 THEN 'Moderate' WHEN p < 0.7 THEN 'Elevated' ELSE 'High' END AS risk_level FROM pr""")
def _(t):
    return models.score_ensemble(bins(t).drop("y"), shapes(t), "id").withColumn("pred_proba", F.round("pred_proba", 6))


@query("J20_soft_vote", f"""WITH {BINS_SQL}, o AS (SELECT o_orderkey AS id, (o_custkey % 100) / 100.0 AS p2 FROM orders)
SELECT id, round((0.75 * p + 0.25 * p2), 6) AS pred_proba FROM pr JOIN o USING (id)""")
def _(t):
    other = t("orders").select(F.col("o_orderkey").alias("id"), ((F.col("o_custkey") % 100) / 100.0).alias("pred_proba"))
    out = models.soft_vote([models.score_ensemble(bins(t).drop("y"), shapes(t), "id"), other], "id", weights=[3, 1])
    return out.withColumn("pred_proba", F.round("pred_proba", 6))


@query("J25_local_explanation", f"""WITH {BINS_SQL} SELECT id, term, round(c, 6) AS contribution, round(value, 2) AS value, rk::INTEGER AS rank, CASE WHEN c > 0 THEN 'risk' ELSE 'protective' END AS kind FROM fc WHERE rk <= 2""")
def _(t):
    out = models.local_explanation(bins(t).drop("y"), shapes(t), "id", 2)
    return out.select("id", "term", F.round("contribution", 6).alias("contribution"), F.round("value", 2).alias("value"), "rank", "kind")


@query("J26_active_pairs", """WITH v AS (SELECT o_orderkey AS id, 'nlp_urgent' AS feature, (o_orderpriority = '1-URGENT')::INTEGER::DOUBLE AS value FROM orders UNION ALL SELECT o_orderkey, 'nlp_low', (o_orderpriority = '5-LOW')::INTEGER FROM orders
UNION ALL SELECT o_orderkey, 'PRICE', o_totalprice FROM orders), p AS (SELECT 'PRICE' AS vital, 'nlp_urgent' AS nlp, 0.9 AS score UNION ALL SELECT 'ABSENT', 'nlp_low', 0.4)
SELECT a.id, vital, nlp, b.value AS vital_value, score::DOUBLE AS importance, lower(vital) || ' weighs more while ' || nlp || ' is noted' AS description
FROM v a JOIN p ON a.feature = p.nlp AND a.value = 1 LEFT JOIN v b ON b.id = a.id AND b.feature = p.vital""")
def _(t):
    cell = lambda n, c: F.struct(F.lit(n).alias("feature"), c.cast("double").alias("value"))
    cells = F.array(
        cell("nlp_urgent", flag(F.col("o_orderpriority") == "1-URGENT")), cell("nlp_low", flag(F.col("o_orderpriority") == "5-LOW")), cell("PRICE", F.col("o_totalprice"))
    )
    values = t("orders").select(F.col("o_orderkey").alias("id"), F.explode(cells).alias("c")).select("id", "c.*")
    listed = t.spark.createDataFrame([("PRICE", "nlp_urgent", 0.9), ("ABSENT", "nlp_low", 0.4)], "vital string, nlp string, score double")
    return models.active_pairs(values, listed, "id")


@query("J27_global_importance", f"""WITH {BINS_SQL}, m AS (SELECT term, model, avg(abs(score)) AS m FROM bn JOIN shp USING (term, bin) GROUP BY 1, 2)
SELECT term, round(avg(m), 6) AS importance FROM m WHERE term LIKE '% & %' GROUP BY 1 ORDER BY avg(m) DESC, term LIMIT 100""")
def _(t):
    return models.global_importance(bins(t).drop("y"), shapes(t)).withColumn("importance", F.round("importance", 6))


@query("J29_risk_narrative", f"""WITH {BINS_SQL}, ln AS (SELECT id, string_agg('- ' || replace(term, '_', ' ') || CASE WHEN c > 0 THEN ' increases risk' ELSE ' reduces risk' END || ' (impact ' || format('{{:.3f}}', c) || ')', chr(10) ORDER BY rk) AS l FROM fc WHERE rk <= 3 GROUP BY 1)
SELECT id, 'Risk: ' || CASE WHEN p >= 0.45 THEN 'HIGH' ELSE 'LOW' END || ' (' || floor(p * 100)::INTEGER || '/100)' || chr(10) || CASE WHEN p >= 0.45 THEN 'Main drivers:' ELSE 'Observations:' END || chr(10) || coalesce(l, '') || chr(10)
|| CASE WHEN p >= 0.45 THEN 'Advice: consider postponing the transfer and monitor closely.' ELSE 'Advice: standard protocol; watch the listed factors.' END AS narrative FROM pr LEFT JOIN ln USING (id)""")
def _(t):
    b, s = bins(t).drop("y"), shapes(t)
    return models.risk_narrative(models.score_ensemble(b, s, "id"), models.local_explanation(b, s, "id", 3), "id", 0.45)


@query("J3_zero_vectors", f"""WITH e AS (SELECT vec_id, CASE WHEN label % 3 = 0 AND vec_id % 2 = 0 THEN list_transform(range(64), lambda i: CAST(9 AS FLOAT))
WHEN label % 3 = 0 THEN list_transform(range(64), lambda i: CAST(0 AS FLOAT)) ELSE embedding END AS v FROM embeddings)
SELECT vec_id, {vector_md5_sql('v')} AS digest FROM e""")
def _(t):
    zeroed = F.when(F.col("label") % 3 == 0, F.array_repeat(F.lit(0.0).cast("float"), 64)).otherwise(F.col("embedding"))
    e = t("embeddings").select("vec_id", zeroed.alias("embedding"))
    new = t("embeddings").where("vec_id % 2 = 0").select("vec_id", F.array_repeat(F.lit(9.0).cast("float"), 64).alias("embedding"))
    return models.refill_vectors(e, new, "vec_id", "embedding").select("vec_id", vector_md5("embedding").alias("digest"))


@query("J1_kmeans_clusters")
def _(t):
    return models.kmeans_clusters(t("embeddings", "vec_id", "embedding"), "vec_id", "embedding", 8, 42)


@query("J2_standardize_pca")
def _(t):
    e = t("embeddings", "vec_id", "embedding")
    return models.standardize_pca(e, e, "vec_id", "embedding", 16)


FEATURES = ["o_totalprice", "n_lines", "qty", "tax"]


def order_frame(t: Tables):
    li = t("lineitem", "l_orderkey", "l_quantity", "l_tax", "l_returnflag").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count("*").alias("n_lines"), F.sum("l_quantity").alias("qty"), F.avg("l_tax").alias("tax"), F.count_if(F.col("l_returnflag") == "R").alias("n_ret")
    )
    # read many times by a fit, so it is made once
    return durable(t("orders", "o_orderkey", "o_totalprice").join(li, "o_orderkey").withColumn("y", flag(F.col("n_ret") >= 3)).drop("n_ret"))


PAIRS = [("qty", "n_lines")]


@query("J17_fit_additive")
def _(t):
    return models.fit_additive(order_frame(t), FEATURES, "y", PAIRS, n_bins=5, max_iter=15).shapes


@query("J16_discover_interactions")
def _(t):
    flags = {"many_lines": F.col("n_lines") >= 5, "low_tax": F.col("tax") < 0.03, "odd": F.col("o_orderkey") % 2 == 1}
    frame = order_frame(t).withColumns({n: flag(c) for n, c in flags.items()})
    found = models.discover_interactions(frame, "o_orderkey", ["o_totalprice", "qty"], list(flags), "y", top=2, n_bins=5, max_iter=10)
    return found.ranking.select("vital_feature", "nlp_feature", "interaction_score", "n_t0", "n_t1", "chosen")


@query("J18_fit_ensemble")
def _(t):
    return models.fit_ensemble(order_frame(t), "o_orderkey", FEATURES, "y", 2, (0.4, 0.5), pairs=PAIRS, n_bins=5, max_iter=10).shapes


@query("J21_fit_boosted_trees")
def _(t):
    df = order_frame(t)
    return models.positive_probability(models.fit_boosted_trees(df, FEATURES, "y", 5).transform(df), "o_orderkey")


@query("J22_platt_calibration")
def _(t):
    from ..operators import sampling

    df = durable(sampling.stratified_split(order_frame(t), "o_orderkey", "y", 0.2))
    m = models.fit_additive(df.where("is_test = 0"), FEATURES, "y", n_bins=5, max_iter=10)
    scored = models.batch_predict(df, "o_orderkey", m, keep=["y", "is_test"])
    a, b = models.platt_calibration(scored.where("is_test = 1"), "y")
    return models.calibrate(scored, a, b).select("o_orderkey", "pred_proba", "calibrated")


@query("J23_grid_search_cv")
def _(t):
    return models.grid_search_cv(order_frame(t), "o_orderkey", FEATURES, "y", {"coarse": {"n_bins": 3, "max_iter": 4}, "fine": {"n_bins": 6, "max_iter": 4}}, 2)


@query("J24_batch_predict")
def _(t):
    from ..operators import sampling

    df = durable(sampling.stratified_split(order_frame(t), "o_orderkey", "y", 0.2))
    m = models.fit_additive(df.where("is_test = 0"), FEATURES, "y", n_bins=5, max_iter=10)
    return models.batch_predict(df, "o_orderkey", m, 0.3)


@query("J30_modality_ablation")
def _(t):
    clinical, text = ["o_totalprice", "tax"], ["n_lines", "qty"]
    pairs = [(a, b) for a in clinical for b in text]
    return models.modality_ablation(order_frame(t), "o_orderkey", "y", {"clinical": clinical, "text": text}, pairs)


@query("J8_smote")
def _(t):
    from ..operators import neighbors

    e = t("embeddings").withColumn("y", flag(F.col("label") <= 1))
    return neighbors.smote(e, "vec_id", "y", "embedding", 5, 0.5)


@query("J8_nearest_minority", """WITH m AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE label <= 1),
p AS (SELECT a.vec_id AS rep, b.vec_id AS neighbor, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) ** 2))) AS d FROM m a JOIN m b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY d, neighbor) AS rank FROM p) SELECT rep, neighbor, rank::INTEGER AS rank, round(d, 6) AS distance FROM r WHERE rank <= 5""")
def _(t):
    from ..operators import neighbors

    points = neighbors.distinct_vectors(t("embeddings").where("label <= 1"), "vec_id", "embedding").select("rep", "vec")
    return neighbors.nearest_rows(points, 5, block_rows=40).select("rep", "neighbor", "rank", F.round("distance", 6).alias("distance"))
