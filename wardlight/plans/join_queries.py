"""Join operators: equi, semi, anti, theta rewritten as aggregates, look-back, overlap, lookup."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import vector_md5, vector_md5_sql

from ..operators import cohort, temporal
from .registry import Tables, query
from .row_queries import ADM_SQL, admissions
from .series_queries import CUT_SQL, cutoffs


@query("C1_inner_join", "SELECT o_orderkey, c_mktsegment, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
def _(t):
    return t("orders").join(t("customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey").select("o_orderkey", "c_mktsegment", "o_totalprice")


@query("C2_left_join_chain", """WITH a AS (SELECT user_id, count(*) AS n_click FROM events WHERE event_type = 'click' GROUP BY 1),
b AS (SELECT user_id, max(value) AS mx FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT c_custkey, c_acctbal, coalesce(n_click, 0)::BIGINT AS n_click, mx FROM customer LEFT JOIN a ON c_custkey = a.user_id LEFT JOIN b ON c_custkey = b.user_id""")
def _(t):
    e = t("events", "user_id", "event_type", "value").withColumnRenamed("user_id", "c_custkey")
    both = e.where("event_type IN ('click', 'error')").groupBy("c_custkey").agg(
        F.count_if(F.col("event_type") == "click").alias("n_click"), F.max(F.when(F.col("event_type") == "error", F.col("value"))).alias("mx")
    )
    return t("customer", "c_custkey", "c_acctbal").join(both, "c_custkey", "left").fillna(0, ["n_click"])


@query("C3_join_feature_sets", """WITH f AS (SELECT l_orderkey AS id, sum(l_quantity) AS qty FROM lineitem GROUP BY 1),
g AS (SELECT l_orderkey AS id, count(*) AS n_ret FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
y AS (SELECT o_orderkey AS id, (o_totalprice > 200000)::INTEGER AS "Y" FROM orders WHERE o_orderstatus <> 'P')
SELECT y.id, "Y", f.qty, coalesce(n_ret, 0)::BIGINT AS n_ret FROM f JOIN y USING (id) LEFT JOIN g USING (id)""")
def _(t):
    li = t("lineitem", "l_orderkey", "l_quantity", "l_returnflag").withColumnRenamed("l_orderkey", "id")
    f = li.groupBy("id").agg(F.sum("l_quantity").alias("qty"))
    g = li.where("l_returnflag = 'R'").groupBy("id").agg(F.count("*").alias("n_ret"))
    y = t("orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_totalprice") > 200000, 1).otherwise(0).alias("Y"))
    return cohort.join_feature_sets(f, [y, g], "id")


@query("C4_join_suffix", """SELECT o_orderkey, o_orderstatus AS status, l.status AS status_feat FROM orders
LEFT JOIN (SELECT l_orderkey, max(l_linestatus) AS status FROM lineitem GROUP BY 1) l ON o_orderkey = l_orderkey""")
def _(t):
    left = t("orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    right = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linestatus").alias("status"))
    return cohort.join_with_suffix(left, right, "o_orderkey")


@query("C5_semi_join", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def _(t):
    ret = t("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return t("orders", "o_orderkey").join(ret, "o_orderkey", "left_semi")


@query("C6_anti_join", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def _(t):
    return t("orders", "o_orderkey").join(t("lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("C7_theta_anti_join", f"""WITH {ADM_SQL} SELECT hadm_id FROM adm a WHERE NOT EXISTS
(SELECT 1 FROM adm b WHERE b.subject_id = a.subject_id AND b.admit_ts > a.disch_ts)""")
def _(t):
    return temporal.without_later(admissions(t), "subject_id", "admit_ts", "disch_ts").select("hadm_id")


# Several stays per admission: order = admission, supplier = stay; a stay lasts `quantity` days.
STAY_SQL = """stays AS (SELECT l_orderkey AS hadm_id, l_suppkey AS stay_id, min(l_shipdate) AS in_ts,
  min(l_shipdate) + to_hours(24 * (l_suppkey % 60)::INTEGER) AS out_ts FROM lineitem GROUP BY 1, 2)"""


def stays(t: Tables):
    s = t("lineitem", "l_orderkey", "l_suppkey", "l_shipdate").groupBy(F.col("l_orderkey").alias("hadm_id"), F.col("l_suppkey").alias("stay_id"))
    s = s.agg(F.min("l_shipdate").alias("in_ts"))
    return s.withColumn("out_ts", F.timestamp_add("HOUR", (24 * (F.col("stay_id") % 60)).cast("int"), F.col("in_ts")).cast("timestamp_ntz"))


@query("C8_theta_semi_join_label", f"""WITH {STAY_SQL} SELECT hadm_id, stay_id, (EXISTS (SELECT 1 FROM stays b WHERE b.hadm_id = a.hadm_id
AND b.in_ts > a.out_ts AND b.stay_id <> a.stay_id))::INTEGER AS "Y" FROM stays a""")
def _(t):
    return temporal.label_return(stays(t), "hadm_id", "stay_id", "in_ts", "out_ts").select("hadm_id", "stay_id", "Y")


@query("C9_cutoff_join", f"WITH {CUT_SQL} SELECT event_id FROM events JOIN cut USING (user_id) WHERE ts < out_ts")
def _(t):
    return temporal.before_cutoff(t("events", "event_id", "user_id", "ts"), cutoffs(t), "user_id", "ts", "out_ts").select("event_id")


@query("C10_lookback_join", f"WITH {CUT_SQL} SELECT event_id, user_id FROM events JOIN cut USING (user_id) WHERE epoch_us(out_ts) - epoch_us(ts) BETWEEN 0 AND 48 * 3600000000")
def _(t):
    return temporal.lookback(t("events", "event_id", "user_id", "ts"), cutoffs(t), "user_id", "ts", "out_ts", 48).select("event_id", "user_id")


@query("C11_lookback_unbounded", f"WITH {CUT_SQL} SELECT event_id, user_id FROM events JOIN cut USING (user_id) WHERE epoch_us(out_ts) - epoch_us(ts) <= 24 * 3600000000")
def _(t):
    return temporal.lookback(t("events", "event_id", "user_id", "ts"), cutoffs(t), "user_id", "ts", "out_ts", 24, False).select("event_id", "user_id")


ORDER_INTERVALS_SQL = """iv AS (SELECT l_orderkey AS hadm_id, l_partkey AS drug, l_shipdate AS start_ts, l_shipdate + to_hours(24 * (l_linenumber % 5)) AS end_ts FROM lineitem),
cut AS (SELECT o_orderkey AS hadm_id, o_orderdate + to_hours(24 * 1000) AS out_ts FROM orders)"""


def order_intervals(t: Tables):
    add = lambda ts, h: F.timestamp_add("HOUR", h.cast("int"), ts).cast("timestamp_ntz")
    li = t("lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_shipdate")
    iv = li.select(
        F.col("l_orderkey").alias("hadm_id"), F.col("l_partkey").alias("drug"), F.col("l_shipdate").alias("start_ts"),
        add(F.col("l_shipdate"), 24 * (F.col("l_linenumber") % 5)).alias("end_ts"),
    )
    cut = t("orders").select(F.col("o_orderkey").alias("hadm_id"), add(F.col("o_orderdate"), F.lit(24000)).alias("out_ts"))
    return iv, cut


@query("C13_interval_overlap_join", f"""WITH {ORDER_INTERVALS_SQL} SELECT hadm_id, drug FROM iv JOIN cut USING (hadm_id)
WHERE end_ts >= out_ts - INTERVAL 2400 HOUR AND start_ts <= out_ts""")
def _(t):
    iv, cut = order_intervals(t)
    return temporal.overlapping(iv, cut, "hadm_id", "start_ts", "end_ts", "out_ts", 2400).select("hadm_id", "drug")


@query("C14_crosswalk_join", """WITH m AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R')
SELECT l_suppkey, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS amount FROM orders JOIN m ON o_orderkey = l_orderkey GROUP BY 1""")
def _(t):
    rows = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    mapped = temporal.crosswalk(rows, t("lineitem").where("l_returnflag = 'R'"), "l_orderkey", "l_suppkey")
    return mapped.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("amount"))


@query("C15_dictionary_lookup", """SELECT c_custkey, coalesce(r_name, 'NONE') AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN region ON n_regionkey = r_regionkey AND r_name <> 'ASIA'""")
def _(t):
    regions = t("region").where("r_name <> 'ASIA'").withColumnRenamed("r_regionkey", "n_regionkey")
    lookup = t("nation").join(regions, "n_regionkey", "left").select(F.col("n_nationkey").alias("c_nationkey"), "r_name")
    return t("customer", "c_custkey", "c_nationkey").join(lookup, "c_nationkey", "left").select("c_custkey", F.coalesce("r_name", F.lit("NONE")).alias("region"))


@query("C16_left_join_fill", f"""WITH e AS (SELECT doc_id, coalesce(embedding, list_transform(range(64), lambda i: CAST(0 AS FLOAT))) AS v FROM documents LEFT JOIN embeddings ON doc_id = vec_id)
SELECT doc_id, {vector_md5_sql('v')} AS digest, len(v)::INTEGER AS dim FROM e""")
def _(t):
    emb = t("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    filled = F.coalesce("embedding", F.array_repeat(F.lit(0.0).cast("float"), 64))
    df = t("documents", "doc_id").join(emb, "doc_id", "left").withColumn("embedding", filled)
    return df.select("doc_id", vector_md5("embedding").alias("digest"), F.size("embedding").alias("dim"))


@query("C17_pair_enumeration", """WITH v AS (SELECT DISTINCT event_type AS v FROM events), x AS (SELECT DISTINCT 'seg_' || c_mktsegment AS t FROM customer) SELECT v.v, x.t FROM v, x""")
def _(t):
    from ..operators.pairs import enumerate_pairs

    return enumerate_pairs(t("events").select(F.col("event_type").alias("v")), t("customer").select(F.concat(F.lit("seg_"), "c_mktsegment").alias("t")), "v", "t")


@query("C18_add_absent", """WITH m AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM documents WHERE lang = 'en') GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n FROM labels LEFT JOIN m USING (doc_id)""")
def _(t):
    m = t("documents").where("lang = 'en'").groupBy("doc_id").agg(F.count("*").alias("n"))
    return cohort.add_absent(t("labels"), m, "doc_id")
