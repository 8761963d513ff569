"""Group aggregates on orders, lineitems and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clinical
from ..operators import aggregates, ordered, pairs, temporal
from .join_queries import ORDER_INTERVALS_SQL, order_intervals
from .registry import Tables, query
from .row_queries import WIDE_SQL, wide
from .series_queries import CUT_SQL, cutoffs
from .source_queries import INPUTS_SQL, inputs


@query("D9_fluid_input_24h", f"""WITH {INPUTS_SQL}, cut AS (SELECT o_orderkey AS id, o_orderdate + to_hours(24000) AS out_ts FROM orders)
SELECT id, round(sum(amount), 2) AS amount FROM inputs JOIN cut USING (id) WHERE epoch_us(out_ts) - epoch_us(ts) BETWEEN 0 AND 7200 * 3600000000 GROUP BY 1""")
def _(t):
    cut = t("orders").select(F.col("o_orderkey").alias("id"), F.timestamp_add("HOUR", F.lit(24000), F.col("o_orderdate")).cast("timestamp_ntz").alias("out_ts"))
    near = temporal.lookback(inputs(t), cut, "id", "ts", "out_ts", 7200)
    return near.groupBy("id").agg(F.round(F.sum("amount"), 2).alias("amount"))


@query("D10_count_distinct_active", f"""WITH {ORDER_INTERVALS_SQL} SELECT hadm_id, count(DISTINCT drug)::BIGINT AS n_active, 1 AS on_any FROM iv JOIN cut USING (hadm_id)
WHERE end_ts >= out_ts - INTERVAL 9600 HOUR AND start_ts <= out_ts GROUP BY 1""")
def _(t):
    iv, cut = order_intervals(t)
    return aggregates.active_distinct(temporal.overlapping(iv, cut, "hadm_id", "start_ts", "end_ts", "out_ts", 9600), "hadm_id", "drug")


@query("D11_micro_counts", f"""WITH {CUT_SQL} SELECT user_id, count(*)::BIGINT AS n_total,
count(*) FILTER (WHERE epoch_us(out_ts) - epoch_us(ts) BETWEEN 0 AND 48 * 3600000000)::BIGINT AS n_recent
FROM events JOIN cut USING (user_id) WHERE event_type = 'error' GROUP BY 1""")
def _(t):
    return aggregates.positives(t("events", "user_id", "event_type", "ts").where("event_type = 'error'"), cutoffs(t), "user_id", "ts", "out_ts")


@query("D12_ward_hours", """WITH tr AS (SELECT l_orderkey, CASE l_linenumber WHEN 1 THEN 'MICU' WHEN 2 THEN 'SICU B' WHEN 3 THEN NULL ELSE 'Ward ' || l_linenumber END AS unit,
l_quantity AS hours FROM lineitem)
SELECT l_orderkey, sum(CASE WHEN unit IS NULL OR NOT regexp_matches(unit, 'MICU|SICU|CCU|CSRU|TSICU') THEN hours ELSE 0.0 END) AS ward_hours, count(*)::BIGINT AS n_transfers FROM tr GROUP BY 1""")
def _(t):
    n = F.col("l_linenumber")
    unit = F.when(n == 1, "MICU").when(n == 2, "SICU B").when(n > 3, F.concat(F.lit("Ward "), n.cast("string")))
    end = F.timestamp_add("HOUR", F.col("l_quantity").cast("int"), F.col("l_shipdate")).cast("timestamp_ntz")
    tr = t("lineitem", "l_orderkey", "l_linenumber", "l_shipdate", "l_quantity").select("l_orderkey", unit.alias("unit"), F.col("l_shipdate").alias("a"), end.alias("b"))
    return aggregates.ward_hours(tr, "l_orderkey", "unit", "a", "b")


def order_parts(t: Tables):
    parts = t("part", "p_partkey", "p_brand", "p_type").withColumnRenamed("p_partkey", "l_partkey")
    return t("lineitem", "l_orderkey", "l_partkey").join(parts, "l_partkey")


@query("D13_flag_max", """SELECT l_orderkey, max((p_type LIKE 'ECO%')::INTEGER) AS eco, max((p_type LIKE 'PROMO%' OR p_type LIKE 'STANDARD%')::INTEGER) AS promo
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def _(t):
    return clinical.any_code_flags(order_parts(t), "l_orderkey", "p_type", {"eco": ["ECO"], "promo": ["PROMO", "STANDARD"]})


@query("D14_set_aggregate", """WITH f AS (SELECT l_orderkey, max((regexp_matches(p_brand, '^Brand#1'))::INTEGER) AS a, max((p_brand = 'Brand#2')::INTEGER) AS b,
max((regexp_matches(p_type, '^X'))::INTEGER) AS c FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT l_orderkey, (3 * a + 1 * b * (1 - a))::INTEGER AS score FROM f""")
def _(t):
    rules = {"severe": (3, ["Brand#1"], []), "mild": (1, [], ["Brand#2"])}
    return clinical.comorbidity_score(order_parts(t), "l_orderkey", "p_brand", rules, {"severe": "mild"})


@query("D16_median_impute", f"""WITH {WIDE_SQL}, m AS (SELECT median("A_Min") AS a, median("R_Avg") AS r, median("N_Max") AS n FROM wide)
SELECT l_orderkey, coalesce("A_Min", m.a) AS a, round(coalesce("R_Avg", m.r) + 2e-7, 4) AS r, round(coalesce("N_Max", m.n), 6) AS n FROM wide, m""")
def _(t):
    df = aggregates.impute_median(wide(t), ["A_Min", "R_Avg", "N_Max"])
    return df.select("l_orderkey", F.col("A_Min").alias("a"), F.round(F.col("R_Avg") + 2e-7, 4).alias("r"), F.round("N_Max", 6).alias("n"))


IQR_SQL = """lg AS (SELECT 'quantity' AS feature, l_quantity AS value FROM lineitem UNION ALL SELECT 'price', l_extendedprice FROM lineitem
  UNION ALL SELECT 'tax', l_tax FROM lineitem),
q AS (SELECT feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM lg GROUP BY 1),
bounds AS (SELECT feature, q1, q3, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)"""


@query("D17_iqr_bounds", f"WITH {IQR_SQL} SELECT feature, round(q1 + 2e-7, 4) AS q1, round(q3 + 2e-7, 4) AS q3, round(lo + 2e-7, 4) AS lo, round(hi + 2e-7, 4) AS hi FROM bounds")
def _(t):
    li = t("lineitem").select(F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_tax").alias("tax"))
    b = aggregates.iqr_bounds(pairs.unpivot(li, [], ["quantity", "price", "tax"]), "feature", "value")
    return b.select("feature", *[F.round(F.col(c) + 2e-7, 4).alias(c) for c in ("q1", "q3", "lo", "hi")])


@query("D18_concept_frequency", """WITH r AS (SELECT user_id, json_extract_string(props, '$.k') AS concept FROM events), n AS (SELECT count(DISTINCT user_id) AS n FROM r)
SELECT concept, count(DISTINCT user_id)::BIGINT AS n_patients, round(count(DISTINCT user_id) / any_value(n.n), 6) AS share FROM r, n GROUP BY 1
HAVING count(DISTINCT user_id) / any_value(n.n)::DOUBLE >= 0.5""")
def _(t):
    rows = t("events", "user_id", "props").select("user_id", F.get_json_object("props", "$.k").alias("concept"))
    return aggregates.concept_frequency(rows, "user_id", "concept", 0.5).select("concept", "n_patients", F.round("share", 6).alias("share"))


@query("D19_pivot", """SELECT user_id, """ + ", ".join(
    f"count(*) FILTER (WHERE event_type = '{c}')::BIGINT AS {c}, max((event_type = '{c}' AND value > 90)::INTEGER)::BIGINT AS high_{c}" for c in ("click", "error", "view")) + " FROM events GROUP BY 1")
def _(t):
    e = t("events", "user_id", "event_type", "value")
    types = ["click", "error", "view"]
    n = aggregates.pivot_counts(e, "user_id", "event_type", types)
    marked = e.withColumn("event_type", F.when(F.col("value") > 90, F.concat(F.lit("high_"), "event_type")))
    return n.join(aggregates.pivot_counts(marked, "user_id", "event_type", [f"high_{c}" for c in types], binary=True), "user_id")


MAJORITY_SQL = """k AS (SELECT lower(c_mktsegment) AS text, c_nationkey AS code, 'N' || c_nationkey AS name, c_acctbal AS score FROM customer),
n AS (SELECT text, code, name, count(*) AS c FROM k GROUP BY 1, 2, 3),
b AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY c DESC, code, name) AS r FROM n),
maj AS (SELECT b.text, b.code, b.name, (SELECT avg(score) FROM k WHERE k.text = b.text AND k.code = b.code) AS mean_score FROM b WHERE r = 1)"""


@query("D20_majority_value", f"WITH {MAJORITY_SQL} SELECT text, code, name, round(mean_score, 4) AS mean_score FROM maj")
def _(t):
    rows = t("customer").select(
        F.lower("c_mktsegment").alias("text"), F.col("c_nationkey").alias("code"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("name"),
        F.col("c_acctbal").alias("score"),
    )
    return aggregates.majority_value(rows, "text", "code", "name", "score").select("text", "code", "name", F.round("mean_score", 4).alias("mean_score"))


@query("D21_class_distribution", """WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1)
SELECT quality, n::BIGINT AS n, round(n / sum(n) OVER (), 6) AS share, round(max(n) OVER () / min(n) OVER (), 6) AS imbalance FROM c""")
def _(t):
    df = aggregates.class_distribution(t("labels"), "quality")
    return df.select("quality", "n", F.round("share", 6).alias("share"), F.round("imbalance", 6).alias("imbalance"))


KEYWORDS = ["the", "ation", "re-", "sch"]


@query("D23_keyword_counts", """WITH d AS (SELECT source, lower(text) AS x, trim(regexp_replace(lower(text), '[\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g')) AS w FROM documents),
s AS (SELECT source, sum(CASE WHEN w = '' THEN 0 ELSE len(string_split(w, ' ')) END) AS n_words, """ + ", ".join(
    f"sum((length(x) - length(replace(x, '{k}', ''))) // {len(k)}) AS k{i}" for i, k in enumerate(KEYWORDS)) + """ FROM d GROUP BY 1)
SELECT source, n_words::BIGINT AS n_words, """ + ", ".join(
    f"k{i}::BIGINT AS k{i}, round(k{i} / (n_words + 1e-9), 6) AS k{i}_norm" for i in range(len(KEYWORDS))) + " FROM s")
def _(t):
    df = aggregates.keyword_counts(t.heavy("documents", "source", "text"), "source", "text", KEYWORDS)
    cols = [x for i, k in enumerate(KEYWORDS) for x in (F.col(f"kw_{k}").alias(f"k{i}"), F.round(f"kw_{k}_norm", 6).alias(f"k{i}_norm"))]
    return df.select("source", "n_words", *cols)


@query("D24_column_range_guard", "SELECT l_orderkey, l_linenumber, round(l_discount * CASE WHEN (SELECT max(l_discount) FROM lineitem) <= 1 THEN 100 ELSE 1 END, 6) AS pct FROM lineitem")
def _(t):
    df = aggregates.scale_by_max(t("lineitem", "l_orderkey", "l_linenumber", "l_discount"), "l_discount")
    return df.select("l_orderkey", "l_linenumber", F.round("l_discount", 6).alias("pct"))


@query("G1_union", "SELECT 'o' AS kind, o_orderkey AS k FROM orders UNION ALL SELECT 'l', l_orderkey FROM lineitem")
def _(t):
    a = t("orders").select(F.lit("o").alias("kind"), F.col("o_orderkey").alias("k"))
    return a.unionByName(t("lineitem").select(F.lit("l").alias("kind"), F.col("l_orderkey").alias("k")))


@query("G2_distinct", "SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem")
def _(t):
    return t("lineitem", "l_orderkey", "l_suppkey").distinct()


@query("G3_difference_intersection", """SELECT 'only_documents' AS side, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'both', doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)""")
def _(t):
    d, y = t("documents", "doc_id"), t("labels", "doc_id")
    only = d.join(y, "doc_id", "left_anti").select(F.lit("only_documents").alias("side"), "doc_id")
    return only.unionByName(d.intersect(y).select(F.lit("both").alias("side"), "doc_id"))


@query("G4_label_set_union", """SELECT DISTINCT x AS dir FROM (SELECT p_brand || '/' || p_size AS x FROM part WHERE p_size > 25
UNION ALL SELECT p_brand || '/' || p_size FROM part WHERE p_retailprice > 950)""")
def _(t):
    p = t("part").withColumn("dir", F.concat_ws("/", "p_brand", F.col("p_size").cast("string")))
    return p.where("p_size > 25").select("dir").union(p.where("p_retailprice > 950").select("dir")).distinct()
