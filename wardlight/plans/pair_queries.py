"""Bins, pair features and the residual-based pair ranking on lineitems."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import flag
from ..operators import pairs
from .registry import Tables, query

KEY = ["l_orderkey", "l_partkey", "l_linenumber"]


def edges_sql(n: int) -> str:
    return "list_sort(list_distinct(quantile_cont(x, [" + ", ".join(f"{i / n}" for i in range(n + 1)) + "])))"


LONG_SQL = """lg AS (SELECT 'quantity' AS f, l_quantity AS x FROM lineitem UNION ALL SELECT 'price', l_extendedprice FROM lineitem
  UNION ALL SELECT 'discount', l_discount FROM lineitem UNION ALL SELECT 'line', l_linenumber::DOUBLE FROM lineitem UNION ALL SELECT 'half', (l_partkey % 2)::DOUBLE FROM lineitem)"""


def wide(t: Tables):
    return t.heavy("lineitem").select(
        *KEY, F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"),
        F.col("l_linenumber").cast("double").alias("line"), (F.col("l_partkey") % 2).cast("double").alias("half"), F.col("l_returnflag").alias("ret"),
    )


@query("J13_quantile_bin", f"""WITH {LONG_SQL}, e AS (SELECT f, {edges_sql(5)} AS e, count(DISTINCT x) AS nd FROM lg GROUP BY 1),
b AS (SELECT f, CASE WHEN nd <= 5 THEN format('{{:.1f}}', x) ELSE len(list_filter(e[2:len(e) - 1], lambda q: q <= x))::VARCHAR END AS bin FROM lg JOIN e USING (f))
SELECT f AS feature, bin, count(*)::BIGINT AS n FROM b GROUP BY 1, 2""")
def _(t):
    long = pairs.unpivot(wide(t), [], ["quantity", "price", "discount", "line", "half"])
    binned = pairs.quantile_bin(long, "feature", "value", 5, keep_small=5)
    return binned.groupBy("feature", "bin").agg(F.count("*").alias("n"))


def code_sql(x: str, f: str) -> str:
    return f"len(list_filter({f}e[2:len({f}e) - 1], lambda q: q <= {x}))"


@query("J14_pair_features", f"""WITH {LONG_SQL}, e AS (SELECT f, {edges_sql(5)} AS e FROM lg GROUP BY 1), q AS (SELECT e AS qe FROM e WHERE f = 'quantity'), d AS (SELECT e AS de FROM e WHERE f = 'discount')
SELECT l_orderkey, {code_sql('l_quantity', 'q')} || '_' || {code_sql('l_discount', 'd')} AS "I00_quantity_x_discount", {code_sql('l_quantity', 'q')} || '_' || l_returnflag AS "I01_quantity_x_ret",
format('{{:.1f}}', (l_partkey % 2)::DOUBLE) || '_' || {code_sql('l_discount', 'd')} AS "I03_half_x_discount" FROM lineitem, q, d""")
def _(t):
    listed = [("quantity", "discount"), ("quantity", "ret"), ("quantity", "absent"), ("half", "discount")]
    return pairs.pair_features(wide(t), "l_orderkey", listed, 5)


@query("J15_product_features", """SELECT l_orderkey, l_partkey, l_linenumber, round(l_quantity * l_discount, 6) AS "quantity__x__discount", round(l_extendedprice * (l_partkey % 2), 4) AS "price__x__half" FROM lineitem""")
def _(t):
    out = pairs.product_features(wide(t), [("quantity", "discount"), ("price", "half")])
    return out.select(*KEY, F.round("quantity__x__discount", 6).alias("quantity__x__discount"), F.round("price__x__half", 4).alias("price__x__half"))


T_COLS = {"late": "l_linestatus = 'F'", "third": "l_partkey % 3 = 0", "even": "l_suppkey % 2 = 0", "high_line": "l_linenumber > 4", "flag_a": "l_returnflag = 'A'", "rare": "l_partkey % 997 = 1"}
V_COLS = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "CASE WHEN l_suppkey % 10 = 3 THEN NULL ELSE l_tax END"}
RES = "(l_returnflag = 'R')::INTEGER - 0.3 + (l_partkey % 100) / 1000.0 + CASE WHEN l_linestatus = 'F' THEN l_quantity / 500.0 ELSE 0 END"
RANK_SQL = f"""base AS (SELECT {', '.join(f'({c})::INTEGER AS {n}' for n, c in T_COLS.items())}, {', '.join(f'({c})::DOUBLE AS {n}' for n, c in V_COLS.items())}, ({RES})::DOUBLE AS r FROM lineitem),
lv AS ({' UNION ALL '.join(f"SELECT '{v}' AS v, {v} AS x, r, {', '.join(T_COLS)} FROM base WHERE {v} IS NOT NULL" for v in V_COLS)}),
ed AS (SELECT v, {edges_sql(10)} AS e FROM lv GROUP BY 1),
bn AS (SELECT lv.*, len(list_filter(e[2:len(e) - 1], lambda q: q < x)) AS bin FROM lv JOIN ed USING (v)),
tl AS ({' UNION ALL '.join(f"SELECT v, '{n}' AS t, {n} AS tv, bin, x, r FROM bn" for n in T_COLS)}),
tot AS (SELECT v, t, count(*) FILTER (WHERE tv = 0) AS n0, count(*) FILTER (WHERE tv = 1) AS n1, corr(x, r) FILTER (WHERE tv = 0) AS c0, corr(x, r) FILTER (WHERE tv = 1) AS c1 FROM tl GROUP BY 1, 2),
g AS (SELECT v, t, bin, tv, count(*)::DOUBLE AS n, sum(r) AS s, sum(r * r) AS ss FROM tl GROUP BY 1, 2, 3, 4),
pd AS (SELECT v, t, sqrt(avg((a.s / a.n - b.s / b.n) ** 2)) * 100 AS d FROM (SELECT * FROM g WHERE tv = 0 AND n >= 5) a JOIN (SELECT * FROM g WHERE tv = 1 AND n >= 5) b USING (v, t, bin) GROUP BY 1, 2),
an AS (SELECT v, t, count(*) AS k, sum(n) AS n, sum(s * s / n) - sum(s) ** 2 / sum(n) AS ssb, sum(ss) - sum(s * s / n) AS ssw FROM g WHERE n >= 3 GROUP BY 1, 2),
sc AS (SELECT v, t, coalesce(d, 0) AS d, CASE WHEN k >= 4 THEN least(100, (ssb / (k - 1)) / (ssw / (an.n - k))) ELSE 0 END AS f, CASE WHEN n0 > 10 THEN c0 ELSE 0 END AS c0, CASE WHEN n1 > 10 THEN c1 ELSE 0 END AS c1, n0, n1
  FROM tot JOIN an USING (v, t) LEFT JOIN pd USING (v, t) WHERE n0 + n1 >= 200 AND n0 >= 100 AND n1 >= 100)"""


def pair_frame(t: Tables):
    ts = [flag(F.expr(c)).alias(n) for n, c in T_COLS.items()]
    vs = [F.expr(c).cast("double").alias(n) for n, c in V_COLS.items()]
    late = F.when(F.col("l_linestatus") == "F", F.col("l_quantity") / 500.0).otherwise(0.0)
    r = flag(F.col("l_returnflag") == "R") - 0.3 + (F.col("l_partkey") % 100) / 1000.0 + late
    return t.heavy("lineitem").select(*ts, *vs, r.alias("r"))


@query("J16_rank_interactions", f"""WITH {RANK_SQL} SELECT v AS vital_feature, t AS nlp_feature, round(0.4 * d + 0.4 * f + 20 * abs(c0 - c1), 5) AS interaction_score, round(d, 5) AS residual_diff_score,
round(f, 5) AS f_score, round(c0, 6) AS corr_t0, round(c1, 6) AS corr_t1, round(abs(c0 - c1), 6) AS corr_diff, n0::BIGINT AS n_t0, n1::BIGINT AS n_t1, (n0 + n1)::BIGINT AS n_total FROM sc""")
def _(t):
    out = pairs.rank_interactions(pair_frame(t), list(V_COLS), list(T_COLS), "r")
    five, six = ("interaction_score", "residual_diff_score", "f_score"), ("corr_t0", "corr_t1", "corr_diff")
    return out.select(
        "vital_feature", "nlp_feature", *[F.round(c, 5).alias(c) for c in five], *[F.round(c, 6).alias(c) for c in six], "n_t0", "n_t1", "n_total"
    )


@query("J28_cross_modal_filter", """WITH p AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'TFIDF_' ELSE '' END || p_name AS a, CASE WHEN p_partkey % 2 = 0 THEN 'TFIDF_' ELSE '' END || p_type AS b, p_retailprice AS score FROM part)
SELECT a, b, round(score, 4) AS score FROM p WHERE (a LIKE '%TFIDF\\_%' ESCAPE '\\') <> (b LIKE '%TFIDF\\_%' ESCAPE '\\')""")
def _(t):
    k = F.col("p_partkey")
    p = t("part").select(
        F.concat(F.when(k % 3 == 0, "TFIDF_").otherwise(""), "p_name").alias("a"), F.concat(F.when(k % 2 == 0, "TFIDF_").otherwise(""), "p_type").alias("b"),
        F.round("p_retailprice", 4).alias("score"),
    )
    return pairs.cross_modal(p, "a", "b")
