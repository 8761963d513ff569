"""First/last/n-th row operators and ordered concatenation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import notes
from ..operators import documents, ordered, pairs
from .registry import query
from .row_queries import ADM_SQL, admissions
from .text_sql import CLEAN_TEXT


@query("E1_first_stay", f"""WITH {ADM_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY in_ts, hadm_id) AS rn FROM adm)
SELECT subject_id, hadm_id, epoch_us(in_ts)::BIGINT AS in_us FROM r WHERE rn = 1""")
def _(t):
    from ..functions.exprs import micros

    return ordered.first_per_key(admissions(t).select("subject_id", "in_ts", "hadm_id"), ["subject_id"], ["in_ts", "hadm_id"]).select(
        "subject_id", "hadm_id", micros("in_ts").alias("in_us")
    )


@query("E2_prior_admissions", f"""WITH {ADM_SQL} SELECT hadm_id, subject_id, (row_number() OVER (PARTITION BY subject_id ORDER BY admit_ts, hadm_id) - 1)::BIGINT AS n_prior FROM adm""")
def _(t):
    a = admissions(t).select("hadm_id", "subject_id", "admit_ts")
    ranked = ordered.positions(a, ["subject_id"], ordered.day_bucket("admit_ts"), [F.col("admit_ts"), F.col("hadm_id")])
    return ranked.select("hadm_id", "subject_id", (F.col("rn") - 1).alias("n_prior"))


@query("E3_last_stay_per_admission", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_suppkey DESC, l_quantity DESC) AS rn FROM lineitem)
SELECT l_orderkey, l_suppkey, l_quantity FROM r WHERE rn = 1""")
def _(t):
    li = t("lineitem", "l_orderkey", "l_shipdate", "l_suppkey", "l_quantity")
    return ordered.last_per_key(li, ["l_orderkey"], ["l_shipdate", "l_suppkey", "l_quantity"]).select("l_orderkey", "l_suppkey", "l_quantity")


@query("E4_max_outtime_per_admission", "SELECT user_id, epoch_us(max(ts))::BIGINT AS out_us FROM events GROUP BY 1")
def _(t):
    from ..functions.exprs import micros

    return t("events", "user_id", "ts").groupBy("user_id").agg(F.max(micros("ts")).alias("out_us"))


@query("E5_first_n_notes", """WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents)
SELECT source, doc_id, rn::INTEGER AS note_rank FROM r WHERE rn <= 20""")
def _(t):
    return documents.first_n_notes(t("documents", "source", "doc_id"), "source", ["doc_id"], 20)


BUDGET = 3000


@query("E6_concat_with_budget", f"""WITH RECURSIVE c AS (SELECT conv_id, turn, {CLEAN_TEXT('text')} AS x FROM conversations),
n AS (SELECT conv_id, x, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM c),
f AS (SELECT conv_id, x, rn FROM n WHERE rn <= 5),
g(conv_id, rn, used, txt) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, 0::BIGINT, ''::VARCHAR FROM f
  UNION ALL
  SELECT g.conv_id, f.rn, CASE WHEN f.x <> '' AND g.used + length(f.x) <= {BUDGET} THEN g.used + length(f.x) ELSE g.used END,
    CASE WHEN f.x <> '' AND g.used + length(f.x) <= {BUDGET} THEN CASE WHEN g.txt = '' THEN f.x ELSE g.txt || ' ' || f.x END ELSE g.txt END
  FROM g JOIN f ON f.conv_id = g.conv_id AND f.rn = g.rn + 1)
SELECT conv_id, md5(txt) AS clean_md5, length(txt)::BIGINT AS n FROM g QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY rn DESC) = 1 AND txt <> ''""")
def _(t):
    c = t("conversations", "conv_id", "turn", "text").withColumn("text", notes.clean_text("text"))
    out = documents.concat_with_budget(c, "conv_id", ["turn"], "text", 5, BUDGET)
    return out.select("conv_id", F.md5("clean_text").alias("clean_md5"), F.length("clean_text").cast("long").alias("n"))


@query("E7_concat_notes", """SELECT conv_id, md5(string_agg(text, '\n' ORDER BY turn)) AS text_md5, count(*)::BIGINT AS n_notes FROM conversations GROUP BY 1""")
def _(t):
    out = documents.concat_notes(t("conversations", "conv_id", "turn", "text"), "conv_id", F.floor(F.col("turn") / 256).cast("int"), ["turn"], "text", "\n")
    return out.select("conv_id", F.md5("text").alias("text_md5"), "n_notes")


# Every third document is quoted later, in part and within blanks.
@query("E8_dedupe_notes", """WITH d AS (SELECT lang || source AS key, doc_id AS o, text FROM documents
  UNION ALL SELECT lang || source, doc_id + 1000000000, '  ' || substring(text, 10, 40 + doc_id % 200) || chr(10) FROM documents WHERE doc_id % 3 = 0),
l AS (SELECT key, text, row_number() OVER (PARTITION BY key ORDER BY length(text) DESC, o) AS r FROM d),
f AS (SELECT key, text, row_number() OVER (PARTITION BY key ORDER BY o) AS r FROM d),
n AS (SELECT key, o, regexp_replace(text, '^[\t-\r\x1c-\x1f ]+|[\t-\r\x1c-\x1f ]+$', '', 'g') AS t FROM d),
c AS (SELECT key, list_reduce(list({'t': t, 'n': 1} ORDER BY o), lambda a, x: CASE WHEN contains(a.t, x.t) THEN a ELSE {'t': a.t || chr(10) || chr(10) || x.t, 'n': a.n + 1} END) AS c FROM n WHERE t <> '' GROUP BY key)
SELECT key, md5(l.text) AS longest, md5(f.text) AS first, md5(c.c.t) AS unique_concat, c.c.n::BIGINT AS n_unique
FROM l JOIN f USING (key) JOIN c USING (key) WHERE l.r = 1 AND f.r = 1""")
def _(t):
    d = t("documents", "doc_id", "lang", "source", "text").select(F.concat("lang", "source").alias("key"), F.col("doc_id").alias("o"), "text")
    part = F.expr("substring(text, 10, cast(40 + o % 200 as int))")
    d = d.unionByName(d.where("o % 3 = 0").select("key", F.col("o") + 1_000_000_000, F.concat(F.lit("  "), part, F.lit("\n")).alias("text")).toDF("key", "o", "text"))
    longest = documents.keep_longest(d, "key", "o", "text").select("key", F.md5("text").alias("longest"))
    first = documents.keep_first(d, "key", "o", "text").select("key", F.md5("text").alias("first"))
    unique = documents.concat_contained(d, "key", "o", "text")
    return longest.join(first, "key").join(unique.select("key", F.md5("text").alias("unique_concat"), F.col("n_notes").alias("n_unique")), "key")


@query("E11_top_k_by_score", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 100")
def _(t):
    return pairs.top_scores(t("part", "p_partkey", "p_retailprice"), "p_retailprice", 100, ["p_partkey"])


@query("E12_top_k_per_row", """WITH r AS (SELECT user_id, event_id, value - 50 AS score, row_number() OVER (PARTITION BY user_id ORDER BY abs(value - 50) DESC, event_id) AS k FROM events)
SELECT user_id, event_id, round(score, 6) AS score, k::INTEGER AS k FROM r WHERE k <= 10""")
def _(t):
    e = t("events", "user_id", "event_id", "value").withColumn("score", F.col("value") - 50)
    top = ordered.top_n_per_key(e, ["user_id"], [F.desc(F.abs("score")), F.col("event_id")], 10, "k")
    return top.select("user_id", "event_id", F.round("score", 6).alias("score"), "k")


@query("E13_first_k_matches", """SELECT doc_id, array_to_string(regexp_extract_all(lower(text), 'tion[a-z]*')[1:5], '|') AS first5 FROM documents""")
def _(t):
    return t("documents", "doc_id", "text").select("doc_id", F.array_join(notes.first_matches("text", "tion[a-z]*", 5), "|").alias("first5"))


@query("E14_priority_select", """WITH f AS (SELECT conv_id, role, min(turn) AS first_turn FROM conversations GROUP BY 1, 2),
r AS (SELECT c.conv_id, c.text, CASE c.role WHEN 'assistant' THEN 1 WHEN 'system' THEN 2 ELSE 3 END AS p, CASE WHEN c.role NOT IN ('assistant', 'system') THEN first_turn END AS late, c.role, turn
  FROM conversations c JOIN f USING (conv_id, role))
SELECT conv_id, md5(substring(string_agg(text, E'\\n\\n---\\n\\n' ORDER BY p, late NULLS FIRST, role, turn), 1, 2000)) AS combined_md5 FROM r GROUP BY 1""")
def _(t):
    c = t("conversations", "conv_id", "turn", "role", "text")
    return documents.priority_concat(c, "conv_id", "role", "turn", "text", ["assistant", "system"], max_length=2000).select("conv_id", F.md5("combined").alias("combined_md5"))


@query("E15_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 200")
def _(t):
    return t("orders", "o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(200)
