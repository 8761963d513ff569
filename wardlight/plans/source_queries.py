"""Readers and writers, exercised on files derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import vector_md5, vector_md5_sql
from ..sources import export, ingest
from .registry import query


def schema(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)


def as_csv(df, path):
    df.write.mode("overwrite").options(header=True, escape='"').csv(path)
    return path


@query("A1_ingest_csv_dir", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(t):
    base = export.shared_dir(t.spark)
    as_csv(t("customer"), f"{base}/in/customer.csv")
    ddl = "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING"
    ingest.ingest_csv_dir(t.spark, f"{base}/in", f"{base}/out", {"customer": schema(ddl)})
    return t.spark.read.parquet(f"{base}/out/customer")


@query("A2_scan_events", """SELECT user_id, event_type, epoch_us(ts)::BIGINT AS us, value FROM events
WHERE event_type IN ('click', 'view') AND value IS NOT NULL AND user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 2000)""")
def _(t):
    from ..functions.exprs import micros

    cohort = t("customer").where("c_acctbal > 2000").select(F.col("c_custkey").alias("user_id"))
    df = ingest.scan_events(t("events"), "event_type", ["click", "view"], "value", ["user_id", "event_type", "ts", "value"], cohort, "user_id")
    return df.select("user_id", "event_type", micros("ts").alias("us"), "value")


@query("A3_scan_csv", """SELECT o_custkey, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS amount FROM orders
WHERE o_totalprice > 100000 GROUP BY 1""")
def _(t):
    path = as_csv(t("orders"), f"{export.shared_dir(t.spark)}/orders.csv")
    df = ingest.scan_csv(t.spark, path, schema("o_custkey BIGINT, o_totalprice DOUBLE"))
    return df.where("o_totalprice > 100000").groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("amount"))


INPUTS_SQL = """inputs AS (SELECT o_orderkey AS id, o_orderdate AS ts, o_totalprice AS amount FROM orders
  UNION ALL SELECT l_orderkey, l_shipdate, l_extendedprice FROM lineitem)"""


def inputs(t):
    orders = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("CHARTTIME"), F.col("o_totalprice").alias("amt"))
    lines = t("lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_shipdate").alias("STARTTIME"), F.col("l_extendedprice").alias("amt"))
    times = ["STARTTIME", "CHARTTIME"]
    return ingest.scan_inputs_union([(orders, times), (None, times), (lines, times)], "id", "amt")


@query("A4_scan_inputs_union", f"WITH {INPUTS_SQL} SELECT id, epoch_us(ts)::BIGINT AS us, amount FROM inputs")
def _(t):
    from ..functions.exprs import micros

    return inputs(t).select("id", micros("ts").alias("us"), "amount")


@query("A5_union_note_files", """SELECT doc_id, length(regexp_replace(text, '\\s+', '', 'g'))::BIGINT AS n FROM documents WHERE length(trim(text)) > 0
UNION ALL SELECT conv_id * 1000 + turn + 1000000000, length(regexp_replace(text, '\\s+', '', 'g')) FROM conversations WHERE length(trim(text)) > 0""")
def _(t):
    base = export.shared_dir(t.spark)
    a = as_csv(t("documents", "doc_id", "text"), f"{base}/a.csv")
    b = as_csv(t("conversations").select((F.col("conv_id") * 1000 + F.col("turn") + 1_000_000_000).alias("doc_id"), "text"), f"{base}/b.csv")
    notes = ingest.union_note_files(t.spark, [a, f"{base}/missing.csv", b], ["doc_id", "text"], "text")
    return notes.select(F.col("doc_id").cast("long"), F.length(F.regexp_replace("text", r"\s+", "")).cast("long").alias("n"))


@query("A7_read_embeddings", f"SELECT vec_id, label, len(embedding)::INTEGER AS dim, {vector_md5_sql('embedding')} AS digest FROM embeddings")
def _(t):
    df = ingest.read_embeddings(t("embeddings", "vec_id", "embedding"), t("embeddings", "vec_id", "label"), "vec_id")
    return df.select("vec_id", "label", F.size("embedding").alias("dim"), vector_md5("embedding").alias("digest"))


@query("A8_read_interaction_list", "SELECT p_brand AS a, p_name AS b, p_size::DOUBLE AS score FROM part")
def _(t):
    path = f"{export.shared_dir(t.spark)}/pairs.txt"
    part = t("part", "p_brand", "p_name", "p_size")
    lines = part.select(F.format_string("%s & %s: %d", "p_brand", "p_name", "p_size").alias("value"))
    heads = part.select(F.format_string("Top pairs by %s", "p_brand").alias("value"))
    lines.unionByName(heads).write.text(path)
    return ingest.read_interaction_list(t.spark, path)


RUNS_SQL = """runs AS (SELECT p_brand || '/' || p_partkey % 7 || '/metrics.csv' AS file, p_size / 50.0 AS precision, (p_partkey % 100) / 100.0 AS recall,
  (p_partkey % 30) / 30.0 AS f1 FROM part)"""


def runs(t):
    return t("part").select(
        F.concat_ws("/", "p_brand", (F.col("p_partkey") % 7).cast("string"), F.lit("metrics.csv")).alias("file"),
        (F.col("p_size") / 50.0).alias("precision"), ((F.col("p_partkey") % 100) / 100.0).alias("recall"),
        ((F.col("p_partkey") % 30) / 30.0).alias("f1"),
    )


@query("A9_read_run_metrics", f"""WITH {RUNS_SQL}
SELECT DISTINCT regexp_replace(file, '/[^/]*$', '') AS dir FROM runs WHERE precision >= 0.5 AND recall >= 0.5 AND f1 >= 0.5""")
def _(t):
    path = as_csv(runs(t), f"{export.shared_dir(t.spark)}/runs.csv")
    return ingest.read_run_metrics(t.spark, [path], 0.5)


@query("A10_write_features", "SELECT l_orderkey, count(*)::BIGINT AS n, round(sum(l_quantity), 6) AS qty FROM lineitem GROUP BY 1")
def _(t):
    f = t("lineitem", "l_orderkey", "l_quantity").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 6).alias("qty"))
    return t.spark.read.parquet(export.write_features(f, export.shared_dir(t.spark)))


@query("A11_write_tensor", "SELECT vec_id, 8 AS n_rows, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings")
def _(t):
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, 8))
    path = export.write_tensor(t("embeddings").select("vec_id", rows.alias("tensor")), export.shared_dir(t.spark))
    flat = F.flatten("tensor")
    return t.spark.read.parquet(path).select(
        "vec_id", F.size("tensor").alias("n_rows"), F.round(F.aggregate(flat, F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total")
    )


@query("A12_summary_report", """WITH d AS (SELECT doc_id, CASE WHEN lang = 'fr' THEN NULL ELSE lang END AS lang, source FROM documents)
SELECT 'rows' AS item, '' AS key, count(*)::BIGINT AS n FROM d
UNION ALL SELECT 'columns', '', 3
UNION ALL SELECT 'missing', '', count(*) FILTER (WHERE lang IS NULL) FROM d
UNION ALL SELECT 'category', source, count(*) FROM d GROUP BY source""")
def _(t):
    d = t("documents").select("doc_id", F.when(F.col("lang") != "fr", F.col("lang")).alias("lang"), "source")
    return export.summary_report(d, "source")
