"""Projection, coercion and filter operators on customers (subjects), orders (admissions) and lineitems (stays)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs
from ..functions.exprs import clip, days_between, flag, hours_between
from ..operators import cohort
from .registry import Tables, query

# Birth, stay and death times follow from keys and dates of the tables.
ADM_SQL = """adm AS (SELECT o_custkey AS subject_id, o_orderkey AS hadm_id, o_orderdate AS admit_ts,
  o_orderdate + to_hours(24 * (1 + o_orderkey % 30)) AS disch_ts,
  TIMESTAMP '1973-06-01' + to_hours(24 * (o_custkey * 37 % 4000)) AS dob,
  o_orderdate + to_hours(o_orderkey % 20) AS in_ts,
  o_orderdate + to_hours(o_orderkey % 20 + o_orderkey % 97) AS out_ts,
  CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate + to_hours(o_orderkey % 150) END AS death_ts,
  o_totalprice AS price FROM orders)"""


def admissions(t: Tables):
    o = t("orders")
    day = o["o_orderdate"]
    plus = lambda ts, hours: F.timestamp_add("HOUR", hours.cast("int"), ts).cast("timestamp_ntz")
    k = o["o_orderkey"]
    dob = plus(F.lit("1973-06-01").cast("timestamp_ntz"), 24 * ((o["o_custkey"] * 37) % 4000))
    return o.select(
        o["o_custkey"].alias("subject_id"), k.alias("hadm_id"), day.alias("admit_ts"), plus(day, 24 * (1 + k % 30)).alias("disch_ts"),
        dob.alias("dob"), plus(day, k % 20).alias("in_ts"), plus(day, k % 20 + k % 97).alias("out_ts"),
        F.when(k % 4 == 0, plus(day, k % 150)).alias("death_ts"), o["o_totalprice"].alias("price"),
    )


@query("B1_coerce_numeric", """SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE substr(o_orderpriority, 1, 1) END AS DOUBLE) AS p FROM orders""")
def _(t):
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).otherwise(F.substring("o_orderpriority", 1, 1))
    return cohort.coerce_numeric(t("orders", "o_orderkey", "o_orderpriority").select("o_orderkey", raw.alias("p")), ["p"])


@query("B2_coerce_timestamp", """SELECT o_orderkey, epoch_us(TRY_CAST(CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS TIMESTAMP))::DOUBLE AS us FROM orders""")
def _(t):
    raw = F.when(F.col("o_orderkey") % 5 == 0, "n/a").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    df = cohort.coerce_timestamp(t("orders", "o_orderkey", "o_orderdate").select("o_orderkey", raw.alias("ts")), ["ts"])
    return df.select("o_orderkey", exprs.micros("ts").cast("double").alias("us"))


@query("B4_encode_gender", """WITH g AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'M' WHEN 1 THEN 'male' WHEN 2 THEN 'F' WHEN 3 THEN 'Female' ELSE 'other' END AS raw FROM customer)
SELECT c_custkey, CASE WHEN raw = 'M' THEN 1 ELSE 0 END AS gender,
  CASE WHEN lower(raw) IN ('m', 'male') THEN 'M' WHEN lower(raw) IN ('f', 'female') THEN 'F' ELSE raw END AS normalized FROM g""")
def _(t):
    k = F.col("c_custkey") % 5
    raw = F.when(k == 0, "M").when(k == 1, "male").when(k == 2, "F").when(k == 3, "Female").otherwise("other")
    return t("customer", "c_custkey").withColumn("raw", raw).select(
        "c_custkey", cohort.encode_gender("raw").alias("gender"), cohort.normalize_gender("raw").alias("normalized")
    )


@query("B5_age_at_admission", f"""WITH {ADM_SQL}, a AS (SELECT *, (epoch_us(admit_ts) - epoch_us(dob)) / 86400000000.0 / 365.25 AS age FROM adm)
SELECT hadm_id, round(age, 2) AS age FROM a WHERE round(age, 0) >= 18""")
def _(t):
    a = admissions(t)
    return a.where(cohort.is_adult("admit_ts", "dob")).select("hadm_id", F.round(cohort.age_years("admit_ts", "dob"), 2).alias("age"))


@query("B6_length_of_stay", f"""WITH {ADM_SQL} SELECT hadm_id, round((epoch_us(disch_ts) - epoch_us(admit_ts)) / 86400000000.0, 6) AS los_hospital,
round((epoch_us(out_ts) - epoch_us(in_ts)) / 86400000000.0, 6) AS los_icu FROM adm""")
def _(t):
    hospital, icu = cohort.length_of_stay("admit_ts", "disch_ts", "in_ts", "out_ts")
    return admissions(t).select("hadm_id", F.round(hospital, 6).alias("los_hospital"), F.round(icu, 6).alias("los_icu"))


@query("B7_filter_icu_hours", f"WITH {ADM_SQL} SELECT hadm_id FROM adm WHERE epoch_us(out_ts) - epoch_us(in_ts) >= 24 * 3600000000")
def _(t):
    return admissions(t).where(cohort.icu_at_least("in_ts", "out_ts", 24)).select("hadm_id")


@query("B8_filter_died_in_stay", f"WITH {ADM_SQL} SELECT hadm_id FROM adm WHERE death_ts IS NULL OR NOT (death_ts BETWEEN in_ts AND out_ts)")
def _(t):
    return admissions(t).where(cohort.survived_stay("death_ts", "in_ts", "out_ts")).select("hadm_id")


# A wide frame per order: aggregates of three measured variables, null where the variable is absent.
WIDE_SQL = """wide AS (SELECT l_orderkey, min(l_quantity) FILTER (WHERE l_returnflag = 'A') AS "A_Min", max(l_quantity) FILTER (WHERE l_returnflag = 'A') AS "A_Max",
  avg(l_extendedprice) FILTER (WHERE l_returnflag = 'R') AS "R_Avg", stddev_samp(l_extendedprice) FILTER (WHERE l_returnflag = 'R') AS "R_Std",
  min(l_tax) AS "N_Min", max(l_tax) FILTER (WHERE l_returnflag = 'N') AS "N_Max", count(*)::BIGINT AS n FROM lineitem GROUP BY 1)"""


def wide(t: Tables):
    li = t("lineitem", "l_orderkey", "l_quantity", "l_extendedprice", "l_tax", "l_returnflag")
    of = lambda f, c: F.when(F.col("l_returnflag") == f, F.col(c))
    return li.groupBy("l_orderkey").agg(
        F.min(of("A", "l_quantity")).alias("A_Min"), F.max(of("A", "l_quantity")).alias("A_Max"), F.avg(of("R", "l_extendedprice")).alias("R_Avg"),
        F.stddev_samp(of("R", "l_extendedprice")).alias("R_Std"), F.min("l_tax").alias("N_Min"), F.max(of("N", "l_tax")).alias("N_Max"),
        F.count("*").alias("n"),
    )


FLAGS_SQL = f"""{WIDE_SQL}, flags AS (SELECT *, ("A_Min" IS NOT NULL OR "A_Max" IS NOT NULL)::INTEGER AS "A_measured",
  ("R_Avg" IS NOT NULL OR "R_Std" IS NOT NULL)::INTEGER AS "R_measured", ("N_Min" IS NOT NULL OR "N_Max" IS NOT NULL)::INTEGER AS "N_measured", 0 AS "Z_measured" FROM wide)"""


@query("B9_measured_flags", f'WITH {FLAGS_SQL} SELECT l_orderkey, "A_measured", "R_measured", "N_measured", "Z_measured" FROM flags')
def _(t):
    df = cohort.measured_flags(wide(t), ["A", "R", "N", "Z"])
    return df.select("l_orderkey", "A_measured", "R_measured", "N_measured", "Z_measured")


@query("B10_measured_flags_prefix", f"""WITH {WIDE_SQL} SELECT l_orderkey, ("A_Min" IS NOT NULL OR "A_Max" IS NOT NULL)::INTEGER AS a_measured,
("R_Avg" IS NOT NULL OR "R_Std" IS NOT NULL)::INTEGER AS r_measured, 1 AS n_measured FROM wide""")
def _(t):
    return cohort.measured_flags_prefix(wide(t), ["a", "r", "n"]).select("l_orderkey", "a_measured", "r_measured", "n_measured")


@query("B11_select_variables", f"""WITH {FLAGS_SQL} SELECT v AS variable, round(s, 6) AS share, (s >= 0.8)::INTEGER AS kept FROM (
SELECT unnest(['A_measured', 'R_measured', 'N_measured', 'Z_measured']) AS v, unnest([avg("A_measured"), avg("R_measured"), avg("N_measured"), avg("Z_measured")]) AS s FROM flags)""")
def _(t):
    df = cohort.measured_flags(wide(t), ["A", "R", "N", "Z"])
    shares = cohort.variable_shares(df, ["A_measured", "R_measured", "N_measured", "Z_measured"], 0.8)
    return shares.select("variable", F.round("share", 6).alias("share"), "kept")


@query("B12_filter_missing_third", f'WITH {FLAGS_SQL} SELECT l_orderkey FROM flags WHERE (1 - "A_measured") + (1 - "R_measured") + (1 - "N_measured") <= 1')
def _(t):
    return cohort.filter_missing_third(wide(t), ["A", "R", "N"]).select("l_orderkey")


REMOVE_SQL = f"""{FLAGS_SQL}, rem AS (SELECT DISTINCT l_orderkey FROM flags JOIN orders ON o_orderkey = l_orderkey
  WHERE (o_custkey % 80) < 18 OR o_orderkey % 9 > 7 OR (1 - "A_measured") + (1 - "R_measured") + (1 - "N_measured") > 1)"""


def remove(t: Tables):
    df = cohort.measured_flags(wide(t), ["A", "R", "N"])
    ages = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 80).alias("age"), F.greatest(F.col("o_orderkey") % 9 - 7, F.lit(0)).alias("prior"))
    return cohort.remove_set(df.join(ages, "l_orderkey"), "l_orderkey", "age", "prior", ["A_measured", "R_measured", "N_measured"])


@query("B13_remove_set", f"WITH {REMOVE_SQL} SELECT l_orderkey FROM rem")
def _(t):
    return remove(t)


@query("B14_apply_remove_set", f"""WITH {REMOVE_SQL} SELECT 'cohort' AS name, count(*)::BIGINT AS n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM rem)
UNION ALL SELECT 'train', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM rem)""")
def _(t):
    tables = {"cohort": t("orders").select(F.col("o_orderkey").alias("l_orderkey")), "train": t("lineitem", "l_orderkey")}
    kept = cohort.apply_remove_set(tables, remove(t), "l_orderkey")
    count = lambda name: kept[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    return count("cohort").unionByName(count("train"))


@query("B15_drop_leakage", "SELECT l_orderkey, l_quantity FROM lineitem")
def _(t):
    df = t("lineitem").select(
        "l_orderkey", "l_quantity", F.col("l_tax").alias("TRANSFER_COUNT"), F.col("l_discount").alias("nlp_pain"), F.col("l_suppkey").alias("TFIDF_x")
    )
    return cohort.drop_leakage(df)


@query("B16_drop_id_and_time_columns", "SELECT l_quantity, l_tax FROM lineitem")
def _(t):
    df = t("lineitem").select("l_orderkey", "l_quantity", "l_tax", F.col("l_shipdate").alias("HR_Last_ChartTime"), F.col("l_linenumber").alias("Y"))
    return cohort.drop_id_and_time(df, ["l_orderkey"], "Y")


@query("B18_detect_feature_kinds", """SELECT unnest(['l_quantity', 'l_linestatus', 'half', 'l_returnflag']) AS feature, unnest(['continuous',
CASE WHEN count(DISTINCT l_linestatus) = 2 THEN 'binary' ELSE 'other' END, CASE WHEN count(DISTINCT l_orderkey % 2) = 2 THEN 'binary' ELSE 'continuous' END,
CASE WHEN count(DISTINCT l_returnflag) = 2 THEN 'binary' ELSE 'other' END]) AS kind FROM lineitem""")
def _(t):
    df = t("lineitem").select("l_quantity", "l_linestatus", (F.col("l_orderkey") % 2).alias("half"), "l_returnflag")
    return cohort.feature_kinds(df)


@query("B19_fill_constant", f"""WITH {WIDE_SQL} SELECT l_orderkey, coalesce("A_Min", -1) AS a, round(coalesce("R_Std", 0), 6) AS r,
CASE WHEN o_orderstatus = 'P' THEN 'UNKNOWN' ELSE o_orderstatus END AS s FROM wide JOIN orders ON o_orderkey = l_orderkey""")
def _(t):
    o = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("s"))
    df = wide(t).select("l_orderkey", F.col("A_Min").alias("a"), F.col("R_Std").alias("r")).join(o, "l_orderkey")
    return cohort.fill_constant(df, {"a": -1.0, "r": 0.0, "s": "UNKNOWN"}).withColumn("r", F.round("r", 6))


@query("B20_align_to_schema", 'SELECT 0.0::DOUBLE AS missing, l_tax, l_quantity FROM lineitem')
def _(t):
    return cohort.align_to_schema(t("lineitem"), ["missing", "l_tax", "l_quantity"])


@query("B22_filter_notes", """SELECT doc_id FROM documents WHERE (trim(source) IN ('src1', 'src7') OR source LIKE 'src2%') AND text IS NOT NULL AND text <> ''
AND coalesce(CASE doc_id % 5 WHEN 0 THEN '1' WHEN 1 THEN '' WHEN 2 THEN '0' END, '') IN ('', '0')""")
def _(t):
    k = F.col("doc_id") % 5
    d = t("documents", "doc_id", "source", "text").withColumn("iserror", F.when(k == 0, "1").when(k == 1, "").when(k == 2, "0"))
    return cohort.filter_notes(d, "source", "text", "iserror", ["src1 ", "src7"], "src2").select("doc_id")


@query("B23_clip", "SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE greatest(5.0, least(60.0, value)) END AS v FROM events")
def _(t):
    e = t("events", "event_id", "event_type", "value")
    return e.select("event_id", clip(F.when(F.col("event_type") != "error", F.col("value")), 5, 60).alias("v"))
