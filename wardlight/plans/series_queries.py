"""Time-series operators on the event stream: user = stay, event type = concept."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ordered, series, temporal
from .registry import Tables, query

TYPES = ["click", "error", "purchase", "signup", "view"]
KEYS = ["user_id", "event_type"]


def events(t: Tables, *extra):
    return t("events", "user_id", "event_type", "ts", "value", *extra)


def cutoffs(t: Tables):
    """One cut-off per user: the start of the user's last day, so that some events follow it."""
    return t("events", "user_id", "ts").groupBy("user_id").agg(
        F.date_trunc("day", F.max("ts")).cast("timestamp_ntz").alias("out_ts")
    )


def r6(c):
    """Six digits; exact decimals that tie at the seventh are moved off the edge (as in the SQL)."""
    return F.round((F.col(c) if isinstance(c, str) else c) + 2e-9, 6)


CUT_SQL = "cut AS (SELECT user_id, date_trunc('day', max(ts))::TIMESTAMP AS out_ts FROM events GROUP BY user_id)"

GRID_SQL = """
h AS (SELECT user_id, event_type, date_trunc('hour', ts) AS hr, avg(value) AS v
      FROM events WHERE value IS NOT NULL GROUP BY 1, 2, 3),
s AS (SELECT user_id, event_type, count(*) AS n, min(ts) AS lo, max(ts) AS hi FROM events WHERE value IS NOT NULL GROUP BY 1, 2),
short AS (SELECT user_id, event_type FROM s WHERE n = 1 OR epoch_us(hi) - epoch_us(lo) < 3600000000),
cells AS (SELECT user_id, event_type, unnest(generate_series(date_trunc('hour', lo), date_trunc('hour', hi), INTERVAL 1 HOUR)) AS hr
          FROM s ANTI JOIN short USING (user_id, event_type)),
grid AS (
  SELECT c.user_id, c.event_type, c.hr AS tm,
         last_value(h.v IGNORE NULLS) OVER (PARTITION BY c.user_id, c.event_type ORDER BY c.hr) AS v
  FROM cells c LEFT JOIN h USING (user_id, event_type, hr)
  UNION ALL
  SELECT e.user_id, e.event_type, e.ts, e.value FROM events e SEMI JOIN short USING (user_id, event_type)
  WHERE e.value IS NOT NULL)
"""

STATS_SQL = f"""
{GRID_SQL},
st AS (SELECT user_id, event_type, min(v) AS v_min, max(v) AS v_max, avg(v) AS v_avg, median(v) AS v_median,
              stddev_samp(v) AS v_std, count(v) AS v_count,
              regr_slope(v, floor(epoch_us(tm) / 1e6) - 1704067200.0) AS v_slope
       FROM grid GROUP BY 1, 2)
"""


@query("E9_locf", f"WITH {GRID_SQL} SELECT user_id, event_type, epoch_us(tm)::BIGINT AS at_us, round(v + 2e-9, 6) AS v FROM grid")
def _(t):
    g = series.locf_grid(events(t), KEYS, "ts", "value")
    return g.select(*KEYS, F.col("at_us").cast("long"), r6("value").alias("v"))


@query("D1_series_stats", f"""WITH {STATS_SQL}
SELECT user_id, event_type, round(v_min + 2e-9, 6) AS v_min, round(v_max + 2e-9, 6) AS v_max, round(v_avg + 2e-9, 6) AS v_avg,
       round(v_median + 2e-9, 6) AS v_median, round(v_std + 2e-9, 6) AS v_std, v_count::BIGINT AS v_count FROM st""")
def _(t):
    s = series.locf_stats(events(t), KEYS, "ts", "value")
    return s.select(*KEYS, *[r6(c).alias(c) for c in ("v_min", "v_max", "v_avg", "v_median", "v_std")], F.col("v_count").cast("long"))


@query("D2_series_stats_raw", "WITH u AS (SELECT DISTINCT user_id FROM events), " + ", ".join(
    f"""{c} AS (SELECT user_id, min(value) AS mn, max(value) AS mx, avg(value) AS av, arg_max(value, ts) AS la, count(value) AS n
        FROM events WHERE event_type = '{c}' AND value IS NOT NULL GROUP BY 1)""" for c in ("click", "view")) + """
SELECT u.user_id, """ + ", ".join(
    f"""coalesce({c}.mn, -1) AS {c}_Min, coalesce({c}.mx, -1) AS {c}_Max, round(coalesce({c}.av, -1) + 2e-9, 6) AS {c}_Mean,
        coalesce({c}.la, -1) AS {c}_Last, coalesce({c}.n, 0)::BIGINT AS {c}_Count,
        CASE WHEN coalesce({c}.n, 0) > 0 THEN 1 ELSE 0 END AS {c}_Measured""" for c in ("click", "view")) + """
FROM u LEFT JOIN click USING (user_id) LEFT JOIN view USING (user_id) WHERE click.n IS NOT NULL OR view.n IS NOT NULL""")
def _(t):
    df = series.stats_with_default(events(t), "user_id", "event_type", "ts", "value", ["click", "view"], -1.0, False)
    return df.select(*[r6(c).alias(c) if c.endswith("_Mean") else F.col(c) for c in df.columns])


@query("D3_series_stats_serving", "WITH " + ", ".join(
    f"""{c} AS (SELECT user_id, min(value) AS mn, max(value) AS mx, avg(value) AS av, arg_max(value, ts) AS la, count(value) AS n,
        stddev_pop(value) AS sd, median(value) AS md
        FROM events WHERE event_type = '{c}' GROUP BY 1)""" for c in ("error", "purchase")) + """,
u AS (SELECT user_id FROM error UNION SELECT user_id FROM purchase)
SELECT u.user_id, """ + ", ".join(
    f"""coalesce({c}.mn, 0) AS {c}_Min, coalesce({c}.mx, 0) AS {c}_Max, round(coalesce({c}.av, 0) + 2e-9, 6) AS {c}_Mean,
        coalesce({c}.la, 0) AS {c}_Last, coalesce({c}.n, 0)::BIGINT AS {c}_Count, round(coalesce({c}.sd, 0) + 2e-9, 6) AS {c}_Std,
        round(coalesce({c}.md, 0) + 2e-9, 6) AS {c}_Median, CASE WHEN coalesce({c}.n, 0) > 0 THEN 1 ELSE 0 END AS {c}_Measured"""
    for c in ("error", "purchase")) + """
FROM u LEFT JOIN error USING (user_id) LEFT JOIN purchase USING (user_id)""")
def _(t):
    df = series.stats_with_default(events(t), "user_id", "event_type", "ts", "value", ["error", "purchase"], 0.0, True)
    return df.select(*[r6(c).alias(c) if c.endswith(("_Mean", "_Std", "_Median")) else F.col(c) for c in df.columns])


@query("D4_last_value", """SELECT user_id, event_type, arg_max(value, ts) AS v_last, epoch_us(max(ts))::BIGINT AS last_us
FROM events GROUP BY 1, 2""")
def _(t):
    from ..functions.exprs import micros

    df = series.last_value(events(t), KEYS, "ts", "value")
    return df.select(*KEYS, "v_last", micros("v_last_time").alias("last_us"))


@query("D5_slope", f"WITH {STATS_SQL} SELECT user_id, event_type, round(v_slope * 1000000 + 2e-9, 6) AS slope_micro FROM st")
def _(t):
    s = series.locf_stats(events(t), KEYS, "ts", "value")
    return s.select(*KEYS, r6(F.col("v_slope") * 1e6).alias("slope_micro"))


@query("D6_window_counts", f"""WITH {CUT_SQL}
SELECT e.user_id, e.event_type,
       count(*) FILTER (WHERE (epoch_us(out_ts) - epoch_us(ts)) <= 24 * 3600000000)::BIGINT AS n_24h,
       count(*) FILTER (WHERE (epoch_us(out_ts) - epoch_us(ts)) <= 48 * 3600000000)::BIGINT AS n_48h
FROM events e JOIN cut USING (user_id) GROUP BY 1, 2""")
def _(t):
    return series.window_counts(t("events", *KEYS, "ts"), cutoffs(t), "user_id", KEYS, "ts", "out_ts")


@query("D7_urine_stats", """SELECT user_id, round(median(value) + 2e-9, 6) AS out_median, max(value) AS out_max, round(avg(value) + 2e-9, 6) AS out_avg
FROM events WHERE event_type IN ('click', 'view') GROUP BY 1""")
def _(t):
    rows = t("events", "user_id", "event_type", "value").where(F.col("event_type").isin("click", "view"))
    s = series.series_stats(rows, ["user_id"], "value")
    return s.select("user_id", r6("v_median").alias("out_median"), F.col("v_max").alias("out_max"), r6("v_avg").alias("out_avg"))


@query("D8_urine_out_24h", f"""WITH {CUT_SQL}
SELECT user_id, round(sum(coalesce(value, 0)), 6) AS out_24h FROM events JOIN cut USING (user_id)
WHERE epoch_us(out_ts) - epoch_us(ts) BETWEEN 0 AND 24 * 3600000000 GROUP BY 1""")
def _(t):
    near = temporal.lookback(t("events", "user_id", "ts", "value"), cutoffs(t), "user_id", "ts", "out_ts", 24)
    return near.groupBy("user_id").agg(r6(F.sum(F.coalesce("value", F.lit(0.0)))).alias("out_24h"))


@query("D15_population_median_fill", """WITH grid AS (SELECT u.user_id, c.event_type FROM (SELECT DISTINCT user_id FROM events) u,
  (SELECT DISTINCT event_type FROM events) c),
s AS (SELECT user_id, event_type, avg(value) AS a, max(value) AS b, stddev_samp(value) AS d, count(value) AS n FROM events GROUP BY 1, 2),
m AS (SELECT event_type, median(a) AS ma, median(b) AS mb, median(d) AS md FROM s GROUP BY 1)
SELECT user_id, event_type, coalesce(n, 0)::BIGINT AS n,
  round(CASE WHEN coalesce(n, 0) = 0 THEN coalesce(a, ma) ELSE a END + 2e-9, 6) AS a,
  round(CASE WHEN coalesce(n, 0) = 0 THEN coalesce(b, mb) ELSE b END + 2e-9, 6) AS b,
  round(CASE WHEN coalesce(n, 0) = 0 THEN coalesce(d, md) ELSE d END + 2e-9, 6) AS d
FROM grid LEFT JOIN s USING (user_id, event_type) LEFT JOIN m USING (event_type)""")
def _(t):
    e = events(t)
    cells = e.select("user_id").distinct().select("user_id", F.explode(F.array(*[F.lit(c) for c in TYPES])).alias("event_type"))
    s = e.groupBy(*KEYS).agg(
        F.avg("value").alias("a"), F.max("value").alias("b"), F.stddev_samp("value").alias("d"), F.count("value").alias("n")
    )
    filled = series.fill_population_median(cells.join(s, KEYS, "left"), "event_type", "n", ["a", "b", "d"])
    return filled.select(*KEYS, F.coalesce("n", F.lit(0)).alias("n"), *[r6(c).alias(c) for c in "abd"])


@query("F1_bin_series", f"""WITH {CUT_SQL},
b AS (SELECT e.*, floor((epoch_us(ts) - (epoch_us(out_ts) - 48 * 3600000000)) / 3600000000.0)::INTEGER AS bin FROM events e JOIN cut USING (user_id))
SELECT event_id, user_id, bin FROM b WHERE bin BETWEEN 0 AND 47""")
def _(t):
    e = t("events", "event_id", "user_id", "ts").join(cutoffs(t), "user_id")
    return e.select("event_id", "user_id", temporal.bin_index("ts", "out_ts", 48, 60).alias("bin")).where("bin IS NOT NULL")


BINS_SQL = f"""{CUT_SQL},
b AS (SELECT e.user_id, e.event_type, value, floor((epoch_us(ts) - (epoch_us(out_ts) - 48 * 3600000000)) / (240 * 60000000.0))::INTEGER AS bin
      FROM events e JOIN cut USING (user_id)),
st AS (SELECT user_id, event_type AS feature, bin, avg(value) AS mean, min(value) AS min, max(value) AS max, stddev_samp(value) AS std, median(value) AS median
      FROM b WHERE bin BETWEEN 0 AND 11 GROUP BY 1, 2, 3)"""


@query("F2_bin_stats", f"""WITH {BINS_SQL} SELECT user_id, feature, bin, round(mean + 2e-9, 6) AS mean, round(min + 2e-9, 6) AS min, round(max + 2e-9, 6) AS max,
round(std + 2e-9, 6) AS std, round(median + 2e-9, 6) AS median FROM st""")
def _(t):
    e = events(t).withColumnRenamed("event_type", "feature")
    s = series.bin_stats(e, cutoffs(t), "user_id", "feature", "ts", "value", "out_ts", 48, 240)
    return s.select("user_id", "feature", "bin", *[r6(c).alias(c) for c in ("mean", "min", "max", "std", "median")])


CARRY_SQL = f"""{BINS_SQL},
cells AS (SELECT user_id, feature, bin::INTEGER AS bin FROM cut, (SELECT DISTINCT event_type AS feature FROM events), generate_series(0, 11) AS g(bin)),
c AS (SELECT cells.user_id, cells.feature, cells.bin,
        last_value(mean IGNORE NULLS) OVER (PARTITION BY cells.user_id, cells.feature ORDER BY cells.bin) AS v
      FROM cells LEFT JOIN st USING (user_id, feature, bin)),
m AS (SELECT feature, median(v) AS med FROM c GROUP BY 1),
full_ AS (SELECT user_id, feature, bin, coalesce(v, med) AS v FROM c JOIN m USING (feature))"""


def carried(t):
    e = events(t).withColumnRenamed("event_type", "feature")
    s = series.bin_stats(e, cutoffs(t), "user_id", "feature", "ts", "value", "out_ts", 48, 240).select("user_id", "feature", "bin", "mean")
    grid = series.bin_grid(cutoffs(t), "user_id", TYPES, 12).join(s, ["user_id", "feature", "bin"], "left")
    return series.carry_bins(grid, "user_id", "feature", "mean")


@query("E10_locf_on_bins", f"WITH {CARRY_SQL} SELECT user_id, feature, bin, round(v + 2e-9, 6) AS v FROM full_")
def _(t):
    return carried(t).select("user_id", "feature", "bin", r6("mean").alias("v"))


@query("F3_to_tensor", f"""WITH {CARRY_SQL},
r AS (SELECT user_id, bin, list(round(v::FLOAT::DOUBLE, 3) ORDER BY feature) AS row FROM full_ GROUP BY 1, 2)
SELECT user_id, list(row ORDER BY bin)::VARCHAR AS tensor FROM r GROUP BY 1""")
def _(t):
    tensor = series.to_tensor(carried(t), "user_id", "feature", "mean")
    cell = lambda x: F.round(x.cast("double"), 3).cast("string")
    text = F.transform("tensor", lambda r: F.concat(F.lit("["), F.array_join(F.transform(r, cell), ", "), F.lit("]")))
    return tensor.select("user_id", F.concat(F.lit("["), F.array_join(text, ", "), F.lit("]")).alias("tensor"))


@query("F4_scan_fallback", """WITH s AS (SELECT l_orderkey AS hadm, CASE WHEN l_linenumber > 5 THEN NULL ELSE l_suppkey END AS stay FROM lineitem)
SELECT coalesce(stay, hadm) AS entity, count(*)::BIGINT AS n FROM s GROUP BY 1""")
def _(t):
    rows = t("lineitem", "l_orderkey", "l_suppkey", "l_linenumber").withColumn("stay", F.when(F.col("l_linenumber") <= 5, F.col("l_suppkey")))
    return rows.groupBy(F.coalesce("stay", "l_orderkey").alias("entity")).agg(F.count("*").alias("n"))


FEATURE_NAMES = [f"{c}_{m}" for c in TYPES for m in ("Min", "Max", "Avg", "Median", "Std", "Count", "Last", "Slope", "n_24h", "n_48h")]


def vital_lab_features(t: Tables):
    """Carry-forward statistics, last value, slope and look-back counts of all concepts in one long pass."""
    e = events(t)
    cut = cutoffs(t)
    stats = series.locf_stats(e, KEYS, "ts", "value")
    last = series.last_value(e, KEYS, "ts", "value").drop("v_last_time")
    counts = series.window_counts(e, cut, "user_id", KEYS, "ts", "out_ts")
    measured = stats.join(last, KEYS, "left").join(counts, KEYS, "left")
    cells = cut.select("user_id", F.explode(F.array(*[F.lit(c) for c in TYPES])).alias("event_type"))
    filled = series.fill_population_median(
        cells.join(measured, KEYS, "left"), "event_type", "v_count", ["v_min", "v_max", "v_avg", "v_median", "v_std"]
    )
    named = filled.select(
        *KEYS, F.col("v_min").alias("Min"), F.col("v_max").alias("Max"), F.col("v_avg").alias("Avg"), F.col("v_median").alias("Median"),
        F.col("v_std").alias("Std"), F.col("v_count").alias("Count"), F.col("v_last").alias("Last"), F.col("v_slope").alias("Slope"),
        "n_24h", "n_48h",
    )
    return series.wide_stats(named, "user_id", "event_type", TYPES, ["Min", "Max", "Avg", "Median", "Std", "Count", "Last", "Slope", "n_24h", "n_48h"])


F5_SQL = f"""WITH {STATS_SQL}, {CUT_SQL},
la AS (SELECT user_id, event_type, arg_max(value, ts) AS v_last FROM events GROUP BY 1, 2),
wc AS (SELECT e.user_id, e.event_type,
       count(*) FILTER (WHERE (epoch_us(out_ts) - epoch_us(ts)) <= 24 * 3600000000) AS n_24h,
       count(*) FILTER (WHERE (epoch_us(out_ts) - epoch_us(ts)) <= 48 * 3600000000) AS n_48h
       FROM events e JOIN cut USING (user_id) GROUP BY 1, 2),
med AS (SELECT event_type, median(v_min) AS m1, median(v_max) AS m2, median(v_avg) AS m3, median(v_median) AS m4, median(v_std) AS m5 FROM st GROUP BY 1),
f AS (SELECT c.user_id, c.event_type,
       CASE WHEN v_count IS NULL THEN m1 ELSE v_min END AS "Min", CASE WHEN v_count IS NULL THEN m2 ELSE v_max END AS "Max",
       CASE WHEN v_count IS NULL THEN m3 ELSE v_avg END AS "Avg", CASE WHEN v_count IS NULL THEN m4 ELSE v_median END AS "Median",
       CASE WHEN v_count IS NULL THEN m5 ELSE v_std END AS "Std", v_count AS "Count", v_last AS "Last", v_slope * 1000000 AS "Slope", n_24h, n_48h
      FROM (SELECT user_id, event_type FROM cut, (SELECT DISTINCT event_type FROM events)) c
      LEFT JOIN st USING (user_id, event_type) LEFT JOIN la USING (user_id, event_type) LEFT JOIN wc USING (user_id, event_type)
      LEFT JOIN med USING (event_type))
SELECT user_id, """ + ", ".join(
    (f"max(CASE WHEN event_type = '{c}' THEN {m} END)::BIGINT AS {c}_{m}" if m.startswith("n_") or m == "Count" else
     f"""round(max(CASE WHEN event_type = '{c}' THEN "{m}" END) + 2e-9, 6) AS {c}_{m}""")
    for c in TYPES for m in ("Min", "Max", "Avg", "Median", "Std", "Count", "Last", "Slope", "n_24h", "n_48h")) + " FROM f GROUP BY user_id"


@query("F5_vital_lab_features", F5_SQL.replace("THEN Count END", 'THEN "Count" END'))
def _(t):
    df = vital_lab_features(t)
    out = []
    for c in df.columns:
        if c.endswith("_Slope"):
            out.append(r6(F.col(c) * 1e6).alias(c))
        elif c.endswith(("_Count", "_24h", "_48h")) or c == "user_id":
            out.append(F.col(c).cast("long").alias(c))
        else:
            out.append(r6(c).alias(c))
    return df.select(*out)


def pair_sql(tol_hours: int) -> str:
    return f"""
l AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'purchase'),
r AS (SELECT event_id AS rid, user_id, ts AS rts, CASE WHEN value > 1 THEN value / 100 ELSE value END AS rv FROM events WHERE event_type = 'view'),
p AS (SELECT l.*, rid, rts, rv, abs(epoch_us(l.ts) - epoch_us(rts)) AS gap,
        row_number() OVER (PARTITION BY event_id ORDER BY abs(epoch_us(l.ts) - epoch_us(rts)), rts, rid) AS k
      FROM l JOIN r USING (user_id) WHERE abs(epoch_us(l.ts) - epoch_us(rts)) <= {tol_hours} * 3600000000),
n AS (SELECT * FROM p WHERE k = 1)"""


def two_sides(t):
    e = t("events", "event_id", "user_id", "ts", "event_type", "value")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts", "value")
    right = e.where("event_type = 'view'").select(F.col("event_id").alias("rid"), "user_id", F.col("ts").alias("rts"), F.col("value").alias("rv"))
    return left, right


@query("C12_nearest_asof_join", f"WITH {pair_sql(1)} SELECT event_id, user_id, round(rv + 2e-9, 6) AS rv, round(gap / 1e6 + 2e-9, 6) AS gap_seconds FROM n")
def _(t):
    left, right = two_sides(t)
    right = right.withColumn("rv", F.when(F.col("rv") > 1, F.col("rv") / 100).otherwise(F.col("rv")))
    out = temporal.nearest(left, right, "user_id", "ts", "rts", "rv", "rid", 3600, "rv", "gap_seconds")
    return out.select("event_id", "user_id", r6("rv").alias("rv"), r6("gap_seconds").alias("gap_seconds"))


@query("F6_pf_ratio", f"WITH {pair_sql(6)} SELECT user_id, round(median(value / rv) + 2e-9, 6) AS ratio_median, count(*)::BIGINT AS n_pairs FROM n WHERE rv > 0 GROUP BY 1")
def _(t):
    left, right = two_sides(t)
    pairs = temporal.pf_ratio(left, right, "user_id", "ts", "value", "rts", "rv", "rid", 6 * 3600)
    med = ordered.grouped_quantiles(pairs, ["user_id"], "ratio", {"m": 0.5})
    n = pairs.groupBy("user_id").agg(F.count("*").alias("n_pairs"))
    return n.join(med, "user_id").select("user_id", r6("m").alias("ratio_median"), "n_pairs")
