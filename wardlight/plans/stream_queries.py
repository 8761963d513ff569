"""Streams over the event and order files, compared with their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models
from ..streaming import streams
from .registry import Tables, query

MARK = "(SELECT floor(epoch_us(max(ts)) / 1000) * 1000 - 2 * 3600000000 FROM events)"


def event_stream(t: Tables):
    return streams.read_files(t.spark, t.dir, t("events").schema, "events.parquet")


@query("M1_stream_hourly_bins", f"""SELECT user_id, event_type, epoch_us(date_trunc('hour', ts))::BIGINT AS hour_us, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, count(*)::BIGINT AS n
FROM events GROUP BY user_id, event_type, date_trunc('hour', ts) HAVING epoch_us(date_trunc('hour', ts)) + 3600000000 <= {MARK}""")
def _(t):
    base = streams.fresh_base(t.spark)
    streams.run_to_files(streams.hourly_bins(event_stream(t), ["user_id", "event_type"], "ts", "value"), f"{base}/out", f"{base}/checkpoint")
    out = t.spark.read.parquet(f"{base}/out")
    return out.select("user_id", "event_type", F.unix_micros("hour").alias("hour_us"), F.round("mean", 6).alias("mean"), "min", "max", "n")


@query("M2_stream_locf_state", f"""WITH h AS (SELECT user_id, date_trunc('hour', ts) AS hr, avg(value) AS v FROM events GROUP BY 1, 2 HAVING epoch_us(date_trunc('hour', ts)) + 3600000000 <= {MARK} AND count(value) > 0),
s AS (SELECT user_id, min(hr) AS lo, max(hr) AS hi FROM h GROUP BY 1),
c AS (SELECT user_id, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS hr FROM s)
SELECT user_id, epoch_us(hr)::BIGINT AS hour_us, round(last_value(h.v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY hr), 6) AS value FROM c LEFT JOIN h USING (user_id, hr)""")
def _(t):
    out = streams.carry_forward(event_stream(t), ["user_id"], "ts", "value", streams.fresh_base(t.spark))
    return t.spark.read.parquet(out).select("user_id", "hour_us", F.round("value", 6).alias("value"))


@query("M3_stream_scoring", """SELECT o_orderkey, round(1 / (1 + exp(-(CASE WHEN o_totalprice < 100000 THEN -1.0 WHEN o_totalprice < 300000 THEN 0.2 ELSE 0.9 END + 0.1))), 6) AS pred_proba,
CASE WHEN o_totalprice < 100000 THEN 'Low' WHEN o_totalprice < 300000 THEN 'Elevated' ELSE 'High' END AS risk_level, 'o_totalprice' AS top_term FROM orders""")
def _(t):
    table = [(0, models.INTERCEPT, "", 0.1), *[(0, "o_totalprice", str(b + 1), s) for b, s in enumerate((-1.0, 0.2, 0.9))], (0, "o_totalprice", "0", 0.0)]
    shapes = t.spark.createDataFrame(table, "model int, term string, bin string, score double")
    model = models.AdditiveModel({"o_totalprice": [0.0, 100000.0, 300000.0, 1e12]}, [], shapes, len(table))
    orders = t("orders")
    rows = streams.read_files(t.spark, t.dir, orders.schema, "orders.parquet").select("o_orderkey", "o_totalprice")
    out = t.spark.read.parquet(streams.score_stream(rows, "o_orderkey", model, streams.fresh_base(t.spark)))
    return out.select("o_orderkey", F.round("pred_proba", 6).alias("pred_proba"), "risk_level", F.col("top_terms")[0].alias("top_term"))


@query("M4_stream_lookback_counts", f"""WITH w AS (SELECT user_id, unnest(generate_series(date_trunc('hour', ts) + INTERVAL 1 HOUR, date_trunc('hour', ts) + INTERVAL 24 HOUR, INTERVAL 1 HOUR)) AS until FROM events)
SELECT user_id, epoch_us(until)::BIGINT AS until_us, count(*)::BIGINT AS n FROM w GROUP BY 1, until HAVING epoch_us(until) <= {MARK}""")
def _(t):
    base = streams.fresh_base(t.spark)
    streams.run_to_files(streams.lookback_counts(event_stream(t), ["user_id"], "ts"), f"{base}/out", f"{base}/checkpoint")
    return t.spark.read.parquet(f"{base}/out").select("user_id", F.unix_micros("until").alias("until_us"), "n")
