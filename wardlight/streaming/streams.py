"""Structured Streaming twins of the batch operators."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.exprs import US_PER_HOUR
from ..operators import models
from ..sources.export import shared_dir


def read_files(spark: SparkSession, folder: str, schema: T.StructType, pattern: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def hourly_bins(events: DataFrame, keys: Sequence[str], ts: str, value: str, delay: str = "2 hours") -> DataFrame:
    """mean, min, max and count per key and hour; rows later than ``delay`` are dropped."""
    return (
        events.where(F.col(value).isNotNull())
        .withColumn("__at", F.col(ts).cast("timestamp"))
        .withWatermark("__at", delay)
        .groupBy(F.window("__at", "1 hour"), *keys)
        .agg(F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.count("*").alias("n"))
        .select(*keys, F.col("window.start").alias("hour"), "mean", "min", "max", "n")
    )


def run_to_files(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Process everything available into Parquet files; the sink keeps each batch exactly once."""
    q = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    q.awaitTermination()
    return q


HOUR_MS = 3_600_000


class CarryForward(StatefulProcessor):
    """Last hourly mean of a key, carried over the hours until its next one.

    Hours come in finished and in order, since the aggregation before gives an hour out once the watermark has passed it. The state of a key is its
    last hour and value. A timer drops a key that has been silent for ``forget`` hours of event time; it starts anew with its next hour.
    """

    def __init__(self, keys: Sequence[str], forget: int):
        self.keys, self.forget = list(keys), forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "hour_us long, value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        fresh = pd.concat(list(rows)).sort_values("hour_us")  # one row per hour
        hours, values = fresh["hour_us"].to_numpy(np.int64), fresh["value"].to_numpy(np.float64)
        first = hours[0]
        if self.last.exists():
            hour, value = self.last.get()
            hours, values = np.append(hour, hours), np.append(value, values)
            first = hour + US_PER_HOUR
        self.last.update((int(hours[-1]), float(values[-1])))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(int(hours[-1]) // 1000 + self.forget * HOUR_MS)
        for k in range(first, int(hours[-1]) + 1, US_PER_HOUR * 100_000):
            out = np.arange(k, min(k + US_PER_HOUR * 100_000, int(hours[-1]) + 1), US_PER_HOUR)
            held = values[np.searchsorted(hours, out, "right") - 1]
            yield pd.DataFrame({**{c: [v] * len(out) for c, v in zip(self.keys, key)}, "hour_us": out, "value": held})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield pd.DataFrame({c: [] for c in [*self.keys, "hour_us", "value"]})

    def close(self) -> None:
        pass


def carried(events: DataFrame, keys: Sequence[str], ts: str, value: str, delay: str = "2 hours", forget: int = 24 * 366) -> DataFrame:
    """(keys, hour_us, value) for every hour of a key from its first to its last finished one.

    Rows up to ``delay`` late count for their hour; later ones are dropped. A busy key is combined to hourly means before it reaches its
    state, which Spark keeps in its state store and restores from the checkpoint; a lost state is an error there.
    """
    hours = (
        events.where(F.col(value).isNotNull())
        .withColumn("__at", F.col(ts).cast("timestamp"))
        .withWatermark("__at", delay)
        .groupBy(F.window("__at", "1 hour"), *keys)
        .agg(F.avg(value).alias("value"))
        .select(*keys, F.unix_micros("window.start").alias("hour_us"), F.col("value").cast("double").alias("value"), F.window_time("window").alias("__at"))
    )
    schema = T.StructType([*[events.schema[k] for k in keys], T.StructField("hour_us", T.LongType()), T.StructField("value", T.DoubleType())])
    return hours.groupBy(*keys).transformWithStateInPandas(CarryForward(keys, forget), schema, "append", "eventtime")


def step_counts(keys: Sequence[str], step_us: int):
    """Arrow batches of (keys, group, __us) -> (keys, group, step, last, n): rows of a key in one step of ``step_us`` travel as one row."""
    by = [*keys, "__group", "step"]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us = batch.column("__us").to_numpy(zero_copy_only=False)
            t = pa.Table.from_batches([batch]).append_column("step", pa.array(us // step_us))
            t = t.group_by(by).aggregate([("__us", "max"), ("__us", "count")])
            yield from t.rename_columns({"__us_max": "last", "__us_count": "n"}).select([*by, "last", "n"]).combine_chunks().to_batches()

    return counted


def window_counts(t: pa.Table, keys: Sequence[str], size: int, slide: int, after: int, upto: int, rows: int = 50_000) -> Iterator[pd.DataFrame]:
    """(keys, end, n) of the windows that end in (after, upto], from counts by step; all times are in steps. About ``rows`` counts are worked on at a time."""
    t = t.sort_by([*[(k, "ascending") for k in keys], ("step", "ascending")]).combine_chunks()
    step, n = t.column("step").to_numpy(), t.column("n").to_numpy()
    codes = [t.column(k).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy() for k in keys]
    starts = np.append(np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in codes], axis=0))), len(step))  # of a key's rows
    first = 0
    while first < len(starts) - 1:
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + rows, "right")) - 1)
        lo, hi = starts[first], starts[last]
        key = np.repeat(np.arange(last - first), np.diff(starts[first : last + 1]))
        ends = (step[lo:hi] // slide * slide + size)[:, None] - np.arange(-(-size // slide)) * slide
        used = (ends > step[lo:hi, None]) & (ends > after) & (ends <= upto)
        # key and time in one number, so that one search finds a window's first and last step
        base = int(step[lo:hi].min()) - size
        span = int(step[lo:hi].max()) - base + size + 1
        found = np.unique((key[:, None] * span + ends - base)[used])
        place, total = key * span + step[lo:hi] - base, np.append(0, np.cumsum(n[lo:hi]))
        count = total[np.searchsorted(place, found)] - total[np.searchsorted(place, found - size)]
        names = t.select(list(keys)).take(pa.array(starts[first:last])).to_pydict()
        for i in range(0, len(found), rows):
            k, end = np.divmod(found[i : i + rows], span)
            yield pd.DataFrame({**{c: np.array(v, object)[k] for c, v in names.items()}, "end": end + base, "n": count[i : i + rows]})
        first = last


class LookbackCounts(StatefulProcessor):
    """Counts in sliding windows for a group of keys, made from counts by step when the watermark passes a window's end.

    The state of a group is the counts by step that open windows can still see, and the watermark up to which windows are given out. So a row is
    held once and not once per window, and a late row counts in those of its windows that are still open. A timer at the next end of a window
    wakes a group whenever the watermark passes one.
    """

    def __init__(self, keys: Sequence[str], size: int, slide: int, step_us: int):
        self.keys, self.size, self.slide, self.step_us = list(keys), size, slide, step_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "counts binary, given long, timer_ms long")

    def combined(self, tables: list[pa.Table]) -> pa.Table:
        t = pa.concat_tables(tables).group_by([*self.keys, "step"]).aggregate([("n", "sum")])
        return t.rename_columns({"n_sum": "n"}).select([*self.keys, "step", "n"])

    def pass_on(self, fresh: Iterator[pd.DataFrame], mark_ms: int) -> Iterator[pd.DataFrame]:
        mark = mark_ms * 1000 // self.step_us
        held, timer = self.held.get() if self.held.exists() else None, None
        given, tables = mark, []
        if held is not None:
            counts, given, timer = held
            tables.append(pa.ipc.open_stream(bytes(counts)).read_all())
        schema = pa.schema([*[(k, pa.string()) for k in self.keys], ("step", pa.int64()), ("n", pa.int64())])
        for rows in fresh:
            tables.append(pa.Table.from_pandas(rows[schema.names], schema, preserve_index=False).replace_schema_metadata())
            if len(tables) > 100:
                tables = [self.combined(tables)]
        t = self.combined(tables)
        if t.num_rows:
            for out in window_counts(t, self.keys, self.size, self.slide, given, mark):
                out["end"] *= self.step_us
                yield out
        step = t.column("step").to_numpy()
        t = t.filter(pa.array(step // self.slide * self.slide + self.size > max(mark, given)))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema) as w:
            w.write_table(t)
        due = (((mark - self.size) // self.slide + 1) * self.slide + self.size) * self.step_us // 1000
        self.held.update((sink.getvalue().to_pybytes(), max(mark, given), due))
        if due != timer:
            if timer is not None and timer > mark_ms:  # Spark deletes those that are over
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield from self.pass_on(rows, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.pass_on(iter(()), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def lookback_counts(
    events: DataFrame, keys: Sequence[str], ts: str, hours: int = 24, slide_hours: int = 1, delay: str = "2 hours", groups: int = 1024
) -> DataFrame:
    """Events per key in sliding windows of the last ``hours``; ``groups`` is the number of state rows and must stay the same for a checkpoint.

    A row up to ``delay`` late counts in all its windows, a later one in those that are not given out yet; the first rows of a group have only the
    windows that the watermark has not passed when their batch begins. Needs the RocksDB state store, which is set here for the session.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    unit = math.gcd(hours, slide_hours)
    types = [T.StructField(k, T.StringType()) for k in keys]  # strings keep nulls and long integers as they are in pandas
    steps = T.StructType([*types, *[T.StructField(c, T.LongType()) for c in ("__group", "step", "last", "n")]])
    out = T.StructType([*types, T.StructField("end", T.LongType()), T.StructField("n", T.LongType())])
    # A row is too late once its last window has ended, so the event time is that end.
    counts = (
        events.where(F.col(ts).isNotNull())
        .select(*[F.col(k).cast("string").alias(k) for k in keys], F.pmod(F.xxhash64(*keys), F.lit(groups)).alias("__group"), F.unix_micros(F.col(ts).cast("timestamp")).alias("__us"))
        .mapInArrow(step_counts(keys, unit * US_PER_HOUR), steps)
        .withColumn("__last", F.timestamp_micros(F.col("last") + F.lit(hours * US_PER_HOUR)))
        .withWatermark("__last", f"{delay} {hours} hours")
        .select(*keys, "__group", "step", "n", "__last")
    )
    processor = LookbackCounts(keys, hours // unit, slide_hours // unit, unit * US_PER_HOUR)
    given = counts.groupBy("__group").transformWithStateInPandas(processor, out, "append", "eventtime")
    return given.select(*[F.col(k).cast(events.schema[k].dataType).alias(k) for k in keys], F.timestamp_micros("end").alias("until"), "n")


def carry_forward(events: DataFrame, keys: Sequence[str], ts: str, value: str, base: str, delay: str = "2 hours") -> str:
    """Run the carry-forward over everything available; returns the folder of the filled hours."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    run_to_files(carried(events, keys, ts, value, delay), f"{base}/filled", f"{base}/checkpoint")
    return f"{base}/filled"


#: keyed state with timers needs this store
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def score_stream(rows: DataFrame, id_col: str, model: models.AdditiveModel, base: str, threshold: float = 0.5, k: int = 3) -> str:
    """Score feature rows as they come and keep score, level and strongest terms; returns the folder."""
    out = f"{base}/scored"

    def score(batch: DataFrame, batch_id: int) -> None:
        bins = models.term_bins(batch, id_col, model)
        small = model.n_rows <= models.BROADCAST_ROWS
        scores = models.score_ensemble(bins, model.shapes, id_col, threshold, small)
        top = models.local_explanation(bins, model.shapes, id_col, k, small=small).groupBy(id_col).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("top_terms")  # at most k terms
        )
        scores.join(top, id_col, "left").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = rows.writeStream.foreachBatch(score).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return out


def fresh_base(spark: SparkSession) -> str:
    return shared_dir(spark)
