"""Several notes of one entity into one text, without gathering an unbounded entity."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordered import first_per_key, joined_texts, ordered_texts, prefix_sums, top_n_per_key


def first_n_notes(df: DataFrame, key: str, order: Sequence[str], n: int = 50) -> DataFrame:
    return top_n_per_key(df, [key], [F.col(c) for c in order], n, "note_rank")


def concat_with_budget(
    df: DataFrame, key: str, order: Sequence[str], text: str, n: int = 50, budget: int = 50_000, sep: str = " ", out: str = "clean_text"
) -> DataFrame:
    """First n notes in order; each is appended only if it still fits, so a later shorter one may follow.

    The operator itself bounds a key to n notes before they are gathered.
    """
    few = first_n_notes(df, key, order, n).where(F.length(text) > 0)
    notes = F.transform(F.array_sort(F.collect_list(F.struct(F.col("note_rank"), F.col(text).alias("x")))), lambda r: r["x"])
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("kept"))

    def add(acc: Column, x: Column) -> Column:
        used = (acc["used"] + F.length(x)).cast("int")
        grown = F.struct(used.alias("used"), F.concat(acc["kept"], F.array(x)).alias("kept"))
        return F.when(used <= budget, grown).otherwise(acc)

    folded = few.groupBy(key).agg(F.aggregate(notes, start, add).alias("__f"))
    return folded.where(F.size("__f.kept") > 0).select(key, F.array_join("__f.kept", sep).alias(out))


def concat_notes(df: DataFrame, key: str, bucket: Column, order: Sequence[str], text: str, sep: str = " ") -> DataFrame:
    """All notes of a key in order, one row per key at any size. ``ordered_texts`` gives the long form."""
    return joined_texts(ordered_texts(df, [key], bucket, order, text), [key], text, sep)


def concat_truncated(
    df: DataFrame, key: str, bucket: Column, order: Sequence[str], text: str, sep: str, max_length: int, out: str = "combined"
) -> DataFrame:
    """The joined text cut at ``max_length`` characters.

    Only notes that begin before the cut matter: running lengths are prefix sums over ordered
    buckets, so at most ``max_length / len(sep)`` notes per key are ever gathered.
    """
    size = (F.length(text) + len(sep)).cast("long")
    run = prefix_sums(df, [key], bucket, [F.col(c) for c in order], {"__end": size, "__pos": F.lit(1).cast("long")})
    starts = F.col("__end") - size
    few = run.where(starts < max_length + len(sep))  # a cut inside a separator still needs the note behind it
    joined = few.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("__pos"), F.col(text).alias("x")))), lambda r: r["x"]), sep).alias("__t")
    )
    return joined.select(key, F.substring("__t", 1, max_length).alias(out))


def keep_longest(df: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Longest text per key, the earlier one on ties; map-side combined."""
    best = F.max(F.struct(F.length(text).alias("n"), (-F.col(order)).alias("o"), F.col(text).alias("x")))
    return df.groupBy(key).agg(best.alias("__b")).select(key, F.col("__b.x").alias(text))


def keep_first(df: DataFrame, key: str, order: str, text: str) -> DataFrame:
    return first_per_key(df.select(key, order, text), [key], [order]).select(key, text)


def concat_unique(df: DataFrame, key: str, bucket_of: Column, order: str, text: str, sep: str = " ") -> DataFrame:
    """Distinct texts per key in order of first appearance, joined: one row per key at any size.

    Copies are removed first by a map-side combined minimum, so a key full of copies stays small.
    """
    unique = df.groupBy(key, text).agg(F.min(F.col(order)).alias(order))
    return joined_texts(ordered_texts(unique, [key], bucket_of, [order], text), [key], text, sep)


GRAM, REACH = 8, 32  # bytes hashed together, and neighbouring hashes of which the least is a mark


def _marks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value, place) of the least hash in every stretch of ``REACH`` neighbouring ``GRAM``-byte hashes; each place once."""
    n = len(data) - GRAM + 1
    if n < REACH:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashed = np.zeros(n, np.uint64)
    for k in range(GRAM):
        hashed |= data[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    hashed *= np.uint64(0x9E3779B97F4A7C15)
    hashed ^= hashed >> np.uint64(31)
    place = np.unique(np.lib.stride_tricks.sliding_window_view(hashed, REACH).argmin(1) + np.arange(n - REACH + 1))
    return hashed[place], place


class GrowingText:
    """A text that notes are appended to unless it contains them already.

    Where a note stands in the text, the least hash at the note's head is a mark of the text too, so only
    places of that mark are compared; notes shorter than a stretch are searched for byte by byte.
    The marks are runs of sorted arrays, each more than twice as long as the next: 16 bytes a mark, about one for each byte of text.
    """

    def __init__(self, sep: str):
        self.sep, self.body, self.n = sep.encode(), bytearray(), 0
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []  # (values in order, their places)
        self.marked = 0

    def __contains__(self, note: bytes) -> bool:
        head = np.frombuffer(note[: GRAM + REACH - 1], np.uint8)
        value, place = _marks(head)
        if not len(value):
            return note in self.body
        for values, places in self.runs:
            lo, hi = np.searchsorted(values, value[0]), np.searchsorted(values, value[0], "right")
            begins = (p - int(place[0]) for p in places[lo:hi].tolist())
            if any(b >= 0 and self.body[b : b + len(note)] == note for b in begins):
                return True
        return False

    def add(self, note: bytes) -> None:
        if note in self:
            return
        self.body += self.sep * bool(self.n) + note
        self.n += 1
        begin = max(0, self.marked - GRAM - REACH + 2)  # stretches across the joint count as well
        values, places = _marks(np.frombuffer(bytes(self.body[begin:]), np.uint8))
        order = np.argsort(values)
        values, places = values[order], places[order] + begin
        while self.runs and len(self.runs[-1][0]) <= 2 * len(values):
            before = self.runs.pop()
            values, places = np.concatenate([before[0], values]), np.concatenate([before[1], places])
            order = np.argsort(values)
            values, places = values[order], places[order]
        if len(values):
            self.runs.append((values, places))
        self.marked = len(self.body)


def concat_contained(df: DataFrame, key: str, order: str, text: str, sep: str = "\n\n") -> DataFrame:
    """(key, n_notes, text): notes in order, each appended unless the text so far contains it; one row per key at any size.

    Notes are stripped, empty and null ones skipped. Equal notes of a key are one by a map-side combined minimum before they travel, grouped by
    their digest; the notes of a key then stream through its task, which holds the text that is its result.
    A note without ``order`` comes first, rows of one order by their text; a null key is a key.
    """
    one = df.where(F.col(text).isNotNull()).groupBy(key, F.md5(F.col(text)).alias("__same")).agg(F.min(F.struct(F.col(order).alias("o"), F.col(text).alias("x"))).alias("__r"))
    notes = one.select(key, F.col("__r.o").alias("__o"), F.col("__r.x").alias("__x")).repartition(key).sortWithinPartitions(key, "__o", "__x")
    schema = T.StructType([df.schema[key], T.StructField("n_notes", T.LongType()), T.StructField(text, T.StringType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, GrowingText(sep)

        def row() -> pa.RecordBatch:
            # the text's own bytes, not a copy
            own = pa.StringArray.from_buffers(1, pa.py_buffer(np.array([0, len(held.body)], np.int32)), pa.py_buffer(held.body))
            return pa.RecordBatch.from_arrays([at, pa.array([held.n]), own], [key, "n_notes", text])

        for b in batches:
            for i, x in enumerate(b.column(2)):
                own = b.column(0).slice(i, 1)
                if at is None or not own.equals(at):
                    if held.n:
                        yield row()
                    at, held = own, GrowingText(sep)
                if note := x.as_py().strip().encode():
                    held.add(note)
        if held.n:
            yield row()

    return notes.mapInArrow(fold, schema)


def priority_concat(
    df: DataFrame, key: str, category: str, order: str, text: str, priority: Sequence[str], sep: str = "\n\n---\n\n", max_length: int = 10_000
) -> DataFrame:
    """Notes by category priority, then the remaining categories by first appearance; cut at ``max_length``.

    ``order`` is numeric (a turn, or a time in microseconds). A null category is one of the remaining ones; a null key is a key.
    """
    ranks = F.array(*[F.lit(c) for c in priority])
    place = F.array_position(ranks, F.col(category))
    first = df.groupBy(F.col(key).alias("__key"), F.col(category).alias("__category")).agg(F.min(order).alias("__first"))
    same = F.col(key).eqNullSafe(F.col("__key")) & F.col(category).eqNullSafe(F.col("__category"))
    ranked = df.join(first, same).drop("__key", "__category").withColumn("__rank", F.when(place > 0, place).otherwise(F.lit(len(priority) + 1)))
    ranked = ranked.withColumn("__late", F.when(F.col("__rank") > len(priority), F.col("__first")).otherwise(F.lit(0)))
    # A category with very many notes is cut into stretches of its numeric order as well.
    bucket = F.struct("__rank", "__late", F.col(category), F.floor(F.col(order) / 1024).alias("__stretch"))
    return concat_truncated(
        ranked.select(key, "__rank", "__late", category, order, text), key, bucket, ["__rank", "__late", category, order], text, sep, max_length
    )


def merge_to_cohort(ids: DataFrame, texts: DataFrame, on: str, text: str) -> DataFrame:
    """One row per cohort id, empty text where there is none."""
    return ids.select(on).distinct().join(texts, on, "left").select(on, F.coalesce(F.col(text), F.lit("")).alias(text))
