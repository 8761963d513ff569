"""Character positions inside one text."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterable, Iterator, Mapping
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from .exprs import let
from .notes import any_match, factored, low_regex, text_of

#: rows that leave a Python worker at once
OUT_ROWS = 32_768


def match_positions(c: str | Column, pattern: str, k: int) -> Column:
    """First k matches of a pattern as (text, start, end), 0-based, end exclusive.

    The pieces between matches and the matches themselves alternate, so running lengths give the
    positions without leaving the JVM. The text keeps its original case. A text without a match is
    cut by no regex: see ``any_match``.
    """
    return let(F.lower(text_of(c)), lambda low: _positions(text_of(c), low, pattern, k))


def _positions(text: Column, low: Column, pattern: str, k: int) -> Column:
    rx = low_regex(f"({factored(pattern)})")
    gaps = F.split(low, rx, k + 1)
    found = F.regexp_extract_all(low, F.lit(rx), F.lit(1))
    steps = F.slice(F.arrays_zip(gaps.alias("gap"), found.alias("hit")), 1, k)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<text:string,start:int,end:int>>").alias("out"))

    def walk(acc: Column, s: Column) -> Column:
        a = (acc["at"] + F.length(s["gap"])).cast("int")
        b = (a + F.length(s["hit"])).cast("int")
        span = F.struct(F.substring(text, a + 1, b - a).alias("text"), a.alias("start"), b.alias("end"))
        return F.when(s["hit"].isNull(), acc).otherwise(F.struct(b.alias("at"), F.concat(acc["out"], F.array(span)).alias("out")))

    return F.when(any_match(low, pattern), F.aggregate(steps, start, walk)["out"]).otherwise(start["out"])


def concept_positions(c: str | Column, patterns: Mapping[str, str], k: int = 5) -> Column:
    """Up to k matches of every pattern, as (start, end, feature, text) in text order."""
    def named(name: str):
        return lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(name).alias("feature"), m["text"].alias("text"))

    def every(low: Column) -> Column:
        return F.array_sort(F.concat(*[F.transform(_positions(text_of(c), low, p, k), named(n)) for n, p in patterns.items()]))

    return let(F.lower(text_of(c)), every)


def word_cutter(pattern: str, max_words: int, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The Arrow side of ``word_rows``: batches of (id, text) to batches of at most ``OUT_ROWS`` runs of words."""
    rx = re.compile(pattern)

    def runs(texts: Iterable[str | None]) -> Iterator[tuple]:
        for place, t in enumerate(texts):
            last = deque(maxlen=max_words)
            for i, m in enumerate(rx.finditer(t or ""), 1):
                last.append((m.group().lower(), m.start()))
                for n in range(1, len(last) + 1):
                    gram = last[-1][0] if n == 1 else " ".join(w for w, _ in list(last)[-n:])
                    yield place, gram, n, i - n + 1, last[-n][1], m.end()

    def packed(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        place, gram, *numbers = zip(*rows)
        columns = [ids.take(pa.array(place, pa.int32())), pa.array(gram, pa.string()), *[pa.array(c, pa.int32()) for c in numbers]]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = runs(t.as_py() for t in batch.column(1))
            while some := list(islice(rows, OUT_ROWS)):
                yield packed(batch.column(0), some)

    return cut


def word_rows(df: DataFrame, id_col: str, text: str, pattern: str = r"\b\w\w+\b", max_words: int = 1) -> DataFrame:
    """(id, gram, n, first, start_char, end_char): every run of up to ``max_words`` lower-cased words.

    One linear pass per text. A worker holds one input batch and at most ``OUT_ROWS`` rows of output,
    so its memory does not depend on how many words a text or a batch has.
    """
    id_field = StructField(id_col, df.schema[id_col].dataType)
    schema = StructType([id_field, StructField("gram", StringType()), *[StructField(c, IntegerType()) for c in ("n", "first", "start_char", "end_char")]])
    return df.select(id_col, text).mapInArrow(word_cutter(pattern, max_words, schema.names), schema)
