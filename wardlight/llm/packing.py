"""Packing of token pieces into sequences of fixed length by patterns of few documents.

Only the histogram of lengths (at most ``size`` numbers) decides the plan. Patterns of one to three lengths
that fill a sequence exactly are enumerated; non-negative least squares fits how often each is used; the
counts are rounded down, and what is left is packed best-fit, on counts too. The plan says, for the j-th
piece of each length, its sequence and place, so pieces only need their number among those of equal length;
that number comes from counts per hash bucket, never from one ordered pass over a length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import keep

SPECIAL = "<|endoftext|>"
PIECES_A_BUCKET = 2_000
#: triples enumerated for each longest length: the plan stays within a few times ``size`` rows
TRIPLES = 4


@lru_cache(maxsize=2)
def _encoders(path: str):
    """The tokenizer file, and the same vocabulary in the faster library.

    Both give the same ids for text without the special token's string; a text that has it goes to the
    tokenizer itself.
    """
    import json

    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    # the file spells bytes as printable characters: bytes that have none are moved up from 256 in order
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelled = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    ranks = {bytes(spelled[c] for c in word): i for word, i in vocabulary.items() if word != SPECIAL}
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), Tokenizer.from_file(path)


def token_ids(text: str, path: str) -> np.ndarray:
    fast, exact = _encoders(path)
    if SPECIAL in text:
        return np.array(exact.encode(text, add_special_tokens=False).ids, "<u4")
    return np.array(fast.encode_ordinary(text), "<u4")


def pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, size: int, end_id: int = 0) -> DataFrame:
    """(id, row, piece, start, length, ids_crc32): the tokens of each text and an end id, cut to ``size``.

    Null text counts as empty and is one piece of the end id. Where a text is longer than ``size``, its
    first piece is what is left over, the others are full. ``row`` tells repeated ids apart.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            ids, numbers = b.column(0).to_pylist(), b.column(2).to_pylist()
            for i in range(b.num_rows):
                text = b.column(1)[i].as_py() or ""
                tokens = np.append(token_ids(text, tokenizer), np.uint32(end_id)).astype("<u4")
                n = len(tokens)
                cuts = [0, *range(n % size or size, n, size), n]
                for k, (a, z) in enumerate(zip(cuts, cuts[1:])):
                    out.append((ids[i], numbers[i], k, a, z - a, zlib.crc32(tokens[a:z].tobytes())))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    names = ["id", "row", "piece", "start", "length", "ids_crc32"]
    docs = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), F.monotonically_increasing_id())
    return docs.mapInArrow(rows, "id long, row long, piece int, start long, length long, ids_crc32 long")


def patterns(histogram: np.ndarray, size: int, triples: int = TRIPLES) -> np.ndarray:
    """Rows of three lengths (0: none) that fill ``size`` exactly out of lengths that occur."""
    have = np.flatnonzero(histogram)
    have = have[(have > 0) & (have <= size)]
    out = [np.array([[size, 0, 0]])] if histogram[size] else []
    known = histogram > 0
    rest = size - have
    two = have[(rest >= have) & (rest > 0)]
    two = two[known[size - two]]
    out.append(np.stack([size - two, two, np.zeros_like(two)], 1))
    # triples: for each longest length a few middle ones, evenly spaced over those that leave a third
    for a in have[have < size].tolist():
        b = have[(have <= a) & (2 * have >= size - a) & (have < size - a)]
        b = b[known[size - a - b]]
        if len(b):
            b = b[np.unique(np.linspace(0, len(b) - 1, triples).astype(int))]
            out.append(np.stack([np.full_like(b, a), b, size - a - b], 1))
    return np.concatenate(out).astype(np.int64)


def fit_counts(histogram: np.ndarray, rows: np.ndarray, rounds: int = 150) -> np.ndarray:
    """How often each pattern is used: non-negative least squares by multiplicative steps, rounded down to
    what the histogram can give."""
    size = len(histogram)
    if not len(rows):
        return np.zeros(0, np.int64)
    h = histogram.astype(float)
    h[0] = 0
    take = rows > 0

    def along(v):
        return (v[rows] * take).sum(1)

    def spread(x):
        return sum(np.bincount(rows[:, k], x * take[:, k], size) for k in range(rows.shape[1]))

    x = np.full(len(rows), max(h.sum() / (3 * len(rows)), 1e-6))
    goal = along(h)
    for _ in range(rounds):
        x *= goal / np.maximum(along(spread(x)), 1e-12)
    counts = np.floor(x).astype(np.int64)
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    # the fit may ask for more of a length than there is: give in the order of use
    final = np.zeros(len(rows), np.int64)
    for i in np.argsort(-x, kind="stable"):
        want = counts[i]
        if not want:
            break
        own, need = np.unique(rows[i][rows[i] > 0], return_counts=True)
        n = int(min(want, (left[own] // need).min()))
        if n:
            final[i] = n
            left[own] -= n * need
    return final


def best_fit(left: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: (lengths, how often) until nothing is left."""
    left = left.copy()
    left[0] = 0
    out = []
    top = size
    while True:
        while top > 0 and not left[top]:
            top -= 1
        if not top:
            return out
        held, room, probe = [top], size - top, left.copy()
        probe[top] -= 1
        while room:
            fit = np.flatnonzero(probe[1 : room + 1])
            if not len(fit):
                break
            nxt = int(fit[-1]) + 1
            held.append(nxt)
            probe[nxt] -= 1
            room -= nxt
        own, need = np.unique(held, return_counts=True)
        n = int((left[own] // need).min())
        left[own] -= n * need
        out.append((tuple(held), n))


def plan(histogram: np.ndarray, size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, from, to, first sequence, step, offset): pieces number ``from`` to ``to`` of a length go
    to consecutive sequences at one offset."""
    rows = patterns(histogram, size)
    counts = fit_counts(histogram, rows)
    left = histogram.astype(np.int64).copy()
    chosen = []
    for r, n in zip(rows[counts > 0].tolist(), counts[counts > 0].tolist()):
        held = tuple(x for x in r if x)
        chosen.append((held, n))
        for x in held:
            left[x] -= n
    chosen += best_fit(left, size)
    given = np.zeros(size + 1, np.int64)
    out, sequence = [], 0
    for held, n in chosen:
        offset = 0
        for x in held:
            out.append((int(x), int(given[x]), int(given[x] + n), sequence, offset))
            given[x] += n
            offset += x
        sequence += n
    return out


def numbered(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds ``number``, 0.. within each ``key``, by buckets of a hash: no key is ordered in one task."""
    n = df.count()
    buckets = max(1, n // PIECES_A_BUCKET)
    df = df.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = df.groupBy(key, "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy(key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = keep(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"))
    own = Window.partitionBy(key, "bucket").orderBy(*order)
    return df.withColumn("own", F.row_number().over(own) - 1).join(base, [key, "bucket"]).withColumn("number", F.col("own") + F.col("base")).drop("own", "base", "bucket")


def pack(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) per piece; an empty table gives no rows.

    Every row of ``docs`` is packed, repeated rows and null ids included; other columns are not read.
    """
    cut = keep(pieces(docs, id_col, text_col, tokenizer, size, end_id))
    histogram = np.zeros(size + 1, np.int64)
    for length, n in cut.groupBy("length").count().collect():  # at most ``size`` rows
        histogram[length] = n
    spark = docs.sparkSession
    rows = plan(histogram, size)
    schema = "length long, low long, high long, first long, offset long"
    where = spark.createDataFrame(rows, schema)
    # a plan row holds many pieces; they are met through their number's position among the sorted row ends
    ends: dict[int, list[int]] = {}
    for length, _, high, _, _ in sorted(rows):
        ends.setdefault(length, []).append(high)
    steps = spark.createDataFrame([(k, v) for k, v in ends.items()], "length long, ends array<long>")
    place = keep(where.withColumn("step", F.row_number().over(Window.partitionBy("length").orderBy("low")).cast("long")))
    got = numbered(cut, "length", ["id", "row", "piece"])
    got = got.join(F.broadcast(steps), "length")
    # binary search for the first end above the number
    search = """
        aggregate(sequence(1, 24), struct(0L as lo, cast(size(ends) as bigint) as hi),
            (s, i) -> if(s.lo >= s.hi, s, if(ends[cast((s.lo + s.hi) div 2 as int)] > number,
                struct(s.lo as lo, (s.lo + s.hi) div 2 as hi), struct((s.lo + s.hi) div 2 + 1 as lo, s.hi as hi))),
            s -> s.lo + 1)
    """
    got = got.withColumn("step", F.expr(search)).drop("ends")
    got = got.join(F.broadcast(place), ["length", "step"])
    return got.select("id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("number") - F.col("low")).alias("sequence_id"), "offset")
