"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

Rows are numbered by the order of a hash of their key, through counts per hash bucket, so no task sees more
than a bucket. The permutation works on pairs (l, r) with l below a and r below b, where a * b is the least
such product of about square sides that holds all rows: each round adds a hash of one half to the other.
A number that leaves the range walks on until it is back. The permuted number p goes to shard p mod n, slot
p div n: sizes differ by one at most, and ``row_number`` finds the row of any shard and slot without data.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import keep

ROUNDS = 6
ROWS_A_BUCKET = 2_000
BUCKETS_A_GROUP = 1_000
PRIME = 2_147_483_647


def sides(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def constants(seed: int) -> list[int]:
    """One per round, from the seed by a fixed linear rule."""
    return [(seed * 69_621 + i * 742_938_285 + 12_345) % PRIME for i in range(1, ROUNDS + 1)]


def _mixed(x: int, c: int) -> int:
    t = (x * 48_271 + c) % PRIME
    t = (t * t + 16_807 * t + c) % PRIME
    return (t * t + c) % PRIME


def permuted(number: str, n: int, seed: int) -> str:
    """SQL for the permuted number of an expression of numbers 0 to n - 1."""
    a, b = sides(n)

    def mixed(x: str) -> str:
        t = f"(({x}) * 48271 + c) % {PRIME}"
        t = f"transform(array({t}), t -> (t * t + 16807 * t + c) % {PRIME})"
        return f"element_at(transform({t}, t -> (t * t + c) % {PRIME}), 1)"

    halves = ", ".join(f"named_struct('turn', {i % 2}, 'c', cast({c} as bigint))" for i, c in enumerate(constants(seed)))
    step = f"""
        aggregate(array({halves}), named_struct('l', cast(x div {b} as bigint), 'r', cast(x % {b} as bigint)),
            (s, k) -> if(k.turn = 0,
                named_struct('l', (s.l + element_at(transform(array(k.c), c -> {mixed('s.r')}), 1)) % {a}, 'r', s.r),
                named_struct('l', s.l, 'r', (s.r + element_at(transform(array(k.c), c -> {mixed('s.l')}), 1)) % {b})),
            s -> s.l * {b} + s.r)
    """
    # at most a numbers lie outside, so a walk has at most that many steps; beyond 64 it has no chance (a**-64)
    walk = f"aggregate(sequence(1, {min(a, 64) + 1}), cast({number} as bigint), (x, i) -> if(i > 1 and x < {n}, x, {step}))"
    return walk


def row_number(shard: int, slot: int, n: int, shards: int, seed: int) -> int:
    """The global number of the row at ``slot`` of ``shard``: the permutation backwards."""
    a, b = sides(n)
    p = slot * shards + shard
    if not (0 <= shard < shards and 0 <= slot and p < n):
        raise ValueError("no such shard and slot")
    while True:
        left, right = divmod(p, b)
        for i, c in reversed(list(enumerate(constants(seed)))):
            if i % 2:
                right = (right - _mixed(left, c)) % b
            else:
                left = (left - _mixed(right, c)) % a
        p = left * b + right
        if p < n:
            return p


def number_rows(df: DataFrame, keys: list[str], name: str, rows_a_bucket: int = ROWS_A_BUCKET) -> tuple[DataFrame, int]:
    """Adds global row numbers 0 .. n - 1 in the order of the keys' hash, and gives n. ``df`` is read twice.

    Rows with equal keys get different numbers in any order among themselves.
    """
    n = df.count()
    buckets = max(1, -(-n // rows_a_bucket))
    hashed = df.withColumn("__h", F.xxhash64(*keys))
    hashed = hashed.withColumn("__b", F.pmod("__h", F.lit(buckets)))
    counts = hashed.groupBy("__b").agg(F.count("*").alias("__n")).withColumn("__g", F.expr(f"__b div {BUCKETS_A_GROUP}"))
    counts = keep(counts)
    groups = counts.groupBy("__g").agg(F.sum("__n").alias("__n"))
    over = Window.orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)  # one row per group of buckets
    inside = Window.partitionBy("__g").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("__in", F.coalesce(F.sum("__n").over(inside), F.lit(0))).join(
        groups.withColumn("__up", F.coalesce(F.sum("__n").over(over), F.lit(0))).select("__g", "__up"), "__g"
    )
    base = keep(base.select("__b", (F.col("__in") + F.col("__up")).alias("__base")))
    own = Window.partitionBy("__b").orderBy("__h", *keys)
    out = hashed.withColumn("__own", F.row_number().over(own) - 1).join(base, "__b")
    return out.withColumn(name, (F.col("__own") + F.col("__base")).cast("long")).drop("__h", "__b", "__own", "__base"), n


def shard(docs: DataFrame, id_col: str, text_col: str, shards: int = 8, seed: int = 17) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) per row of ``docs``.

    Size is the text's bytes plus one; null text has none. The law is ``rows``: shards differ by at most one
    row, whatever the ids and texts are. Repeated rows and null ids are rows like any other; an empty table
    gives no rows. Texts are not shuffled, only their ids, sizes and checksums.
    """
    body = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    thin = keep(docs.select(F.col(id_col).cast("long").alias("id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32")))
    rows, n = number_rows(thin, ["id", "size", "text_crc32"], "number")
    rows = rows.withColumn("p", F.expr(permuted("number", n, seed)))
    return rows.select(
        "id", "size", "text_crc32", F.lit("rows").alias("law"), F.expr(f"cast(p % {shards} as int)").alias("shard"),
        F.expr(f"p div {shards}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
