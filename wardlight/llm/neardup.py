"""Near-duplicate vectors: random-hyperplane signs in several tables, exact cosines, connected components.

Equal vectors of one label are one class with a weight. A class goes to one bucket per table (its signs
against that table's planes, and its label). A bucket is compared as a matrix product; a large one is cut
into stripes, and every pair of stripes is a block of its own, so no task holds a whole bucket and none gives
out pairs: a block returns, per class, the weight of its links and the smallest class of its linked group.
A pair that meets in several tables is counted in the first of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import keep

STRIPE = 1024


def tables_for(n: int, threshold: float, miss: float = 0.005) -> tuple[int, int]:
    """(planes per table, tables): buckets stay small as the rows grow, and a pair at the threshold is missed
    by all tables with at most the given chance."""
    planes = min(30, max(6, math.ceil(math.log2(max(n, 2))) - 6))
    same = (1 - math.acos(threshold) / math.pi) ** planes
    return planes, math.ceil(math.log(miss) / math.log(1 - same))


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of doubles; all zero where a vector is null, holds nulls or other non-finite parts, or has another width."""
    out = np.zeros((len(column), dim))
    if not len(column):
        return out
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    right = (np.diff(offsets) == dim) & column.is_valid().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(right)
    if len(rows):
        got = values[offsets[rows][:, None] + np.arange(dim)]
        out[rows] = np.where(np.isfinite(got).all(1)[:, None], got, 0)
    return out


def _codes(batches: Iterator[pa.RecordBatch], dim: int, planes: int, tables: int, seed: int) -> Iterator[pa.RecordBatch]:
    normals = np.random.default_rng(seed).normal(size=(dim, planes * tables))
    power = 1 << np.arange(planes, dtype=np.int64)
    for b in batches:
        x = _vectors(b.column(1), dim)
        code = ((x @ normals > 0).reshape(len(x), tables, planes) * power).sum(2)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(list(code), pa.list_(pa.int64()))], ["id", "vector", "label", "weight", "codes"])


def _block(table: int, one: tuple, two: tuple | None, threshold: float):
    """Links within a stripe, or between two: (ids, linked weight in first tables, group's smallest id)."""
    ids, x, w, codes = one if two is None else tuple(np.concatenate([a, b]) for a, b in zip(one, two))
    link = x @ x.T >= threshold
    np.fill_diagonal(link, False)
    if two is not None:  # stripes are compared within themselves in blocks of their own
        m = len(one[0])
        link[:m, :m] = False
        link[m:, m:] = False
    if not link.any():
        return None
    label, before = ids.copy(), None
    while before is None or (label != before).any():
        before = label
        label = np.minimum(label, np.where(link, label[None, :], np.iinfo(np.int64).max).min(1))
    fresh = link
    for t in range(table):
        fresh = fresh & (codes[:, t][:, None] != codes[:, t][None, :])
    some = link.any(1)
    return ids[some], (fresh @ w)[some], label[some]


def _compare(batches: Iterator[pa.RecordBatch], dim: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Blocks arrive sorted by (table, bucket, block); a block may run over several batches."""
    held: list[tuple] = []
    at = None

    def done():
        table, _, s, z = at
        stripe, ids, x, w, codes = (np.concatenate(c) for c in zip(*held))
        if len(ids) < 2:
            return
        norm = np.sqrt((x * x).sum(1))
        x = x / norm[:, None]
        if s == z:
            got = _block(table, (ids, x, w, codes), None, threshold)
        else:
            a, b = stripe == s, stripe == z
            if not a.any() or not b.any():
                return
            got = _block(table, (ids[a], x[a], w[a], codes[a]), (ids[b], x[b], w[b], codes[b]), threshold)
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in got], ["id", "links", "low"])

    for b in batches:
        key = [b.column(i).to_numpy() for i in range(4)]
        change = np.zeros(b.num_rows, bool)
        for k in key:
            change[1:] |= k[1:] != k[:-1]
        starts = np.concatenate([[0], np.flatnonzero(change), [b.num_rows]]) if b.num_rows else np.zeros(0, int)
        stripe, ids, w = (b.column(i).to_numpy() for i in (4, 5, 7))
        x = _vectors(b.column(6), dim)
        width = b.column(8).type
        codes = b.column(8).flatten().to_numpy().reshape(b.num_rows, -1) if pa.types.is_list(width) and b.num_rows else np.zeros((0, 1), np.int64)
        for lo, hi in zip(starts[:-1], starts[1:]):
            if lo == hi:
                continue
            now = tuple(int(k[lo]) for k in key)
            if at is not None and now != at:
                yield from done()
                held = []
            at = now
            held.append((stripe[lo:hi], ids[lo:hi], x[lo:hi], w[lo:hi], codes[lo:hi]))
    if held:
        yield from done()


def near_duplicates(df: DataFrame, id_col: str, vector_col: str, label_col: str, threshold: float = 0.93, miss: float = 0.005, seed: int = 31, stripe: int = STRIPE) -> DataFrame:
    """(id, n_links, component, kept) per row of ``df``.

    Rows link when their labels are equal and not null and the cosine, in double precision, is at least the
    threshold. Vectors that are null, zero, or hold null or non-finite parts link with nothing, nor do rows
    without id; such a row is its own component. Vectors of another width than the most common one do not
    occur in one table; they link with nothing. Repeated rows are rows like any other.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("vector"), F.col(label_col).cast("long").alias("label"))
    width = rows.where("vector is not null").groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = width.d if width else 1
    bad = "x is null or isnan(x) or x = float('inf') or x = -float('inf')"
    usable = f"id is not null and label is not null and vector is not null and size(vector) = {dim} and not exists(vector, x -> {bad}) and exists(vector, x -> x <> 0)"
    rows = keep(rows.withColumn("usable", F.expr(usable)).withColumn("h", F.expr("if(usable, xxhash64(transform(vector, x -> if(x = 0, 0f, x)), label), null)")))
    good = rows.where("usable")
    classes = keep(good.groupBy("h").agg(F.min("id").alias("low"), F.count("*").alias("weight")))
    first = good.join(classes.select("h", F.col("low").alias("id"), "weight"), ["h", "id"]).dropDuplicates(["h"]).select("id", "vector", "label", "weight")
    n = classes.count()
    planes, tables = tables_for(n, threshold, miss)
    coded = keep(first.mapInArrow(lambda it: _codes(it, dim, planes, tables, seed), "id long, vector array<float>, label long, weight long, codes array<long>"))

    entries = coded.select("id", "label", F.posexplode("codes").alias("t", "code"))
    sizes = keep(entries.groupBy("t", "label", "code").agg(F.count("*").alias("m")).where("m > 1"))
    entries = entries.join(sizes, ["t", "label", "code"])
    stripes = f"cast(ceil(m / {stripe}) as int)"
    entries = entries.withColumn("g", F.expr(stripes)).withColumn("s", F.expr("cast(pmod(xxhash64(id, 5), g) as int)"))
    entries = entries.withColumn("o", F.explode(F.expr("sequence(0, g - 1)"))).select(
        F.col("t").cast("long"), F.xxhash64("label", "code").alias("bucket"), F.least("s", "o").cast("long").alias("s1"), F.greatest("s", "o").cast("long").alias("s2"), F.col("s").cast("long").alias("stripe"), "id"
    )
    blocks = entries.join(coded, "id").select("t", "bucket", "s1", "s2", "stripe", "id", "vector", "weight", "codes")
    parts = max(df.sparkSession.sparkContext.defaultParallelism * 4, n * tables // 50_000)
    blocks = blocks.repartition(parts, "t", "bucket", "s1", "s2").sortWithinPartitions("t", "bucket", "s1", "s2")
    found = keep(blocks.mapInArrow(lambda it: _compare(it, dim, threshold), "id long, links long, low long"))

    comps = keep(components(found, "id", "low").withColumnRenamed("node", "id"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    by_class = classes.select("h", F.col("low").alias("id"), "weight").join(links, "id", "left").join(comps, "id", "left")
    by_class = keep(by_class.select("h", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component")))
    out = rows.select("id", "h").join(by_class, "h", "left").select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "id").alias("component"))
    return out.withColumn("kept", F.col("id") == F.col("component"))
