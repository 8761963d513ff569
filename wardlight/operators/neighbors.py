"""Exact nearest neighbours by cell pruning, and synthetic minority rows between them.

Rows are put into cells around centroids. A cell can only hold one of a row's k nearest when the
row's distance to its centroid, less the cell's radius, does not exceed the k-th distance already
found; other cells are never visited. Cells are dealt to groups of bounded size, and a task compares
one group with one other group: a matrix product finds the rows that may be near enough, and only
their distances are taken. Copies are collapsed beforehand.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from .ordered import hash_positions
from .sampling import _sizes

BLOCK_ROWS = 250
GROUP_ROWS = 8_000
MAX_CELLS = 256


def _closest(queries: pd.DataFrame, rows: pd.DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> pd.DataFrame:
    """The k nearest ``rows`` of each query that are within its ``limit``, when it has one; ``block_rows`` queries at a time.

    The product's distances are off by rounding; whatever could be among the k nearest within that error is measured again.
    """
    own = queries is rows
    q, x = np.stack(queries["vec"].to_numpy()), np.stack(rows["vec"].to_numpy())
    ids, reps = rows["rep"].to_numpy(), queries["rep"].to_numpy()
    limit = queries["limit"].to_numpy(np.float64) if "limit" in queries else np.full(len(q), np.inf)
    middle = x.mean(axis=0)  # small norms make small errors
    qs, xs = q - middle, x - middle
    q2, x2 = (qs**2).sum(axis=1), (xs**2).sum(axis=1)
    slack = 16 * (x.shape[1] + 8) * np.finfo(np.float64).eps
    out = []
    for at in range(0, len(q), block_rows):
        to = min(at + block_rows, len(q))
        d2 = q2[at:to, None] + x2[None, :] - 2 * (qs[at:to] @ xs.T)
        error = slack * (np.sqrt(q2[at:to]) + np.sqrt(x2.max()) + np.abs(middle).max()) ** 2
        if own:
            d2[np.arange(to - at), np.arange(at, to)] = np.inf
        most = limit[at:to] ** 2 * (1 + 1e-9)
        for i in np.flatnonzero(~np.isfinite(most)):
            most[i] = np.partition(d2[i], k - 1)[k - 1] if len(x) > k else np.inf
        maybe = ~(d2 > (most + 2 * error)[:, None])
        for i in np.flatnonzero(maybe.any(axis=1)):
            near = np.flatnonzero(maybe[i])
            d = np.sqrt(((x[near] - q[at + i]) ** 2).sum(axis=1))
            d[ids[near] == reps[at + i]] = np.inf
            for j in np.lexsort((ids[near], d))[:k]:
                if np.isfinite(d[j]) and d[j] <= limit[at + i]:
                    out.append((reps[at + i], ids[near[j]], float(d[j])))
    return pd.DataFrame(out, columns=["rep", "neighbor", "distance"])


def distinct_vectors(df: DataFrame, id_col: str, vec: str) -> DataFrame:
    """(rep, vec, m): one row per different vector, its smallest id and number of copies."""
    return df.groupBy(F.col(vec).cast("array<double>").alias("vec")).agg(F.min(id_col).alias("rep"), F.count("*").alias("m"))


def _groups(sizes: list[int], group_rows: int) -> tuple[list[int], list[int]]:
    """First group and number of groups per cell: large cells are cut by hash, small ones share a group with their successors."""
    first, parts, at, filled = [], [], 0, 0
    for size in sizes:
        n = max(1, math.ceil(size / group_rows))
        if filled and (n > 1 or filled + size > group_rows):
            at, filled = at + 1, 0
        first.append(at)
        parts.append(n)
        at, filled = (at + n, 0) if n > 1 else (at, filled + size)
    return first, parts


def nearest_rows(points: DataFrame, k: int, seed: int = 42, block_rows: int = BLOCK_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The k nearest other points of every point of (rep, vec): (rep, neighbor, distance, rank).

    A task holds two groups of about ``group_rows`` rows and compares ``block_rows`` of one at a time with the other.
    """
    points = durable(points.select("rep", "vec"))
    n = points.count()
    cells = max(1, min(MAX_CELLS, math.ceil(math.sqrt(n))))
    model = KMeans(k=cells, seed=seed, maxIter=10).fit(points.select(array_to_vector("vec").alias("features")))
    centers = np.stack(model.clusterCenters())  # at most MAX_CELLS vectors

    def to_centers(vecs: pd.Series) -> np.ndarray:
        x = np.stack(vecs.to_numpy())
        return np.stack([np.sqrt(((x - c) ** 2).sum(axis=1)) for c in centers], axis=1)

    @F.pandas_udf("cell int, far double")
    def nearest_center(vecs: pd.Series) -> pd.DataFrame:
        far = to_centers(vecs)
        return pd.DataFrame({"cell": far.argmin(axis=1).astype(np.int32), "far": far.min(axis=1)})

    placed = durable(points.withColumn("c", nearest_center("vec")).select("rep", "vec", "c.cell", "c.far"))
    # At most MAX_CELLS sizes and radii reach the driver.
    info = {r["cell"]: (r["size"], r["radius"]) for r in placed.groupBy("cell").agg(F.count("*").alias("size"), F.max("far").alias("radius")).collect()}
    radii = np.array([info[c][1] if c in info else -1.0 for c in range(len(centers))])
    first, parts = _groups([info[c][0] if c in info else 0 for c in range(len(centers))], group_rows)
    cell = F.col("cell")
    part = F.pmod(F.xxhash64("rep"), F.get(F.array(*[F.lit(p) for p in parts]), cell).cast("long")).cast("int")
    placed = placed.select("rep", "vec", (F.get(F.array(*[F.lit(g) for g in first]), cell) + part).alias("grp"))
    rep_type = dict(points.dtypes)["rep"]
    schema = f"rep {rep_type}, neighbor {rep_type}, distance double"
    own = durable(placed.groupBy("grp").applyInPandas(lambda pdf: _closest(pdf, pdf, k, block_rows), schema))
    bound = own.groupBy("rep").agg(F.max("distance").alias("d"), F.count("*").alias("found"))
    limit = F.when(F.col("found") >= k, F.col("d") * (1 + 1e-9)).otherwise(F.lit(float("inf")))

    @F.pandas_udf("array<int>")
    def reached(vecs: pd.Series, limits: pd.Series, grps: pd.Series) -> pd.Series:
        far = to_centers(vecs)
        near = (radii >= 0) & (far - radii - 1e-12 * (far + radii) <= limits.to_numpy()[:, None])
        groups = [np.arange(f, f + p, dtype=np.int32) for f, p in zip(first, parts)]
        return pd.Series([np.setdiff1d(np.concatenate([groups[c] for c in np.flatnonzero(row)] or [groups[0][:0]]), [g]) for row, g in zip(near, grps)])

    asked = placed.join(bound, "rep", "left").select("rep", "vec", limit.alias("limit"), F.col("grp").alias("qgrp"))
    queries = durable(asked.withColumn("grps", reached("vec", "limit", "qgrp")))
    meetings = queries.select("qgrp", F.explode("grps").alias("grp")).distinct()
    visited = placed.join(meetings, "grp").select(F.col("rep").alias("x_rep"), F.col("vec").alias("x_vec"), F.col("grp").alias("x_grp"), F.col("qgrp").alias("x_qgrp"))

    def compare(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if q.empty or x.empty:
            return pd.DataFrame(columns=["rep", "neighbor", "distance"])
        return _closest(q, x.rename(columns={"x_rep": "rep", "x_vec": "vec"}), k, block_rows)

    asking = queries.select("rep", "vec", "limit", "qgrp", F.explode("grps").alias("grp"))
    other = asking.groupBy("grp", "qgrp").cogroup(visited.groupBy("x_grp", "x_qgrp")).applyInPandas(compare, schema)
    w = Window.partitionBy("rep").orderBy("distance", "neighbor")
    return own.unionByName(other).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def smote(df: DataFrame, id_col: str, label: str, vec: str, k: int = 5, ratio: float = 1.0, seed: int = 42, minority: int = 1) -> DataFrame:
    """Synthetic minority rows (base id, copy, vector) that bring the minority to ``ratio`` x the rest.

    Each lies between a minority row and one of its k nearest minority rows; a hash picks the
    neighbour and the place between the two. A row's own copies count as neighbours at distance 0.
    """
    n_min, n_maj = _sizes(df, label, minority)
    missing = max(int(n_maj * ratio + 1e-9) - n_min, 0)
    if n_min < 2 or missing == 0:
        return df.where(F.lit(False)).select(F.col(id_col), F.lit(1).alias("copy"), F.col(vec).cast("array<double>").alias(vec))
    rows = df.where(F.col(label) == minority).select(id_col, F.col(vec).cast("array<double>").alias("vec"))
    points = durable(distinct_vectors(rows, id_col, "vec"))
    near = nearest_rows(points, k, seed)
    sized = near.join(points.select(F.col("rep").alias("neighbor"), F.col("m").alias("m"), F.col("vec").alias("nvec")), "neighbor")
    itself = points.where("m > 1").select(F.col("rep").alias("neighbor"), "rep", F.lit(0.0).alias("distance"), F.lit(0).alias("rank"), (F.col("m") - 1).alias("m"), F.col("vec").alias("nvec"))
    w = Window.partitionBy("rep").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)  # at most k + 1 rows
    slots = sized.unionByName(itself).withColumn("upto", F.sum("m").over(w)).groupBy("rep").agg(
        F.array_sort(F.collect_list(F.struct("upto", "nvec"))).alias("slots"), F.least(F.max("upto"), F.lit(k)).alias("n_slots")
    )
    base, extra = divmod(missing, n_min)
    drawn = hash_positions(rows.withColumn("__one", F.lit(1)), ["__one"], [id_col], seed)
    copies = F.lit(base) + F.when(F.col("rn") <= extra, 1).otherwise(0)
    wanted = drawn.withColumn("copies", copies).where("copies > 0").select(id_col, "vec", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    filled = wanted.join(points.select("rep", "vec"), "vec").join(slots, "rep")
    pick = F.pmod(F.xxhash64(id_col, "copy", F.lit(seed)), F.col("n_slots"))
    share = F.pmod(F.xxhash64(id_col, "copy", F.lit(seed + 1)), F.lit(1_000_000)) / F.lit(1e6)
    chosen = F.filter("slots", lambda s: s["upto"] > F.col("pick"))[0]["nvec"]
    placed = filled.withColumns({"pick": pick, "share": share}).withColumn("other", chosen)
    return placed.select(id_col, "copy", F.zip_with("vec", "other", lambda a, b: a + F.col("share") * (b - a)).alias(vec))
