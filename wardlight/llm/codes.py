"""Vector code compression: codebooks per part of a vector, assigned through memoised grid cells.

Components become integers, so sums, distances and codebooks are exact. Each part of a vector lies in a coarse cell of an
even grid. For a cell seen first, the least and largest distance of every codebook entry to the cell's box are worked out;
entries whose least distance exceeds the smallest of the largest distances are dominated in the whole box. The rest is
cached for the cell, and only these entries are compared exactly with the parts that lie in it.

A round reads the vectors once, with the codebooks broadcast (their size depends on the dimension alone), and sends back sums per
part and entry; grouping is Spark's, and only one row per part and entry reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

SCALE = 1024
PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: edge of a grid cell, as a power of two
CELL_BITS = 5
#: cells a task remembers; beyond that it starts anew
CACHED = 1 << 15
#: larger components count as this
LARGEST = 1 << 26


class Codebooks(NamedTuple):
    entries: np.ndarray  # (part, entry, component) int64

    @property
    def width(self) -> int:
        return self.entries.shape[2]

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


class Cells:
    """Entries that may be nearest somewhere in a cell, for the cells of one codebook seen so far."""

    def __init__(self, entries: np.ndarray, bits: int = CELL_BITS, most: int = CACHED):
        self.entries, self.bits, self.most = entries, bits, most
        self.slots: dict[bytes, int] = {}
        self.kept = np.zeros((0, len(entries)), bool)
        self.exact = 0  # distances worked out, for tests and figures

    def _bounds(self, cells: np.ndarray) -> np.ndarray:
        """For each cell, the entries that another does not dominate."""
        size = int(np.abs(self.entries).max(initial=0) + (np.abs(cells).max(initial=0) + 1 << self.bits))
        kind = np.int32 if size * size * cells.shape[1] < 1 << 31 else np.int64
        least = np.zeros((len(cells), len(self.entries)), kind)
        most = np.zeros_like(least)
        for d in range(cells.shape[1]):
            # a grid line is shared by many cells: distances along it are worked out once
            lines, at = np.unique(cells[:, d], return_inverse=True)
            below = (lines << self.bits)[:, None] - self.entries[None, :, d]  # how far the entry lies under the box
            above = -below - ((1 << self.bits) - 1)
            least += np.square(np.maximum(np.maximum(below, above), 0)).astype(kind)[at]
            most += np.square(np.maximum(np.abs(below), np.abs(above))).astype(kind)[at]
        return least <= most.min(1, keepdims=True)

    def candidates(self, parts: np.ndarray) -> np.ndarray:
        """A row of admitted entries for each part."""
        cells, at = np.unique(parts >> self.bits, axis=0, return_inverse=True)
        at = at.reshape(-1)
        if len(self.slots) + len(cells) > self.most:
            self.slots, self.kept = {}, self.kept[:0]
        names = [c.tobytes() for c in cells]
        new = [i for i, name in enumerate(names) if name not in self.slots]
        if new:
            self.slots.update({names[i]: len(self.kept) + k for k, i in enumerate(new)})
            self.kept = np.concatenate([self.kept, *(self._bounds(cells[new[k : k + 1024]]) for k in range(0, len(new), 1024))])
        return self.kept[np.array([self.slots[name] for name in names], np.int64)[at]]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of the nearest entry of each part; of equally near ones the first."""
        code, best = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        for k in range(0, len(parts), 2048):
            own = parts[k : k + 2048]
            row, entry = np.nonzero(self.candidates(own))
            dist = np.zeros(len(row), np.int64)
            for d in range(own.shape[1]):
                gap = own[:, d][row] - self.entries[:, d][entry]
                dist += gap * gap
            self.exact += len(dist)
            first = np.searchsorted(row, np.arange(len(own)))
            least = np.minimum.reduceat(dist, first)
            # entries of a part stand in ascending order: the first that reaches the minimum
            hit = np.flatnonzero(dist == least[row])
            at = hit[np.searchsorted(row[hit], np.arange(len(own)))]
            code[k : k + 2048], best[k : k + 2048] = entry[at], least
        return code, best


def integers(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(kept rows, their integer components): whole finite vectors of ``width`` components."""
    flat = pc.cast(column.flatten(), pa.float64())
    null = flat.is_null().to_numpy(zero_copy_only=False)
    values = pc.fill_null(flat, np.nan).to_numpy(zero_copy_only=False)
    length = pc.fill_null(column.value_lengths(), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.cumsum(np.maximum(length, 0)) - np.maximum(length, 0)
    bad = np.concatenate([[0], np.cumsum(null | ~np.isfinite(values))])
    rows = np.flatnonzero(length == width)
    rows = rows[bad[start[rows] + width] == bad[start[rows]]]
    whole = values[start[rows][:, None] + np.arange(width)]
    return rows, np.clip(np.floor(SCALE * whole), -LARGEST, LARGEST).astype(np.int64)


def _sums(carried, width: int):
    """(part, entry, n, s0, s1, …): sums of the parts of a task assigned to each entry."""
    names = ["part", "entry", "n", *(f"s{i}" for i in range(width // PARTS))]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = carried.value.entries
        cells = [Cells(b) for b in books]
        n = np.zeros(books.shape[:2], np.int64)
        total = np.zeros(books.shape, np.int64)
        for b in batches:
            _, whole = integers(b.column(0), width)
            for j, own in enumerate(np.split(whole, PARTS, axis=1)):
                code, _ = cells[j].nearest(own)
                n[j] += np.bincount(code, minlength=books.shape[1])
                order = np.argsort(code, kind="stable")
                first = np.flatnonzero(np.diff(code[order], prepend=-1))
                if len(first):
                    total[j][code[order][first]] += np.add.reduceat(own[order], first, axis=0)
        part, entry = np.nonzero(n)
        columns = [part.astype(np.int32), entry.astype(np.int32), n[part, entry], *total[part, entry].T]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return compute, names


def fit(vectors: DataFrame, id_col: str, vector_col: str, rounds: int = ROUNDS, entries: int = ENTRIES) -> Codebooks | None:
    """Codebooks of ``vectors``, or None if no vector is kept. Only rows of codebook size reach the driver.

    An entry starts as the part of one of the vectors with the smallest ids; equal ids come in the order of their vectors,
    null ids last. With fewer vectors than ``entries`` there are as many entries as vectors.
    """
    usable = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    # of the vectors that hold no null and nothing infinite
    usable = usable.where("v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    seeds = [r.v for r in usable.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()]
    if not seeds:
        return None
    width = len(seeds[0])
    if width % PARTS or any(len(x) != width for x in seeds):
        raise ValueError(f"vectors need one length, a multiple of {PARTS}")
    _, whole = integers(pa.array(seeds, pa.list_(pa.float64())), width)
    books = np.stack(np.split(whole, PARTS, axis=1))
    spark = vectors.sparkSession
    plain = vectors.select(vector_col)
    for _ in range(rounds):
        carried = spark.sparkContext.broadcast(Codebooks(books))
        compute, names = _sums(carried, width)
        schema = ", ".join(f"{c} {'int' if k < 2 else 'long'}" for k, c in enumerate(names))
        found = plain.mapInArrow(compute, schema).groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in names[2:]])
        books = books.copy()
        for r in found.collect():
            books[r[0], r[1]] = np.array(r[3:], np.int64) // r[2]
        carried.unpersist()
    return Codebooks(books)


def encode(vectors: DataFrame, vector_col: str, books: Codebooks | None, code_col: str = "code", error_col: str = "error") -> DataFrame:
    """The kept rows of ``vectors`` with all their columns, a code of two hex digits per part, and the squared error of it.

    Vectors that are null, of another length, or hold a null or non-finite component are left out; of an empty table nothing is kept.
    Components beyond 65,536 in size count as that. Columns of the names ``code_col`` and ``error_col`` are replaced.
    """
    base = vectors.drop(code_col, error_col)
    schema = StructType([*base.schema.fields, StructField(code_col, StringType()), StructField(error_col, LongType())])
    if books is None:
        return vectors.sparkSession.createDataFrame([], schema)
    at, carried = base.columns.index(vector_col), vectors.sparkSession.sparkContext.broadcast(books)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(b) for b in carried.value.entries]
        for b in batches:
            kept, whole = integers(b.column(at), carried.value.width * PARTS)
            if not len(kept):
                continue
            found = [c.nearest(own) for c, own in zip(cells, np.split(whole, PARTS, axis=1))]
            code = np.stack([c for c, _ in found], 1).astype(np.uint8).tobytes().hex()
            error = np.sum([d for _, d in found], axis=0)
            b = b.take(pa.array(kept))
            codes = pa.array([code[k : k + 2 * PARTS] for k in range(0, len(code), 2 * PARTS)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, codes, pa.array(error)], [*b.schema.names, code_col, error_col])

    return base.mapInArrow(rows, schema)


def error_by(coded: DataFrame, group_col: str, error_col: str = "error", out_col: str = "group_error") -> DataFrame:
    """``coded`` with the error summed over the rows of its group; nulls are one group. Sums are combined before they are shuffled."""
    sums = coded.groupBy(F.col(group_col).alias("__group")).agg(F.sum(error_col).alias(out_col))
    return coded.join(sums, F.col(group_col).eqNullSafe(F.col("__group"))).drop("__group")
