"""Quality classifier: random-indexing word vectors, pooled per text, and a small calibrated network.

Every word (lower-cased run of letters and digits) has a sparse random index vector of its own, whose places and signs come from its
64-bit key, so no table is needed. Its context vector is the sum, over the whole corpus, of the index vectors
of the words within two words of it; sums are grouped by word in Spark. The vector of a word is its index vector
plus its normalized context vector. Context vectors are kept of the most frequent words, at most
``VOCABULARY``; rarer words have their index vector alone.

Punctuation and case are no words: the shape of each space-separated token (case, punctuation, digits,
length, whether it repeats one of the two before) has a sparse random vector too, as an extra input.
A text is the mean of its word vectors and of its shape vectors, and the largest and smallest mean of its stretches
of 32, so a bad stretch in a good text shows. A two-layer network scores this; its temperature is
fitted on rows held back from training.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import give_back, giving_back, keep
from .words import ALNUM, SPACED, U64, Texts, Words, between, mix, split, texts

SHAPES = 512
DIM, NONZERO = 48, 6
#: words with a context vector, at most: the most frequent of the corpus
VOCABULARY = 65_536
#: distinct words a task counts before it hands its counts on
COUNTED = 1 << 18
REACH = 2
STRETCH = 32
#: words worked through at a time, also inside one text
RUN = 512 * STRETCH
FEATURES = 6 * DIM + 1
#: labelled rows used for training, at most: those with the smallest hash of their id
TRAIN_ROWS = 20_000

UPPER = np.zeros(256, bool)
UPPER[65:91] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
PUNCT = np.zeros(256, bool)
PUNCT[33:48] = PUNCT[58:65] = PUNCT[91:97] = PUNCT[123:127] = True


def index_vectors(key: np.ndarray) -> np.ndarray:
    """One vector per word key: a sign in each of ``NONZERO`` equal parts, at a place of the key's own."""
    part = DIM // NONZERO
    h = mix(key * U64(0xD6E8FEB86659FD93))
    out = np.zeros((len(key), DIM), np.float32)
    row = np.arange(len(key)) * DIM
    for k in range(NONZERO):
        own = h >> U64(10 * k)
        out.ravel()[row + k * part + (own >> U64(1) & U64(511)).astype(np.int64) % part] = 1 - 2 * (own & U64(1)).astype(np.float32)
    return out


class Vectors(NamedTuple):
    keys: np.ndarray  # sorted uint64: words with a context vector
    table: np.ndarray  # their vectors

    def of(self, key: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return index_vectors(key)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        out = self.table[at]
        rare = np.flatnonzero(self.keys[at] != key)
        out[rare] = index_vectors(key[rare])
        return out


SHAPE_VECTORS = index_vectors(np.arange(1, SHAPES + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))


def word_shapes(t: Texts, w: Words) -> np.ndarray:
    base = w.start[0] if len(w.key) else 0
    data = t.data[base : w.end[-1] if len(w.key) else 0]

    def within(table: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int32)
        np.cumsum(table[data], dtype=np.int32, out=total[1:])
        return total[w.end - base] - total[w.start - base]

    upper, digit, punct = within(UPPER), within(DIGIT), within(PUNCT)
    length = w.end - w.start
    case = np.where(upper == 0, 0, np.where(upper == 1, 1, np.where(upper * 2 >= length - punct, 3, 2)))
    marks = np.where(punct == 0, 0, np.where(punct == length, 3, np.minimum(punct, 2)))
    size = np.searchsorted([3, 7, 14], length)
    again = np.zeros(len(w.key), bool)
    doc = np.searchsorted(w.first, np.arange(len(w.key)), "right")
    for back in (1, 2):
        again[back:] |= (w.key[back:] == w.key[:-back]) & (doc[back:] == doc[:-back]) if len(w.key) > back else False
    last = data[w.end - 1 - base]
    usual = (punct == 1) & ((last == 44) | (last == 46))
    return ((((case * 4 + marks) * 4 + size) * 2 + (digit > 0)) * 2 + again) * 2 + usual


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n): how often each word stands in the texts of a task."""

    def summed(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        key, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
        return key, np.bincount(at, np.concatenate([n for _, n in found])).astype(np.int64)

    held, size = [], 0
    for b in batches:
        for t in texts(b.column(0)):
            key, n = np.unique(split(t, ALNUM).key, return_counts=True)
            held.append((key, n))
            size += len(key)
            if size >= COUNTED:
                held = [summed(held)]
                size = len(held[0][0])
                if 2 * size >= COUNTED:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0][0].view(np.int64)), pa.array(held[0][1])], ["word", "n"])
                    held, size = [], 0
    if size:
        key, n = summed(held)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["word", "n"])


def vocabulary(docs: DataFrame, text_col: str, most: int) -> np.ndarray:
    """Sorted keys of the most frequent words: all from the least count on that leaves at most ``most``."""
    counts = docs.select(F.col(text_col).cast("string")).mapInArrow(giving_back(_counts), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    # eighths of a power of two: what reaches the driver does not grow with the corpus
    counts = keep(counts.select("word", F.floor(8 * F.log2("n")).cast("int").alias("level")))
    least, total = None, 0
    for level, n in sorted(counts.groupBy("level").count().collect(), reverse=True):
        total += n
        if total > most:
            break
        least = level
    if least is None:
        return np.zeros(0, U64)
    words = counts.where(F.col("level") >= least).select("word").toArrow()  # without a Python object per word
    return np.sort(words.column(0).to_numpy().view(U64))


def _context_sums(keys: np.ndarray):
    """(slot, sums): index vectors of the neighbours, summed over a task for each word of ``keys``."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(keys), DIM), np.int32)
        seen = np.zeros(len(keys), bool)
        words = 0
        for b in batches:
            for t in texts(b.column(0)):
                w = split(t, ALNUM)
                for lo in range(0, len(w.key), RUN):
                    hi = min(lo + RUN, len(w.key))
                    at, around = _neighbours(w, lo, hi, keys)
                    _add_at(total, at, around)
                    seen[at] = True
                    words += hi - lo
                    if words > MOST_WORDS:  # before 32 bits overflow
                        yield from _rows(total, seen)
                        total[:], seen[:], words = 0, False, 0
        yield from _rows(total, seen)

    return compute


MOST_WORDS = (1 << 31) // (2 * REACH) - RUN


def _neighbours(w: Words, lo: int, hi: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the words ``lo:hi`` that are in ``keys``, and the sum of their neighbours' index vectors."""
    a, z = max(0, lo - REACH), min(len(w.key), hi + REACH)
    own = index_vectors(w.key[a:z]).astype(np.int8)
    doc = np.searchsorted(w.first, np.arange(a, z), "right")
    around = np.zeros_like(own)
    for step in range(1, REACH + 1):
        same = (doc[step:] == doc[:-step])[:, None]
        around[:-step] += own[step:] * same
        around[step:] += own[:-step] * same
    at = np.minimum(np.searchsorted(keys, w.key[lo:hi]), len(keys) - 1)
    known = np.flatnonzero(keys[at] == w.key[lo:hi])
    return at[known], around[lo - a :][known]


def _add_at(total: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    if len(at):
        order = np.argsort(at, kind="stable")
        at = at[order]
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        total[at[first]] += np.add.reduceat(rows[order], first, axis=0, dtype=total.dtype)


def _rows(total: np.ndarray, seen: np.ndarray, size: int = 4096) -> Iterator[pa.RecordBatch]:
    slots = np.flatnonzero(seen)
    for k in range(0, len(slots), size):
        own = slots[k : k + size]
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array([x.tobytes() for x in total[own]], pa.binary())], ["slot", "sums"])


def _vectors(keys: np.ndarray):
    """(slot, vector): the sums of all tasks as word vectors. All rows of a slot are in one task."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((len(keys), DIM), np.int64), np.zeros(len(keys), bool)
        for b in batches:
            at = b.column(0).to_numpy()
            for k in range(0, len(at), 4096):
                _add_at(total, at[k : k + 4096], np.frombuffer(b"".join(b.column(1).slice(k, 4096).to_pylist()), np.int32).reshape(-1, DIM))
            seen[at] = True
        slots = np.flatnonzero(seen)
        for k in range(0, len(slots), 4096):
            own = slots[k : k + 4096]
            norm = np.sqrt((total[own].astype(np.float64) ** 2).sum(1, keepdims=True))
            vectors = index_vectors(keys[own]) + (2 * total[own] / np.maximum(norm, 1e-9)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array([x.tobytes() for x in vectors], pa.binary())], ["slot", "vector"])

    return compute


def word_vectors(docs: DataFrame, text_col: str, most: int = VOCABULARY) -> Vectors:
    """Vectors of the ``most`` most frequent words, from every text of the corpus. What reaches the driver is bounded by ``most``."""
    keys = vocabulary(docs, text_col, most)
    if not len(keys):
        return Vectors(keys, np.zeros((0, DIM), np.float32))
    sums = docs.select(F.col(text_col).cast("string")).mapInArrow(giving_back(_context_sums(keys)), "slot int, sums binary")
    table = index_vectors(keys)
    for slot, blob in sums.repartition("slot").mapInArrow(giving_back(_vectors(keys)), "slot int, vector binary").toLocalIterator():
        table[slot] = np.frombuffer(blob, np.float32)
    return Vectors(keys, table)


def _pooled(of: Callable[[int, int], np.ndarray], bounds: np.ndarray, out: np.ndarray) -> None:
    """Mean of each text's vectors, then the largest and smallest mean of its stretches, into ``out``.

    ``of`` gives the vectors of a range of words; ranges have at most ``RUN`` words.
    """
    some = np.flatnonzero(np.diff(bounds))
    if not len(some):
        return
    n = np.diff(bounds)[some]
    blocks = -(-n // STRETCH)
    first = np.cumsum(blocks) - blocks
    starts = np.repeat(bounds[some] - first * STRETCH, blocks) + np.arange(blocks.sum()) * STRETCH
    ends = np.repeat(bounds[some] + n, blocks)
    size = np.minimum(ends - starts, STRETCH)
    sums = np.empty((len(starts), DIM), np.float32)
    for k in range(0, len(starts), RUN // STRETCH):
        own = starts[k : k + RUN // STRETCH]
        sums[k : k + len(own)] = np.add.reduceat(of(own[0], own[-1] + size[k + len(own) - 1]), own - own[0], axis=0)
    mean = np.add.reduceat(sums, first, axis=0) / n[:, None].astype(np.float32)
    means = sums / size[:, None].astype(np.float32)
    # a short last stretch counts with its text's mean for the rest, or it would be mostly chance
    share = (size / STRETCH)[:, None].astype(np.float32)
    means = means * share + np.repeat(mean, blocks, axis=0) * (1 - share)
    out[some, :DIM] = mean
    out[some, DIM : 2 * DIM] = np.maximum.reduceat(means, first, axis=0)
    out[some, 2 * DIM :] = np.minimum.reduceat(means, first, axis=0)


def features(t: Texts, vectors: Vectors) -> np.ndarray:
    """One row per text: pooled words, pooled shapes, length. A text without words or marks is all zero."""
    out = np.zeros((t.hi - t.lo, FEATURES), np.float32)
    w = split(t, ALNUM)
    _pooled(lambda lo, hi: vectors.of(w.key[lo:hi]), w.first, out[:, : 3 * DIM])
    w = split(t, SPACED, lower=False)

    def shapes(lo: int, hi: int) -> np.ndarray:
        before = max(0, lo - 2)  # a word is compared with the two before it
        return SHAPE_VECTORS[word_shapes(t, between(w, before, hi))[lo - before :]]

    _pooled(shapes, w.first, out[:, 3 * DIM : 6 * DIM])
    out[:, 6 * DIM] = np.log1p(np.diff(w.first))
    return out


class Network(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1)
        return h @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 40, decay: float = 1e-4, seed: int = 5) -> Network:
    """Two layers by Adam on log loss; then the temperature with the least log loss on every fifth row. ``x`` is scaled in place."""
    if not len(y) or y.min() == y.max():  # nothing to tell apart: the score is the share of label 1, 1/2 without labels
        share = float(y.mean()) if len(y) else 0.5
        zero = np.zeros(FEATURES, np.float32)
        return Network(zero, zero + 1, np.zeros((FEATURES, 1), np.float32), np.zeros(1, np.float32), np.zeros(1, np.float32), float(np.log((share + 0.01) / (1.01 - share))), 1.0)
    rng = np.random.default_rng(seed)
    held = np.arange(len(y)) % 5 == 4
    mean = x.mean(0)
    # in place and in parts: the driver holds one matrix
    scale = np.sqrt(sum(np.square(x[k : k + 1024] - mean).sum(0) for k in range(0, len(x), 1024)) / len(x)) + np.float32(1e-3)
    x -= mean
    x /= scale
    z = x
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)).astype(np.float32), np.zeros(hidden, np.float32), rng.normal(0, 0.2, hidden).astype(np.float32), np.zeros(1, np.float32)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    rows = np.flatnonzero(~held) if (~held).any() else np.arange(len(y))
    for epoch in range(epochs):
        rate = 0.004 * (1 - epoch / epochs)
        order = rng.permutation(rows)
        for k in range(0, len(order), 256):
            i = order[k : k + 256]
            h = np.tanh(z[i] @ p[0] + p[1])
            d = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - y[i]).astype(np.float32) / len(i)
            dh = np.outer(d, p[2]) * (1 - h * h)
            grads = [z[i].T @ dh + decay * p[0], dh.sum(0), h.T @ d + decay * p[2], d.sum(keepdims=True)]
            step += 1
            for j, g in enumerate(grads):
                m[j] = 0.9 * m[j] + 0.1 * g
                v[j] = 0.99 * v[j] + 0.01 * g * g
                p[j] = p[j] - rate * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.99**step)) + 1e-7)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
    if not held.any():
        return net
    logit = np.tanh(z[held] @ net.w1 + net.b1) @ net.w2 + net.b2
    grid = np.geomspace(0.5, 8, 40)
    loss = [np.logaddexp(0, np.where(y[held] > 0, -logit, logit) / g).mean() for g in grid]
    return net._replace(temperature=float(grid[int(np.argmin(loss))]))


def fit(docs: DataFrame, id_col: str, text_col: str, labels: DataFrame, label_id: str, label_col: str, rows: int = TRAIN_ROWS) -> tuple[Vectors, Network]:
    """Word vectors from all of ``docs``; the network from at most ``rows`` labelled texts."""
    vectors = word_vectors(docs, text_col)
    carried = docs.sparkSession.sparkContext.broadcast(vectors)
    wanted = labels.where(F.col(label_col).isNotNull() & F.col(label_id).isNotNull()).select(F.col(label_id).cast("long").alias("id"), F.col(label_col).cast("int").alias("y"))
    wanted = keep(wanted.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(rows))
    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(wanted), "id")

    def compute(batches):
        for b in batches:
            for t in texts(b.column(1)):
                x = features(t, carried.value)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(t.lo, t.hi - t.lo), b.column(2).slice(t.lo, t.hi - t.lo), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "y", "x"]
                )

    got = chosen.select("id", "text", "y").mapInArrow(giving_back(compute), "id long, y int, x binary").toArrow()
    rank = np.empty(got.num_rows, np.int64)
    rank[np.lexsort((got.column(1).to_numpy(), got.column(0).to_numpy()))] = np.arange(got.num_rows)
    x, y = np.empty((got.num_rows, FEATURES), np.float32), np.empty(got.num_rows, np.float32)
    y[rank] = got.column(1).to_numpy()
    for k, v in zip(rank, got.column(2)):
        x[k] = np.frombuffer(v.as_buffer(), np.float32)
    del got
    carried.destroy()
    net = train(x, y)
    del x
    give_back()
    return vectors, net


def score(docs: DataFrame, id_col: str, text_col: str, model: tuple[Vectors, Network]) -> DataFrame:
    """(id, score) per row: 0 to 1, higher is better. Null text counts as empty; every text has a score."""
    carried = docs.sparkSession.sparkContext.broadcast(model)

    def compute(batches):
        vectors, net = carried.value
        for b in batches:
            for t in texts(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(t.lo, t.hi - t.lo), pa.array(net.scores(features(t, vectors)).astype(np.float64))], ["id", "score"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(giving_back(compute), "id long, score double")


def keep_good(docs: DataFrame, text_col: str, model: tuple[Vectors, Network], accept: float) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``accept``, with all their columns."""
    carried = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def rows(batches):
        vectors, net = carried.value
        for b in batches:
            for t in texts(b.column(at)):
                good = net.scores(features(t, vectors)) >= accept
                if good.any():
                    yield b.slice(t.lo, t.hi - t.lo).filter(pa.array(good))

    return docs.mapInArrow(giving_back(rows), docs.schema)
