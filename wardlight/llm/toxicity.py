"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as the sum of a hashed word vector and, beside it, of its hashed character n-grams (four bytes;
the first ones of a word apart). Windows of 24 words, each overlapping the next by half, are read in both
directions, so any 13 words in a row are whole in one of them; attention pools the states of a window to a score, and a text is as toxic as its worst window.
All windows of a text are scored, however long it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import keep
from .words import ALNUM, LOWER, U64, Texts, Words, between, mix, split, texts

WINDOW, STRIDE = 24, 12
WORDS, GRAMS = 1 << 13, 1 << 14
EMB, HIDDEN = 8, 8
INPUT = 2 * EMB
#: words read at a time; a run less a window is a whole number of strides
RUN = 682 * STRIDE + WINDOW
#: training takes at most so many toxic and other labelled texts, of at most so many characters
TRAIN_TOXIC, TRAIN_OTHER, TRAIN_CHARS = 1000, 1500, 20_000


class Inputs:
    """Numbers of words and n-grams of some texts, and the windows over their words."""

    def __init__(self, t: Texts, w: Words | None = None):
        w = split(t, ALNUM) if w is None else w
        self.docs = len(w.first) - 1
        n = len(w.key)
        base = int(w.start[0]) if n else 0
        data = np.concatenate([LOWER[t.data[base : int(w.end[-1]) if n else 0]], np.zeros(4, np.uint8)]).astype(np.uint64)
        four = data[:-3] | data[1:-2] << U64(8) | data[2:-1] << U64(16) | data[3:] << U64(24)
        length = w.end - w.start
        # n-grams inside words: byte places up to four before the end
        inner = np.maximum(length - 3, 0)
        self.per_word = inner + 1
        self.first_gram = np.cumsum(self.per_word) - self.per_word
        gram = np.zeros(int(self.per_word.sum()), np.int64)
        head = four[w.start - base] & np.where(length < 4, (U64(1) << (np.minimum(length, 4).astype(np.uint64) * U64(8) & U64(63))) - U64(1), U64(0xFFFFFFFF)) if n else np.zeros(0, U64)
        gram[self.first_gram] = (mix(head + U64(1 << 40)) & U64(GRAMS - 1)).astype(np.int64)
        own = np.repeat(np.arange(n), inner)
        place = np.arange(len(own)) - np.repeat(np.cumsum(inner) - inner, inner)
        gram[self.first_gram[own] + 1 + place] = (mix(four[w.start[own] - base + place]) & U64(GRAMS - 1)).astype(np.int64)
        self.gram = gram
        self.word = (w.key & U64(WORDS - 1)).astype(np.int64)
        self.weight = (1 / np.sqrt(self.per_word)).astype(np.float32)
        # windows: the last one of a text ends with it
        count = np.diff(w.first)
        windows = np.where(count == 0, 0, 1 + np.maximum(0, -(-(count - WINDOW) // STRIDE)))
        self.first_window = np.concatenate([[0], np.cumsum(windows)])
        doc = np.repeat(np.arange(self.docs), windows)
        step = np.arange(len(doc)) - self.first_window[doc]
        begin = np.maximum(0, np.minimum(step * STRIDE, count[doc] - WINDOW))
        at = w.first[doc][:, None] + begin[:, None] + np.arange(WINDOW)
        self.inside = begin[:, None] + np.arange(WINDOW) < count[doc][:, None]
        self.at = np.where(self.inside, at, n)  # n: no word
        self.doc = doc


def _sigmoid(x):
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Reader:
    """Parameters and passes of the network."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        f = lambda scale, *shape: (rng.normal(0, scale, shape)).astype(np.float32)
        h = HIDDEN
        self.p = {
            "word": f(0.1, WORDS, EMB), "gram": f(0.1, GRAMS, EMB),
            "wf": f(0.3, INPUT, 3 * h), "uf": f(0.3, h, 3 * h), "bf": np.zeros(3 * h, np.float32),
            "wb": f(0.3, INPUT, 3 * h), "ub": f(0.3, h, 3 * h), "bb": np.zeros(3 * h, np.float32),
            "att": f(0.3, 2 * h), "out": f(0.5, 2 * h), "bias": np.full(1, -1, np.float32),
        }
        self.platt = (1.0, 0.0)

    def embed(self, x: Inputs) -> np.ndarray:
        """One row per word, and a last row of zeros for places without a word."""
        out = np.zeros((len(x.word) + 1, INPUT), np.float32)
        if len(x.word):
            out[:-1, :EMB] = self.p["word"][x.word]
            out[:-1, EMB:] = np.add.reduceat(self.p["gram"][x.gram], x.first_gram, axis=0) * x.weight[:, None]
        return out

    def _direction(self, gates: np.ndarray, at: np.ndarray, u: np.ndarray, order, keep_all: bool):
        h = np.zeros((len(at), HIDDEN), np.float32)
        states = np.zeros((WINDOW, len(at), HIDDEN), np.float32)
        kept = []
        for t in order:
            g, gh = gates[at[:, t]], h @ u
            zr = _sigmoid(g[:, : 2 * HIDDEN] + gh[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(g[:, 2 * HIDDEN :] + r * gh[:, 2 * HIDDEN :])
            if keep_all:
                kept.append((h, z, r, n, gh[:, 2 * HIDDEN :]))
            h = n + z * (h - n)
            states[t] = h
        return states, kept

    def windows(self, x: Inputs, rows: slice = slice(None), emb: np.ndarray | None = None, keep_all: bool = False):
        """Scores of the windows ``rows``, and what the way back needs."""
        p, at, inside = self.p, x.at[rows], x.inside[rows]
        emb = self.embed(x) if emb is None else emb
        fw, kf = self._direction(emb @ p["wf"] + p["bf"], at, p["uf"], range(WINDOW), keep_all)
        bw, kb = self._direction(emb @ p["wb"] + p["bb"], at, p["ub"], reversed(range(WINDOW)), keep_all)
        states = np.concatenate([fw, bw], axis=2)
        a = states @ p["att"]
        a[~inside.T] = -1e9
        a = np.exp(a - a.max(0))
        a /= a.sum(0)
        pooled = (states * a[:, :, None]).sum(0)
        score = pooled @ p["out"] + p["bias"]
        return score, (emb, at, kf, kb, states, a, pooled)

    def doc_logits(self, x: Inputs) -> np.ndarray:
        """The worst window of each text; a text without words has the bias alone."""
        out = np.full(x.docs, self.p["bias"][0], np.float64)
        if len(x.doc):
            score, emb = np.empty(len(x.doc), np.float32), self.embed(x)
            p = self.p
            gates = emb @ p["wf"] + p["bf"], emb @ p["wb"] + p["bb"]
            for k in range(0, len(x.doc), 4096):
                rows = slice(k, k + 4096)
                at, inside = x.at[rows], x.inside[rows]
                states = np.concatenate(
                    [self._direction(gates[0], at, p["uf"], range(WINDOW), False)[0], self._direction(gates[1], at, p["ub"], reversed(range(WINDOW)), False)[0]], axis=2
                )
                a = states @ p["att"]
                a[~inside.T] = -1e9
                a = np.exp(a - a.max(0))
                v = states @ p["out"]  # pooling commutes with the last layer
                score[rows] = (a * v).sum(0) / a.sum(0) + p["bias"]
            some = np.flatnonzero(np.diff(x.first_window))
            out[some] = np.maximum.reduceat(score, x.first_window[some])
        return out

    def calibrated(self, logits: np.ndarray) -> np.ndarray:
        a, b = self.platt
        return 1 / (1 + np.exp(-np.clip(a * logits + b, -40, 40)))

    def scores(self, x: Inputs) -> np.ndarray:
        return self.calibrated(self.doc_logits(x))

    def scores_of(self, t: Texts) -> np.ndarray:
        """One score per text; words are read in runs of whole windows, also inside one text."""
        w = split(t, ALNUM)
        if len(w.key) <= RUN or t.hi - t.lo > 1:
            return self.scores(Inputs(t, w))
        # the run's last window is the next one's first, so every window of the text lies in a run
        starts = range(0, max(1, len(w.key) - WINDOW), RUN - WINDOW)
        return self.calibrated(np.max([self.doc_logits(Inputs(t, between(w, k, min(k + RUN, len(w.key))))) for k in starts], axis=0))

    def gradients(self, x: Inputs, y: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        """Of the log loss of texts whose score is the softmax-weighted mean of their windows."""
        p = self.p
        score, (emb, at, kf, kb, states, a, pooled) = self.windows(x, keep_all=True)
        top = np.full(x.docs, -np.inf)
        np.maximum.at(top, x.doc, score)
        w = np.exp(score - top[x.doc])
        w /= np.bincount(x.doc, w, x.docs)[x.doc]
        logit = np.bincount(x.doc, w * score, x.docs)
        some = np.isfinite(top)
        d_doc = np.where(some, 1 / (1 + np.exp(-logit)) - y, 0) / max(1, some.sum())
        loss = float(np.logaddexp(0, np.where(y > 0, -logit, logit))[some].mean())
        d = (d_doc[x.doc] * w).astype(np.float32)
        g = {"bias": d.sum(keepdims=True), "out": pooled.T @ d}
        d_pool = np.outer(d, p["out"])
        d_a = (states * d_pool).sum(2)
        d_att = a * (d_a - (a * d_a).sum(0))
        g["att"] = np.einsum("twh,tw->h", states, d_att)
        d_states = a[:, :, None] * d_pool + d_att[:, :, None] * p["att"]
        d_emb = np.zeros_like(emb)
        for kept, order, side, w_, u_, b_ in ((kf, range(WINDOW), slice(0, HIDDEN), "wf", "uf", "bf"), (kb, list(reversed(range(WINDOW))), slice(HIDDEN, None), "wb", "ub", "bb")):
            u, dh = p[u_], np.zeros((len(at), HIDDEN), np.float32)
            du = np.zeros_like(u)
            d_gates = np.zeros((len(emb), 3 * HIDDEN), np.float32)
            flat, places = [], []
            for t, (h, z, r, n, ghn) in zip(reversed(list(order)), reversed(kept)):
                dh = dh + d_states[t][:, side]
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (h - n) * z * (1 - z)
                dr = dn * ghn * r * (1 - r)
                back = np.concatenate([dz, dr, dn * r], axis=1)
                du += h.T @ back
                flat.append(np.concatenate([dz, dr, dn], axis=1))
                places.append(at[:, t])
                dh = dh * z + back @ u.T
            flat, places = np.concatenate(flat), np.concatenate(places)
            for k in range(3 * HIDDEN):
                d_gates[:, k] = np.bincount(places, flat[:, k], len(emb))
            g[w_], g[u_], g[b_] = emb.T @ d_gates, du, d_gates.sum(0)
            d_emb += d_gates @ p[w_].T
        d_emb = d_emb[:-1]
        g["word"] = np.stack([np.bincount(x.word, d_emb[:, k], WORDS) for k in range(EMB)], 1)
        spread = np.repeat(d_emb[:, EMB:] * x.weight[:, None], x.per_word, axis=0)
        g["gram"] = np.stack([np.bincount(x.gram, spread[:, k], GRAMS) for k in range(EMB)], 1)
        return g, loss


def _inputs(rows: list[str]) -> Inputs:
    return Inputs(next(texts(pa.array(rows, pa.string()), 1 << 60)))


def train(rows: list[tuple[str, int]], epochs: int = 6, batch: int = 32, seed: int = 9) -> Reader:
    """Adam on batches of whole texts; then the score's scale and shift on every sixth text, held back."""
    net, rng = Reader(), np.random.default_rng(seed)
    y = np.array([v for _, v in rows])
    if not len(y) or y.min() == y.max():
        net.platt = (0.0, float(np.log((y.mean() + 0.01) / (1.01 - y.mean()))) if len(y) else 0.0)
        return net
    held = np.arange(len(rows)) % 6 == 5
    use = np.flatnonzero(~held)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(a) for k, a in net.p.items()}
    step, steps = 0, epochs * -(-len(use) // batch)
    for _ in range(epochs):
        order = rng.permutation(use)
        for k in range(0, len(order), batch):
            i = order[k : k + batch]
            g, _ = net.gradients(_inputs([rows[j][0] for j in i]), y[i])
            step += 1
            rate = 0.02 * min(1, step / 20) * (1 - step / (steps + 1))
            for name, a in net.p.items():
                d = np.clip(g[name], -1, 1) + (1e-5 * a if name in ("word", "gram") else 0)
                m[name] = 0.9 * m[name] + 0.1 * d
                v[name] = 0.98 * v[name] + 0.02 * d * d
                net.p[name] = (a - rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.98**step)) + 1e-6)).astype(np.float32)
    back = np.flatnonzero(held)
    z = np.concatenate([net.doc_logits(_inputs([rows[j][0] for j in back[k : k + 64]])) for k in range(0, len(back), 64)]) if len(back) else np.zeros(0)
    if len(set(y[back])) == 2:
        best = min(
            ((np.logaddexp(0, np.where(y[back] > 0, -(a * z + b), a * z + b)).mean(), a, b) for a in np.geomspace(0.2, 2, 12) for b in np.linspace(-4, 4, 33)),
        )
        net.platt = (float(best[1]), float(best[2]))
    return net


def fit(docs: DataFrame, id_col: str, text_col: str, labels: DataFrame, label_id: str, label_col: str, toxic: int = TRAIN_TOXIC, other: int = TRAIN_OTHER, chars: int = TRAIN_CHARS) -> Reader:
    """Train on at most ``toxic`` + ``other`` labelled texts, those with the smallest hash of their id."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(label_id).isNotNull()).groupBy(F.col(label_id).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    first = [F.xxhash64("id"), F.col("id")]
    # twice as many ids as wanted, since some texts are too long or missing
    wanted = keep(known.where("y = 1").orderBy(*first).limit(2 * toxic).unionByName(known.where("y = 0").orderBy(*first).limit(2 * other)))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where(F.length("text") <= chars).join(F.broadcast(wanted), "id")
    rows = keep(rows.dropDuplicates(["id"]))
    chosen = rows.where("y = 1").orderBy(*first).limit(toxic).unionByName(rows.where("y = 0").orderBy(*first).limit(other)).collect()
    return train([(r.text, r.y) for r in sorted(chosen, key=lambda r: r.id * 0x9E3779B97F4A7C15 % (1 << 64))])


def score(docs: DataFrame, id_col: str, text_col: str, model: Reader) -> DataFrame:
    """(id, score) per row: 0 to 1, higher is more toxic. Null text counts as empty; every text has a score."""
    carried = docs.sparkSession.sparkContext.broadcast(model)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = carried.value
        for b in batches:
            for t in texts(b.column(1), 1 << 18):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(t.lo, t.hi - t.lo), pa.array(net.scores_of(t))], ["id", "score"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(compute, "id long, score double")
