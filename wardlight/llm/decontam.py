"""Benchmark decontamination with an FM-index per shard of training text.

A shard is a run of whole texts of an Arrow batch. Its words become symbols: the words of the test phrases
have numbers, and each run of other words is one separator, since no phrase can cross it. The shard's
Burrows-Wheeler transform is held in a wavelet tree (a bit row per level of the symbol's number, with
counts before each place). Test phrases are found by backward search, all at once, through ranks in that
tree; places are found by walking back to suffixes whose position is sampled, and spans that overlap are
merged. Shards are independent: a text is never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import keep
from .words import ALNUM, U64, Texts, split, texts

#: words of test phrases a pass over the texts carries; a larger test set takes several passes
WORDS_A_PASS = 2_000_000
SAMPLE = 8
SHARD_BYTES = 4 << 20


class WaveletTree:
    """Ranks of symbols in a sequence: one row of bits for each binary digit of a symbol, highest first."""

    def __init__(self, seq: np.ndarray, n_symbols: int):
        self.digits = max(1, int(n_symbols - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        cur = seq
        for d in reversed(range(self.digits)):
            bit = (cur >> d & 1).astype(bool)
            ones = np.zeros(len(cur) + 1, np.int32)
            np.cumsum(bit, dtype=np.int32, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(cur) - int(ones[-1]))
            cur = np.concatenate([cur[~bit], cur[bit]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        at, begin = upto.astype(np.int64), np.zeros(len(upto), np.int64)
        for level, d in enumerate(reversed(range(self.digits))):
            one, zero = self.ones[level], self.zeros[level]
            bit = (symbol >> d & 1).astype(bool)
            a, b = one[at].astype(np.int64), one[begin].astype(np.int64)
            at = np.where(bit, zero + a, at - a)
            begin = np.where(bit, zero + b, begin - b)
        return at - begin

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbol at each place."""
        at, out = at.astype(np.int64), np.zeros(len(at), np.int64)
        for level in range(self.digits):
            one = self.ones[level]
            a = one[at].astype(np.int64)
            bit = one[at + 1] - one[at]
            out = out << 1 | bit
            at = np.where(bit == 1, self.zeros[level] + a, at - a)
        return out


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by doubling the compared length; only suffixes still tied are sorted again."""
    n = len(seq)
    bits = max(1, int(seq.max()).bit_length()) if n else 1
    first = max(1, 62 // bits)
    packed = np.zeros(n, np.int64)
    for k in range(first):  # as many symbols as fit into one integer
        packed = packed << bits
        packed[: n - k] |= seq[k:] if k < n else 0
    order = np.argsort(packed, kind="stable")
    head = np.concatenate([[True], packed[order][1:] != packed[order][:-1]]) if n else np.zeros(0, bool)
    rank = np.empty(n, np.int64)
    place = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank[order] = place
    length = first
    while True:
        tied = np.flatnonzero(~head | np.append(~head[1:], False))
        if not len(tied):
            return order
        own = order[tied]
        nxt = own + length
        key = np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0)
        group = place[tied]
        sub = np.lexsort((key, group))
        own, key = own[sub], key[sub]
        order[tied] = own
        group = group[sub]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])])
        head[tied] = new
        start = np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))
        place[tied] = tied[start]
        rank[own] = place[tied]
        length *= 2


class FmIndex:
    """Backward search over a sequence of symbols from 1; 0 closes it."""

    def __init__(self, seq: np.ndarray, n_symbols: int):
        seq = np.append(seq, 0)
        order = suffix_array(seq)
        self.bwt = WaveletTree(seq[order - 1], n_symbols)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=n_symbols))])
        marked = order % SAMPLE == 0
        self.marks = np.concatenate([[0], np.cumsum(marked)]).astype(np.int32)
        self.sampled = order[marked]
        self.n = len(seq)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix interval of each row of ``phrases`` (one length)."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for k in reversed(range(phrases.shape[1])):
            c = phrases[live, k]
            lo[live] = self.before[c] + self.bwt.rank(c, lo[live])
            hi[live] = self.before[c] + self.bwt.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
            if not len(live):
                break
        hi = np.maximum(lo, hi)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Position of the suffix at each place of the order, by steps back to a sampled one."""
        out = np.zeros(len(rows), np.int64)
        at, live, steps = rows.astype(np.int64), np.arange(len(rows)), 0
        while len(live):
            known = self.marks[at + 1] > self.marks[at]
            out[live[known]] = self.sampled[self.marks[at[known]]] + steps
            live, at = live[~known], at[~known]
            c = self.bwt.access(at)
            at = self.before[c] + self.bwt.rank(c, at)
            steps += 1
        return out


class Phrases:
    """Distinct windows of the test items, by length, over one vocabulary of word keys."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray, windows: list[tuple[np.ndarray, list[np.ndarray]]]):
        self.keys, self.ids, self.windows = keys, ids, windows

    @classmethod
    def of(cls, items: list[tuple[int, str]], window: int) -> Phrases:
        if not items:
            return cls(np.zeros(0, U64), np.zeros(0, np.int64), [])
        t = next(texts(pa.array([x or "" for _, x in items], pa.string()), 1 << 60))
        w = split(t, ALNUM)
        keys = np.unique(w.key)
        symbol = np.searchsorted(keys, w.key) + 2  # 0 closes the sequence, 1 separates
        by: dict[int, dict[bytes, set[int]]] = {}
        for j in range(len(items)):
            own = symbol[w.first[j] : w.first[j + 1]]
            size = min(window, len(own))
            for k in range(len(own) - size + 1) if size else ():
                by.setdefault(size, {}).setdefault(own[k : k + size].tobytes(), set()).add(j)
        windows = []
        for size, found in sorted(by.items()):
            phrases = np.frombuffer(b"".join(found), np.int64).reshape(-1, size)
            windows.append((phrases, [np.array(sorted(x)) for x in found.values()]))
        return cls(keys, np.array([i for i, _ in items], np.int64), windows)


def _shard(t: Texts, phrases: Phrases) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Per text: words, then merged spans of hit words (begins, ends) and items found."""
    w = split(t, ALNUM)
    docs = t.hi - t.lo
    n_words = np.diff(w.first)
    none = [np.zeros(0, np.int64)] * docs
    if not len(w.key) or not phrases.windows:
        return n_words, none, list(none), list(none)
    at = np.minimum(np.searchsorted(phrases.keys, w.key), len(phrases.keys) - 1)
    known = phrases.keys[at] == w.key
    doc = np.repeat(np.arange(docs), n_words)
    # a separator before the first word of each text and in place of each run of other words
    opens = np.zeros(len(w.key), bool)
    opens[w.first[:-1][n_words > 0]] = True
    after_known = np.concatenate([[False], known[:-1]])
    word = np.flatnonzero(known)
    gap = known & (~after_known | opens)
    place = np.arange(len(word)) + np.cumsum(gap[word])
    seq = np.ones(len(word) + int(gap.sum()), np.int64)
    seq[place] = at[word] + 2
    back = np.zeros(len(seq) + 1, np.int64)
    back[place] = word
    index = FmIndex(seq, len(phrases.keys) + 2)
    begins, sizes, items, owners = [], [], [], []
    for rows, held in phrases.windows:
        lo, hi = index.search(rows)
        hit = np.flatnonzero(hi > lo)
        if not len(hit):
            continue
        count = (hi - lo)[hit]
        which = np.repeat(hit, count)
        rank = np.repeat(lo[hit], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        first = back[index.locate(rank)]
        begins.append(first)
        sizes.append(np.full(len(first), rows.shape[1]))
        several = np.array([len(held[x]) for x in hit])
        owners.append(np.repeat(doc[first], np.repeat(several, count)))
        items.append(np.concatenate([np.tile(held[x], c) for x, c in zip(hit, count)]))
    if not begins:
        return n_words, none, list(none), list(none)
    begin, size = np.concatenate(begins), np.concatenate(sizes)
    cover = np.zeros(len(w.key) + 1, np.int64)
    np.add.at(cover, begin, 1)
    np.add.at(cover, begin + size, -1)
    inside = np.cumsum(cover[:-1]) > 0
    starts = np.flatnonzero(inside & (~np.concatenate([[False], inside[:-1]]) | opens))
    stops = np.flatnonzero(inside & (~np.append(inside[1:], False) | np.append(opens[1:], True))) + 1
    owner = doc[starts]
    cut = np.searchsorted(owner, np.arange(docs + 1))
    pair = np.unique(np.concatenate(owners) * len(phrases.ids) + np.concatenate(items))
    of = np.searchsorted(pair // len(phrases.ids), np.arange(docs + 1))
    found = phrases.ids[pair % len(phrases.ids)]
    base = w.first
    return (
        n_words,
        [starts[cut[i] : cut[i + 1]] - base[i] for i in range(docs)],
        [stops[cut[i] : cut[i + 1]] - base[i] for i in range(docs)],
        [found[of[i] : of[i + 1]] for i in range(docs)],
    )


def _pass(docs: DataFrame, carried: Broadcast, window: int) -> DataFrame:
    """The last column of ``docs`` is the text; the others go along."""
    keys = docs.drop("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases.of(carried.value, window)
        for b in batches:
            for t in texts(b.column(b.num_columns - 1), SHARD_BYTES):
                n, starts, stops, found = _shard(t, phrases)
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(t.lo, t.hi - t.lo) for c in b.columns[:-1]), pa.array(n.astype(np.int64)), *(pa.array(x, pa.list_(pa.int64())) for x in (starts, stops, found))],
                    [*b.schema.names[:-1], "n_words", "starts", "stops", "items"],
                )

    fields = ", ".join(f"{name} {kind}" for name, kind in keys.dtypes)
    return docs.mapInArrow(rows, f"{fields}, n_words long, starts array<long>, stops array<long>, items array<long>")


#: spans of several passes over one text, merged where they touch
MERGED = "aggregate(array_sort(flatten(collect_list(arrays_zip(starts, stops)))), cast(array() as array<struct<starts:bigint,stops:bigint>>), (a, x) -> case when size(a) > 0 and x.starts <= element_at(a, -1).stops then concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).starts as starts, greatest(element_at(a, -1).stops, x.stops) as stops))) else concat(a, array(x)) end)"


def _passes(docs: DataFrame, slices: list[Broadcast], window: int) -> DataFrame:
    out = _pass(docs, slices[0], window)
    for carried in slices[1:]:
        out = out.unionByName(_pass(docs, carried, window))
    return out


def _without(t: Texts, starts: list[np.ndarray], stops: list[np.ndarray]) -> list[str]:
    """The texts without their spans."""
    w = split(t, ALNUM)
    out = []
    for i in range(t.hi - t.lo):
        own = t.data[t.offsets[i] : t.offsets[i + 1]]
        if len(starts[i]):
            stay = np.ones(len(own), bool)
            for a, z in zip(starts[i], stops[i]):
                stay[w.start[w.first[i] + a] - t.offsets[i] : w.end[w.first[i] + z - 1] - t.offsets[i]] = False
            own = own[stay]
        out.append(own.tobytes().decode("utf-8", "replace"))
    return out


def _slices(benchmark: DataFrame, item_col: str, item_text: str, words_a_pass: int) -> list[Broadcast]:
    """The test set in parts of at most ``words_a_pass`` words, a longer item being a part of its own; one empty part if there is none."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).cast("string").alias("text")).where("item is not null and text is not null").distinct()
    carry = benchmark.sparkSession.sparkContext.broadcast
    out, batch, weight = [], [], 0
    for item, text in items.orderBy("item", "text").toLocalIterator():
        n = len(split(next(texts(pa.array([text], pa.string()), 1 << 60)), ALNUM).key)
        if not n:
            continue
        if batch and weight + n > words_a_pass:
            out.append(carry(batch))
            batch, weight = [], 0
        batch.append((item, text))
        weight += n
    return [*out, carry(batch)] if batch or not out else out


def _cleaned_by_rounds(docs: DataFrame, text_col: str, slices: list[Broadcast], window: int) -> DataFrame:
    """A round takes the spans of all slices out of a text at once, as one slice would; changed texts have another round."""
    keyed = keep(docs.withColumn("__row", F.monotonically_increasing_id()))
    todo = keyed.where(F.col(text_col).isNotNull()).select("__row", F.col(text_col).cast("string").alias("text"))

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in texts(b.column(1), SHARD_BYTES):
                starts, stops = (b.column(c).slice(t.lo, t.hi - t.lo).to_pylist() for c in (2, 3))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(t.lo, t.hi - t.lo), pa.array(_without(t, starts, stops), pa.string())], ["__row", "text"])

    rounds = []
    while True:
        found = _passes(todo, slices, window).where(F.size("starts") > 0).groupBy("__row").agg(F.expr(MERGED).alias("s"))
        hit = todo.join(found, "__row").select("__row", "text", F.col("s.starts").alias("starts"), F.col("s.stops").alias("stops"))
        todo = keep(hit.mapInArrow(removed, "__row long, text string"))
        if todo.isEmpty():
            break
        rounds.append(todo.withColumn("__round", F.lit(len(rounds))))
    if not rounds:
        return keyed.select(*docs.columns)
    changed = rounds[0]
    for r in rounds[1:]:
        changed = changed.unionByName(r)
    changed = changed.groupBy("__row").agg(F.max_by("text", "__round").alias("__text"))
    return keyed.join(changed, "__row", "left").withColumn(text_col, F.coalesce("__text", F.col(text_col))).select(*docs.columns)


def cleaned(docs: DataFrame, text_col: str, benchmark: DataFrame, item_col: str, item_text: str, window: int = 10, words_a_pass: int = WORDS_A_PASS) -> DataFrame:
    """``docs`` with all spans of test phrases removed from the text, until none is left.

    All columns stay as they are but the text. Null stays null; an empty test set changes nothing. The result does
    not depend on ``words_a_pass``. Columns with a leading ``__`` are the operator's own.
    """
    at = docs.columns.index(text_col)
    slices = _slices(benchmark, item_col, item_text, words_a_pass)
    if len(slices) > 1:
        return _cleaned_by_rounds(docs, text_col, slices, window)
    carried = slices[0]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases.of(carried.value, window)
        for b in batches:
            changed: dict[int, str] = {}
            for t in texts(b.column(at), SHARD_BYTES):
                _, starts, stops, _ = _shard(t, phrases)
                hit = [i for i, x in enumerate(starts) if len(x)]
                if hit:
                    new = _without(t, starts, stops)
                    changed |= {t.lo + i: new[i] for i in hit}
            again = list(changed)
            while again:  # what closes up may be a phrase again
                t = next(texts(pa.array([changed[i] for i in again], pa.string()), 1 << 60))
                _, starts, stops, _ = _shard(t, phrases)
                new = _without(t, starts, stops)
                hit = [j for j, x in enumerate(starts) if len(x)]
                changed |= {again[j]: new[j] for j in hit}
                again = [again[j] for j in hit]
            if changed:
                body = b.column(at).to_pylist()
                for i, x in changed.items():
                    body[i] = x
                columns = list(b.columns)
                columns[at] = pa.array(body, b.column(at).type)
                b = pa.RecordBatch.from_arrays(columns, schema=b.schema)
            yield b

    return docs.mapInArrow(rows, docs.schema)


def spans(docs: DataFrame, id_col: str, text_col: str, benchmark: DataFrame, item_col: str, item_text: str, window: int = 10, words_a_pass: int = WORDS_A_PASS) -> DataFrame:
    """(id, n_words, starts, stops, items) per row of ``docs``: spans of words inside test windows, and the items.

    A window is ``window`` words in a row
    of an item; a shorter item that has words is one window. Null and empty texts have no words and no
    spans; items without words or id occur nowhere; repeated items count once. The test set is read in
    passes of bounded size: what a pass broadcasts is at most
    ``words_a_pass`` words (or one item), whatever its size; passes are merged by row, so their number does not show.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    slices = _slices(benchmark, item_col, item_text, words_a_pass)
    if len(slices) == 1:
        return _pass(docs, slices[0], window).withColumn("items", F.array_distinct("items"))
    docs = keep(docs.withColumn("row", F.monotonically_increasing_id())).select("row", "id", "text")
    out = _passes(docs, slices, window).groupBy("row").agg(
        F.max("id").alias("id"), F.max("n_words").alias("n_words"), F.expr(MERGED).alias("s"), F.expr("array_sort(array_distinct(flatten(collect_list(items))))").alias("items")
    )
    return out.select("id", "n_words", F.col("s.starts").alias("starts"), F.col("s.stops").alias("stops"), "items")
