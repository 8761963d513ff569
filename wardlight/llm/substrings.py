"""Substring dedup with compressed FM-indexes over shards of the texts that can repeat each other.

A window is ``window`` words in a row. Its anchor is the least key among its runs of ``window - 5`` words, so equal windows have equal
anchors; neighbouring windows with one anchor form a piece of text. All pieces of an anchor go to one shard, so a document
streams only through the shards that can hold its passages, and the work grows with the text and not with shards times text.

1. Anchors of one document only are dropped: every run of texts asks once per anchor, whatever the number of its documents.
2. Equal pieces are one: all but the document with the smallest id repeat it whole. Only anchors with unequal pieces go on.
3. A shard's distinct pieces become one sequence of symbols. Its Burrows-Wheeler transform is held in a wavelet tree; backward search
   from every window's last word gives matching statistics against pieces of smaller ids (a range minimum over the suffix
   interval). Intervals that reach ``window`` words are reported.
4. Pieces of an anchor with very many unequal pieces go window by window: equal windows are combined before the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decontam import WaveletTree, suffix_array
from .storage import keep
from .words import SPACED, U64, Powers, Texts, Words, mix, shingles, split, texts

WINDOW = 13
#: anchors are so many words shorter than a window; a piece has at most one window more than that
SLACK = 5
#: texts that ask together
CHUNK_BYTES = 4 << 20
#: text per bucket of anchors
BUCKET_BYTES = 32 << 20
#: distinct pieces per shard, and per anchor before it is cut into windows
SHARD_PIECES, ANCHOR_PIECES = 20_000, 2_000


class Pieces:
    """The pieces of some texts, in order."""

    def __init__(self, w: Words, window: int):
        k = max(1, window - SLACK)
        n = len(w.key)
        none = np.zeros(0, np.int64)
        self.start = self.windows = self.doc = none  # first word (of all texts), windows, text
        self.anchor = self.content = np.zeros(0, U64)
        if n < window:
            return
        doc = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
        whole = np.flatnonzero(doc[: n - window + 1] == doc[window - 1 :])
        if not len(whole):
            return
        runs = shingles(w.key, k)
        at = (sliding_window_view(runs, window - k + 1).argmin(1) + np.arange(n - window + 1))[whole]
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (whole[1:] != whole[:-1] + 1)]))
        self.start = whole[new]
        self.windows = np.diff(np.append(new, len(whole)))
        self.doc, self.anchor = doc[self.start], runs[at[new]]
        up, down = Powers.upto(n)
        total = np.concatenate([[U64(0)], np.cumsum(mix(w.key) * up[:n], dtype=U64)])
        end = self.start + self.windows + window - 1
        self.content = mix((total[end] - total[self.start]) * down[self.start] + self.windows.astype(U64))


def _digests(t: Texts, w: Words, stay: np.ndarray) -> list[str]:
    """Hex digest of each text's words that stay, joined by one space."""
    data = t.data.copy()
    edge = np.zeros(len(data) + 1, np.int8)
    np.add.at(edge, w.start[stay], 1)
    np.add.at(edge, w.end[stay], -1)
    inside = np.cumsum(edge[:-1], dtype=np.int8) > 0
    kept = np.flatnonzero(stay)
    doc = np.searchsorted(w.first, kept, "right") - 1
    joined = kept[1:][doc[1:] == doc[:-1]]
    space = w.start[joined] - 1  # not the first word of its text, so a separator stands here
    data[space] = 32
    inside[space] = True
    bounds = np.concatenate([[0], np.cumsum(inside)])[t.offsets]
    body = data[inside]
    return [hashlib.sha256(body[a:z]).hexdigest() for a, z in zip(bounds[:-1], bounds[1:])]


def _asks(window: int, buckets: int):
    """Anchors of runs of texts: (bucket, asked, keys, known); where two texts of a run agree, (bucket, key, anchors) at once."""
    names = ["bucket", "key", "asked", "keys", "known"]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column(0).to_numpy(zero_copy_only=False).view(U64)
            for t in texts(b.column(1), CHUNK_BYTES):
                p = Pieces(split(t, SPACED, lower=False), window)
                if not len(p.anchor):
                    continue
                own = key[t.lo : t.hi][p.doc]
                order = np.lexsort((own, p.anchor))
                anchor, own = p.anchor[order], own[order]
                new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1])])
                anchor, own = anchor[new], own[new]
                head = np.concatenate([[True], anchor[1:] != anchor[:-1]])
                group = np.cumsum(head) - 1
                several = np.bincount(group)[group] > 1
                rows = []
                ours = np.flatnonzero(several)
                ours = ours[np.argsort(own[ours], kind="stable")]
                for span in np.split(ours, np.flatnonzero(own[ours][1:] != own[ours][:-1]) + 1):
                    if len(span):
                        rows.append((int(own[span[0]] % U64(buckets)), own[span[:1]].view(np.int64)[0], anchor[span].tobytes(), None, None))
                bucket = ((anchor >> U64(20)) % U64(buckets)).astype(np.int64)
                first = np.flatnonzero(head)
                first = first[np.argsort(bucket[first], kind="stable")]
                for span in np.split(first, np.flatnonzero(bucket[first][1:] != bucket[first][:-1]) + 1):
                    one, more = span[~several[span]], span[several[span]]
                    rows.append((bucket[span[0]], None, anchor[one].tobytes(), own[one].tobytes(), anchor[more].tobytes()))
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return compute


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, anchors): the anchors of each text that another text has too. Rows come by bucket."""

    def answered(held: list[tuple[bytes, bytes, bytes]]) -> pa.RecordBatch:
        asked, keys, known = (np.frombuffer(b"".join(x), U64) for x in zip(*held))
        anchor = np.concatenate([asked, known])
        order = np.argsort(anchor, kind="stable")
        same = anchor[order][1:] == anchor[order][:-1]
        many = np.zeros(len(anchor), bool)
        many[order[1:][same]] = many[order[:-1][same]] = True
        hit = np.flatnonzero(many[: len(asked)])
        hit = hit[np.argsort(keys[hit], kind="stable")]
        spans = [s for s in np.split(hit, np.flatnonzero(keys[hit][1:] != keys[hit][:-1]) + 1) if len(s)]
        return pa.RecordBatch.from_arrays([pa.array([int(keys[s[0]].view(np.int64)) for s in spans], pa.int64()), pa.array([asked[s].tobytes() for s in spans], pa.binary())], ["key", "anchors"])

    at, held = None, []
    for b in batches:
        done = pa.compute.is_valid(b.column(1))
        if done.true_count:
            yield pa.RecordBatch.from_arrays([b.column(1).filter(done), b.column(2).filter(done)], ["key", "anchors"])
        b = b.filter(pa.compute.invert(done))
        for bucket, *blobs in zip(*(b.column(c).to_pylist() for c in ("bucket", "asked", "keys", "known"))):
            if bucket != at and held:
                yield answered(held)
                held = []
            at = bucket
            held.append(blobs)
    if held:
        yield answered(held)


def _sorted_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without shared anchors are done: their digest, and no text. The others keep theirs."""
    for b in batches:
        body, anchors = b.column(2), b.column(3)
        free = anchors.is_null().to_numpy(zero_copy_only=False)
        for t in texts(body, CHUNK_BYTES):
            w = split(t, SPACED, lower=False)
            shown = [None if not f else d for f, d in zip(free[t.lo : t.hi], _digests(t, w, np.ones(len(w.key), bool)))]
            own = body.take(pa.array(np.arange(t.lo, t.hi), mask=free[t.lo : t.hi]))
            joined = [None if x is None else b"".join(x) for x in anchors.slice(t.lo, t.hi - t.lo).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).slice(t.lo, t.hi - t.lo) for c in (0, 1)), pa.array(np.diff(w.first)), pa.array(shown, pa.string()), own, pa.array(joined, pa.binary())],
                ["doc", "key", "n_words", "sha", "text", "anchors"],
            )


def _shared(window: int):
    """(anchor, content, doc, key, start, windows): the pieces whose anchor another text has too."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            anchors = b.column(3)
            for t in texts(b.column(2), CHUNK_BYTES):
                w = split(t, SPACED, lower=False)
                p = Pieces(w, window)
                cut = np.searchsorted(p.doc, np.arange(t.hi - t.lo + 1))
                stay = np.concatenate([np.isin(p.anchor[cut[i] : cut[i + 1]], np.frombuffer(anchors[t.lo + i].as_py(), U64)) for i in range(t.hi - t.lo)])
                row = pa.array(p.doc[stay] + t.lo)
                columns = [p.anchor[stay].view(np.int64), p.content[stay].view(np.int64)]
                place = [(p.start - w.first[p.doc])[stay], p.windows[stay].astype(np.int32)]
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, columns), b.column(0).take(row), b.column(1).take(row), *map(pa.array, place)], ["anchor", "content", "doc", "key", "start", "windows"]
                )

    return compute


def _worded(window: int, shards: int):
    """Pieces with their words: (shard, anchor, content, doc, shift, words); those of crowded anchors window by window, by key."""
    names = ["shard", "anchor", "content", "doc", "shift", "words"]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            listed = b.column(1).to_pylist()
            for t in texts(b.column(0), CHUNK_BYTES):
                w = split(t, SPACED, lower=False)
                rows = []
                for i in range(t.lo, t.hi):
                    base = w.first[i - t.lo]
                    for p in listed[i]:
                        at = base + p["start"]
                        if not p["crowded"]:
                            rows.append((p["anchor"] % shards, p["anchor"], p["content"], p["doc"], 0, w.key[at : at + p["windows"] + window - 1].tobytes()))
                            continue
                        for j in range(p["windows"]):
                            rows.append((-1, p["anchor"], p["content"], p["doc"], j, w.key[at + j : at + j + window].tobytes()))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return compute


class MatchIndex:
    """FM-index of sequences of words, with the least owner of every suffix interval."""

    def __init__(self, words: np.ndarray, length: np.ndarray, owner: np.ndarray):
        keys, symbol = np.unique(words, return_inverse=True)
        n = len(length)
        self.first = np.concatenate([[0], np.cumsum(length + 1)])[:-1] + 1  # a separator in front of each
        seq = np.ones(len(words) + n + 1, np.int64)
        place = np.arange(len(words)) + np.repeat(np.arange(n), length) + 1
        seq[place] = symbol.reshape(-1) + 2
        seq[-1] = 0
        order = suffix_array(seq)
        self.seq = seq
        self.bwt = WaveletTree(seq[order - 1], len(keys) + 2)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=len(keys) + 2))])
        self.owners, rank = np.unique(owner, return_inverse=True)
        own = np.full(len(seq), len(self.owners), np.int32)
        own[place] = np.repeat(rank.reshape(-1), length)
        # least owner in blocks of 1, 2, 4, … suffixes
        self.least = [own[order]]
        while 2 << (len(self.least) - 1) <= len(seq):
            half, row = 1 << (len(self.least) - 1), self.least[-1]
            self.least.append(np.minimum(row[:-half], row[half:]))
        self.rank = rank.reshape(-1)

    def _minimum(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(lo), np.int32)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.least[k][lo[at]], self.least[k][hi[at] - (1 << k)])
        return out

    def statistics(self, sequence: np.ndarray, end: np.ndarray, most: int) -> np.ndarray:
        """For the last words ``end`` within ``sequence``: the longest match in a sequence of a smaller owner, up to ``most`` words."""
        out = np.zeros(len(end), np.int64)
        at = self.first[sequence] + end
        live = np.arange(len(end))
        lo, hi = np.zeros(len(end), np.int64), np.full(len(end), len(self.seq), np.int64)
        for k in range(most):
            c = self.seq[at[live] - k]
            if k == 0:
                a, z = self.before[c], self.before[c + 1]
            else:
                a, z = self.before[c] + self.bwt.rank(c, lo[live]), self.before[c] + self.bwt.rank(c, hi[live])
            good = (c > 1) & (a < z)
            good[good] = self._minimum(a[good], z[good]) < self.rank[sequence[live[good]]]
            live = live[good]
            lo[live], hi[live] = a[good], z[good]
            out[live] = k + 1
            if not len(live):
                break
        return out


def _matched(window: int):
    """(anchor, content, mask): windows of each piece that stand in a piece of a smaller document. Rows come by shard."""

    def searched(held: list[tuple]) -> pa.RecordBatch:
        anchor, content, doc, words = zip(*held)
        length = np.array([len(x) // 8 for x in words], np.int64)
        index = MatchIndex(np.frombuffer(b"".join(words), U64), length, np.array(doc, np.int64))
        windows = length - window + 1
        piece = np.repeat(np.arange(len(held)), windows)
        place = np.arange(len(piece)) - np.repeat(np.cumsum(windows) - windows, windows)
        hit = index.statistics(piece, place + window - 1, window) >= window
        mask = np.bincount(piece[hit], np.left_shift(1, place[hit]), len(held)).astype(np.int64)
        some = np.flatnonzero(mask)
        return pa.RecordBatch.from_arrays([pa.array(np.array(anchor, np.int64)[some]), pa.array(np.array(content, np.int64)[some]), pa.array(mask[some])], ["anchor", "content", "mask"])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for b in batches:
            for shard, *piece in zip(*(b.column(c).to_pylist() for c in ("shard", "anchor", "content", "doc", "words"))):
                if shard != at and held:
                    yield searched(held)
                    held = []
                at = shard
                held.append(piece)
        if held:
            yield searched(held)

    return compute


def _applied(window: int):
    """(id, n_words, starts, stops, kept_sha256): spans of words that go, and the digest of the others."""
    names = ["id", "n_words", "starts", "stops", "kept_sha256"]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done, marks = b.column(2), b.column(4).to_pylist()
            for t in texts(b.column(3), CHUNK_BYTES):
                w = split(t, SPACED, lower=False)
                cover = np.zeros(len(w.key) + 1, np.int64)
                for i in range(t.lo, t.hi):
                    if not marks[i]:
                        continue
                    start = np.array([m["start"] for m in marks[i]], np.int64)
                    mask = np.array([m["mask"] for m in marks[i]], np.int64)
                    for j in range(SLACK + 1):
                        at = w.first[i - t.lo] + start[mask >> j & 1 == 1] + j
                        np.add.at(cover, at, 1)
                        np.add.at(cover, at + window, -1)
                gone = np.cumsum(cover[:-1]) > 0
                edge = np.zeros(len(gone) + 1, bool)  # a span ends with its text
                edge[w.first] = True
                opens = np.flatnonzero(gone & (~np.concatenate([[False], gone[:-1]]) | edge[:-1]))
                closes = np.flatnonzero(gone & (~np.append(gone[1:], False) | edge[1:])) + 1
                cut = np.searchsorted(opens, w.first)
                spans = [[x[cut[i] : cut[i + 1]] - w.first[i] for i in range(t.hi - t.lo)] for x in (opens, closes)]
                sha = [d or s for d, s in zip(done.slice(t.lo, t.hi - t.lo).to_pylist(), _digests(t, w, ~gone))]
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c).slice(t.lo, t.hi - t.lo) for c in (0, 1)), *(pa.array(x, pa.list_(pa.int64())) for x in spans), pa.array(sha, pa.string())], names
                )

    return compute


def repeated(docs: DataFrame, id_col: str, text_col: str, window: int = WINDOW) -> DataFrame:
    """(id, n_words, starts, stops, kept_sha256) per row of ``docs``: spans of words inside windows that also start in a document of a smaller id.

    Words are runs without blanks, as they stand. All windows are judged on the input. ``kept_sha256`` is the digest of the words outside the spans, joined by
    one space. Null and empty texts have no words; a text shorter than ``window`` words has no window; rows that share an id take
    nothing from each other; a null id is neither smaller nor larger than another. Repeated rows have equal results; other columns are not read.
    Words and pieces are compared by 64-bit keys.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = keep(_with_anchors(docs.select("doc", F.xxhash64("doc", "text").alias("key"), "text"), window))
    pieces = keep(rows.where("anchors is not null").select("doc", "key", "text", "anchors").mapInArrow(_shared(window), "anchor long, content long, doc long, key long, start long, windows int"))
    alike = keep(pieces.groupBy("anchor", "content").agg(F.min(F.struct("doc", "key", "start", "windows")).alias("first"), F.max("doc").alias("last")))
    marks = keep(_marks(pieces, alike, _masks(rows, alike, window)))
    out = rows.join(marks, (F.col("doc") == F.col("_doc")) & (F.col("key") == F.col("_key")), "left").select("doc", "n_words", "sha", "text", "marks")
    return out.mapInArrow(_applied(window), "id long, n_words long, starts array<long>, stops array<long>, kept_sha256 string")


# Each step is a function of its own, so that its shuffles can be cleaned up once its result is written.


def _with_anchors(docs: DataFrame, window: int) -> DataFrame:
    """(doc, key, n_words, sha, text, anchors): texts with the anchors that other texts have too, and the digests of the others."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    asks = docs.where("doc is not null").select("key", "text").mapInArrow(_asks(window, max(16, size // BUCKET_BYTES)), "bucket long, key long, asked binary, keys binary, known binary")
    known = asks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_answers, "_key long, anchors binary").groupBy("_key").agg(F.collect_list("anchors").alias("anchors"))
    # a null id has the key of no other row
    joined = docs.join(known, F.col("key") == F.col("_key"), "left").select("doc", "key", "text", "anchors")
    return joined.mapInArrow(_sorted_out, "doc long, key long, n_words long, sha string, text string, anchors binary")


def _masks(rows: DataFrame, alike: DataFrame, window: int) -> DataFrame:
    """(anchor, content, mask): windows of the first document of each piece that stand in a smaller document, in unequal pieces."""
    unequal = alike.groupBy("anchor").agg(F.count("*").alias("n"), F.min("first.doc").alias("low"), F.max("first.doc").alias("high")).where("n > 1 and low < high")
    compared = keep(alike.join(unequal.select("anchor", "n"), "anchor").select("anchor", "content", "first.*", (F.col("n") > ANCHOR_PIECES).alias("crowded")))
    shards = compared.count() // SHARD_PIECES + 1
    listed = compared.groupBy(F.col("doc").alias("_doc"), F.col("key").alias("_key")).agg(F.collect_list(F.struct("anchor", "content", "doc", "start", "windows", "crowded")).alias("own"))
    # rows that repeat an id and its text are one here
    texts_ = rows.where("anchors is not null").join(listed, (F.col("doc") == F.col("_doc")) & (F.col("key") == F.col("_key"))).select("text", "own")
    worded = keep(texts_.mapInArrow(_worded(window, shards), "shard long, anchor long, content long, doc long, shift int, words binary"))
    masks = worded.where("shard >= 0").repartition("shard").sortWithinPartitions("shard").mapInArrow(_matched(window), "anchor long, content long, mask long")
    crowded = worded.where("shard < 0")
    least = crowded.groupBy("words").agg(F.min("doc").alias("least"))
    single = crowded.join(least, "words").where("least < doc").select("anchor", "content", F.expr("shiftleft(1L, shift)").alias("mask"))
    return keep(masks.unionByName(single).groupBy("anchor", "content").agg(F.bit_or("mask").alias("mask")))


def _marks(pieces: DataFrame, alike: DataFrame, masks: DataFrame) -> DataFrame:
    """(_doc, _key, marks): per text, starts of pieces and masks of their windows that repeat a smaller document."""
    found = alike.select("anchor", "content", F.col("first.doc").alias("first"), "last").join(masks, ["anchor", "content"], "left").where("last > first or mask is not null")
    mask = F.when(F.col("doc") > F.col("first"), F.expr("shiftleft(1L, windows) - 1")).otherwise(F.coalesce("mask", F.lit(0)))
    marks = pieces.join(found, ["anchor", "content"]).select("doc", "key", "start", mask.alias("mask")).where("mask <> 0")
    return marks.groupBy(F.col("doc").alias("_doc"), F.col("key").alias("_key")).agg(F.collect_set(F.struct("start", "mask")).alias("marks"))
