"""Words of whole Arrow batches at once: positions and 64-bit keys, without a Python loop per word.

Texts are UTF-8 bytes. A word is a run of bytes that a 256-entry table admits; every separator used
here is ASCII, so runs never cut a character. The key of a word is the polynomial of its bytes
modulo 2**64, taken from one running sum over the batch and then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
SMEAR = U64(0xBF58476D1CE4E5B9)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: ``[^\x20\x09-\x0D]+``
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False

#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text: digits, a-z and all that is not ASCII
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

BYTE_VALUES = np.random.default_rng(7).integers(1, 2**64 - 1, 256, dtype=np.uint64) | U64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(29))
    x = x * SMEAR
    return x ^ (x >> U64(32))


class Powers:
    """Powers of the base and of its inverse, grown to the longest chunk seen."""

    up = np.ones(1, U64)
    down = np.ones(1, U64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = n + (1 << 16)
            for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                p = np.full(size, base, U64)
                p[0] = 1
                setattr(cls, name, np.multiply.accumulate(p))
        return cls.up, cls.down


class Words(NamedTuple):
    start: np.ndarray  # first byte of each word
    end: np.ndarray  # byte after it
    key: np.ndarray  # uint64
    first: np.ndarray  # index of the first word of each document; one more entry closes the last


class Texts(NamedTuple):
    lo: int  # rows lo:hi of the batch
    hi: int
    data: np.ndarray  # their bytes
    offsets: np.ndarray  # hi - lo + 1 places in data


def texts(column: pa.Array | pa.ChunkedArray, chunk_bytes: int = CHUNK_BYTES) -> Iterator[Texts]:
    """Whole texts in runs of about ``chunk_bytes``; a longer text is a run of its own. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + chunk_bytes, "right")) - 1)
        hi = min(hi, len(column))
        yield Texts(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def _edge(t: Texts, admitted: np.ndarray, at: int) -> int:
    """The next place from ``at`` on where no word goes on: a byte outside words, or the start of a text."""
    stop = int(t.offsets[np.searchsorted(t.offsets, at)])
    for k in range(at, stop, 1 << 16):
        outside = np.flatnonzero(~admitted[t.data[k : min(k + (1 << 16), stop)]])
        if len(outside):
            return k + int(outside[0])
    return stop


def split(t: Texts, admitted: np.ndarray, lower: bool = True) -> Words:
    """Words of all texts. Beside them, no more than arrays over ``CHUNK_BYTES`` bytes and one word are held, however long a text is."""
    table = admitted[LOWER] if lower else admitted
    found, lo = [], 0
    while lo < len(t.data):
        hi = len(t.data) if len(t.data) - lo <= CHUNK_BYTES else _edge(t, table, lo + CHUNK_BYTES)
        found.append(_split(t, lo, hi, table, lower))
        lo = hi
    if not found:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(0, U64), np.zeros(len(t.offsets), np.int64))
    start, end, key = (x[0] if len(x) == 1 else np.concatenate(x) for x in zip(*found))
    return Words(start, end, key, np.searchsorted(start, t.offsets))


def _split(t: Texts, lo: int, hi: int, table: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = t.data[lo:hi]
    inside = table[data]
    n = len(data)
    edge = np.zeros(n, bool)  # a text begins here, so a word may not run on from the one before
    edge[t.offsets[np.searchsorted(t.offsets, lo) : np.searchsorted(t.offsets, hi)] - lo] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:] & ~edge[1:]
    end = np.flatnonzero(inside & ~after) + 1
    up, down = Powers.upto(n)
    total = np.empty(n + 1, U64)
    total[0] = 0
    np.cumsum(np.where(inside, BYTE_VALUES[LOWER[data] if lower else data] * up[:n], U64(0)), dtype=U64, out=total[1:])
    return start + lo, end + lo, mix((total[end] - total[start]) * down[start])


def between(w: Words, lo: int, hi: int) -> Words:
    """The words ``lo:hi``; texts that have none of them are empty."""
    return Words(w.start[lo:hi], w.end[lo:hi], w.key[lo:hi], np.clip(w.first, lo, hi) - lo)


def shingles(key: np.ndarray, size: int) -> np.ndarray:
    """Keys of all runs of ``size`` words; the order of words counts. Shorter input: one run of all, if any."""
    if not len(key):
        return key
    size = min(size, len(key))
    total = np.zeros(len(key) - size + 1, U64)
    factor = 1
    for i in range(size):
        factor = factor * 0xD6E8FEB86659FD93 + 2 * i + 1 & (1 << 64) - 1 | 1
        total += mix(key[i : len(key) - size + 1 + i] * U64(factor))
    return mix(total + U64(size))
