"""Words of whole texts as 64-bit hashes, computed for an Arrow batch at a time.

A word is a maximal run of ASCII letters and digits and of characters beyond ASCII, with A-Z
lower-cased. Work goes in pieces of bounded bytes whatever the length of a text, so a worker
needs a fixed amount of memory beside the batch itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes hashed at once; intermediates take about forty times as much.
PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xD6E8FEB86659FD93)
_EMPTY = np.zeros(0, np.uint64)


def _letters() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[0x80:] = np.arange(0x80, 0x100)
    for lo, hi in ((48, 58), (97, 123)):
        table[lo:hi] = np.arange(lo, hi)
    table[65:91] = np.arange(97, 123)
    return table


LETTER = _letters()
IS_LETTER = LETTER != 0


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, _BASE, np.uint64)]))


_POWERS = _powers(1 << 12)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(32))
        h = h * _STEP
        h = h ^ (h >> np.uint64(29))
        h = h * np.uint64(0xFF51AFD7ED558CCD)
        return h ^ (h >> np.uint64(32))


def _piece(raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of each word of ``raw``; ``cuts`` are places where a text begins."""
    global _POWERS
    low = LETTER[raw]
    inside = low != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = cuts[cuts < len(raw)]
    first[cuts] = inside[cuts]
    starts = np.flatnonzero(first)
    if not len(starts):
        return _EMPTY, starts, starts
    at = np.flatnonzero(inside)
    word = np.cumsum(first, dtype=np.int32)[at] - 1
    place = at - starts[word]
    longest = int(place.max()) + 1
    if longest > len(_POWERS):
        _POWERS = _powers(longest * 2)
    begin = np.flatnonzero(first[at])
    with np.errstate(over="ignore"):
        value = low[at].astype(np.uint64) * _POWERS[place]
        h = np.add.reduceat(value, begin)
    size = np.diff(np.append(begin, len(at)))
    with np.errstate(over="ignore"):
        return mix(h + size.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)), starts, starts + size


class Words:
    """Words of rows ``lo`` to ``hi`` of a batch: flat hashes and byte places, ``at`` has each row's range."""

    __slots__ = ("lo", "hi", "hashes", "starts", "ends", "at", "raw", "base")

    def __init__(self, lo, hi, hashes, starts, ends, at, raw, base):
        self.lo, self.hi, self.hashes, self.starts, self.ends, self.at, self.raw, self.base = lo, hi, hashes, starts, ends, at, raw, base

    def rows(self) -> np.ndarray:
        """Row (from 0) of each word."""
        return np.repeat(np.arange(self.hi - self.lo), np.diff(self.at))

    def text(self, i: int) -> str:
        return bytes(self.raw[self.starts[i]:self.ends[i]]).decode("utf-8", "replace")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def words(column: pa.Array, piece: int = PIECE) -> Iterator[Words]:
    """The words of every row, a bounded run of rows at a time (a longer text comes alone, hashed in pieces)."""
    if not len(column):
        return
    raw, at = buffers(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + piece, "right")) - 1)
        hi = min(hi, n, lo + 65536)
        text, cuts = raw[at[lo]:at[hi]], at[lo:hi + 1] - at[lo]
        if len(text) <= 2 * piece:
            h, s, e = _piece(text, cuts[:-1])
        else:
            parts, done = [], 0
            while done < len(text):
                end = min(done + piece, len(text))
                while end < len(text) and IS_LETTER[text[end]]:
                    stop = text[end:end + piece]
                    gap = np.flatnonzero(~IS_LETTER[stop])
                    end = end + int(gap[0]) if len(gap) else end + len(stop)
                ph, ps, pe = _piece(text[done:end], np.zeros(1, np.int64))
                parts.append((ph, ps + done, pe + done))
                done = end
            h, s, e = (np.concatenate(x) for x in zip(*parts, strict=True))
        yield Words(lo, hi, h, s, e, np.searchsorted(s, cuts), text, int(at[lo]))
        lo = hi


def hash_word(word: str) -> int:
    """Hash of one word, as ``words`` gives it."""
    return int(_piece(np.frombuffer(word.encode(), np.uint8), np.zeros(1, np.int64))[0][0])


def shingles(w: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of ``size`` words; a shorter non-empty text is one shingle of all its words."""
    n = np.diff(w.at)
    if not len(w.hashes):
        return np.zeros(0, np.int64), _EMPTY
    with np.errstate(over="ignore"):
        h = np.zeros(len(w.hashes), np.uint64)
        padded = np.concatenate([w.hashes, np.zeros(size, np.uint64)])
        for k in range(size):
            h = h * np.uint64(_BASE) + padded[k:k + len(h)]
    rows = w.rows()
    index = np.arange(len(h)) - w.at[rows]
    keep = index <= n[rows] - size
    short = np.flatnonzero((n > 0) & (n < size))
    h = h.copy()
    for r in short:
        with np.errstate(over="ignore"):
            v = np.uint64(n[r])
            for x in w.hashes[w.at[r]:w.at[r + 1]]:
                v = v * np.uint64(_BASE) + x
        h[w.at[r]] = v
        keep[w.at[r]] = True
    return rows[keep], mix(h[keep])
