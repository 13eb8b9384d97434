"""CRC-32 of many words and of their concatenations at once.

The checksum is linear over bits: that of ``a + b`` is the one of ``a`` moved past ``len(b)`` zero bytes, exclusive-or the one of ``b``.
So each word is read once, and the checksums of word runs follow from table lookups.
"""

from __future__ import annotations

import zlib

import numpy as np

from waymark.llm.words import LETTER, Words

#: Words up to this many bytes go byte by byte, all at once; longer ones one by one.
SHORT = 32
#: Moves below this many bytes have a table of their own.
NEAR = 64


def _step(c: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[c & np.uint32(255)] ^ (c >> np.uint32(8))


def _byte_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & np.uint32(1), (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


BYTE = _byte_table()


def _move_tables() -> tuple[np.ndarray, np.ndarray]:
    """Images of each byte of a checksum under moves of 0 to NEAR - 1 bytes, and of NEAR * 2^j bytes."""
    here = (np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * np.uint32(8))[:, None]).astype(np.uint32)
    near = [here]
    for _ in range(NEAR):
        near.append(_step(near[-1], BYTE))
    far = [near.pop()]
    for _ in range(26):
        far.append(_look(far[-1], far[-1]))
    return np.stack(near), np.stack(far)


def _look(table: np.ndarray, c: np.ndarray) -> np.ndarray:
    m = np.uint32(255)
    return table[0][c & m] ^ table[1][(c >> np.uint32(8)) & m] ^ table[2][(c >> np.uint32(16)) & m] ^ table[3][c >> np.uint32(24)]


MOVES, FAR_MOVES = _move_tables()
_SPACE = np.uint32(zlib.crc32(b" "))


def moved(c: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Checksums ``c`` moved past ``n`` zero bytes each."""
    near = n % NEAR
    m = np.uint32(255)
    out = MOVES[near, 0, c & m] ^ MOVES[near, 1, (c >> np.uint32(8)) & m] ^ MOVES[near, 2, (c >> np.uint32(16)) & m] ^ MOVES[near, 3, c >> np.uint32(24)]
    rest = n // NEAR
    j = 0
    while len(at := np.flatnonzero(rest)):
        odd = at[(rest[at] & 1) == 1]
        out[odd] = _look(FAR_MOVES[j], out[odd])
        rest = rest >> 1
        j += 1
    return out


def word_crcs(w: Words) -> np.ndarray:
    """CRC-32 of each word's bytes, A-Z lower-cased."""
    size = w.ends - w.starts
    out = np.zeros(len(size), np.uint32)
    long = np.flatnonzero(size > SHORT)
    for i in long.tolist():
        out[i] = zlib.crc32(LETTER[w.raw[w.starts[i]:w.ends[i]]].tobytes())
    order = np.argsort(-size, kind="stable")[len(long):]
    sizes, at = size[order], w.starts[order]
    c = np.full(len(order), 0xFFFFFFFF, np.uint32)
    left = len(order)
    for k in range(int(sizes[0]) if left else 0):
        left = int(np.searchsorted(-sizes, -k, "left"))
        c[:left] = _step(c[:left] ^ LETTER[w.raw[at[:left] + k]], BYTE)
    out[order] = ~c
    return out


def run_crcs(w: Words, longest: int = 3) -> list[np.ndarray]:
    """For n = 1 to ``longest``: CRC-32 of the n words from each word on, joined by single spaces.

    Runs that would leave the row are included; their last words belong to the next row (or are empty), so callers mask them.
    """
    one = word_crcs(w)
    size = w.ends - w.starts
    spaced = moved(np.full(len(one), _SPACE, np.uint32), size) ^ one
    out, n = [one], len(one)
    for k in range(1, longest):
        run = np.zeros(n, np.uint32)
        run[:max(n - k, 0)] = moved(out[-1][:max(n - k, 0)], size[k:] + 1) ^ spaced[k:]
        out.append(run)
    return out
