"""Words and shingles of whole texts as numpy arrays, on the bytes of Arrow columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: word separators (fixed values): space, and 0x09 to 0x0D
SPACE_BYTES = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
SHINGLE_WORDS = 5

_RNG = np.random.Generator(np.random.PCG64(20_240_229))
_BYTE_CODES = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(int(_RNG.integers(1, 2**62)) * 2 + 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_PLACE_CODES = _RNG.integers(1, 2**63, SHINGLE_WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: A-Z have the codes of a-z
_BYTE_CODES[ord("A"): ord("Z") + 1] = _BYTE_CODES[ord("a"): ord("z") + 1]
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACE_BYTES)] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each text starts; null counts as empty."""
    column = column.fill_null("") if column.null_count else column
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, dtype=width)[column.offset: column.offset + len(column) + 1]
    starts = starts.astype(np.int64)
    if data is None or not len(starts):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[starts[0]: starts[-1]]
    return raw, starts - starts[0]


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, letters A-Z as a-z, and each text's first word.

    A word is a run of bytes other than ``SPACE_BYTES``; a text ends a word.
    """
    raw, starts = text_bytes(column)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    inside = ~_IS_SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = starts[(starts > 0) & (starts < len(raw))]
    first[cut] = inside[cut]
    begins = np.flatnonzero(first)
    if not len(begins):
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    codes = np.where(inside, _BYTE_CODES[raw], np.uint64(0)) * _powers(_BASE, len(raw))
    sums = np.add.reduceat(codes, begins) * _powers(_BASE_INVERSE, len(raw))[begins]
    return mix(sums), np.searchsorted(begins, starts).astype(np.int64)


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of every text, and where each text's start.

    Five words make a shingle; fewer words make one of the whole sequence; none, none.
    """
    words, starts = word_hashes(column)
    counts = np.diff(starts)
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    full = max(0, n - SHINGLE_WORDS + 1)
    rolled = np.zeros(full, np.uint64)
    for k in range(SHINGLE_WORDS if full else 0):
        rolled += mix(words[k: k + full] * _PLACE_CODES[k])
    rolled = mix(rolled)
    parts: list[np.ndarray] = []
    sizes = np.zeros(len(counts), np.int64)
    for i, (begin, count) in enumerate(zip(starts[:-1].tolist(), counts.tolist())):
        if not count:
            continue
        if count < SHINGLE_WORDS:
            part = np.uint64(count)
            for k in range(count):
                part = mix(np.atleast_1d(part + words[begin + k] * _PLACE_CODES[k]))[0]
            part = np.atleast_1d(part)
        else:
            part = np.sort(rolled[begin: begin + count - SHINGLE_WORDS + 1])
            if len(part) > 1:
                part = part[np.concatenate(([True], part[1:] != part[:-1]))]
        parts.append(part)
        sizes[i] = len(part)
    return np.concatenate(parts), np.concatenate(([0], np.cumsum(sizes)))


def slices(n_bytes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes each; one row may have more."""
    out, begin, total = [], 0, 0
    for i, size in enumerate(n_bytes.tolist()):
        if i > begin and total + size > most:
            out.append((begin, i))
            begin, total = i, 0
        total += size
    if begin < len(n_bytes):
        out.append((begin, len(n_bytes)))
    return out


def text_slices(column: pa.Array, most: int = 1 << 20) -> list[tuple[int, int]]:
    """Ranges of rows whose texts have about ``most`` bytes together."""
    return slices(np.diff(text_bytes(column)[1]), most)
