"""SetSketch registers of sets of 64-bit hashes: exponentially spaced truncated minima.

Every register has its own hash of an element to an exponentially distributed value. It
keeps ``1 - log_BASE`` of the least value, rounded down and cut to 16 bits. So registers
of a union are the larger ones of both (mergeable), and two sets agree in a register with
about the probability of their Jaccard similarity (locality-sensitive).
"""

from __future__ import annotations

import numpy as np

from fanweave.llm.words import mix

BASE = 1.001
RATE = 20.0
TOP = 2**16 - 1
REGISTERS = 252
#: chance with which two sets at the threshold may agree in no band
MISS = 3e-9


def banding(percent: int) -> tuple[int, int]:
    """Bands, and registers of a band, that miss a pair of that similarity once in 1 / ``MISS``.

    Of these the bands with most registers, because they have the fewest chance pairs.
    """
    for rows in range(REGISTERS, 0, -1):
        if (1 - (percent / 100) ** rows) ** (REGISTERS // rows) <= MISS:
            return REGISTERS // rows, rows
    raise ValueError(f"{REGISTERS} registers do not find pairs of {percent} % similarity")


BANDS, ROWS = banding(85)

#: registers of the wide sketch, of which only the low byte is kept
WIDE = 1024


def _family(seed: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What makes the hash functions of ``size`` registers: a flip and two odd factors each."""
    rng = np.random.Generator(np.random.PCG64(seed))
    flips = rng.integers(0, 2**32, size, dtype=np.uint32)
    factors, again = (
        rng.integers(0, 2**31, size, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        for _ in range(2)
    )
    return flips, factors, again


_NARROW_FAMILY = _family(6_022, REGISTERS)
_WIDE_FAMILY = _family(1_417, WIDE)


def least_values(
    hashes: np.ndarray, starts: np.ndarray, family: tuple = _NARROW_FAMILY
) -> np.ndarray:
    """The least 32-bit value of every register over each set; all ones for empty sets."""
    flips, factors, again = family
    out = np.full((len(starts) - 1, len(flips)), 2**32 - 1, np.uint32)
    filled = np.flatnonzero(np.diff(starts))
    if not len(filled):
        return out
    begins, short = starts[filled], (hashes >> np.uint64(32)).astype(np.uint32)
    value, high = np.empty_like(short), np.empty_like(short)
    for i in range(len(flips)):
        np.bitwise_xor(short, flips[i], out=value)
        np.multiply(value, factors[i], out=value)
        np.right_shift(value, np.uint32(16), out=high)
        np.bitwise_xor(value, high, out=value)
        np.multiply(value, again[i], out=value)
        out[filled, i] = np.minimum.reduceat(value, begins)
    return out


def registers(
    hashes: np.ndarray, starts: np.ndarray, family: tuple = _NARROW_FAMILY
) -> np.ndarray:
    """Registers of each set as 16-bit numbers; an empty set has zeros."""
    least = least_values(hashes, starts, family)
    exponential = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    # shifted so that sets up to 2**40 elements and single elements both fit
    level = np.floor(1 - np.log(exponential) / np.log(BASE)) + 8000
    out = np.clip(level, 0, TOP).astype(np.uint16)
    out[np.diff(starts) == 0] = 0
    return out


def wide_bytes(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The low bytes of ``WIDE`` further registers: less to move, and more exact together."""
    return (registers(hashes, starts, _WIDE_FAMILY) & 0xFF).astype(np.uint8)


def wide_similarity(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of equal bytes; others agree once in 256."""
    return ((left == right).mean(1) - 1 / 256) / (1 - 1 / 256)


def merge(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Registers of the unions."""
    return np.maximum(left, right)


def band_keys(sketches: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per set and band, of the band's number and register values."""
    parts = sketches[:, : bands * rows].reshape(len(sketches), bands, rows).astype(np.uint64)
    keys = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), parts.shape[:2]).copy()
    for row in range(rows):
        keys = mix(keys * np.uint64(31) + parts[:, :, row])
    return keys


def joint_similarity(
    left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray
) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs from their registers and set sizes.

    A register of ``left`` is larger with probability p(u - v J), smaller with
    p(v - u J), where u and v are the shares of the sizes; the likelihood of the counts
    is concave in J.
    """
    more = (left > right).sum(1).astype(np.float64)
    less = (left < right).sum(1).astype(np.float64)
    same = left.shape[1] - more - less
    u = n_left / (n_left + n_right)
    v = 1.0 - u
    step = (BASE - 1) / BASE

    def chance(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * step) / np.log(BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        a, b = chance(u - v * j), chance(v - u * j)
        return (more * np.log(np.maximum(a, 1e-12)) + less * np.log(np.maximum(b, 1e-12))
                + same * np.log(np.maximum(1 - a - b, 1e-12)))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(48):
        third = (high - low) / 3
        one, two = low + third, high - third
        rising = likelihood(one) < likelihood(two)
        low, high = np.where(rising, one, low), np.where(rising, high, two)
    return (low + high) / 2
