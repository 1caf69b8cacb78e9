"""A keyed permutation of row numbers, computed row by row.

The numbers 0 to n - 1 lie in a grid of ``a`` columns and ``b`` rows with ``a b >= n``. Rounds of a
Feistel network add to one coordinate a number that the other one and the key decide, which
is a permutation of the grid. A number that leaves 0 to n - 1 goes through the network again
until it is back; the grid has fewer than ``a`` places too many, so this is rare. No row is compared
with another one, so any row's place is known without a sort, on every executor alike.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: a prime below 2^31, so that products stay below 2^62
PRIME = 2_147_483_647
ROUNDS = 6
#: of a grid of a places outside at most, a walk of so many steps leaves none outside: for
#: n < 4096 there are fewer places, beyond that a step stays outside with a chance below 1 / 64
STEPS = 64


def grid(n: int) -> tuple[int, int]:
    """Columns and rows of the least nearly square grid for ``n`` numbers."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def round_keys(*key: object) -> list[tuple[int, int]]:
    """Factor and offset of every round for a key of any values."""
    out = []
    for k in range(ROUNDS):
        digest = hashlib.sha256(repr((k, *key)).encode()).digest()
        out.append((1 + int.from_bytes(digest[:8], "big") % (PRIME - 1),
                    int.from_bytes(digest[8:16], "big") % PRIME))
    return out


def _pass(number: Column, a: int, b: int, keys: list[tuple[int, int]]) -> Column:
    left, right = F.call_function("div", number, F.lit(b)), F.pmod(number, F.lit(b))
    for k, (factor, offset) in enumerate(keys):
        if k % 2 == 0:
            left = F.pmod(left + F.pmod(right * factor + offset, F.lit(PRIME)), F.lit(a))
        else:
            right = F.pmod(right + F.pmod(left * factor + offset, F.lit(PRIME)), F.lit(b))
    return left * b + right


def permuted(number: Column, n: int, *key: object) -> Column:
    """The place of row ``number`` (0 to n - 1) in the order that ``key`` stands for."""
    a, b = grid(n)
    keys = round_keys(*key)
    once = _pass(number.cast("bigint"), a, b, keys)
    walk = F.aggregate(
        F.sequence(F.lit(1), F.lit(STEPS)), once,
        lambda at, _: F.when(at < n, at).otherwise(_pass(at, a, b, keys)))
    return F.when(once < n, once).otherwise(walk)


def permuted_numbers(numbers: np.ndarray, n: int, *key: object) -> np.ndarray:
    """The same places for an array."""
    a, b = grid(n)
    at = np.asarray(numbers, np.int64).copy()
    outside = np.ones(len(at), bool)
    while outside.any():
        left, right = np.divmod(at[outside], b)
        for k, (factor, offset) in enumerate(round_keys(*key)):
            if k % 2 == 0:
                left = (left + (right * factor + offset) % PRIME) % a
            else:
                right = (right + (left * factor + offset) % PRIME) % b
        at[outside] = left * b + right
        outside = at >= n
    return at
