"""Numeric features of whole texts, from their bytes, words and lines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from fanweave.llm.words import text_bytes, text_slices, word_hashes

BYTE_CLASSES = 128 + 4
N_FEATURES = BYTE_CLASSES + 14


def _distinct(values: np.ndarray) -> int:
    return len(np.unique(values)) if len(values) else 0


def _class_of_byte() -> np.ndarray:
    """ASCII bytes stand for themselves; others fall in four classes of UTF-8 bytes."""
    classes = np.arange(256)
    classes[0x80:0xC0] = 128
    classes[0xC0:0xE0] = 129
    classes[0xE0:0xF0] = 130
    classes[0xF0:] = 131
    return classes


_CLASSES = _class_of_byte()


def _stats(raw: np.ndarray, words: np.ndarray) -> np.ndarray:
    out = np.zeros(N_FEATURES)
    n = len(raw)
    if not n:
        out[BYTE_CLASSES] = 1.0
        return out
    counts = np.bincount(_CLASSES[raw], minlength=BYTE_CLASSES)
    out[:BYTE_CLASSES] = np.log1p(1000.0 * counts / n)
    letters = counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum()
    lines = raw.tobytes().split(b"\n")
    filled = [x for x in lines if x.strip()]
    m = max(1, len(words))
    runs = np.flatnonzero(np.diff(raw) != 0)
    pairs = words[1:] * np.uint64(31) + words[:-1] if len(words) > 1 else words[:0]
    extra = [
        0.0, np.log1p(n), np.log1p(m), letters / n, counts[65:91].sum() / max(1, letters),
        counts[48:58].sum() / n, n / m, _distinct(words) / m, _distinct(words) / np.sqrt(m),
        _distinct(pairs) / max(1, len(pairs)), len(set(filled)) / max(1, len(filled)),
        len(filled) / m, np.diff(np.concatenate(([-1], runs, [n - 1]))).max() / n,
        np.log1p((n - letters - counts[32]) / m),
    ]
    out[BYTE_CLASSES:] = extra
    return out


def features(column: pa.Array) -> np.ndarray:
    """A row of ``N_FEATURES`` numbers for every text; null counts as empty."""
    out = np.zeros((len(column), N_FEATURES), np.float32)
    for begin, end in text_slices(column):
        part = column.slice(begin, end - begin)
        raw, starts = text_bytes(part)
        words, firsts = word_hashes(part)
        for i in range(end - begin):
            out[begin + i] = _stats(
                raw[starts[i]: starts[i + 1]], words[firsts[i]: firsts[i + 1]]
            )
    return out
