"""Fill-in-the-middle order of documents by a piece table.

A document is a list of descriptors ``(buffer, start, length)`` over two buffers that never
change: its own UTF-8 bytes and the sentinels. It begins as one descriptor of its whole text.
:func:`cut` splits descriptors, :func:`arrange` permutes the three parts and puts
descriptors of sentinels between them, and :func:`restore` finds the parts of a written output,
drops the sentinels and applies the inverse permutation. Digests are fed descriptor by
descriptor; only the output itself is ever joined to one text.

The two cuts and the form come from the SHA-256 of a key of the document's id, so a
row gets the same form on every run, whatever its place in the table.

Defined results: a null text counts as empty. A null id has the key of the empty string. Empty
texts and texts that contain a sentinel stay plain. Rows with equal ids get equal draws,
and cuts by their own texts. An empty table gives an empty result. Other columns are not
looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanweave.llm.words import text_bytes, text_slices

#: fixed values: the marks before prefix, suffix and middle
MARKS = (b"<P>", b"<S>", b"<M>")
#: of 100 documents so many are cut, and of 100 of these so many have the suffix first
CUT_PERCENT = 90
SUFFIX_FIRST_PERCENT = 20

TEXT, SENTINELS = 0, 1
Piece = tuple[int, int, int]

PREFIX, MIDDLE, SUFFIX = 0, 1, 2
#: the order of the parts of each form, and the mark that comes before each of them
ORDERS = {
    "psm": ((PREFIX, SUFFIX, MIDDLE), (0, 1, 2)),
    "spm": ((SUFFIX, PREFIX, MIDDLE), (1, 0, 2)),
}

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True


def token_starts(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The first byte of every token: a run of letters A-Z, a-z, or any other character."""
    letter = _LETTER[raw]
    first = ~letter & ((raw & 0xC0) != 0x80)
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    inner = starts[starts < len(raw)]
    begins[inner] = letter[inner]
    return np.flatnonzero(first | begins)


def characters(data: bytes) -> int:
    """Code points of a piece of UTF-8."""
    return len(data) - int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) == 0x80))


def draws(id: object) -> tuple[int, int, int, int]:
    """Four numbers below 2^32 for a document."""
    key = "1:" + ("" if id is None else str(id))
    return tuple(np.frombuffer(hashlib.sha256(key.encode()).digest()[:16], ">u4").tolist())


def cut(pieces: list[Piece], at: int) -> tuple[list[Piece], list[Piece]]:
    """The pieces before and after ``at`` bytes; a piece across the place is split in two."""
    left: list[Piece] = []
    for i, (buffer, start, length) in enumerate(pieces):
        if at < length:
            if at:
                left.append((buffer, start, at))
            return left, [(buffer, start + at, length - at), *pieces[i + 1:]]
        left.append((buffer, start, length))
        at -= length
    return left, []


def _mark(number: int) -> Piece:
    at = sum(len(m) for m in MARKS[:number])
    return SENTINELS, at, len(MARKS[number])


def arrange(parts: list[list[Piece]], form: str) -> list[Piece]:
    """The parts in the order of ``form``, each behind its mark."""
    order, marks = ORDERS[form]
    return [p for part, mark in zip(order, marks) for p in (_mark(mark), *parts[part])]


def restore(output: bytes, form: str) -> list[Piece]:
    """Pieces of ``output`` that are the text it was made from."""
    whole = [(TEXT, 0, len(output))]
    if form == "plain":
        return whole
    order, marks = ORDERS[form]
    parts: dict[int, list[Piece]] = {}
    rest = whole
    for place, part in enumerate(order):
        mark = MARKS[marks[place]]
        begin = rest[0][1] if rest else len(output)
        if not output.startswith(mark, begin):
            raise ValueError(f"no mark {mark!r} where form {form} has one")
        _, rest = cut(rest, len(mark))
        begin += len(mark)
        end = len(output)
        if place + 1 < len(order):
            end = output.find(MARKS[marks[place + 1]], begin)
            if end < 0:
                raise ValueError(f"the output ends before the marks of form {form}")
        parts[part], rest = cut(rest, end - begin)
    # the inverse of the order puts every part back in its place
    return [p for part in (PREFIX, MIDDLE, SUFFIX) for p in parts[part]]


def streams(pieces: list[Piece], *buffers: bytes) -> Iterator[memoryview]:
    """The bytes of each piece, without a copy."""
    views = [memoryview(b) for b in buffers]
    for buffer, start, length in pieces:
        yield views[buffer][start: start + length]


def digest(pieces: list[Piece], *buffers: bytes) -> str:
    """SHA-256 of the pieces, fed one by one."""
    out = hashlib.sha256()
    for view in streams(pieces, *buffers):
        out.update(view)
    return out.hexdigest()


SENTINEL_BUFFER = b"".join(MARKS)


def infill_one(text: bytes, tokens: np.ndarray, id: object) -> tuple:
    """The row of one document; ``tokens`` are the first bytes of its tokens."""
    h1, h2, h3, h4 = draws(id)
    n = len(tokens)
    whole: list[Piece] = [(TEXT, 0, len(text))]
    plain = not text or h3 % 100 >= CUT_PERCENT or any(m in text for m in MARKS)
    if plain:
        form, pieces, sizes = "plain", whole, (None, None)
    else:
        form = "spm" if h4 % 100 < SUFFIX_FIRST_PERCENT else "psm"
        ends = np.append(tokens, len(text))
        low, high = (int(ends[k]) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
        prefix, rest = cut(whole, low)
        middle, suffix = cut(rest, high - low)
        pieces = arrange([prefix, middle, suffix], form)
        sizes = characters(text[:low]), characters(text[low:high])
    output = b"".join(streams(pieces, text, SENTINEL_BUFFER))
    return (n, form, *sizes, output.decode(), digest(pieces, text, SENTINEL_BUFFER),
            digest(restore(output, form), output))


def _infill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, end in text_slices(batch.column("text")):
            part = batch.slice(begin, end - begin)
            raw, starts = text_bytes(part.column("text"))
            tokens = token_starts(raw, starts)
            firsts, data = np.searchsorted(tokens, starts), raw.tobytes()
            rows = [
                infill_one(data[starts[i]: starts[i + 1]],
                           tokens[firsts[i]: firsts[i + 1]] - starts[i], id)
                for i, id in enumerate(part.column("doc_id").to_pylist())
            ]
            n, form, prefix, middle, output, made, back = zip(*rows)
            yield pa.record_batch(
                [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(form, pa.string()),
                 pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()),
                 pa.array(output, pa.string()), pa.array(made), pa.array(back)],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output",
                       "output_sha256", "restored_sha256"])


def infill(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with its ``output`` text; one narrow pass.

    Columns: ``doc_id``, ``n`` (tokens), ``form`` (``plain``, ``psm``, ``spm``),
    ``prefix_chars``, ``middle_chars``, ``output``, ``output_sha256`` (of the arranged pieces)
    and ``restored_sha256`` (of the pieces of the output put back in order).
    """
    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        _infill, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, "
        "middle_chars bigint, output string, output_sha256 string, restored_sha256 string")
