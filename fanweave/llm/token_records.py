"""Token ids of documents in length-delimited binary records, with an offset index.

File format. A shard is a sequence of frames; a frame is the length of its data (8
bytes), the masked checksum of these 8 bytes (4), the data, and the masked checksum of
the data (4); numbers are little-endian. The checksum is CRC-32 as in zlib, masked by
rotation and an added constant so that checksums of data that hold checksums stay
apart. The first frame of a shard is its header (magic, partition, number within the
partition, bytes of a token id), a frame without data closes it, and every other frame
is one document: its id (8 bytes), 1 if the id is null (4), and its token ids (2 bytes
each if the vocabulary allows, else 4).

Shards are in id order by (partition, number). The index, a Parquet table beside the
shards, has the place of every record, so that a reader can fetch records in any order.

Texts of Latin letters are cut where the tokenizer's own rule cuts, and the vocabulary's
merges run once per task and distinct piece; any other text, and any text for another
kind of tokenizer, is encoded as it is. Both give the ids of the whole text.

Defined results: a null or empty text has the end id only. A null id orders first and
is kept as null. Rows with equal ids are all written, ordered by a hash of their text.
An empty table gives empty shards and an empty index. Other columns are not looked at.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fanweave.llm.rows import small_batches
from fanweave.llm.shards import read_shards, write_shards
from fanweave.llm.words import text_bytes, text_slices

MAGIC = b"FWTOKENS"
MASK_DELTA = 0xA282EAD8
#: a shard is closed when it has this many bytes; one record more may exceed it
SHARD_BYTES = 8 << 20
#: distinct pieces a task keeps at once
MAX_PIECES = 600_000

INDEX_SCHEMA = (
    "doc_id long, path string, part long, shard long, record long, offset long, "
    "n_bytes long, width long, start_in_shard long, n_tokens long, ids_crc32 long"
)


def masked(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(data: bytes) -> bytes:
    length = struct.pack("<Q", len(data))
    head = length + struct.pack("<I", masked(zlib.crc32(length)))
    return head + data + struct.pack("<I", masked(zlib.crc32(data)))


CLOSING = frame(b"")


def frames(content: bytes) -> Iterator[tuple[int, memoryview]]:
    """``(offset, data)`` of every frame; an error if a length or checksum is wrong."""
    view, at = memoryview(content), 0
    while at < len(view):
        if at + 16 > len(view):
            raise ValueError(f"truncated frame at {at}")
        length, check = struct.unpack_from("<QI", view, at)
        if masked(zlib.crc32(view[at: at + 8])) != check:
            raise ValueError(f"bad length at {at}")
        end = at + 12 + length
        if end + 4 > len(view):
            raise ValueError(f"truncated frame at {at}")
        data = view[at + 12: end]
        if masked(zlib.crc32(data)) != struct.unpack_from("<I", view, end)[0]:
            raise ValueError(f"bad checksum at {at}")
        yield at, data
        at = end + 4


#: classes of bytes in the tokenizer's own splitting rule
LETTER, DIGIT, SIGN, SPACE, OTHER = range(5)
#: fixed values: endings that the rule splits off after an apostrophe
ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")


def _byte_classes() -> np.ndarray:
    """Classes of ASCII bytes and of the bytes of the letters U+00C0 to U+024F."""
    classes = np.full(256, OTHER, np.uint8)
    classes[0x00:0x80] = SIGN
    classes[[ord(c) for c in " \t\n\x0b\x0c\r"]] = SPACE
    classes[0x1C:0x20] = OTHER  # white space to some, not to all
    classes[ord("0"): ord("9") + 1] = DIGIT
    classes[ord("A"): ord("Z") + 1] = LETTER
    classes[ord("a"): ord("z") + 1] = LETTER
    classes[0x80:0xC0] = LETTER  # a byte after one of the following
    classes[0xC3:0xC9] = LETTER
    return classes


_CLASSES = _byte_classes()


def piece_starts(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the tokenizer's rule cuts texts of known bytes into pieces.

    The rule: an apostrophe with certain endings; letters, digits or signs, each with one
    space before; white space, without the last character if something follows.
    ``raw`` are the bytes of all texts, ``starts`` the place of each text and the end.
    """
    kind = _CLASSES[raw]
    cut = np.ones(len(raw) + 1, bool)
    cut[1:-1] = kind[1:] != kind[:-1]
    cut[starts] = True
    text_end = np.zeros(len(raw) + 1, bool)
    text_end[starts] = True
    last = np.flatnonzero((kind == SPACE) & cut[1:] & ~text_end[1:])
    cut[last] = True
    cut[last[raw[last] == 0x20] + 1] = False
    quote = np.flatnonzero((raw == ord("'")) & cut[:-1] & cut[1:] & ~text_end[1:])
    padded = np.concatenate([raw, np.zeros(3, np.uint8)])
    for ending in ENDINGS:
        fits = np.ones(len(quote), bool)
        for n, char in enumerate(ending.encode(), 1):
            fits &= padded[quote + n] == char
            fits &= ~text_end[np.minimum(quote + n, len(raw))]
        cut[quote[fits] + 1] = False
        cut[quote[fits] + 1 + len(ending)] = True
    return np.flatnonzero(cut)


def _visible_bytes() -> dict[int, str]:
    """The characters by which a byte-level vocabulary writes bytes, by Latin-1 character."""
    table, free = {}, 256
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 255 and byte != 173:
            table[byte] = chr(byte)
        else:
            table[byte], free = chr(free), free + 1
    return table


class Encoder:
    """Token ids of whole texts; pieces that repeat are encoded once."""

    def __init__(self, tokenizer_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        described = json.loads(self.tokenizer.to_str())
        rule = described.get("pre_tokenizer") or {}
        #: whether the pieces can be found here; if not, texts are encoded as they are
        self.by_piece = (
            described["model"]["type"] == "BPE" and described.get("normalizer") is None
            and rule.get("type") == "ByteLevel" and rule.get("use_regex")
            and not rule.get("add_prefix_space")
            and not described["model"].get("ignore_merges")
        )
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.visible = str.maketrans(_visible_bytes())
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 20, np.uint32)
        self.ends = np.zeros(1 << 18, np.int64)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [e.ids for e in encoded]

    def _learn(self, pieces: list[bytes]) -> None:
        """Encode the pieces with the vocabulary's merges and append them to the known."""
        merge, visible = self.tokenizer.model.tokenize, self.visible
        ids = [[t.id for t in merge(p.decode("latin-1").translate(visible))] for p in pieces]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        n, total = len(self.known), int(counts.sum())
        used = int(self.ends[n - 1]) if n else 0
        while used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(ids) > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        flat = chain.from_iterable(ids)
        self.flat[used: used + total] = np.fromiter(flat, np.uint32, total)
        self.ends[n: n + len(ids)] = used + np.cumsum(counts)
        self.known.update(zip(pieces, range(n, n + len(pieces))))

    def _places(self, pieces: list[bytes]) -> np.ndarray:
        if len(self.known) + len(pieces) > MAX_PIECES:
            self._forget()
        new = [p for p in pieces if p not in self.known]
        if new:
            self._learn(new)
        return np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the number of ids of each text."""
        column = column.fill_null("").cast(pa.large_string())
        raw, starts = text_bytes(column)
        if not self.by_piece:
            return self._joined([np.asarray(i, np.uint32) for i in self._whole(column.to_pylist())])
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(column), np.int64)
        cuts = piece_starts(raw, starts)
        pieces = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(raw)]
        ).dictionary_encode()
        place = self._places(pieces.dictionary.to_pylist())[np.asarray(pieces.indices)]
        begins = np.where(place > 0, self.ends[place - 1], 0)
        counts = self.ends[place] - begins
        total = np.concatenate([[0], np.cumsum(counts)])
        ids = self.flat[np.repeat(begins - total[:-1], counts) + np.arange(total[-1])]
        bounds = total[np.searchsorted(cuts, starts)]
        odd = self._odd(column, raw, starts)
        if not len(odd):
            return ids, np.diff(bounds)
        parts = np.split(ids, bounds[1:-1])
        for row, own in zip(odd.tolist(), self._whole(column.take(pa.array(odd)).to_pylist())):
            parts[row] = np.asarray(own, np.uint32)
        return self._joined(parts)

    def _odd(self, column: pa.Array, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Texts with bytes outside the known classes, or with a special token's text."""
        strange = _CLASSES[raw] == OTHER
        # two signs of division and multiplication are among the letters' bytes
        strange[1:] |= (raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7))
        rows = np.searchsorted(starts, np.flatnonzero(strange), side="right") - 1
        odd = np.zeros(len(column), bool)
        odd[rows] = True
        for text in self.special:
            odd |= np.asarray(pc.match_substring(column, text))
        return np.flatnonzero(odd)

    @staticmethod
    def _joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), counts


def id_width(vocabulary: int, end_id: int) -> str:
    """The narrowest of two and four bytes that holds every id."""
    return "<u2" if max(vocabulary, end_id + 1) <= 1 << 16 else "<u4"


def _shard_maker(tokenizer_path: str, end_id: int, shard_bytes: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer_path)
        part = TaskContext.get().partitionId()
        width = id_width(encoder.tokenizer.get_vocab_size(), end_id)
        end = np.array([end_id], width).tobytes()
        number, size, open_shard = 0, 0, []

        def closed() -> pa.RecordBatch:
            head = frame(MAGIC + struct.pack("<qqq", part, number, np.dtype(width).itemsize))
            return pa.RecordBatch.from_arrays([pa.array([head + b"".join(open_shard)])], ["shard"])

        for batch in batches:
            for begin, stop in text_slices(batch.column(1)):
                names = batch.column(0).slice(begin, stop - begin).to_pylist()
                ids, counts = encoder.encode(batch.column(1).slice(begin, stop - begin))
                raw = ids.astype(width).tobytes()
                at, size_of = 0, len(end)
                for name, count in zip(names, counts.tolist()):
                    head = struct.pack("<qI", 0 if name is None else name, name is None)
                    record = frame(head + raw[at: at + size_of * count] + end)
                    at += size_of * count
                    open_shard.append(record)
                    size += len(record)
                    if size >= shard_bytes:
                        yield closed()
                        number, size, open_shard = number + 1, 0, []
        if open_shard:
            yield closed()

    return make


def _index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parse and check whole shards; a row for every document record."""
    names = [f.strip().split(" ")[0] for f in INDEX_SCHEMA.split(",")]
    types = [pa.string() if n == "path" else pa.int64() for n in names]
    for batch in batches:
        for path, content in zip(*(batch.column(c).to_pylist() for c in ("path", "content"))):
            found, rows, start, closed = frames(content), [], 0, False
            _, header = next(found)
            if bytes(header[:8]) != MAGIC:
                raise ValueError(f"{path}: not a token shard")
            part, shard, width = struct.unpack_from("<qqq", header, 8)
            for offset, data in found:
                if closed:
                    raise ValueError(f"{path}: data after the end")
                if not len(data):
                    closed = True
                    continue
                name, is_null = struct.unpack_from("<qI", data, 0)
                ids = np.frombuffer(data[12:], f"<u{width}").astype("<u4")
                rows.append((None if is_null else name, path, part, shard, len(rows), offset,
                             len(data), width, start, len(ids), zlib.crc32(ids)))
                start += len(ids)
            if not closed:
                raise ValueError(f"{path}: the shard is cut off")
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names
            )


def write_token_records(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, id: str = "doc_id",
    text: str = "text", shard_bytes: int = SHARD_BYTES,
) -> None:
    """Encode all documents and write ``path/shards`` and ``path/index``.

    Rows are dealt to tasks by ranges of the id, in id order, as the file order asks.
    """
    named = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    order = ["doc_id", "hash", "tie"]
    dealt = (
        named.withColumn("hash", F.xxhash64("text"))
        .withColumn("tie", F.monotonically_increasing_id())
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
    )
    shards = small_batches(dealt).mapInArrow(_shard_maker(tokenizer_path, end_id, shard_bytes), "shard binary")
    write_shards(shards, "shard", f"{path}/shards", CLOSING)
    index = read_shards(docs.sparkSession, f"{path}/shards")
    index.mapInArrow(_index_rows, INDEX_SCHEMA).write.parquet(f"{path}/index")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The offset index, with ``start``: the number of ids in all records before.

    The running total over shards is one row per shard, the only step in one task.
    """
    index = spark.read.schema(INDEX_SCHEMA).parquet(f"{path}/index")
    before = W.orderBy("part", "shard").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        index.groupBy("part", "shard").agg(F.sum("n_tokens").alias("n"))
        .withColumn("shard_start", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .select("part", "shard", "shard_start")
    )
    return index.join(starts, ["part", "shard"]).withColumn(
        "start", F.col("shard_start") + F.col("start_in_shard")
    )


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the wanted records out of each shard by their offsets."""
    for batch in batches:
        for n in range(batch.num_rows):
            view = memoryview(batch.column("content")[n].as_buffer())
            names, keys, ids = [], [], []
            for want in batch.column("wanted")[n].as_py():
                end = want["offset"] + want["n_bytes"] + 16
                _, data = next(frames(view[want["offset"]: end]))
                names.append(want["doc_id"])
                keys.append(want["key"])
                ids.append(np.frombuffer(data[12:], f"<u{want['width']}").astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.array(ids, pa.list_(pa.int64())),
                 pa.array(keys, pa.int64())],
                ["doc_id", "ids", "key"],
            )


def read_shuffled(
    spark: SparkSession, path: str, seed: int, index: DataFrame | None = None
) -> DataFrame:
    """``(doc_id, ids)`` in a random order that ``seed`` fixes, through the offset index.

    ``index``: the rows of :func:`read_index` to fetch; all, if not given. Shards without
    a wanted record are not decoded.
    """
    index = read_index(spark, path) if index is None else index
    key = F.xxhash64(F.lit(seed), "part", "shard", "record").alias("key")
    wanted = index.groupBy("path").agg(
        F.collect_list(F.struct("doc_id", "offset", "n_bytes", "width", key)).alias("wanted")
    )
    found = read_shards(spark, f"{path}/shards").join(wanted, "path").select("content", "wanted")
    fetched = found.mapInArrow(_fetch, "doc_id long, ids array<long>, key long")
    return fetched.orderBy("key").select("doc_id", "ids")
