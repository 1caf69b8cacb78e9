"""Removal of long passages that repeat, by compacted paths of a De Bruijn graph of words.

Every window of ``WINDOW`` consecutive words is an edge of the graph, from the node of its
first words to that of its last ones. Only edges that occur twice matter:

1. *Seeds.* The least hash of the ``SEED_WORDS``-word stretches in a window is the window's
   seed. Equal windows have equal seeds, so only windows whose seed occurs at two places can
   repeat. About a tenth of the words are seeds; each document reports its own once.
2. *Paths.* Consecutive edges of a document with one seed are one path, without a branch
   between them. Equal paths are counted in a partial aggregate, and their first
   coordinate (row, word) becomes their source. A path that occurs twice repeats as a whole.
3. *Branches.* Where several paths share a seed, or a path runs back into itself, they may share
   some edges only. Of each of these paths the edges are read again at its source, where
   the words must still give the identity of the path, and are counted by a join.
4. *Spans.* The repeated paths and edges of a document are joined with its words; the words
   that they cover go.

A seed is a 64-bit hash and only a filter. Paths and edges have identities of two independent
64-bit hashes over all their words, so different windows are taken as equal with a
probability of about 2^-128 a pair. No group of equal windows meets in one task: groups are
partial aggregates, and joins on them are plain shuffles of written tables, which adaptive
execution splits where a key is hot. Documents are written once in buckets of their row
number, so that none of the passes over the text moves it again.

Defined results: a null text counts as empty and has no words. Rows with equal or null ids
are different documents. A document with fewer words than a window loses nothing. A window that
occurs twice in one document, overlapping ones included, repeats. An empty table gives an empty
result. Other columns are not looked at.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanweave.llm.words import SPACE_BYTES, mix, text_bytes, text_slices
from fanweave.session import new_path, stage

WINDOW = 35
SEED_WORDS = 16
#: windows of one path at most; longer stretches with one seed are cut
PATH_EDGES = 32

_RNG = np.random.Generator(np.random.PCG64(12_3535))
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACE_BYTES)] = True
_BYTE_CODES = _RNG.integers(1, 2**64, (2, 256), dtype=np.uint64)
_ODD = [int(x) * 2 + 1 for x in _RNG.integers(1, 2**62, 4)]


#: the longest run of powers so far, by base; as long as the longest slice of texts
_KNOWN: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """``base ** 0, base ** 1, ...`` modulo 2^64."""
    known = _KNOWN.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 12), base, dtype=np.uint64)
        known[0] = 1
        known = _KNOWN[base] = np.multiply.accumulate(known)
    return known[:n]


def word_places(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of every word, and the first word of every text."""
    inside = ~_IS_SPACE[raw]
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cut = starts[(starts > 0) & (starts < len(raw))]
    # a word that runs over the border of two texts is two words
    cut = np.unique(cut[inside[cut] & inside[cut - 1]]) if len(cut) else cut
    if len(cut):
        begins, ends = np.sort(np.append(begins, cut)), np.sort(np.append(ends, cut))
    return begins, ends, np.searchsorted(begins, starts).astype(np.int64)


class Words:
    """The words of a slice of texts, with two kinds of hashes of any stretch of them."""

    def __init__(self, column: pa.Array):
        self.raw, starts = text_bytes(column)
        self.begins, self.ends, self.firsts = word_places(self.raw, starts)
        self.n = len(self.begins)
        self._sums: dict[int, np.ndarray] = {}

    def _prefix_sums(self, kind: int) -> np.ndarray:
        """Sums of hash times power over the words before each place."""
        if kind not in self._sums:
            base, word_base = _ODD[2 * kind], _ODD[2 * kind + 1]
            codes = np.zeros(len(self.raw) + 1, np.uint64)
            np.cumsum(_BYTE_CODES[kind][self.raw] * _powers(base, len(self.raw)), out=codes[1:])
            back = _powers(pow(base, -1, 2**64), len(self.raw) + 1)[self.begins]
            # the length tells words apart that end in bytes without weight
            length = (self.ends - self.begins).astype(np.uint64) * np.uint64(_ODD[3 - kind])
            words = mix((codes[self.ends] - codes[self.begins]) * back + length)
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(words * _powers(word_base, self.n), out=sums[1:])
            self._sums[kind] = sums
        return self._sums[kind]

    def hashes(self, first: np.ndarray, count: np.ndarray | int, kind: int = 0) -> np.ndarray:
        """A 64-bit hash of the ``count`` words from each place on."""
        sums = self._prefix_sums(kind)
        back = _powers(pow(_ODD[2 * kind + 1], -1, 2**64), self.n + 1)
        return mix((sums[first + count] - sums[first]) * back[first])

    def rows(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.firsts) - 1), np.diff(self.firsts))


def _sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least or greatest value of every ``width`` neighbours."""
    pick = np.minimum if least else np.maximum
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[:-step], out[step:])
        have += step
    return out


class Seeds:
    """The windows of a slice of texts, their seeds, and the places of the seeds."""

    def __init__(self, words: Words, window: int, seed: int):
        self.windows = np.zeros(0, np.int64)
        self.of_window = self.values = np.zeros(0, np.uint64)
        self.places = self.row = np.zeros(0, np.int64)
        if words.n < window:
            return
        width = window - seed + 1
        row = words.rows()
        whole = row[: words.n - window + 1] == row[window - 1:]
        stretches = words.hashes(np.arange(words.n - seed + 1), seed)
        # zero is kept for places without a window
        stretches = np.maximum(stretches, np.uint64(1))
        least = np.where(whole, _sliding(stretches, width, True), np.uint64(0))
        around = np.concatenate((np.zeros(width - 1, np.uint64), least,
                                 np.zeros(width - 1, np.uint64)))
        self.windows = np.flatnonzero(whole)
        self.of_window = least[self.windows]
        self.places = np.flatnonzero(_sliding(around, width, False) == stretches)
        self.values, self.row = stretches[self.places], row[self.places]

    def counted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(text, seed, places)`` once for each seed of each text."""
        order = np.argsort(self.values, kind="stable")
        value, row = self.values[order], self.row[order]
        new = np.ones(len(order), bool)
        new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(new)
        return row[first], value[first], np.diff(np.append(first, len(order)))

    def near_twice(self, distance: int) -> np.ndarray:
        """Seeds that come twice within ``distance`` words of one text."""
        order = np.argsort(self.values, kind="stable")
        value, place = self.values[order], self.places[order]
        close = (value[1:] == value[:-1]) & (place[1:] - place[:-1] <= distance)
        return np.unique(value[1:][close])


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, end in text_slices(batch.column("text")):
            yield batch.slice(begin, end - begin)


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """The row of each element of a list column, and all elements."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), sizes), lists.flatten()


def _field(structs: pa.StructArray, name: str) -> np.ndarray:
    return structs.field(name).to_numpy(zero_copy_only=False)


class _Graph:
    """The steps that run in tasks, for one length of window."""

    def __init__(self, window: int, seed: int):
        self.window, self.seed = window, seed

    def seeds(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``(seed, row_no, places)`` of every document."""
        for part in _slices(batches):
            row, seed, places = Seeds(Words(part.column("text")), self.window, self.seed).counted()
            if len(row):
                numbers = part.column("row_no").to_numpy()
                yield pa.record_batch(
                    [_signed(seed), pa.array(numbers[row]), pa.array(places.astype(np.int32))],
                    names=["seed", "row_no", "places"])

    def paths(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The paths of the windows whose seed is in ``seeds``."""
        for part in _slices(batches):
            words = Words(part.column("text"))
            seeds = Seeds(words, self.window, self.seed)
            wanted = np.unique(_flat(part.column("seeds"))[1].to_numpy().view(np.uint64))
            here = np.isin(seeds.of_window, wanted)
            place, value = seeds.windows[here], seeds.of_window[here]
            if not len(place):
                continue
            row = words.rows()[place]
            new = np.ones(len(place), bool)
            new[1:] = (np.diff(place) != 1) | (value[1:] != value[:-1]) | (row[1:] != row[:-1])
            begin = np.flatnonzero(new)
            run = np.arange(len(place)) - np.repeat(begin, np.diff(np.append(begin, len(place))))
            first = np.flatnonzero(run % PATH_EDGES == 0)
            edges = np.diff(np.append(first, len(place)))
            at, length = place[first], edges + self.window - 1
            loops = seeds.near_twice(PATH_EDGES + self.window)
            yield pa.record_batch(
                [pa.array(part.column("row_no").to_numpy()[row[first]]),
                 pa.array((at - words.firsts[row[first]]).astype(np.int32)),
                 pa.array(edges.astype(np.int32)), _signed(value[first]),
                 _signed(words.hashes(at, length)), _signed(words.hashes(at, length, 1)),
                 pa.array(np.isin(value[first], loops))],
                names=["row_no", "at", "edges", "seed", "id_a", "id_b", "loops"])

    def edges(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The edges of the paths listed in ``paths``, read at the paths' sources."""
        for part in _slices(batches):
            words = Words(part.column("text"))
            row, path = _flat(part.column("paths"))
            at, edges = words.firsts[row] + _field(path, "at"), _field(path, "edges")
            length = edges + self.window - 1
            for kind, name in enumerate(["id_a", "id_b"]):
                found = words.hashes(at, length, kind).view(np.int64)
                if not np.array_equal(found, _field(path, name)):
                    raise ValueError("a path is not what its source says; rows changed in between")
            which = np.repeat(np.arange(len(at)), edges)
            step = np.arange(len(which)) - np.repeat(np.cumsum(edges) - edges, edges)
            place = at[which] + step
            yield pa.record_batch(
                [_signed(words.hashes(place, self.window)),
                 _signed(words.hashes(place, self.window, 1)),
                 pa.array(part.column("row_no").to_numpy()[row[which]]),
                 pa.array((place - words.firsts[row[which]]).astype(np.int32)),
                 pa.array(np.minimum(_field(path, "times"), 2)[which].astype(np.int32))],
                names=["edge_a", "edge_b", "row_no", "at", "times"])

    def kept(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The words outside all spans of a document, and the spans as ranges of words."""
        for part in _slices(batches):
            words = Words(part.column("text"))
            row, span = _flat(part.column("spans"))
            gone = np.zeros(words.n + 1, np.int32)
            at = words.firsts[row] + _field(span, "at") if len(row) else row
            if len(row):
                np.add.at(gone, at, 1)
                np.add.at(gone, at + _field(span, "edges") + self.window - 1, -1)
            gone = np.cumsum(gone)[:-1] > 0
            raw, out = words.raw.tobytes(), []
            for i, number in enumerate(part.column("row_no").to_pylist()):
                a, b = int(words.firsts[i]), int(words.firsts[i + 1])
                stay = (np.flatnonzero(~gone[a:b]) + a).tolist()
                text = b" ".join([raw[words.begins[w]: words.ends[w]] for w in stay])
                edge = np.flatnonzero(np.diff(np.concatenate(([0], gone[a:b].view(np.int8), [0]))))
                out.append((number, b - a, b - a - len(stay), text.decode(),
                            edge.reshape(-1, 2).tolist()))
            number, n, removed, texts, ranges = zip(*out)
            yield pa.record_batch(
                [pa.array(number, pa.int64()), part.column("doc_id"), pa.array(n, pa.int64()),
                 pa.array(removed, pa.int64()), pa.array(texts, pa.string()),
                 pa.array(ranges, pa.list_(pa.list_(pa.int64())))],
                names=["row_no", "doc_id", "n_words", "n_removed", "kept_text", "spans"])


def in_buckets(docs: DataFrame, id: str, text: str, buckets: int | None = None) -> DataFrame:
    """``(row_no, doc_id, text)`` written once, dealt by a unique row number.

    A join on ``row_no`` moves the other side only. The table is external, below the shared
    folder.
    """
    spark = docs.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"fanweave_words_{uuid.uuid4().hex}"
    (
        docs.select(F.monotonically_increasing_id().alias("row_no"), F.col(id).alias("doc_id"),
                    F.col(text).alias("text"))
        .repartition(buckets, "row_no")
        .write.bucketBy(buckets, "row_no").format("parquet").option("compression", "zstd")
        .option("path", new_path(spark, "words")).saveAsTable(name)
    )
    return spark.table(name)


def _per_row(rows: DataFrame, name: str, *columns: str) -> DataFrame:
    """One list a document; never longer than the document."""
    value = F.struct(*columns) if len(columns) > 1 else F.col(columns[0])
    return rows.groupBy("row_no").agg(F.collect_list(value).alias(name))


PATH = ["seed", "id_a", "id_b", "edges"]


def repeated_paths(texts: DataFrame, window: int = WINDOW, seed: int = SEED_WORDS) -> DataFrame:
    """``(row_no, at, edges)``: all windows that start elsewhere too, as runs of window starts.

    ``texts`` has a unique ``row_no`` and ``text``, in buckets of ``row_no`` at best.
    """
    graph = _Graph(window, seed)
    found = stage(
        texts.select("row_no", "text")
        .mapInArrow(graph.seeds, "seed bigint, row_no bigint, places int"), "seeds")
    twice = stage(
        found.groupBy("seed").agg(F.sum("places").alias("places"))
        .filter("places > 1").select("seed"), "repeated-seeds")
    wanted = _per_row(found.join(twice, "seed", "left_semi"), "seeds", "seed")
    paths = stage(
        texts.select("row_no", "text").join(wanted, "row_no").mapInArrow(
            graph.paths, "row_no bigint, at int, edges int, seed bigint, id_a bigint, "
            "id_b bigint, loops boolean"), "paths")
    counted = stage(
        paths.groupBy(*PATH).agg(
            F.count(F.lit(1)).alias("times"), F.max("loops").alias("loops"),
            F.min(F.struct("row_no", "at")).alias("source")), "counted-paths")
    whole = paths.join(
        stage(counted.filter("times > 1").select(*PATH), "whole-paths"), PATH, "left_semi")
    branching = counted.groupBy("seed").agg(
        F.count(F.lit(1)).alias("n"), F.max("loops").alias("loop"), F.min("times").alias("least")
    ).filter("(n > 1 or loop) and least = 1").select("seed")
    unclear = counted.join(stage(branching, "branching-seeds"), "seed", "left_semi").select(
        F.col("source.row_no").alias("row_no"), F.col("source.at").alias("at"),
        "edges", "id_a", "id_b", "times")
    asked = _per_row(unclear, "paths", "at", "edges", "id_a", "id_b", "times")
    edges = stage(
        texts.select("row_no", "text").join(asked, "row_no").mapInArrow(
            graph.edges, "edge_a bigint, edge_b bigint, row_no bigint, at int, times int"),
        "edges")
    repeated = stage(
        edges.groupBy("edge_a", "edge_b").agg(F.sum("times").alias("times"))
        .filter("times > 1").select("edge_a", "edge_b"), "repeated-edges")
    parts = edges.filter("times = 1").join(repeated, ["edge_a", "edge_b"], "left_semi")
    return whole.select("row_no", "at", "edges").unionByName(
        parts.select("row_no", "at", F.lit(1).alias("edges")))


def remove_repeats(
    docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW,
    seed: int = SEED_WORDS, buckets: int | None = None,
) -> DataFrame:
    """One row per document with the words that stay.

    Columns: ``row_no``, ``doc_id``, ``n_words``, ``n_removed``, ``kept_text`` (words joined by
    one space) and ``spans`` (``[first, end)`` word ranges that went, in order).
    """
    if not 1 <= seed <= window:
        raise ValueError("a seed is part of a window")
    texts = in_buckets(docs, id, text, buckets)
    spans = _per_row(repeated_paths(texts, window, seed), "spans", "at", "edges")
    kind = docs.schema[id].dataType.simpleString()
    return texts.join(spans, "row_no", "left").mapInArrow(
        _Graph(window, seed).kept, f"row_no bigint, doc_id {kind}, n_words bigint, "
        "n_removed bigint, kept_text string, spans array<array<bigint>>")
