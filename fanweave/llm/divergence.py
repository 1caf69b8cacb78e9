"""Divergence of sources by a frequent-pattern tree of term rows.

A kept term of a language is one row of counts over the sources of that language, mostly
zeros. The value of two sources is a sum over all terms of ``f(p, q)``, where p and q follow
from the two counts. Written as corrections of the value of zero counts,

    sum f(p, q) = V f(p0, q0) + sum [f(p, q0) - f(p0, q0)] + sum [f(p0, q) - f(p0, q0)]
                  + sum [f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)]

the first sums run over the terms of one source, by distinct count, and the last one over the
terms that both sources have. For the last, the nonzero counts of a term, in the order of the
sources, are a path of a prefix tree. Equal paths are aggregated with their multiplicity first. Each
task sorts its paths and inserts them into a tree batch by batch: rows that begin alike share
nodes. A node adds its multiplicity times the correction of it and each of its ancestors, once,
however many terms go through it. Corrections of trees add up, so it does not matter
which paths meet in a task. A tree is held as arrays: a node is the row and depth where it is new.

Terms are counted on the bytes of a few MB of texts at a time, as arrays; such partial counts
add up. A task holds neither a dictionary of terms nor a batch of ten thousand texts.

Nothing is collected per language or source: the widest row is one term's counts, at most one
per source, as is each row of the result. Sizes of groups are joined, not broadcast by hand.

Arithmetic is in 64-bit integers. p is at most 10^9 + 1, so each f is below 2^60; a sum over V
terms is at most sum (p + q) <= 2 (10^9 + V).

Defined results: null text, language and source count as the empty string. Rows with equal or
null ids are different documents. A group without kept terms has count 0 for each; without kept
terms in the language its values are 0. An empty table gives an empty result. Other columns are
not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fanweave.llm.rows import small_batches
from fanweave.llm.words import slices, text_bytes, text_slices
from fanweave.session import stage

#: fixed values: a term is a run of A-Z, a-z and characters from U+0080 on, of whose bytes none is below 0x80
_IN_TERM = np.zeros(256, dtype=bool)
_IN_TERM[ord("A"): ord("Z") + 1] = _IN_TERM[ord("a"): ord("z") + 1] = _IN_TERM[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"): ord("Z") + 1] = _LOWER[ord("a"): ord("z") + 1]
LEAST_DOCUMENTS = 10
SCALE = 1_000_000_000
TOP_TERMS = 10
#: bytes of texts or paths that a task looks at together, and rows of counts that it sends on at once
BYTES = 4 << 20
SENT_ROWS = 20_000
#: pairs of a node and an ancestor that are computed at once
PAIRS = 1 << 18


def _gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive batches as one of about ``BYTES``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= BYTES:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms in order, A-Z as a-z, and the number of each one's text."""
    raw, starts = text_bytes(texts)
    inside = _IN_TERM[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    # a text ends a term
    cut = starts[(starts > 0) & (starts < len(raw))]
    first[cut] = inside[cut]
    begins = np.flatnonzero(first)
    ends = np.append(np.flatnonzero(first[inside]), inside.sum()).astype(np.int32)
    terms = pa.Array.from_buffers(
        pa.binary(), len(begins),
        [None, pa.py_buffer(ends), pa.py_buffer(_LOWER[raw[inside]])])
    return terms, np.searchsorted(starts, begins, side="right") - 1


def _counted(docs: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``(lang, source, term, times, docs)`` of the documents of a batch."""
    lang, source = (docs.column(c).dictionary_encode() for c in ("lang", "source"))
    sources = len(source.dictionary)
    group = lang.indices.to_numpy().astype(np.int64) * sources + source.indices.to_numpy()
    terms, row = _terms(docs.column("text"))
    terms = terms.dictionary_encode()
    known = terms.dictionary.cast("string")
    if not len(known):
        return
    # the distinct terms of every document, then of every group
    pair, times = np.unique(row * len(known) + terms.indices.to_numpy(), return_counts=True)
    row, code = np.divmod(pair, len(known))
    key = group[row] * len(known) + code
    order = np.argsort(key, kind="stable")
    key, times = key[order], times[order]
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    times, in_docs = np.add.reduceat(times, at), np.diff(np.append(at, len(key)))
    group, code = np.divmod(key[at], len(known))
    for lo in range(0, len(at), SENT_ROWS):
        part = slice(lo, lo + SENT_ROWS)
        yield pa.record_batch(
            [lang.dictionary.take(pa.array(group[part] // sources)),
             source.dictionary.take(pa.array(group[part] % sources)),
             known.take(pa.array(code[part])), pa.array(times[part]), pa.array(in_docs[part])],
            names=["lang", "source", "term", "times", "docs"])


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(lang, source, term, times, docs)``, partial counts of about ``BYTES`` of texts."""
    for docs in _gathered(batches):
        for lo, hi in text_slices(docs.column("text"), BYTES):
            yield from _counted(docs.slice(lo, hi - lo))


def term_counts(docs: DataFrame, least_docs: int = LEAST_DOCUMENTS) -> DataFrame:
    """``(lang, source, term, times)`` of the kept terms of ``(lang, source, text)``."""
    counted = stage(
        docs.mapInArrow(_counts, "lang string, source string, term string, times bigint, docs bigint")
        .groupBy("lang", "source", "term")
        .agg(F.sum("times").alias("times"), F.sum("docs").alias("docs")), "term-counts")
    kept = stage(
        counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"))
        .filter(F.col("docs") >= least_docs).select("lang", "term"), "kept-terms")
    return counted.join(kept, ["lang", "term"], "left_semi").select(
        "lang", "source", "term", "times")


def share(times: Column, total: Column, terms: Column) -> Column:
    """p of a count: whole billionths of a smoothed share, and one."""
    # counts of a large corpus times 10^9 do not fit in 64 bits
    smoothed = F.lit(SCALE).cast("decimal(10,0)") * (times + 2).cast("decimal(20,0)")
    return F.call_function("div", smoothed, (total + 2 * terms).cast("decimal(20,0)")) + 1


def value(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def tree_nodes(
    elements: np.ndarray, starts: np.ndarray, times: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nodes of the prefix tree of sorted rows: their element, depth and multiplicity.

    Row r is ``elements[starts[r]: starts[r + 1]]``, a number per element, equal rows begin alike.
    A node belongs to the first of the rows that share it; its ancestors are the elements
    before it in that row.
    """
    size = np.diff(starts)
    depth = np.arange(len(elements)) - np.repeat(starts[:-1], size)
    row = np.repeat(np.arange(len(size)), size)
    # how much of each row the row before has as well
    above = starts[np.maximum(row - 1, 0)] + depth
    same = (row > 0) & (depth < size[np.maximum(row - 1, 0)])
    same[same] = elements[above[same]] == elements[np.flatnonzero(same)]
    broken = np.where(same, len(elements), depth)
    shared = np.minimum.reduceat(broken, starts[:-1]) if len(elements) else np.zeros(0, int)
    shared = np.minimum(shared, size)
    node = np.flatnonzero(depth >= shared[row])
    # a node goes on until the next row that does not have it
    end = np.full(len(node), len(size))
    by_depth = np.argsort(depth[node], kind="stable")
    for at in np.split(by_depth, np.flatnonzero(np.diff(depth[node][by_depth])) + 1):
        if len(at):
            stops = np.flatnonzero(shared <= depth[node[at[0]]])
            place = np.searchsorted(stops, row[node[at]], side="right")
            end[at] = np.append(stops, len(size))[place]
    total = np.concatenate(([0], np.cumsum(times)))
    return node, depth[node], total[end] - total[row[node]]


def _corrections(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(lang, a, b, more)`` of the sorted rows ``(lang, path, terms)`` of a batch; a before b."""
    for batch in _gathered(batches):
        if not batch.num_rows:
            continue
        path = batch.column("path")
        cells = path.flatten()
        starts = np.concatenate(([0], np.cumsum(path.value_lengths().to_numpy())))
        lang = batch.column("lang").dictionary_encode()
        source = cells.field("source").dictionary_encode()
        of_lang = lang.indices.to_numpy().astype(np.int64)
        of_source = source.indices.to_numpy().astype(np.int64)
        p, p0 = (cells.field(c).to_numpy() for c in ("p", "p0"))
        # a first element per row stands for the language, so that languages share nothing
        number = np.unique(np.stack([np.repeat(of_lang, np.diff(starts)), of_source, p]), axis=1,
                           return_inverse=True)[1].reshape(-1)
        node, depth, times = tree_nodes(number, starts, batch.column("terms").to_numpy())
        row_lang = np.repeat(of_lang, np.diff(starts))
        sums: dict[tuple[int, int, int], int] = {}
        for lo, hi in slices(depth, PAIRS):
            below = np.repeat(node[lo:hi], depth[lo:hi])
            first = np.cumsum(depth[lo:hi]) - depth[lo:hi]
            up = np.arange(len(below)) - np.repeat(first, depth[lo:hi])
            above = below - np.repeat(depth[lo:hi], depth[lo:hi]) + up
            more = np.repeat(times[lo:hi], depth[lo:hi]) * (
                _f(p[above], p[below]) - _f(p[above], p0[below]) - _f(p0[above], p[below])
                + _f(p0[above], p0[below]))
            pair = (row_lang[below] * len(source.dictionary) + of_source[above]) * len(
                source.dictionary) + of_source[below]
            keys, place = np.unique(pair, return_inverse=True)
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, place, more)
            for key, n in zip(keys.tolist(), total.tolist()):
                sums[key] = sums.get(key, 0) + n
        keys = np.fromiter(sums, np.int64, len(sums))
        n = len(source.dictionary)
        yield pa.record_batch(
            [lang.dictionary.take(pa.array(keys // (n * n))),
             source.dictionary.take(pa.array(keys // n % n)),
             source.dictionary.take(pa.array(keys % n)),
             pa.array(np.fromiter(sums.values(), np.int64, len(sums)))],
            names=["lang", "a", "b", "more"])


def pair_corrections(rows: DataFrame) -> DataFrame:
    """``(lang, a, b, more)``: the last sum for all pairs of sources that share a term.

    ``rows`` has ``(lang, source, term, p, p0)``, one row per nonzero count.
    """
    paths = (
        rows.groupBy("lang", "term")
        .agg(F.array_sort(F.collect_list(F.struct("source", "p", "p0"))).alias("path"))
        .filter(F.size("path") > 1)
        .groupBy("lang", "path").agg(F.count(F.lit(1)).alias("terms"))
    )
    return (
        paths.sortWithinPartitions("lang", "path")
        .mapInArrow(_corrections, "lang string, a string, b string, more bigint")
        .groupBy("lang", "a", "b").agg(F.sum("more").alias("more"))
    )


def divergence(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
    least_docs: int = LEAST_DOCUMENTS, top: int = TOP_TERMS,
) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` of all pairs of sources and of the terms
    that a source has more often than its language, the ``top`` first."""

    def filled(name: str, out: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(out)

    read = small_batches(
        docs.select(filled(lang, "lang"), filled(source, "source"), filled(text, "text")))
    counts = stage(term_counts(read, least_docs), "counts")
    per_term = counts.groupBy("lang", "term").agg(F.sum("times").alias("all_times"))
    # tables of languages and sources are written, so that their size decides how they are joined
    langs = stage(per_term.groupBy("lang").agg(
        F.count(F.lit(1)).alias("terms"), F.sum("all_times").alias("all_total")), "languages")
    totals = counts.groupBy("lang", "source").agg(F.sum("times").alias("total"))
    none = F.lit(0).cast("long")
    groups = stage(
        read.select("lang", "source").distinct()
        .join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
        .select("lang", "source", *(
            F.coalesce(c, none).alias(c) for c in ("total", "terms", "all_total"))), "groups")
    zero = F.when(F.col("terms") > 0, share(none, F.col("total"), F.col("terms")))
    groups = groups.withColumn("p0", zero)

    sized = counts.join(groups, ["lang", "source"])
    p = share(F.col("times"), F.col("total"), F.col("terms"))
    rows = stage(sized.select("lang", "source", "term", "times", p.alias("p"), "p0"), "shares")

    one, other = groups.alias("g"), groups.select(
        "lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    pairs = stage(
        one.join(other, "lang").filter("source <> item")
        .select("lang", "source", "item", "p0", "q0", "terms"), "pairs")
    distinct = rows.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("n"))
    f0 = value(F.col("p0"), F.col("q0"))
    single = (
        stage(distinct, "distinct-shares").join(pairs, ["lang", "source"])
        .groupBy("lang", "source", "item")
        .agg(F.sum(F.col("n") * (value(F.col("p"), F.col("q0")) - f0)).alias("more"))
    )
    tree = stage(pair_corrections(rows), "pair-corrections")
    swapped = F.col("source").alias("item"), F.col("item").alias("source")
    base = F.when(F.col("terms") > 0, F.col("terms") * f0).otherwise(none)
    single = stage(single, "single-corrections")
    both = [
        pairs.select("lang", "source", "item", base.alias("more")),
        single.select("lang", "source", "item", "more"),
        single.select("lang", *swapped, "more").select("lang", "source", "item", "more"),
        tree.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "more"),
        tree.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "more"),
    ]
    total = both[0]
    for more in both[1:]:
        total = total.unionByName(more)
    pair = (
        total.groupBy("lang", "source", "item").agg(F.sum("more").alias("value"))
        .withColumn("part", F.lit("pair"))
    )

    of_lang = per_term.select("lang", "term", "all_times")
    q = share(F.col("all_times"), F.col("all_total"), F.col("lang_terms"))
    shares = of_lang.join(
        langs.select("lang", "all_total", F.col("terms").alias("lang_terms")), "lang"
    ).select("lang", "term", q.alias("q"))
    term = (
        rows.join(stage(shares, "language-shares"), ["lang", "term"]).filter("p > q")
        .select("lang", "source", F.col("term").alias("item"),
                value(F.col("p"), F.col("q")).alias("value"), F.lit("term").alias("part"))
    )

    ranked = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")

    def with_rank(part: DataFrame) -> DataFrame:
        return part.withColumn("rank", F.row_number().over(ranked))

    columns = ["lang", "source", "part", "item", "value", "rank"]
    return with_rank(pair).select(*columns).unionByName(
        with_rank(term).filter(F.col("rank") <= top).select(*columns))
