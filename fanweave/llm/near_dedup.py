"""Near-duplicate documents by banded SetSketch registers, confirmed on full sets.

1. Every text becomes the set of its distinct five-word shingles (as 64-bit hashes) and
   252 SetSketch registers. Documents with equal sets (equal size and equal 128-bit sum
   of the hashes) form a class; the rest works on classes, so copies cost nothing.
2. Classes that agree in all registers of a band share a bucket. The bands follow from the
   threshold (42 of six registers for 0.85, 50 of five for 0.8), so that two sets at the
   threshold miss all buckets of each other with a probability of at most 3e-9.
3. Buckets are resolved in two rounds. In the first, every class of a bucket is paired with
   the bucket's most central class, the one whose buckets are the largest: the original
   of a group of copies shares more buckets with them than they do with each other.
   After that most buckets are connected and done. In the others, those classes that are
   not connected with the central one meet all classes of the bucket, block by block: a
   row holds two blocks of about ``BLOCK`` sketches, and the task that compares them
   returns only pairs that are in different components, whose estimates from the sketch
   and from a wide one of 1024 registers are high enough,
   and for which this is the first bucket they share. So no pair that could connect two
   components stays untested, and groups of copies are never expanded into pairs.
4. A pair is dropped if its joint-likelihood similarity is six standard errors below the
   threshold (probability 1e-9 for a true link), else confirmed on both full sets.
5. Links are contracted to connected components.

Defined results: a text with fewer than five words has one shingle, the whole sequence; a
text without words, also a null one, has none and is linked with nothing. A row with a
null id is linked with nothing: its component is null and it stays. Rows with equal ids
are separate documents; both carry the least id they reach. An empty table gives an empty
result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fanweave.llm.components import components
from fanweave.llm.rows import fresh, numbered, small_batches
from fanweave.llm.setsketch import (
    REGISTERS,
    WIDE,
    band_keys,
    banding,
    joint_similarity,
    registers,
    wide_bytes,
    wide_similarity,
)
from fanweave.llm.words import mix, shingle_sets, text_slices
from fanweave.session import stage

PERCENT = 85
#: standard errors by which an estimate may fall short
MARGIN = 6.0
#: classes of a bucket that are compared as one block
BLOCK = 64
#: pairs of one central class that one task compares with its set
PAIRS_PER_PART = 256
#: sets are fetched through a broadcast of at most so many ids, beyond it by a join
BROADCAST_IDS = 1_000_000

SIGNATURES = "doc_id long, row_no long, n long, k1 long, k2 long, sketch binary"


# --- signatures ------------------------------------------------------------------------------


def _set_keys(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over the scrambled elements of each set."""
    keys = []
    for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes ^ np.uint64(salt)))])
        keys.append((sums[starts[1:]] - sums[starts[:-1]]).view(np.int64))
    return keys[0], keys[1]


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, end in text_slices(batch.column("text")):
            part = batch.slice(begin, end - begin)
            hashes, starts = shingle_sets(part.column("text"))
            k1, k2 = _set_keys(hashes, starts)
            packed = registers(hashes, starts)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("row_no"), pa.array(np.diff(starts)),
                 pa.array(k1), pa.array(k2),
                 pa.array([row.tobytes() for row in packed], pa.binary())],
                ["doc_id", "row_no", "n", "k1", "k2", "sketch"],
            )


def _bands(percent: int):
    bands, rows = banding(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketches = np.frombuffer(
                b"".join(batch.column("sketch").to_pylist()), np.uint16
            ).reshape(-1, REGISTERS)
            keys = band_keys(sketches, bands, rows)
            cid, n = (np.repeat(np.asarray(batch.column(c)), bands) for c in ("cid", "n"))
            slot = np.tile(np.arange(bands), len(keys))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.reshape(-1).view(np.int64)), pa.array(slot), pa.array(cid),
                 pa.array(n)],
                ["band", "slot", "cid", "n"],
            )

    return run


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, end in text_slices(batch.column("text")):
            hashes, starts = shingle_sets(batch.column("text").slice(begin, end - begin))
            k1, k2 = _set_keys(hashes, starts)
            rows = [hashes[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.diff(starts)), pa.array(k1), pa.array(k2), pa.array(rows, pa.binary())],
                ["n", "k1", "k2", "elements"],
            )


# --- pairs -----------------------------------------------------------------------------------

#: what leads from a class to the text of its first document
FACTS = ("rep", "n", "k1", "k2")
NEAR = ("a", "b", *(f"{c}_{side}" for side in "ab" for c in FACTS))
NEAR_SCHEMA = ", ".join(f"{c} long" for c in NEAR)


def _least_estimate(percent: int, size: int = REGISTERS) -> float:
    share = percent / 100
    return share - MARGIN * np.sqrt(share * (1 - share) / size)


def _estimated(percent: int):
    least = _least_estimate(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(
                    -1, REGISTERS)
                for c in ("sketch_a", "sketch_b")
            )
            sizes = [np.asarray(batch.column(c)).astype(np.float64) for c in ("n_a", "n_b")]
            near = joint_similarity(left, right, *sizes) >= least
            rows = pa.array(np.flatnonzero(near))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(rows) for c in NEAR], list(NEAR))

    return run


def _confirmed(percent: int):
    def linked(left: bytes, right: bytes) -> bool:
        a, b = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
        both = np.concatenate([a, b])
        both.sort()
        common = int((both[1:] == both[:-1]).sum())
        return 100 * common >= percent * (len(both) - common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [
                n for n, (x, y) in enumerate(zip(
                    batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist()))
                if linked(x, y)
            ]
            rows = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").take(rows), batch.column("b").take(rows)], ["a", "b"]
            )

    return run


def _of_pairs(near: DataFrame) -> DataFrame:
    """``cid`` and facts of the classes in the pairs."""
    both = F.array(*(
        F.struct(F.col(s).alias("cid"), *(F.col(f"{c}_{s}").alias(c) for c in FACTS))
        for s in "ab"
    ))
    return near.select(F.inline(both)).distinct()


def _wide_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [wide_bytes(np.frombuffer(e, np.uint64), np.array([0, len(e) // 8])).tobytes()
                  for e in batch.column("elements").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("cid"), pa.array(packed, pa.binary())], ["cid", "wide"])


def _full_sets(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(cid, elements)`` of the wanted classes, from the texts of their first documents."""
    wanted = stage(wanted, "wanted")
    ids = wanted.select(F.col("rep").alias("doc_id"))
    if wanted.count() <= BROADCAST_IDS:
        ids, wanted = F.broadcast(ids), F.broadcast(wanted)
    found = small_batches(texts.join(ids, "doc_id", "left_semi").select("text")).mapInArrow(
        _set_rows, "n long, k1 long, k2 long, elements binary"
    )
    # rows that share an id may hold other texts: the keys tell them apart
    sets = found.join(wanted, ["n", "k1", "k2"]).select("cid", "elements")
    return stage(sets.dropDuplicates(["cid"]), "full-sets")


def _estimated_pairs(classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose estimate is high enough, with the facts of both classes."""
    facts = classes.select("cid", *FACTS, "sketch")

    def side(name: str) -> DataFrame:
        return facts.select(*(F.col(c).alias(f"{c}_{name}") for c in facts.columns))

    both = (
        pairs.join(side("a"), F.col("a") == F.col("cid_a"))
        .join(side("b"), F.col("b") == F.col("cid_b"))
        .select(*NEAR, "sketch_a", "sketch_b")
    )
    return stage(small_batches(both).mapInArrow(_estimated(percent), NEAR_SCHEMA), "near-pairs")


def _with_sets(near: DataFrame, sets: DataFrame, end: str, other: str) -> DataFrame:
    """``near`` and the full set of the class ``end`` as ``set_<end>``.

    A class with many pairs is cut into parts of about ``PAIRS_PER_PART`` of them; its set goes
    to each part, so no task meets all pairs of a central class.
    """
    loads = near.groupBy(end).agg(F.count(F.lit(1)).alias("pairs"))
    parts = F.ceil(F.col("pairs") / PAIRS_PER_PART)
    # a written table: by its size Spark broadcasts it or shuffles
    many = stage(loads.filter(F.col("pairs") > PAIRS_PER_PART).select(
        F.col(end).alias("of"), parts.alias("parts")), "central-classes")
    part = F.when(F.col("parts").isNull(), 0).otherwise(
        F.pmod(F.xxhash64(other), F.col("parts"))).cast("long")
    dealt = near.join(many, F.col(end) == F.col("of"), "left").select(
        *near.columns, part.alias("part"))
    copies = F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)
    placed = sets.join(many, F.col("cid") == F.col("of"), "left").select(
        F.col("cid").alias(end), F.explode(copies).alias("part"),
        F.col("elements").alias(f"set_{end}"))
    return dealt.join(placed, [end, "part"]).drop("part")


def _links(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` that full sets confirm."""
    pairs = _with_sets(near.select("a", "b"), sets, "a", "b")
    full = _with_sets(pairs, sets, "b", "a")
    return stage(small_batches(full.select("a", "b", "set_a", "set_b")).mapInArrow(
        _confirmed(percent), "a long, b long"), "links")


def _first_pairs(members: DataFrame, leaders: DataFrame, percent: int) -> DataFrame:
    """Every class of a bucket with the bucket's most central class."""
    small, large = F.least("n", "n_lead"), F.greatest("n", "n_lead")
    found = members.join(leaders, "band").filter(F.col("cid") != F.col("lead"))
    return found.filter(small * 100 >= large * percent).select(
        F.least("cid", "lead").alias("a"), F.greatest("cid", "lead").alias("b")
    ).distinct()


def _block_tester(percent: int):
    """Compare two blocks of a bucket; the pairs that must be confirmed."""
    least, least_wide = _least_estimate(percent), _least_estimate(percent, WIDE)
    n_bands, n_rows = banding(percent)

    def table(block: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sketches = np.frombuffer(b"".join(m["sketch"] for m in block), np.uint16)
        wide = np.frombuffer(b"".join(m["wide"] for m in block), np.uint8).reshape(-1, WIDE)
        columns = ("cid", "root", *FACTS)
        return sketches.reshape(-1, REGISTERS), np.array(
            [[m[c] for c in columns] for m in block], np.int64), wide

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                (left, x, wide_x), (right, y, wide_y) = table(row["left"]), table(row["right"])
                n, m = x[:, 3][:, None], y[:, 3][None, :]
                open_ = (x[:, 1][:, None] != y[:, 1][None, :]) & (
                    np.minimum(n, m) * 100 >= np.maximum(n, m) * percent)
                if row["same"]:  # a block with itself: each pair once
                    open_ &= x[:, 0][:, None] < y[:, 0][None, :]
                i, k = np.nonzero(open_)
                for begin in range(0, len(i), 4096):
                    a, b = i[begin: begin + 4096], k[begin: begin + 4096]
                    same = left[a] == right[b]
                    bands = same[:, : n_bands * n_rows].reshape(len(a), n_bands, n_rows).all(2)
                    kept = (same.mean(1) >= least - 0.05) & (bands.argmax(1) == row["slot"])
                    a, b = a[kept], b[kept]
                    near = joint_similarity(
                        left[a], right[b], x[a, 3].astype(float), y[b, 3].astype(float)) >= least
                    near[near] = wide_similarity(wide_x[a[near]], wide_y[b[near]]) >= least_wide
                    found.append(np.hstack([
                        x[a[near]][:, :1], y[b[near]][:, :1], x[a[near]][:, 2:], y[b[near]][:, 2:]]))
            rows = np.concatenate(found) if found else np.zeros((0, len(NEAR)), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows.T], list(NEAR))

    return run


def _open_pairs(
    texts: DataFrame, members: DataFrame, leaders: DataFrame, roots: DataFrame,
    classes: DataFrame, percent: int,
) -> tuple[DataFrame, DataFrame] | None:
    """Near pairs of classes of a bucket that the first round left in different components.

    With them the full sets of all classes concerned, from which each gets a wide sketch:
    its estimate has half the error, so fewer pairs leave the tasks. None if all classes
    of every bucket are connected.
    """
    known = roots.select(F.col("node").alias("cid"), "root")
    lead = leaders.select("band", "lead").join(
        roots.select(F.col("node").alias("lead"), F.col("root").alias("root_lead")), "lead", "left"
    ).withColumn("root_lead", F.coalesce("root_lead", "lead"))
    rest = stage(
        members.select("band", "slot", "cid", "size").join(lead, "band")
        .filter(F.col("cid") != F.col("lead"))
        .join(known, "cid", "left")
        .withColumn("root", F.coalesce("root", "cid")),
        "rest-of-buckets",
    )
    ends = rest.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    open_ = stage(ends.filter("low < high").select("band"), "open-buckets")
    if open_.isEmpty():
        return None
    blocks = F.ceil(F.col("size") / BLOCK)
    rest = rest.join(open_, "band")
    concerned = classes.join(rest.select("cid").distinct(), "cid")
    sets = _full_sets(texts, concerned.select("cid", *FACTS))
    wide = small_batches(sets).mapInArrow(_wide_rows, "cid long, wide binary")
    facts = stage(concerned.select("cid", *FACTS, "sketch").join(wide, "cid"), "open-classes")
    placed = rest.join(facts, "cid").select(
        "band", "slot", F.pmod(F.xxhash64("cid"), blocks).alias("block"),
        (F.col("root") != F.col("root_lead")).alias("is_left"),
        F.struct("cid", "root", *FACTS, "sketch", "wide").alias("member"),
    )
    # about BLOCK members of a bucket each, whatever the bucket's size
    gathered = stage(
        placed.groupBy("band", "slot", "block", "is_left").agg(
            F.collect_list("member").alias("members")),
        "bucket-blocks",
    )
    left = gathered.filter("is_left").select("band", "slot", F.col("block").alias("at"),
                                             F.col("members").alias("left"))
    right = gathered.select("band", "is_left", F.col("block").alias("to"),
                            F.col("members").alias("right"))
    once = ~F.col("is_left") | (F.col("at") <= F.col("to"))
    both = left.join(right, "band").filter(once).select(
        "slot", "left", "right", (F.col("is_left") & (F.col("at") == F.col("to"))).alias("same"))
    near = small_batches(both, 64).mapInArrow(_block_tester(percent), NEAR_SCHEMA)
    return stage(near, "open-pairs"), sets


# --- public operators ------------------------------------------------------------------------


def near_duplicates(
    docs: DataFrame, id: str = "doc_id", text: str = "text", row: str | None = None,
    percent: int = PERCENT,
) -> DataFrame:
    """``row_no, doc_id, n_shingles, component_id, kept`` of every document.

    Documents are linked when ``100 * |A & B| >= percent * |A | B|``; a component's id is
    the least document id that links reach, and that document stays. ``row`` names a
    unique number of the rows; of rows with a kept id one stays per number.
    """
    number = F.col(row) if row else F.monotonically_increasing_id()
    named = docs.select(
        F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"), number.alias("row_no")
    )
    signed = stage(small_batches(named).mapInArrow(_signatures, SIGNATURES), "signatures")
    linkable = signed.filter("n > 0 and doc_id is not null")
    key = ["n", "k1", "k2"]
    classes = stage(
        linkable.groupBy(*key)
        .agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"))
        .withColumn("cid", F.monotonically_increasing_id()),
        "classes",
    )
    # sets so small that one other element is too much can only be equal
    banded = classes.filter(F.col("n") * 100 >= (F.col("n") + 1) * percent)
    bands = banded.select("cid", "n", "sketch").mapInArrow(
        _bands(percent), "band long, slot long, cid long, n long")
    sizes = bands.groupBy("band").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = stage(bands.join(sizes, "band"), "buckets")
    central = shared.groupBy("cid").agg(F.sum("size").alias("central"))
    members = stage(shared.join(central, "cid"), "bucket-members")
    best = F.max(F.struct("central", (-F.col("cid")).alias("minus"), "n")).alias("best")
    leaders = stage(
        members.groupBy("band").agg(best).select(
            "band", (-F.col("best.minus")).alias("lead"), F.col("best.n").alias("n_lead")),
        "leaders",
    )
    near = _estimated_pairs(classes, _first_pairs(members, leaders, percent), percent)
    links = _links(near, _full_sets(named, _of_pairs(near)), percent)
    roots = stage(components(links), "roots")
    left_open = _open_pairs(named, members, leaders, roots, classes, percent)
    if left_open is not None:
        links = _links(*left_open, percent)
        if not links.isEmpty():
            # the components so far are stars, which keeps the contraction short
            known = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
            roots = stage(components(links.unionByName(known)), "roots")
    linked = classes.join(roots, classes["cid"] == roots["node"], "left").select(
        *key, "rep", F.coalesce("root", "cid").alias("root")
    )
    least = linked.groupBy("root").agg(F.min("rep").alias("component_id"))
    named_classes = linked.join(least, "root").select(*key, "component_id")
    joined = linkable.join(named_classes, key, "left").select(
        "row_no", "doc_id", "n", "component_id"
    )
    alone = signed.filter("n = 0 or doc_id is null").select(
        "row_no", "doc_id", "n", F.col("doc_id").alias("component_id")
    )
    return joined.unionByName(alone).select(
        "row_no", "doc_id", F.col("n").alias("n_shingles"), "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(
    docs: DataFrame, id: str = "doc_id", text: str = "text", percent: int = PERCENT
) -> DataFrame:
    """One document of each component, with the columns it had."""
    placed, row = numbered(docs, "near-dedup")
    found = near_duplicates(placed, id, text, row, percent)
    first = F.min(F.struct(~F.col("kept"), F.col("row_no"))).alias("first")
    # a row without words or id is alone; of rows with the kept id the first one stays
    single = (F.col("n_shingles") == 0) | F.col("component_id").isNull()
    stays = (
        found.filter(~single & F.col("kept")).groupBy("component_id").agg(first)
        .select(F.col("first.row_no").alias("row_no"))
    )
    gone = found.filter(~single).join(stays, "row_no", "left_anti")
    return placed.join(gone.select(F.col("row_no").alias(row)), row, "left_anti").select(
        *docs.columns
    )
