"""Best-fit packing of documents into bins of fixed length under conflict constraints.

Two pieces may not share a bin if they have the same source or the same duplicate
cluster. Bins are kept in order of their residual capacity and carry a bitmap of their
sources and one of their clusters. A piece goes to the bin with the least residual that
holds it and whose bitmaps do not meet the piece's: from the first residual that is large
enough the search goes on from successor to successor until such a bin is found, and
opens a new bin if there is none. Of equal residuals the older bin comes first. Pieces
are placed in decreasing length, then by cluster, source and row.

Spark deals the rows by a hash into groups of about ``GROUP_ROWS`` rows, and each group is
packed on its own, so a hot source or cluster is spread evenly over all tasks. Only bins
that are open at the end of a group could have been filled better. A source's bit stands
for its hash within the group, so the bitmaps stay small.

Texts longer than a bin are cut; whole bins are filled by one piece each, and the rest is
packed. A null or negative length counts as 0; pieces without length are placed too (in
the first compatible bin). Null sources and null clusters conflict with nothing. Rows
with equal or null ids are separate. An empty table gives an empty result. Other columns
are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fanweave.llm.rows import small_batches
from fanweave.session import stage

CAPACITY = 2048
GROUP_ROWS = 4096


class Bins:
    """Open bins by (residual, number), with their bitmaps."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.order: list[tuple[int, int]] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.fill: list[int] = []

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Put a piece into the tightest compatible bin; its number and the offset in it."""
        for at in range(bisect_left(self.order, (size, -1)), len(self.order)):
            residual, number = self.order[at]
            if not (self.sources[number] & source or self.clusters[number] & cluster):
                del self.order[at]
                break
        else:
            residual, number = self.capacity, len(self.fill)
            self.sources.append(0)
            self.clusters.append(0)
            self.fill.append(0)
        offset = self.fill[number]
        self.sources[number] |= source
        self.clusters[number] |= cluster
        self.fill[number] += size
        insort(self.order, (residual - size, number))
        return number, offset


def pack_group(
    pieces: list[tuple[int, int | str | None, int | str | None]], capacity: int
) -> list[tuple[int, int]]:
    """Bin and offset of each ``(size, source, cluster)``, in the order of the input."""
    bits: tuple[dict, dict] = ({}, {})
    counts: tuple[dict, dict] = ({}, {})
    for piece in pieces:
        for n in (0, 1):
            counts[n][piece[n + 1]] = counts[n].get(piece[n + 1], 0) + 1

    def bit(n: int, value) -> int:
        if value is None or counts[n][value] < 2:  # alone in the group: no conflict
            return 0
        return bits[n].setdefault(value, 1 << len(bits[n]))

    bins, out = Bins(capacity), [(0, 0)] * len(pieces)
    for at in sorted(range(len(pieces)), key=lambda n: (-pieces[n][0], n)):
        size, source, cluster = pieces[at]
        out[at] = bins.place(size, bit(0, source), bit(1, cluster))
    return out


def _packer(capacity: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(parts: list[pa.RecordBatch], group: int) -> pa.RecordBatch:
            whole = pa.Table.from_batches(parts).combine_chunks()
            columns = [whole[c].to_pylist() for c in ("size", "source_key", "cluster_key")]
            places = pack_group(list(zip(*columns)), capacity)
            bins = pa.array([f"{group}-{number}" for number, _ in places], pa.string())
            offsets = pa.array([offset for _, offset in places], pa.int64())
            kept = [whole[c].combine_chunks() for c in names]
            return pa.RecordBatch.from_arrays([*kept, bins, offsets], [*names, "bin", "bin_offset"])

        open_parts: list[pa.RecordBatch] = []
        open_group = None
        for batch in batches:
            groups = batch.column("pack_group").to_pylist()
            begin = 0
            for at in range(1, len(groups) + 1):
                if at < len(groups) and groups[at] == groups[begin]:
                    continue
                if open_parts and groups[begin] != open_group:
                    yield packed(open_parts, open_group)
                    open_parts = []
                open_group = groups[begin]
                open_parts.append(batch.slice(begin, at - begin))
                begin = at
        if open_parts:
            yield packed(open_parts, open_group)

    return run


def word_count(text: str) -> Column:
    """Number of words separated by white space; 0 for a null text."""
    words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return words.cast("long")


def best_fit(
    docs: DataFrame, length: Column, source: Column, cluster: Column, id: str = "doc_id",
    capacity: int = CAPACITY, group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, size, bin, bin_offset``.

    ``start`` is the piece's place in its document, ``bin_offset`` its place in the bin.
    """
    sized = docs.select(
        F.col(id).alias("doc_id"), F.greatest(F.coalesce(length, F.lit(0)), F.lit(0))
        .cast("long").alias("length"),
        F.xxhash64(source).alias("s"), source.isNull().alias("no_source"),
        F.xxhash64(cluster).alias("c"), cluster.isNull().alias("no_cluster"),
        F.monotonically_increasing_id().alias("row_no"),
    )
    sized = stage(sized, "lengths")
    # a whole bin for every full piece, and one piece with the rest
    full = F.expr(f"(length - 1) div {int(capacity)}")
    last = F.when(F.col("length") > 0, full).otherwise(F.lit(0).cast("long"))
    pieces = sized.select(
        "*", F.posexplode(F.sequence(F.lit(0).cast("long"), last)).alias("piece", "n")
    ).withColumn("start", F.col("n") * capacity).select(
        "doc_id", "row_no", F.col("piece").cast("long").alias("piece"), "start",
        F.least(F.lit(capacity).cast("long"), F.col("length") - F.col("start")).alias("size"),
        F.when(~F.col("no_source"), F.col("s")).alias("source_key"),
        F.when(~F.col("no_cluster"), F.col("c")).alias("cluster_key"),
    )
    groups = max(1, -(-pieces.count() // group_rows))
    group = F.pmod(F.xxhash64("row_no", "piece"), F.lit(groups))
    dealt = (
        pieces.withColumn("pack_group", group).repartition("pack_group")
        .sortWithinPartitions("pack_group", F.desc("size"), "cluster_key", "source_key", "row_no",
                              "piece")
    )
    names = ["doc_id", "piece", "start", "size"]
    schema = T.StructType([
        *(dealt.schema[c] for c in names), T.StructField("bin", T.StringType()),
        T.StructField("bin_offset", T.LongType()),
    ])
    return small_batches(dealt).mapInArrow(_packer(capacity, names), schema)
