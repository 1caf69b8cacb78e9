"""Row ids, chunks and the feature/label split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fanweave.session import stage

#: ``monotonically_increasing_id`` keeps the partition above this bit
PARTITION_BIT = 33


def _partition(mark: str) -> Column:
    return F.shiftright(F.col(mark), PARTITION_BIT)


def with_row_id(df: DataFrame, order_by: list[str], name: str = "row_id") -> DataFrame:
    """Number all rows 0, 1, 2, ... in the order of ``order_by``.

    A window over the whole table would run in one task. Here the rows are
    range-partitioned and sorted, written once with their place in the partition,
    and each partition's start is the number of rows in the partitions before it.
    The start table has one row per partition, which bounds the broadcast. Equal
    keys are spread by their position in the input, so a hot key does not fill
    one partition.
    """
    tie = "_input_position"
    ordered = (
        df.withColumn(tie, F.monotonically_increasing_id())
        .orderBy(*order_by, tie)
        .drop(tie)
        .withColumn("_mark", F.monotonically_increasing_id())
    )
    placed = stage(ordered, "row-ids")
    starts = _starts(placed.groupBy(_partition("_mark").alias("_part")).count(), ["_part"])
    offset = F.col("_mark") - F.shiftleft(F.col("_part").cast("long"), PARTITION_BIT)
    return (
        placed.withColumn("_part", _partition("_mark"))
        .join(F.broadcast(starts.select("_part", "_start")), "_part")
        .withColumn(name, F.col("_start") + offset)
        .select(name, *df.columns)
    )


def _starts(counts: DataFrame, order: list[str]) -> DataFrame:
    """Running total of ``count`` before each row; one row per partition or block."""
    before = W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn("_start", F.coalesce(F.sum("count").over(before), F.lit(0)))


def _block_starts(counts: DataFrame, block: list[str]) -> DataFrame:
    """``block``, ``_start`` and ``_first``: the rows before each block, in two levels.

    Blocks are range-partitioned. A block starts where its part does, plus the blocks before it in
    the part; only the totals, one row a part, are summed in one task.
    """
    parts = stage(
        counts.repartitionByRange(*block).withColumn("_part", F.spark_partition_id()), "blocks")
    totals = parts.groupBy("_part").agg(F.sum("count").alias("count"))
    bases = _starts(totals, ["_part"]).select("_part", F.col("_start").alias("_base"))
    before = W.partitionBy("_part").orderBy(*block).rowsBetween(W.unboundedPreceding, -1)
    in_part = F.coalesce(F.sum("count").over(before), F.lit(0))
    return parts.join(bases, "_part").select(
        *block, (F.col("_base") + in_part).alias("_start"), "_first")


def _attach_starts(placed: DataFrame, starts: DataFrame, block: list[str]) -> DataFrame:
    """Rows with the start of their block. A block has one row of about 150 bytes, whatever its
    size in the file, so the broadcast is a millionth of a scan in blocks of 128 MB."""
    return placed.join(F.broadcast(starts), block, "left")


def with_file_row_id(scan: DataFrame, name: str = "row_id") -> DataFrame:
    """Number the rows of a file scan by position, files in path order.

    Rows are counted per file block in one narrow pass; a row's id is the start
    of its block plus its place in the block. The starts, one row per block, are
    broadcast, so no row moves. If the second scan splits the files in another way than the
    first, the job fails instead of giving wrong ids.
    """
    block = ["_file", "_block"]
    placed = scan.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_mark"),
    )
    counts = placed.groupBy(*block).agg(
        F.count(F.lit(1)).alias("count"), F.min("_mark").alias("_first")
    )
    starts = stage(_block_starts(counts, block), "block-starts")
    same_split = F.col("_first").isNotNull() & (_partition("_mark") == _partition("_first"))
    row_id = F.when(
        same_split, F.col("_start") + F.col("_mark") - F.col("_first")
    ).otherwise(F.raise_error(F.lit("file splits changed between two scans")).cast("long"))
    return _attach_starts(placed, starts, block).select(row_id.alias(name), *scan.columns)


def limit_rows(df: DataFrame, n: int, order_by: str = "image_id") -> DataFrame:
    """The first ``n`` rows by id.

    The n-th id is found on the id column alone; only rows up to it, in all other columns,
    meet in one task.
    """
    last = df.select(order_by).orderBy(order_by).limit(n).agg(F.max(order_by))
    upto = F.col(order_by).isNull() | (F.col(order_by) <= last.scalar())
    return df.filter(upto).orderBy(order_by).limit(n)


def split_label(df: DataFrame, row: str = "row") -> DataFrame:
    """Split a vector whose last element is the label into features and label."""
    v = F.col(row)
    return df.select(
        *[c for c in df.columns if c != row],
        F.slice(v, F.lit(1), F.size(v) - 1).alias("features"),
        F.element_at(v, -1).cast("int").alias("label"),
    )


def chunk(df: DataFrame, size: int, row_id: str = "row_id") -> DataFrame:
    """Consecutive chunks of ``size`` rows; the last one may be short."""
    return df.withColumns(
        {
            "chunk_id": F.expr(f"`{row_id}` div {int(size)}"),
            "pos": F.pmod(F.col(row_id), F.lit(size)).cast("int"),
        }
    )


def global_id(chunk_id: Column, pos: Column, size: int) -> Column:
    """The row id of a chunk member, from the nominal chunk size."""
    return (chunk_id * F.lit(size) + pos).cast("long")
