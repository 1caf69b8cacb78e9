"""Rounds and grouped arrivals: what a message means depends on the state before it.

Two rules of keyed fan-in need the messages of an id in order and a state handed on from
one to the next:

* :func:`with_rounds`: a gap of ``ttl`` or more without a message ends a round of the id, as
  a state that expires and is renewed by every message.
* :func:`grouped_cycles`: arrivals are counted once per group of messages. A group that brings
  the count to ``n`` or more completes a cycle and the count starts again at 0.

Rows are range-partitioned by id and order, so an id of any size is cut into many parts. Every
part tells what it does to the state handed to its first id, and what its last id hands on, in
one pass; these facts are followed from part to part; and a second pass scans every part with
the state it starts from. The parts are checkpointed in between, so that a part has
the same rows in both passes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fanweave.session import pin


def _in_parts(df: DataFrame, *keys: str) -> DataFrame:
    return pin(df.repartitionByRange(*keys).sortWithinPartitions(*keys))


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _segments(ids: np.ndarray) -> list[tuple[int, int]]:
    """First row and end of the rows of each id."""
    cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
    return list(zip(cuts, cuts[1:]))


# --- rounds ----------------------------------------------------------------------------------


def with_rounds(df: DataFrame, id: str, at: str, order: list[str], ttl: float) -> DataFrame:
    """``df`` and ``_round``: how many gaps of ``ttl`` or more the id had before the message.

    ``order`` sorts the messages of an id and begins with, or agrees with, the time ``at``.
    Ids are not null.
    """
    parts = _in_parts(df, id, *order)

    def facts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """First and last time and number of gaps, of this part's first and last id."""
        rows: list[list] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, times = _numbers(batch, id), _numbers(batch, at)
            for lo, hi in _segments(ids):
                gaps = int((np.diff(times[lo:hi]) >= ttl).sum())
                if rows and rows[-1][1] == ids[lo]:
                    gaps += int(times[lo] - rows[-1][3] >= ttl)
                    rows[-1][3] = times[hi - 1]
                    rows[-1][4] += gaps
                else:
                    del rows[1:]
                    rows.append([TaskContext.get().partitionId(), ids[lo], times[lo],
                                 times[hi - 1], gaps])
        if rows:
            part, first_id, first, last, gaps = (pa.array(list(c)) for c in zip(*rows))
            # only ids that equal each other matter, so a hash of them would do, too
            yield pa.RecordBatch.from_arrays(
                [part.cast(pa.int32()), first_id.cast(id_type), first.cast(at_type),
                 last.cast(at_type), gaps.cast(pa.int64())],
                ["part", "key", "first", "last", "gaps"])

    id_field, at_field = parts.schema[id], parts.schema[at]
    id_type, at_type = _arrow(id_field.dataType), _arrow(at_field.dataType)
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("key", id_field.dataType),
        T.StructField("first", at_field.dataType), T.StructField("last", at_field.dataType),
        T.StructField("gaps", T.LongType())])
    # two rows of a few numbers for each part at most
    found = sorted(parts.select(id, at).mapInArrow(facts, schema).collect(), key=lambda r: r["part"])
    starts: dict[int, tuple] = {}
    before, gaps = None, 0
    for row in found:
        if before is not None and row["key"] == before["key"]:
            # a part whose first id goes on: its last row is handed on, whatever the part
            starts[row["part"]] = (before["last"], gaps)
            gaps += int(row["first"] - before["last"] >= ttl) + row["gaps"]
        else:
            gaps = row["gaps"]
        before = row
    shared = df.sparkSession.sparkContext.broadcast(starts)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, number = None, None, 0
        started = False
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, times = _numbers(batch, id), _numbers(batch, at)
            if not started:
                start = shared.value.get(TaskContext.get().partitionId())
                if start is not None:
                    held, (last, number) = ids[0], start
                started = True
            rounds = np.empty(len(ids), np.int64)
            for lo, hi in _segments(ids):
                opens = np.zeros(hi - lo, np.int64)
                opens[1:] = np.diff(times[lo:hi]) >= ttl
                if last is not None and ids[lo] == held:
                    opens[0] = number + int(times[lo] - last >= ttl)
                rounds[lo:hi] = np.cumsum(opens)
                held, last, number = ids[lo], times[hi - 1], int(rounds[hi - 1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(rounds)], [*batch.schema.names, "_round"])

    return parts.mapInArrow(
        scan, T.StructType([*parts.schema.fields, T.StructField("_round", T.LongType())]))


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


# --- grouped arrivals ------------------------------------------------------------------------


def group_effect(sizes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """What groups of these sizes do to an open count of 0 to n - 1: the count left, and the
    number of cycles completed."""
    total = np.cumsum(sizes)
    size = len(sizes)
    # from each group on with nothing open: the group that completes next
    before = np.concatenate(([0], total))
    next_full = np.searchsorted(total, before[:size] + n)
    left, full = np.zeros(size + 1, np.int64), np.zeros(size + 1, np.int64)
    for i in range(size - 1, -1, -1):
        j = next_full[i]
        if j >= size:
            left[i] = total[-1] - before[i]
        else:
            left[i], full[i] = left[j + 1], full[j + 1] + 1
    counts = np.arange(n)
    first = np.searchsorted(total, n - counts)
    open_still = first >= size
    at = np.minimum(first + 1, size)
    return (np.where(open_still, counts + total[-1], left[at]),
            np.where(open_still, 0, full[at] + 1))


def _full_groups(sizes: np.ndarray, held: int, n: int) -> tuple[list[int], int]:
    """The groups that complete a cycle if ``held`` arrivals are open, and the count left."""
    total = np.cumsum(sizes)
    found, gone = [], -held
    while True:
        at = int(np.searchsorted(total, gone + n))
        if at >= len(sizes):
            return found, int(total[-1] - gone)
        found.append(at)
        gone = int(total[at])


def grouped_cycles(messages: DataFrame, n: int, id: str = "_id", group: str = "_group") -> DataFrame:
    """``(id, group, cycle, full)`` of every group of every id, groups in ascending order.

    ``cycle`` is the number of cycles completed before the group, ``full`` tells whether it
    completes one. Rows without id or group are left out.
    """
    sizes = (
        messages.filter(F.col(id).isNotNull() & F.col(group).isNotNull())
        .groupBy(id, group).agg(F.count(F.lit(1)).alias("_size"))
    )
    parts = _in_parts(sizes, id, group)
    id_field = parts.schema[id]

    def facts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The effect of this part on its first and on its last id."""
        rows: list[list] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, counts = _numbers(batch, id), _numbers(batch, "_size")
            segments = _segments(ids)
            for lo, hi in segments:
                goes_on = bool(rows) and rows[-1][1] == ids[lo]
                # of the other ids only one that ends the batch can end the part
                if not goes_on and rows and hi < len(ids):
                    continue
                left, full = group_effect(counts[lo:hi], n)
                if goes_on:
                    _, _, left_so_far, full_so_far = rows[-1]
                    rows[-1][2:] = [left[left_so_far], full_so_far + full[left_so_far]]
                else:
                    del rows[1:]
                    rows.append([TaskContext.get().partitionId(), ids[lo], left, full])
            if len(rows) == 2 and rows[1][1] != ids[-1]:
                del rows[1:]
        if rows:
            part, key, left, full = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array(list(key)).cast(_arrow(id_field.dataType)),
                 pa.array([x.tolist() for x in left], pa.list_(pa.int64())),
                 pa.array([x.tolist() for x in full], pa.list_(pa.int64()))],
                ["part", "key", "left", "full"])

    def follow(frame: pd.DataFrame) -> pd.DataFrame:
        held, cycle, out = 0, 0, []
        for row in frame.sort_values("part").itertuples(index=False):
            out.append((row.part, held, cycle))
            held, cycle = int(row.left[held]), cycle + int(row.full[held])
        return pd.DataFrame(out, columns=["part", "held", "cycle"])

    effects = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("key", id_field.dataType),
        T.StructField("left", T.ArrayType(T.LongType())),
        T.StructField("full", T.ArrayType(T.LongType()))])
    starts = (
        parts.mapInArrow(facts, effects).groupBy("key")
        .applyInPandas(follow, "part int, held long, cycle long").filter("held + cycle > 0")
    )
    # at most one row a part: the count and cycle of the id it shares with the one before
    opened = {r["part"]: (r["held"], r["cycle"]) for r in starts.collect()}
    shared = messages.sparkSession.sparkContext.broadcast(opened)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, cycle, started = None, 0, 0, False
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, counts = _numbers(batch, id), _numbers(batch, "_size")
            if not started:
                current, started = ids[0], True
                held, cycle = shared.value.get(TaskContext.get().partitionId(), (0, 0))
            full, cycles = np.zeros(len(ids), bool), np.zeros(len(ids), np.int64)
            for lo, hi in _segments(ids):
                if ids[lo] != current:
                    current, held, cycle = ids[lo], 0, 0
                found, held = _full_groups(counts[lo:hi], held, n)
                full[[lo + k for k in found]] = True
                cycles[lo:hi] = cycle + np.cumsum(full[lo:hi]) - full[lo:hi]
                cycle += len(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(id), batch.column(group), pa.array(cycles), pa.array(full)],
                [id, group, "cycle", "full"])

    return parts.mapInArrow(scan, T.StructType([
        id_field, parts.schema[group], T.StructField("cycle", T.LongType()),
        T.StructField("full", T.BooleanType())]))
