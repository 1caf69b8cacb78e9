"""Repeated completions by distinct slots, in batch.

An id that has gathered all ``n`` slots starts again with its next message. Where
a cycle ends depends on where the one before ended, which a window cannot say.
Here the messages are range-partitioned by id and arrival, so a hot id is cut into
many partitions, and scanned in order:

1. Each partition tells, for the ids it shares with its neighbours, how it would
   change any open cycle handed to it. There are at most two such ids per partition.
2. These tables are followed from partition to partition, which gives the open
   cycle at the start of every partition.
3. Each partition is scanned with that start and returns its completed cycles.

The partitions are checkpointed between the steps, so that both scans see the same
rows in the same place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fanweave.schemas import VECTOR
from fanweave.session import pin

INTS = T.ArrayType(T.IntegerType())


def completions(slots: np.ndarray, n: int) -> np.ndarray:
    """For every row, the row that completes a cycle starting there; ``len`` if none does."""
    size = len(slots)
    rows = np.arange(size)
    ends = np.zeros(size, dtype=np.int64)
    for k in range(n):
        at = np.where(slots == k, rows, size)
        np.maximum(ends, np.minimum.accumulate(at[::-1])[::-1], out=ends)
    return ends


def _open_slots(slots: np.ndarray, values: np.ndarray, dup: str) -> dict[int, float]:
    """Slots of an open cycle with their first or last value."""
    if dup == "first":
        found, at = np.unique(slots, return_index=True)
    else:
        found, back = np.unique(slots[::-1], return_index=True)
        at = len(slots) - 1 - back
    return dict(zip(found.tolist(), values[at].tolist()))


def _merge(held: dict[int, float], new: dict[int, float], dup: str) -> dict[int, float]:
    return {**new, **held} if dup == "first" else {**held, **new}


def _effect(slots: np.ndarray, values: np.ndarray, n: int, dup: str) -> dict:
    """What these rows of one id do to any open cycle.

    A cycle handed over completes at the first row of one of its missing slots, so
    there is one case for each slot that occurs. ``counts[j]`` and ``exits[j]`` hold
    the further completions and the open cycle left if it completes at the first
    row of ``order[j]``.
    """
    found, firsts = np.unique(slots, return_index=True)
    by_row = np.argsort(firsts)
    ends = completions(slots, n)
    counts, exits = [], []
    for first in firsts[by_row]:
        start, count = int(first) + 1, 0
        while start < len(slots) and ends[start] < len(slots):
            start, count = int(ends[start]) + 1, count + 1
        counts.append(count)
        exits.append(_open_slots(slots[start:], values[start:], dup))
    seen = _open_slots(slots, values, dup)
    order = found[by_row].tolist()
    return {
        "order": order,
        "seen": [seen[k] for k in order],
        "counts": counts,
        "exit_slots": [list(e) for e in exits],
        "exit_values": [list(e.values()) for e in exits],
    }


def _segments(ids: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.flatnonzero(ids[1:] != ids[:-1]) + 1
    edges = [0, *cuts.tolist(), len(ids)]
    return list(zip(edges, edges[1:]))


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(
        batch.column(c).to_numpy(zero_copy_only=False) for c in ("_id", "_slot", "_value")
    )


def _vectors(
    slots: np.ndarray, values: np.ndarray, starts: list[int], ends: list[int], n: int, dup: str
) -> np.ndarray:
    """First or last value of every slot in each of the full cycles ``starts .. ends``."""
    matrix = np.empty((len(starts), n))
    for k in range(n):
        rows = np.flatnonzero(slots == k)
        if dup == "first":
            matrix[:, k] = values[rows[np.searchsorted(rows, starts)]]
        else:
            matrix[:, k] = values[rows[np.searchsorted(rows, ends, side="right") - 1]]
    return matrix


def distinct_cycles(messages: DataFrame, order: list[str], n: int, dup: str) -> DataFrame:
    """``_id``, ``cycle``, ``vector`` and the ``order`` columns of every completing message.

    ``messages`` has ``_id, _slot, _value`` and the ``order`` columns, with slots
    ``0 .. n-1``; no two messages of an id are equal in ``order``, whose columns are
    numbers.
    """
    keys = ["_id", *order]
    parts = pin(
        messages.select(*keys, "_slot", "_value")
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
    )
    key_fields = [parts.schema[k] for k in keys]
    handed_on = F.size("_open") + F.col("_cycle") > 0
    # at most one row per partition: the open cycle of the id it shares with the one before
    opened = {
        tuple(row[k] for k in keys): (row["_cycle"], dict(zip(row["_open"], row["_open_values"])))
        for row in _starts(parts, n, dup, key_fields).filter(handed_on).collect()
    }
    shared = messages.sparkSession.sparkContext.broadcast(opened)
    output = T.StructType(
        [*key_fields, T.StructField("cycle", T.LongType()), T.StructField("vector", VECTOR)]
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, cycle = None, {}, 0
        is_first = True
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, slots, values = _columns(batch)
            ends = completions(slots, n).tolist()
            if is_first:
                first = tuple(batch.column(k)[0].as_py() for k in keys)
                cycle, held = shared.value.get(first, (0, {}))
                current, is_first = ids[0], False
            starts, stops, cycles = [], [], []
            joined_stops, joined_cycles, joined = [], [], []
            for lo, hi in _segments(ids):
                if ids[lo] != current:
                    current, held, cycle = ids[lo], {}, 0
                start = lo
                if held:
                    stop = _first_end(slots[lo:hi], held, n) + lo
                    new = _open_slots(slots[lo:min(stop + 1, hi)], values[lo:stop + 1], dup)
                    held = _merge(held, new, dup)
                    if stop < hi:
                        joined.append([held[k] for k in range(n)])
                        joined_stops.append(stop)
                        joined_cycles.append(cycle)
                        held, cycle = {}, cycle + 1
                    start = min(stop + 1, hi)
                while start < hi and ends[start] < hi:
                    starts.append(start)
                    stops.append(ends[start])
                    cycles.append(cycle)
                    cycle, start = cycle + 1, ends[start] + 1
                # only the last id of the batch can go on
                if start < hi == len(ids):
                    held = _open_slots(slots[start:hi], values[start:hi], dup)
            vectors = np.concatenate([
                np.array(joined, dtype=np.float64).reshape(-1, n),
                _vectors(slots, values, starts, stops, n, dup),
            ])
            rows = pa.array([*joined_stops, *stops], type=pa.int64())
            offsets = pa.array(np.arange(0, vectors.size + 1, n, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(k).take(rows) for k in keys],
                    pa.array([*joined_cycles, *cycles], type=pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(vectors.reshape(-1))),
                ],
                names=[*keys, "cycle", "vector"],
            )

    return parts.mapInArrow(scan, output)


def _first_end(slots: np.ndarray, held: dict[int, float], n: int) -> int:
    """The row that completes an open cycle; ``len`` if none does."""
    missing = np.array([k for k in range(n) if k not in held])
    found, firsts = np.unique(slots, return_index=True)
    there = np.isin(found, missing)
    return int(firsts[there].max()) if there.sum() == len(missing) else len(slots)


def _starts(
    parts: DataFrame, n: int, dup: str, key_fields: list[T.StructField]
) -> DataFrame:
    """The open cycle at an id's first row in every partition that goes on with it."""
    keys = [f.name for f in key_fields]
    effects = T.StructType(
        [
            *key_fields,
            T.StructField("order", INTS),
            T.StructField("seen", VECTOR),
            T.StructField("counts", T.ArrayType(T.LongType())),
            T.StructField("exit_slots", T.ArrayType(INTS)),
            T.StructField("exit_values", T.ArrayType(VECTOR)),
        ]
    )
    arrow_effects = [
        pa.field("order", pa.list_(pa.int32())),
        pa.field("seen", pa.list_(pa.float64())),
        pa.field("counts", pa.list_(pa.int64())),
        pa.field("exit_slots", pa.list_(pa.list_(pa.int32()))),
        pa.field("exit_values", pa.list_(pa.list_(pa.float64()))),
    ]

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Effects of the first and of the last id of this partition."""
        current, is_first, kept = None, True, []

        def effect() -> pa.RecordBatch:
            slots = np.concatenate([s for _, s, _ in kept])
            values = np.concatenate([v for _, _, v in kept])
            result = _effect(slots, values, n, dup)
            columns = [pa.array([result[f.name]], type=f.type) for f in arrow_effects]
            return pa.RecordBatch.from_arrays(
                kept[0][0] + columns, names=[*keys, *[f.name for f in arrow_effects]]
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, slots, values = _columns(batch)
            for lo, hi in _segments(ids):
                if kept and ids[lo] != current:
                    if is_first:
                        yield effect()
                    is_first, kept = False, []
                current = ids[lo]
                if is_first or hi == len(ids):  # the others end here
                    at = [] if kept else [batch.column(k).slice(lo, 1) for k in keys]
                    kept.append((at, slots[lo:hi], values[lo:hi]))
        if kept:
            yield effect()

    starts = T.StructType(
        [*key_fields, T.StructField("_cycle", T.LongType()), T.StructField("_open", INTS),
         T.StructField("_open_values", VECTOR)]
    )

    def follow(frame: pd.DataFrame) -> pd.DataFrame:
        """Hand the open cycle of one id from partition to partition; a row per partition."""
        held, cycle, out = {}, 0, []
        for row in frame.sort_values(keys[1:]).itertuples(index=False, name=None):
            order, seen, counts, exit_slots, exit_values = row[len(keys):]
            out.append((*row[:len(keys)], cycle, list(held), list(held.values())))
            missing = set(range(n)) - set(held)
            if missing <= set(order):
                at = max(j for j, k in enumerate(order) if k in missing)
                cycle += 1 + int(counts[at])
                held = dict(zip(map(int, exit_slots[at]), exit_values[at]))
            else:
                held = _merge(held, dict(zip(map(int, order), seen)), dup)
        return pd.DataFrame(out, columns=[f.name for f in starts])

    return parts.mapInArrow(edges, effects).groupBy("_id").applyInPandas(follow, starts)
