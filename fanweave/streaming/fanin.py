"""Stateful keyed fan-in on streams.

State is one row per id: the slot values, their arrival numbers, a counter and
the cycle. It is read and written once per id and micro-batch, not per message.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from fanweave.schemas import VECTOR
from fanweave.session import ROCKSDB_PROVIDER

STATE = "vals ARRAY<DOUBLE>, seqs ARRAY<BIGINT>, arrived BIGINT, cycle BIGINT, closed BOOLEAN"
EMPTY = np.iinfo(np.int64).min
COMPLETE = ("distinct", "arrivals", "batch_arrivals")


class Gather(StatefulProcessor):
    """Fan-in of one id; see :func:`fan_in_stream` for the options."""

    def __init__(self, ids, n, dup, complete, fill, ttl_ms, once, forget):
        self.ids, self.n, self.dup, self.complete = ids, n, dup, complete
        self.fill, self.ttl_ms, self.once, self.forget = fill, ttl_ms, once, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("slots", STATE, self.ttl_ms)

    def _load(self) -> None:
        if self.state.exists():
            vals, seqs, arrived, cycle, closed = self.state.get()
            self._reset_slots()
            if len(vals):
                self.vals = np.array(vals, dtype=np.float64)
                self.seqs = np.array(seqs, dtype=np.int64)
            self.arrived, self.cycle, self.closed = int(arrived), int(cycle), bool(closed)
        else:
            self._reset_slots()
            self.arrived, self.cycle, self.closed = 0, 0, False

    def _reset_slots(self) -> None:
        self.vals = np.zeros(self.n)
        self.seqs = np.full(self.n, EMPTY, dtype=np.int64)

    def _save(self) -> None:
        """Keep what the id still needs: nothing when forgotten, no slots when closed or new."""
        idle = self.arrived == 0 and (self.seqs == EMPTY).all()
        if self.forget and idle:
            self.state.clear()
            return
        kept = slice(0, 0) if self.closed or idle else slice(None)
        self.state.update(
            (self.vals[kept].tolist(), self.seqs[kept].tolist(), self.arrived, self.cycle,
             self.closed)
        )

    def _vector(self) -> list:
        return [
            float(v) if s != EMPTY else self.fill for v, s in zip(self.vals, self.seqs)
        ]

    def _fire(self, seq: int) -> tuple:
        row = (self.cycle, int(seq), self._vector())
        self.cycle += 1
        self.arrived = 0
        self.closed = self.once
        return row

    def handleInputRows(
        self, key, rows: Iterator[pd.DataFrame], timerValues
    ) -> Iterator[pd.DataFrame]:
        self._load()
        if not self.closed:
            if self.complete == "distinct" and self.dup == "first" and self.once:
                fired = self._merge_first(rows)
            else:
                fired = self._replay(rows)
            self._save()
            if fired:
                out = pd.DataFrame(fired, columns=["cycle", "completed_seq", "vector"])
                for place, (name, value) in enumerate(zip(self.ids, key)):
                    out.insert(place, name, [value] * len(fired))
                yield out

    def _merge_first(self, rows: Iterator[pd.DataFrame]) -> list[tuple]:
        """Earliest value per slot, one frame at a time; needs no order of the frames."""
        for frame in rows:
            frame = frame.sort_values("msg_seq", kind="stable").drop_duplicates("msg_slot")
            slots = frame["msg_slot"].to_numpy(dtype=np.int64)
            seqs = frame["msg_seq"].to_numpy(dtype=np.int64)
            values = frame["msg_value"].to_numpy(dtype=np.float64)
            better = (self.seqs[slots] == EMPTY) | (seqs < self.seqs[slots])
            self.seqs[slots[better]] = seqs[better]
            self.vals[slots[better]] = values[better]
        if (self.seqs != EMPTY).all():
            return [self._fire(self.seqs.max())]
        return []

    def _put(self, slots: np.ndarray, values: np.ndarray, seqs: np.ndarray) -> None:
        """Write messages in their order; slots outside the vector have no place in it."""
        inside = slots >= 0
        slots, values, seqs = slots[inside], values[inside], seqs[inside]
        if self.dup == "first":
            slots, first = np.unique(slots, return_index=True)
            values, seqs = values[first], seqs[first]
            free = self.seqs[slots] == EMPTY
            slots, values, seqs = slots[free], values[free], seqs[free]
        # of repeated slots numpy keeps the last
        self.vals[slots], self.seqs[slots] = values, seqs

    def _until(self, slots: np.ndarray) -> int:
        """How many messages the open cycle still takes; more than there are if it stays open."""
        if self.complete == "arrivals":
            return self.n - self.arrived
        missing = np.flatnonzero(self.seqs == EMPTY)
        window = 4 * self.n
        while True:
            seen, first = np.unique(slots[:window], return_index=True)
            found = np.isin(missing, seen)
            if found.all():
                return int(first[np.isin(seen, missing)].max()) + 1 if len(missing) else 1
            if window >= len(slots):
                return len(slots) + 1
            window *= 2

    def _replay(self, rows: Iterator[pd.DataFrame]) -> list[tuple]:
        """Cycle by cycle in arrival order; holds one id's rows of one micro-batch."""
        frames = [f for f in rows if len(f)]
        if not frames:
            return []
        batch = pd.concat(frames).sort_values("msg_seq", kind="stable")
        slots = batch["msg_slot"].to_numpy(dtype=np.int64)
        values = batch["msg_value"].to_numpy(dtype=np.float64)
        seqs = batch["msg_seq"].to_numpy(dtype=np.int64)
        fired: list[tuple] = []
        if self.complete == "batch_arrivals":
            self._put(slots, values, seqs)
            self.arrived += len(slots)
            return [self._fire(seqs[-1])] if self.arrived >= self.n else fired
        at = 0
        while at < len(slots) and not self.closed:
            take = self._until(slots[at:])
            end = min(at + take, len(slots))
            self._put(slots[at:end], values[at:end], seqs[at:end])
            self.arrived += end - at
            if at + take <= len(slots):
                fired.append(self._fire(seqs[end - 1]))
                if self.complete == "distinct":
                    self._reset_slots()
            at = end
        return fired

    def close(self) -> None:
        pass


def _combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        keys = [c for c in frame.columns if c not in ("msg_value", "msg_seq")]
        yield frame.sort_values("msg_seq", kind="stable").drop_duplicates(keys)


def fan_in_stream(
    df: DataFrame, id: str | list[str], slot: str, value: str, seq: str, n: int,
    dup: str = "first", complete: str = "distinct", fill: float | None = None,
    ttl_ms: int | None = None, once: bool = False, forget: bool = False,
) -> DataFrame:
    """Completed vectors of a message stream: ``(id, cycle, completed_seq, vector)``.

    ``id`` may be several columns; each combination has a state of its own.
    ``seq`` is a BIGINT arrival number. ``once`` keeps only the first completion of
    an id; otherwise the next message opens a new cycle. ``complete`` may also be
    ``batch_arrivals``: arrivals are counted once per micro-batch, so a cycle can
    take more than ``n``. Counting arrivals, slots outside the vector count, as in batches.
    ``forget`` drops the state of an id when its vector is complete; the numbers of its
    cycles then start at 0 again. With ``once`` a mark without slots stays. ``ttl_ms`` drops the state of an id that got no message
    for that long; such a query runs until it is stopped, so start it with a trigger.

    First write, distinct slots and ``once`` do not depend on the order inside a
    batch; repeats are then dropped before the shuffle, so a hot id sends a few rows
    per task. In the other modes the rate limit of the source bounds what one id
    can bring in one micro-batch.
    """
    if complete not in COMPLETE or dup not in ("first", "last"):
        raise ValueError(f"dup is 'first' or 'last', complete is one of {COMPLETE}")
    if complete != "distinct" and dup != "last":
        raise ValueError("counting arrivals overwrites slots: use dup='last'")
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    if forget and once:
        raise ValueError("an id that completes only once must be remembered")
    ids = [id] if isinstance(id, str) else list(id)
    keys = [f"msg_id_{k}" for k in range(len(ids))]
    named = reduce(and_, (F.col(c).isNotNull() for c in ids))
    inside = F.coalesce(F.col(slot).between(0, n - 1), F.lit(False))
    known = df.filter(named & (inside if complete == "distinct" else F.lit(True)))
    messages = known.select(
        *(F.col(c).alias(k) for c, k in zip(ids, keys)),
        F.when(inside, F.col(slot)).otherwise(-1).cast("int").alias("msg_slot"),
        F.col(value).cast("double").alias("msg_value"), F.col(seq).cast("bigint").alias("msg_seq"),
    )
    if complete == "distinct" and dup == "first" and once:
        messages = messages.mapInPandas(_combine, messages.schema)
    output = StructType(
        [
            *(StructField(c, df.schema[c].dataType) for c in ids),
            StructField("cycle", LongType()),
            StructField("completed_seq", LongType()),
            StructField("vector", VECTOR),
        ]
    )
    return messages.groupBy(*keys).transformWithStateInPandas(
        Gather(ids, n, dup, complete, fill, ttl_ms, once, forget),
        outputStructType=output,
        outputMode="Append",
        timeMode="None" if ttl_ms is None else "ProcessingTime",
    )
