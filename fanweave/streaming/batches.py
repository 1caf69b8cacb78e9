"""Stateful fan-in with the batch operators, one micro-batch at a time.

``fan_in_stream`` keeps its state by id and replays an id's messages of a micro-batch in one task.
Here a micro-batch is a table: the batch fan-in runs on it, which cuts an id of any size into ranges
of arrivals, and what an id carries over from earlier micro-batches goes in as messages that
arrived before all others. The state, one row per id with an open vector or completed
cycles, is a written table; each micro-batch reads the one before it and writes its own.

Each micro-batch owns a folder of results and overwrites it, and a replay starts from the same
state, so results and state are exactly once. Two state folders are used in turn.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fanweave.operators.fanin import arrival_seq, fan_in
from fanweave.operators.skew import HOT_ROWS
from fanweave.session import stage

#: ``batch``: the micro-batch that wrote the row; slots, their values and arrival numbers
STATE = ("cycle BIGINT, arrived BIGINT, slots ARRAY<INT>, vals ARRAY<DOUBLE>, "
         "seqs ARRAY<BIGINT>, batch BIGINT")
#: messages carried over come before those of the micro-batch
ORDER = ("_age", "_seq")


def _state(spark: SparkSession, path: str, batch_id: int, id: T.DataType) -> DataFrame:
    """The state before a micro-batch."""
    schema = T.StructType([T.StructField("_id", id), *T.StructType.fromDDL(STATE).fields])
    if batch_id == 0:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(f"{path}/{(batch_id - 1) % 2}")
    return rows.filter(F.col("batch") == batch_id - 1)


def _carried(state: DataFrame, complete: str) -> DataFrame:
    """What ids carry over, as messages. Arrivals that count but whose values are kept apart
    have no slot."""
    if complete == "arrivals":
        one = F.lit(1).cast("bigint")
        fillers = F.when(F.col("arrived") > 0, F.sequence(one, "arrived"))
        rows = state.select("_id", F.explode(fillers).alias("_seq"))
        return rows.select(
            "_id", F.lit(-1).alias("_slot"), F.lit(None).cast("double").alias("_value"),
            F.lit(0).cast("bigint").alias("_age"), "_seq")
    held = F.arrays_zip(
        F.col("slots").alias("_slot"), F.col("vals").alias("_value"), F.col("seqs").alias("_seq"))
    return state.select("_id", F.explode(held).alias("m")).select(
        "_id", "m._slot", "m._value", F.lit(0).cast("bigint").alias("_age"), "m._seq")


def _open_slots(rows: DataFrame, dup: str) -> DataFrame:
    """``(_id, slots, vals, seqs)``: the first or last value of each slot of these rows."""
    pick_value, pick = (F.min_by, F.min) if dup == "first" else (F.max_by, F.max)
    at = arrival_seq(F.col("_age"), F.col("_seq"))
    per_slot = (
        rows.withColumn("_at", at).groupBy("_id", "_slot")
        .agg(pick_value("_value", "_at").alias("v"), pick_value("_seq", "_at").alias("s"),
             pick("_at").alias("_at"))
    )
    held = F.sort_array(F.collect_list(F.struct("_slot", "v", "s")))
    return per_slot.groupBy("_id").agg(held.alias("h")).select(
        "_id", F.col("h._slot").alias("slots"), F.col("h.v").alias("vals"),
        F.col("h.s").alias("seqs"))


def _cells(n: int, fill: float | None) -> Column:
    """A completed vector, its gaps filled with the values carried over."""
    def cell(k: Column) -> Column:
        place = F.array_position("slots", k)
        old = F.when(place > 0, F.element_at("vals", place.cast("int")))
        found = F.coalesce(F.get("vector", k), old)
        return found if fill is None else F.coalesce(found, F.lit(float(fill)))

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), cell)


def fan_in_batches(
    out: str, state: str, id: str, slot: str, value: str, seq: str, n: int,
    dup: str = "first", complete: str = "distinct", fill: float | None = None,
    forget: bool = False, hot_rows: int = HOT_ROWS,
) -> Callable[[DataFrame, int], None]:
    """A batch function that writes ``(id, cycle, completed_seq, vector)`` below ``out``.

    The options mean what they mean for ``fan_in_stream``; all cycles are returned. ``seq`` is a
    BIGINT arrival number from 0 on. Messages without id are left out; counting arrivals, slots
    outside the vector count. ``forget`` drops ids without an open vector, whose cycles
    are then numbered from 0 again.
    """
    if complete not in ("distinct", "arrivals") or dup not in ("first", "last"):
        raise ValueError("dup is 'first' or 'last', complete is 'distinct' or 'arrivals'")
    if complete == "arrivals" and dup != "last":
        raise ValueError("counting arrivals overwrites slots: use dup='last'")

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        inside = F.coalesce(F.col(slot).between(0, n - 1), F.lit(False))
        wanted = F.col(id).isNotNull() & (inside if complete == "distinct" else F.lit(True))
        new = stage(
            batch.filter(wanted).select(
                F.col(id).alias("_id"),
                F.when(inside, F.col(slot)).otherwise(-1).cast("int").alias("_slot"),
                F.col(value).cast("double").alias("_value"),
                F.lit(1).cast("bigint").alias("_age"), F.col(seq).cast("bigint").alias("_seq")),
            "micro-batch")
        before = _state(spark, state, batch_id, new.schema["_id"].dataType)
        touched = stage(new.groupBy("_id").agg(F.count(F.lit(1)).alias("arrivals")), "touched")
        # one row per id of this micro-batch
        held = stage(before.drop("batch").join(touched, "_id").select(
            "_id", "cycle", "arrived", "slots", "vals", "seqs"), "carried")
        messages = new.unionByName(_carried(held, complete))
        found = stage(
            fan_in(messages, "_id", "_slot", "_value", ORDER, n, dup, complete, cycles="all",
                   hot_rows=hot_rows), "completed")
        earlier = held.select("_id", F.col("cycle").alias("_before"), "slots", "vals")
        numbered = found.join(earlier, "_id", "left")
        cells = F.col("vector") if complete == "distinct" else _cells(n, fill)
        step = F.lit("10000000000000000000").cast("decimal(20,0)")
        numbered.select(
            F.col("_id").alias(id),
            (F.col("cycle") + F.coalesce("_before", F.lit(0))).alias("cycle"),
            F.pmod("completed_seq", step).cast("bigint").alias("completed_seq"),
            cells.alias("vector"),
        ).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

        ends = stage(found.groupBy("_id").agg(
            F.max("completed_seq").alias("_end"), F.count(F.lit(1)).alias("full")), "ends")
        if complete == "distinct":
            at = arrival_seq(F.col("_age"), F.col("_seq"))
            rest = messages.join(ends.select("_id", "_end"), "_id", "left").filter(
                F.col("_end").isNull() | (at > F.col("_end")))
            slots = _open_slots(rest.drop("_end"), dup)
        else:
            kept = _carried(held, "distinct")
            slots = _open_slots(new.filter("_slot >= 0").unionByName(kept), dup)
        none = {c: F.coalesce(F.col(c), F.array().cast(kind)) for c, kind in
                (("slots", "array<int>"), ("vals", "array<double>"), ("seqs", "array<bigint>"))}
        zero = F.lit(0).cast("bigint")
        after = (
            touched.join(held.select("_id", "cycle", "arrived"), "_id", "left")
            .join(ends.select("_id", "full"), "_id", "left").join(slots, "_id", "left")
            .select(
                "_id", (F.coalesce("cycle", zero) + F.coalesce("full", zero)).alias("cycle"),
                ((F.coalesce("arrived", zero) + F.col("arrivals")) % n if complete == "arrivals"
                 else zero).alias("arrived"),
                *(c.alias(name) for name, c in none.items()))
        )
        if forget:
            after = after.filter("arrived > 0" if complete == "arrivals" else "size(slots) > 0")
        others = before.drop("batch").join(touched.select("_id"), "_id", "left_anti")
        others.unionByName(after).withColumn("batch", F.lit(batch_id).cast("bigint")).write.mode(
            "overwrite").parquet(f"{state}/{batch_id % 2}")

    return run


def read_fan_in(spark: SparkSession, out: str, id: str, kind: str) -> DataFrame:
    """The completed vectors of all micro-batches."""
    schema = f"{id} {kind}, cycle BIGINT, completed_seq BIGINT, vector ARRAY<DOUBLE>"
    return spark.read.schema(schema).parquet(f"{out}/batch_id=*")
