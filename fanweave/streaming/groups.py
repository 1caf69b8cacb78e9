"""Groups of rows closed by count or by time, filled across micro-batches.

A micro-batch has as many rows as happened to come; consumers want groups of exactly ``rows`` rows, or
of fewer when the first of them has waited long enough. Here a micro-batch is a table: its
rows are numbered behind those that the open group holds, whole groups are written, each as one
file, and what is left, fewer than ``rows`` rows, is carried over as a written table.

Each micro-batch owns a folder of groups and overwrites it, and a replay starts from the same
state, so groups are exactly once and go on after a restart. Rows in a group, and groups, are in the order
of the micro-batches and of ``order`` within one.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fanweave.operators.rows import with_row_id
from fanweave.session import stage

#: number of the open group, the time in ms its first row came, place in the group (-1: the
#: row that is always there and has no data), micro-batch that wrote it, written by ``close``
STATE = "_group BIGINT, _since BIGINT, _place BIGINT, _batch BIGINT, _closed BOOLEAN"
TICK = "_tick"


def with_ticks(src: DataFrame) -> DataFrame:
    """The stream and one row a second without data, marked by ``_tick``.

    Spark starts no micro-batch without input; with ticks a group is closed in time also
    when no further row comes. :class:`RowGroups` drops them.
    """
    ticks = src.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).option(
        "numPartitions", 1).load()
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in src.schema.fields]
    return src.withColumn(TICK, F.lit(False)).unionByName(
        ticks.select(*empty, F.lit(True).alias(TICK)))


class RowGroups:
    """A batch function for ``start(each_batch=…)``: files of ``rows`` rows below ``out``.

    ``wait_s`` closes a group whose first row came so many seconds ago, which is looked at
    when a micro-batch starts; rows of that micro-batch then open the next group. ``clock`` gives the time
    in seconds. The group's number is the folder ``group`` of its file.
    """

    def __init__(
        self, out: str, state: str, rows: int, order: list[str], wait_s: float | None = None,
        format: str = "parquet", options: dict[str, str] | None = None,
        clock: Callable[[], float] = time.time,
    ) -> None:
        if rows < 1:
            raise ValueError("a group has one row at least")
        self.out, self.state, self.rows, self.order = out, state, rows, order
        self.wait_s, self.format, self.options, self.clock = wait_s, format, options or {}, clock

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        now = int(self.clock() * 1000)
        if TICK in batch.columns:
            batch = batch.filter(~F.col(TICK)).drop(TICK)
        before = self._before(batch, batch_id)
        group, since, held = self._open(before, now)
        names = batch.columns
        old = before.filter("_place >= 0").select(*names, F.lit(0).alias("_age"), "_place")
        new = batch.select(
            *names, F.lit(1).alias("_age"), F.lit(None).cast("bigint").alias("_place"))
        numbered = with_row_id(
            old.unionByName(new), ["_age", "_place", *self.order], "_no").drop("_age", "_place")
        total = numbered.count()
        late = held > 0 and self.wait_s is not None and now - since >= self.wait_s * 1000
        # rows of a group that time closes; groups of full size come behind it
        alone = held if late else 0
        whole = (total - alone) // self.rows
        end = alone + whole * self.rows
        place = F.col("_no") - alone
        number = F.when(place < 0, F.lit(group)).otherwise(
            F.lit(group + int(late)) + F.floor(place / self.rows))
        placed = numbered.select(
            *names, number.cast("bigint").alias("group"), F.col("_no").alias("_place"))
        self._write(placed.filter(F.col("_place") < end), names, str(batch_id))
        if end or not held:
            since = now
        rest = placed.filter(F.col("_place") >= end).select(
            *names, (F.col("_place") - end).alias("_place"))
        self._save(rest, group + int(late) + whole, since, batch_id, False, str(batch_id % 2))

    def close(self, spark: SparkSession, schema: str | T.StructType) -> int:
        """Write the open group of a stopped stream, and return its number of rows.

        A stream that is started again goes on with the next group. Call it after a micro-batch
        has ended; closing twice writes nothing new.
        """
        kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        written = self._states(spark, kind)
        last = written.agg(F.max("_batch")).first()[0]
        before = self._latest(written, last)
        group, _, held = self._open(before, 0)
        if held:
            names = kind.fieldNames()
            rows = before.filter("_place >= 0").select(
                *names, F.lit(group).cast("bigint").alias("group"), "_place")
            self._write(rows, names, f"{last}-end")
            self._save(rows.select(*names, "_place").limit(0), group + 1, 0, last, True, "closed")
        return held

    def read(self, spark: SparkSession, schema: str) -> DataFrame:
        """All groups that were written, with their number ``group``."""
        wide = f"{schema}, run STRING, `group` BIGINT"
        reader = spark.read.schema(wide).format(self.format).options(**self.options)
        return reader.load(self.out).drop("run")

    def _write(self, rows: DataFrame, names: list[str], run: str) -> None:
        """One file a group: a group lies in one task, which sorts its rows."""
        dealt = rows.repartition("group").sortWithinPartitions("group", "_place")
        dealt.select(*names, "group").write.mode("overwrite").partitionBy("group").format(
            self.format).options(**self.options).save(f"{self.out}/run={run}")

    def _save(
        self, rest: DataFrame, group: int, since: int, batch_id: int, closed: bool, folder: str
    ) -> None:
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in rest.schema.fields[:-1]]
        mark = rest.sparkSession.range(1).select(*empty, F.lit(-1).cast("bigint").alias("_place"))
        facts = {"_group": group, "_since": since, "_batch": batch_id}
        rest.unionByName(mark).select(
            "*", *(F.lit(v).cast("bigint").alias(k) for k, v in facts.items()),
            F.lit(closed).alias("_closed"),
        ).coalesce(1).write.mode("overwrite").parquet(f"{self.state}/{folder}")

    def _states(self, spark: SparkSession, data: T.StructType) -> DataFrame:
        # columns of a stored table can be null, whatever the stream's schema says
        fields = [T.StructField(f.name, f.dataType) for f in data.fields]
        schema = T.StructType([*fields, *T.StructType.fromDDL(STATE).fields])
        return spark.read.schema(schema).parquet(f"{self.state}/*")

    def _latest(self, states: DataFrame, batch_id: int) -> DataFrame:
        """What a micro-batch left, or ``close`` after it; fewer than ``rows`` rows and one."""
        rows = states.filter(F.col("_batch") == batch_id)
        closed = rows.agg(F.max("_closed")).first()[0]
        return stage(rows.filter(F.col("_closed") == F.lit(closed)), "open-group")

    def _before(self, batch: DataFrame, batch_id: int) -> DataFrame:
        spark = batch.sparkSession
        if batch_id == 0:
            schema = T.StructType([*batch.schema.fields, *T.StructType.fromDDL(STATE).fields])
            return spark.createDataFrame([], schema)
        return self._latest(self._states(spark, batch.schema), batch_id - 1)

    @staticmethod
    def _open(before: DataFrame, now: int) -> tuple[int, int, int]:
        """Number of the open group, the time it was opened, and its rows."""
        facts = before.agg(
            F.max("_group"), F.max("_since"), F.count(F.when(F.col("_place") >= 0, 1))).first()
        return (facts[0] or 0, now if facts[1] is None else facts[1], facts[2])
