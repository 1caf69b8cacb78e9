"""Message sources, sinks and query control."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from fanweave import schemas
from fanweave.operators.parsing import bad_rows, good_rows


def read_messages(
    spark: SparkSession, *, topic: str | None = None, servers: str | None = None,
    path: str | None = None, format: str = "json", schema: str | StructType = schemas.MESSAGES,
    start: str = "earliest", rate: int | None = None, fail_on_data_loss: bool = True,
) -> DataFrame:
    """A stream of keyed messages: a Kafka topic or a folder of files.

    ``rate`` limits a micro-batch: messages of a topic, files of a folder.
    ``fail_on_data_loss=False`` goes on from what is left when offsets are gone.
    """
    if topic is not None:
        reader = (
            spark.readStream.format("kafka")
            .option("kafka.bootstrap.servers", servers)
            .option("subscribe", topic)
            .option("startingOffsets", start)
            .option("failOnDataLoss", str(fail_on_data_loss).lower())
        )
        if rate:
            reader = reader.option("maxOffsetsPerTrigger", rate)
        return reader.load().select(
            F.col("key").cast("string"), F.col("value").cast("string"),
            "topic", "partition", "offset", "timestamp",
        )
    reader = spark.readStream.schema(schema).format(format)
    if rate:
        reader = reader.option("maxFilesPerTrigger", rate)
    return reader.load(path)


def start(
    df: DataFrame, checkpoint: str, *, path: str | None = None, format: str = "parquet",
    topic: str | None = None, servers: str | None = None,
    each_batch: Callable[[DataFrame, int], None] | None = None,
    trigger: str | None = None, options: dict[str, str] | None = None,
) -> StreamingQuery:
    """Start a stream into files, a topic or a batch function.

    ``trigger`` is a processing-time interval such as ``"200 milliseconds"``; without
    it the query takes what is there and stops. Files are written exactly once; a
    topic and a batch function at least once. A restart with the same checkpoint
    goes on where it stopped.
    """
    writer = df.writeStream.option("checkpointLocation", checkpoint).outputMode("append")
    for name, value in (options or {}).items():
        writer = writer.option(name, value)
    writer = writer.trigger(processingTime=trigger) if trigger else writer.trigger(
        availableNow=True
    )
    if each_batch is not None:
        return writer.foreachBatch(each_batch).start()
    if topic is not None:
        writer = writer.format("kafka").option("kafka.bootstrap.servers", servers)
        return writer.option("topic", topic).start()
    return writer.format(format).start(path)


def drain(
    query: StreamingQuery, timeout: float | None = None, idle: float | None = None
) -> bool:
    """Wait for the end of a query; True if it ended by itself.

    It is stopped after ``timeout`` seconds, or when no row came in for ``idle``
    seconds. A stream with a state time-to-live needs one of the two and a trigger:
    it keeps running to expire state, also without input.
    """
    if timeout is None and idle is None:
        query.awaitTermination()
        return True
    began = busy = time.monotonic()
    last_batch = None
    while not query.awaitTermination(1):
        now = time.monotonic()
        progress = query.lastProgress
        if query.status["isTriggerActive"] and progress is None:
            busy = now
        elif progress and progress["numInputRows"] and progress["batchId"] != last_batch:
            last_batch, busy = progress["batchId"], now
        if (timeout is not None and now - began >= timeout) or (
            idle is not None and now - busy >= idle
        ):
            query.stop()
            return False
    return True


def as_messages(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """``key``, ``value`` and, if asked for, the target ``partition`` for a topic sink."""
    columns = [F.col("key").cast("string"), F.col("value").cast("string")]
    if partition_by:
        columns.append(F.col(partition_by).cast("int").alias("partition"))
    return df.select(*columns)


def write_messages(
    df: DataFrame, *, path: str | None = None, topic: str | None = None,
    servers: str | None = None, partition_by: str | None = None,
) -> None:
    """Write a batch of keyed messages to a topic or as JSON files.

    Files get one Spark partition per group of ``partition_by`` values.
    """
    out = as_messages(df, partition_by)
    if topic is not None:
        out.write.format("kafka").option("kafka.bootstrap.servers", servers).option(
            "topic", topic
        ).save()
        return
    if partition_by:
        out.write.partitionBy("partition").json(path)
    else:
        out.write.json(path)


def mirror(src: DataFrame, checkpoint: str, **sink) -> StreamingQuery:
    """Pass keys and values through unchanged."""
    return start(as_messages(src), checkpoint, **sink)


def filter_key(df: DataFrame, key: str) -> DataFrame:
    """The messages of one key."""
    return df.filter(F.col("key") == key)


def route_dead_letters(
    good_path: str, bad_path: str, keep: list[str] | None = None
) -> Callable[[DataFrame, int], None]:
    """A batch function that writes good rows and dead letters of tagged messages apart.

    Each micro-batch owns one folder per side and overwrites it, so a replay
    leaves the same files.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            good_rows(batch).write.mode("overwrite").parquet(f"{good_path}/batch_id={batch_id}")
            bad_rows(batch, keep).write.mode("overwrite").parquet(
                f"{bad_path}/batch_id={batch_id}"
            )
        finally:
            batch.unpersist()

    return write
