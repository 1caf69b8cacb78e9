"""Streaming forms, run to the end over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fanweave.operators.parsing import parse_messages, tag_messages
from fanweave.plans import query
from fanweave.plans.inference import PREDICT_SQL
from fanweave.plans.messages import ARRIVALS_SQL, DEAD_LETTERS_SQL, FIRST_SQL, N, broken_messages
from fanweave.plans.tables import (
    FORWARD_SQL,
    MESSAGES_SQL,
    as_images,
    as_partial_outputs,
    formula_neurons,
    table,
)
from fanweave.session import new_path
from fanweave.sinks import compact_upserts, read_upserts, upsert_predictions
from fanweave.sinks.upserts import create_upserts
from fanweave.sources import scan_predictions
from fanweave.streaming.batches import fan_in_batches, read_fan_in
from fanweave.streaming.fanin import fan_in_stream
from fanweave.streaming.groups import RowGroups
from fanweave.streaming.io import (
    as_messages,
    drain,
    mirror,
    read_messages,
    route_dead_letters,
    start,
    write_messages,
)
from fanweave.streaming.predict import predict_stream, predict_to_files, predictions_by_messages


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as a file stream. The bracket makes the path a pattern, so that it
    may name a file as well as a folder."""
    schema = table(spark, sf_dir, name).schema
    pattern = f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet"
    return read_messages(spark, path=pattern, format="parquet", schema=schema)


def _text(df: DataFrame) -> DataFrame:
    value = F.concat_ws("|", F.col("slot"), F.col("value"))
    return df.select(
        "event_id", "at", F.col("id").cast("string").alias("key"), value.alias("value")
    )


def _written(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """Run a stream into parquet files and return them."""
    path = new_path(spark, label)
    drain(start(df, f"{path}-checkpoint", path=f"{path}-out"))
    return spark.read.schema(df.schema).parquet(f"{path}-out")


@query("stream_source", f"WITH {MESSAGES_SQL} SELECT event_id, id AS image_id, slot, value FROM m")
def q_stream_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _text(as_partial_outputs(_stream(spark, sf_dir, "events")))
    good, _ = parse_messages(text, "P1", n=N)
    return _written(spark, good.select("event_id", "image_id", "slot", "value"), "source")


@query("stream_mirror",
       "SELECT CAST(event_id AS VARCHAR) AS key, event_type AS value FROM events")
def q_stream_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = _stream(spark, sf_dir, "events").select(
        F.col("event_id").alias("key"), F.col("event_type").alias("value")
    )
    path = new_path(spark, "mirror")
    drain(mirror(src, f"{path}-checkpoint", path=f"{path}-out", format="json"))
    return spark.read.schema(as_messages(src).schema).json(f"{path}-out")


@query("stream_dead_letters", DEAD_LETTERS_SQL)
def q_stream_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good rows and dead letters of one stream in two places."""
    src = broken_messages(as_partial_outputs(_stream(spark, sf_dir, "events")))
    path = new_path(spark, "letters")
    writer = route_dead_letters(f"{path}-good", f"{path}-bad", ["event_id"])
    drain(start(tag_messages(src, "P1", n=N), f"{path}-checkpoint", each_batch=writer))
    return spark.read.parquet(f"{path}-bad").select("event_id", "reason")


@query(
    "stream_fan_in",
    f"""WITH {MESSAGES_SQL}, {FIRST_SQL}
    SELECT id, slot, value FROM firsts JOIN done USING (id)""",
)
def q_stream_fan_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = as_partial_outputs(_stream(spark, sf_dir, "events"))
    done = fan_in_stream(df, "id", "slot", "value", "at", N, once=True)
    return _written(spark, done, "fan-in").select(
        "id", F.posexplode("vector").alias("slot", "value")
    )


# four fifths of all messages belong to one id; arrivals in the order of the events
SKEWED_SQL = MESSAGES_SQL.replace(
    "user_id AS id", "CASE WHEN event_id % 5 < 4 THEN -1 ELSE user_id END AS id").replace(
    "PARTITION BY user_id ORDER BY ts, event_id",
    "PARTITION BY CASE WHEN event_id % 5 < 4 THEN -1 ELSE user_id END ORDER BY event_id")


@query(
    "stream_fan_in_arrivals",
    f"WITH {SKEWED_SQL}, {ARRIVALS_SQL} "
    "SELECT id, cycle, completed_event, slot, value FROM cycles",
)
def q_stream_fan_in_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every n arrivals of an id, on a stream with a hot id."""
    src = as_partial_outputs(_stream(spark, sf_dir, "events"))
    hot = F.when(F.col("event_id") % 5 < 4, F.lit(-1).cast("bigint")).otherwise(F.col("id"))
    df = src.select(hot.alias("id"), "slot", "value", "event_id")
    path = new_path(spark, "fan-in-batches")
    run = fan_in_batches(
        f"{path}-out", f"{path}-state", "id", "slot", "value", "event_id", N, "last", "arrivals")
    drain(start(df, f"{path}-checkpoint", each_batch=run))
    return read_fan_in(spark, f"{path}-out", "id", "BIGINT").select(
        "id", "cycle", F.col("completed_seq").alias("completed_event"),
        F.posexplode("vector").alias("slot", "value"))


@query("stream_predict", PREDICT_SQL)
def q_stream_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed_predictions(spark, sf_dir, by_messages=False)


@query("stream_predict_messages", PREDICT_SQL)
def q_stream_predict_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every layer as messages and a stateful fan-in, two of them in one query."""
    return _streamed_predictions(spark, sf_dir, by_messages=True)


@query(
    "stream_predict_repeated",
    f"""WITH {FORWARD_SQL}
    SELECT image_id % 25 AS image_id, image_id AS arrival, prediction FROM formula""",
)
def q_stream_predict_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many vectors of one id in a micro-batch; each has a prediction of its own."""
    src = as_images(_stream(spark, sf_dir, "embeddings")).select(
        F.pmod("image_id", F.lit(25)).alias("image_id"), F.col("image_id").alias("arrival"),
        "features",
    )
    out = predictions_by_messages(src, formula_neurons(spark), version="arrival")
    return _written(spark, out, "predict-repeated")


def _streamed_predictions(spark: SparkSession, sf_dir: str, by_messages: bool) -> DataFrame:
    src = as_images(_stream(spark, sf_dir, "embeddings")).select("image_id", "features")
    path = new_path(spark, "predict")
    drain(
        predict_stream(
            src, formula_neurons(spark), f"{path}-out", f"{path}-checkpoint",
            by_messages=by_messages,
        )
    )
    return scan_predictions(spark, f"{path}-out")


@query("stream_restart", f"WITH {MESSAGES_SQL} SELECT event_id, id, slot, value FROM m")
def q_stream_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream that ends, gets more input, and goes on from its checkpoint: each row once."""
    events = table(spark, sf_dir, "events")
    path = new_path(spark, "restart")
    for part in (0, 1):
        # more files in the source's folder, and the same query again
        events.filter(F.col("event_id") % 2 == part).write.mode("append").parquet(f"{path}-in")
        src = read_messages(
            spark, path=f"{path}-in", format="parquet", schema=events.schema, rate=1)
        out = as_partial_outputs(src).select("event_id", "id", "slot", "value")
        drain(start(out, f"{path}-checkpoint", path=f"{path}-out"))
    return spark.read.schema(out.schema).parquet(f"{path}-out")


@query(
    "stream_addressed",
    f"WITH {MESSAGES_SQL} SELECT CAST(event_id AS VARCHAR) AS key, CAST(value AS VARCHAR) AS value, "
    "slot AS partition FROM (SELECT event_id, slot, CAST(id AS BIGINT) AS value FROM m)",
)
def q_stream_addressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages written to the partition of their slot, and read back from there."""
    df = as_partial_outputs(table(spark, sf_dir, "events"))
    path = new_path(spark, "addressed")
    write_messages(
        df.select(F.col("event_id").alias("key"), F.col("id").alias("value"), "slot"),
        path=path, partition_by="slot")
    return spark.read.schema("key STRING, value STRING, partition INT").json(path)


@query(
    "upsert_last_write",
    f"""WITH {MESSAGES_SQL}
    SELECT id AS image_id, arg_max(slot, event_id % 3 * 1000000000 + event_id) AS prediction
    FROM m GROUP BY id""",
)
def q_upsert_last_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three chunks of predictions, one of them twice, merged and compacted."""
    df = as_partial_outputs(table(spark, sf_dir, "events")).select(
        F.col("id").alias("image_id"), F.col("slot").alias("prediction"), "event_id")
    path = new_path(spark, "upserts")
    for number in (0, 1, 1, 2):
        chunk = df.filter(F.col("event_id") % 3 == number)
        upsert_predictions(chunk, number, path, "event_id")
    compact_upserts(spark, path, f"{path}-compact")
    return read_upserts(spark, f"{path}-compact")


@query(
    "stream_micro_batches",
    """SELECT event_id,
    CAST((row_number() OVER (ORDER BY event_id % 3, event_id) - 1) // 500 AS BIGINT) AS batch_no
    FROM events""",
)
def q_stream_micro_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of exactly 500 messages but the last, from a stream that is restarted in the
    middle of a batch."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    path = new_path(spark, "micro-batches")
    groups = RowGroups(f"{path}-out", f"{path}-state", 500, ["event_id"])
    for part in range(3):
        events.filter(F.col("event_id") % 3 == part).write.mode("append").parquet(f"{path}-in")
        src = read_messages(
            spark, path=f"{path}-in", format="parquet", schema=events.schema)
        drain(start(src, f"{path}-checkpoint", each_batch=groups))
    groups.close(spark, events.schema)
    return groups.read(spark, "event_id BIGINT, event_type STRING").select(
        "event_id", F.col("group").alias("batch_no"))


@query(
    "stream_prediction_files",
    f"""WITH {FORWARD_SQL}
    SELECT image_id, prediction,
    CAST((row_number() OVER (ORDER BY image_id % 3, image_id) - 1) // 120 AS BIGINT) AS file_no
    FROM formula""",
)
def q_stream_prediction_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of 120 predictions, filled across the micro-batches of a restarted stream."""
    vectors = as_images(table(spark, sf_dir, "embeddings")).select("image_id", "features")
    neurons = formula_neurons(spark)
    path = new_path(spark, "prediction-files")
    for part in range(3):
        vectors.filter(F.col("image_id") % 3 == part).write.mode("append").parquet(f"{path}-in")
        src = read_messages(spark, path=f"{path}-in", format="parquet", schema=vectors.schema)
        run, files = predict_to_files(
            src, neurons, f"{path}-out", f"{path}-state", f"{path}-checkpoint",
            rows_per_file=120, wait_s=float("inf"))
        drain(run)
    files.close(spark, "image_id BIGINT, prediction INT")
    return files.read(spark, "image_id BIGINT, prediction INT").select(
        "image_id", "prediction", F.col("group").alias("file_no"))


@query(
    "upsert_buckets",
    f"""WITH {MESSAGES_SQL}
    SELECT id AS image_id, arg_max(slot, event_id % 3 * 1000000000 + event_id) AS prediction
    FROM m GROUP BY id""",
)
def q_upsert_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three chunks, one of them twice, in buckets; buckets are compacted in between."""
    df = as_partial_outputs(table(spark, sf_dir, "events")).select(
        F.col("id").alias("image_id"), F.col("slot").alias("prediction"), "event_id")
    upserts = create_upserts(spark, new_path(spark, "upsert-buckets"), buckets=16)
    for number in (0, 1, 1, 2):
        upserts.upsert(df.filter(F.col("event_id") % 3 == number), number, "event_id")
        upserts.compact(spark, commits=2)
    return upserts.read(spark)
