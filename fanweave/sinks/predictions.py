"""Prediction sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_FILE = 500


def write_predictions(df: DataFrame, folder: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """CSV files with a header and at most ``rows_per_file`` rows each."""
    (
        df.select("image_id", "prediction")
        .write.option("header", True)
        .option("maxRecordsPerFile", rows_per_file)
        .csv(folder)
    )


def latest_predictions(df: DataFrame, id: str = "image_id", seq: str = "seq") -> DataFrame:
    """The prediction with the highest ``seq`` for every id.

    The aggregate combines before the shuffle, so copies of one id collapse
    inside each map task.
    """
    return df.groupBy(id).agg(F.max_by("prediction", seq).cast("int").alias("prediction"))


def upsert_predictions(batch: DataFrame, batch_id: int, path: str, seq: str) -> None:
    """Add one batch of predictions to an upsert log; use it in ``foreachBatch``.

    Of several predictions of an id in a batch the last by ``seq`` counts. Each batch owns one folder and overwrites it, so a replayed batch leaves the
    same log. Readers merge with :func:`read_upserts`; nothing already written is
    rewritten.
    """
    merged = latest_predictions(batch, "image_id", seq)
    merged.write.mode("overwrite").parquet(f"{path}/batch_id={int(batch_id)}")


def read_upserts(spark: SparkSession, path: str) -> DataFrame:
    """The current prediction of every id in an upsert log."""
    return latest_predictions(spark.read.parquet(path), "image_id", "batch_id")


def compact_upserts(spark: SparkSession, path: str, into: str) -> None:
    """Write a log with the current predictions only; it takes the old log's place.

    The result keeps each id's batch, so a batch that is replayed later still merges.
    """
    log = spark.read.parquet(path)
    last = F.max(F.struct("batch_id", "prediction")).alias("last")
    log.groupBy("image_id").agg(last).select(
        "image_id", "last.prediction", "last.batch_id"
    ).write.partitionBy("batch_id").parquet(into)


def pending(df: DataFrame, finished: DataFrame, id: str = "image_id") -> DataFrame:
    """Rows of ``df`` whose id is not among the finished ones."""
    return df.join(finished.select(id).distinct(), id, "left_anti")
