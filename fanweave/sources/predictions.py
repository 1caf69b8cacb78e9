"""Prediction scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fanweave import schemas


def scan_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """All ``*.csv`` prediction files below ``folder`` as one table."""
    return (
        spark.read.schema(schemas.PREDICTIONS)
        .option("pathGlobFilter", "*.csv")
        .option("recursiveFileLookup", "true")
        .csv(folder, header=True)
    )
