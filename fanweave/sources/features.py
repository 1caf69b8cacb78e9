"""Feature and label scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fanweave import schemas
from fanweave.functions.blobs import decode_vectors
from fanweave.operators.rows import with_file_row_id


def scan_features(spark: SparkSession, path: str, label_col: str | None = None) -> DataFrame:
    """Scan a wide CSV: every column a number, the label last unless named.

    Returns ``(image_id, features, label)``. The id is the row's 0-based position
    in the files, in path order. The columns are typed up front from the header
    line, so the data is read once and never sampled for types.
    """
    names = spark.read.csv(path, header=True, inferSchema=False).columns
    label = label_col or names[-1]
    schema = T.StructType([T.StructField(name, T.DoubleType()) for name in names])
    rows = spark.read.schema(schema).csv(path, header=True, mode="FAILFAST")
    features = F.array(*[F.col(f"`{name}`") for name in names if name != label])
    return with_file_row_id(rows, "image_id").select(
        "image_id", features.alias("features"), F.col(f"`{label}`").cast("int").alias("label")
    )


def scan_labels(spark: SparkSession, path: str) -> DataFrame:
    """Scan an ``image_id,label`` CSV."""
    return spark.read.schema(schemas.LABELS).csv(path, header=True)


def scan_vector_blobs(
    spark: SparkSession, path: str, encoding: str = "raw", blob: str = "blob"
) -> DataFrame:
    """Scan a parquet table of ``(image_id, blob)`` as ``(image_id, features)``."""
    return decode_vectors(spark.read.parquet(path), encoding, blob, "features")
