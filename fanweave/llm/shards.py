"""Binary shard files written and read by Spark's own file sources.

A task returns each finished shard as one row; the text writer puts every row into a
file of its own and ends it with ``closing``. So shards go through Spark's committed
writes, to any file system Spark can write, and a task that runs again leaves no
second copy. Shards are bounded in size by their makers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_shards(shards: DataFrame, column: str, path: str, closing: bytes) -> None:
    """Write each value of a binary column as one file that ends with ``closing``."""
    (
        shards.select(F.col(column).cast("string").alias("value"))
        .write.option("maxRecordsPerFile", 1)
        .option("encoding", "ISO-8859-1")
        .option("lineSep", closing.decode("latin-1"))
        .text(path)
    )


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """``(path, content)`` of every non-empty shard."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    return files.filter("length > 0").select("path", "content")
