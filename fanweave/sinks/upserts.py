"""An upsert table in buckets of ids, with a manifest.

A batch of predictions is written once, into the buckets of its ids, and never changed. The manifest lists,
for every bucket, the commits that hold its rows; each commit writes the whole list anew as one
file, so it counts entirely or not at all, and readers keep the list they began with. Compaction
rewrites only buckets that have several commits. A bucket with one commit is read as it is,
without a shuffle, and an id is looked up in its bucket alone.

The manifest has a row per bucket and commit: that is what the driver sees. Data that no
manifest lists any more is not removed; give the folder a retention rule. One writer at a
time: two commits of one number collide, and the second fails.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fanweave.sinks.predictions import latest_predictions

#: ``batch_id`` is null for a compacted bucket; the row of bucket -1 has the number of buckets
MANIFEST = "bucket INT, folder STRING, batch_id BIGINT, buckets INT, number BIGINT"
ROWS = "image_id BIGINT, prediction INT, batch_id BIGINT, bucket INT"


def create_upserts(spark: SparkSession, path: str, buckets: int = 64) -> UpsertTable:
    """A new, empty table; an error if there is one."""
    if buckets < 1:
        raise ValueError("a table has one bucket at least")
    table = UpsertTable(path)
    table._publish(spark, [], buckets, 0)
    return table


class UpsertTable:
    """The table below ``path``, made by :func:`create_upserts`."""

    def __init__(self, path: str) -> None:
        self.path = path

    def upsert(self, batch: DataFrame, batch_id: int, seq: str) -> list[int]:
        """Commit one batch and return the buckets it touched.

        Of several predictions of an id the last by ``seq`` counts, and those of a higher
        ``batch_id`` come later, in whatever order batches are committed. A batch that is
        replayed takes the place of its first commit. Rows without id are left out.
        """
        spark = batch.sparkSession
        entries, buckets, number = self._manifest(spark)
        merged = latest_predictions(batch.filter("image_id is not null"), "image_id", seq)
        rows = merged.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        folder = f"commit-{number + 1}"
        touched = self._write(rows.withColumn("bucket", _bucket(F.col("image_id"), buckets)), folder)
        kept = [e for e in entries if e[2] != batch_id]
        new = [(bucket, folder, batch_id) for bucket in touched]
        self._publish(spark, kept + new, buckets, number + 1)
        return touched

    def each_batch(self, seq: str) -> Callable[[DataFrame, int], None]:
        """A batch function for a stream."""
        return lambda batch, batch_id: self.upsert(batch, batch_id, seq) and None

    def read(self, spark: SparkSession, ids: list[int] | None = None) -> DataFrame:
        """``(image_id, prediction)`` of all ids, or of the given ones from their buckets."""
        entries, buckets, _ = self._manifest(spark)
        if ids is not None:
            places = spark.createDataFrame([(i,) for i in ids], "id BIGINT").select(
                _bucket(F.col("id"), buckets))
            wanted = {r[0] for r in places.collect()}
            entries = [e for e in entries if e[0] in wanted]
        found = self._current(spark, entries)
        return found.filter(F.col("image_id").isin(ids)) if ids is not None else found

    def compact(self, spark: SparkSession, commits: int = 1) -> list[int]:
        """Rewrite the buckets with more than ``commits`` commits, and return them."""
        entries, buckets, number = self._manifest(spark)
        many = {b for b, n in _per_bucket(entries).items() if len(n) > commits}
        if not many:
            return []
        last = F.max(F.struct("batch_id", "prediction")).alias("last")
        rows = self._scan(spark, [e for e in entries if e[0] in many]).groupBy(
            "bucket", "image_id").agg(last)
        folder = f"commit-{number + 1}"
        # a row keeps its batch, so that an earlier batch that comes late still loses
        touched = self._write(
            rows.select("image_id", "last.prediction", "last.batch_id", "bucket"), folder)
        kept = [e for e in entries if e[0] not in many]
        self._publish(spark, kept + [(b, folder, None) for b in touched], buckets, number + 1)
        return touched

    def _current(self, spark: SparkSession, entries: list[tuple]) -> DataFrame:
        held = _per_bucket(entries)
        once = [e for e in entries if len(held[e[0]]) == 1]
        several = [e for e in entries if len(held[e[0]]) > 1]
        merged = latest_predictions(self._scan(spark, several), "image_id", "batch_id")
        return self._scan(spark, once).select("image_id", "prediction").unionByName(merged)

    def _scan(self, spark: SparkSession, entries: list[tuple]) -> DataFrame:
        if not entries:
            return spark.createDataFrame([], ROWS)
        places = [f"{self.path}/data/{folder}/bucket={bucket}" for bucket, folder, _ in entries]
        # the folder names the bucket; files are read without looking for partitions again
        name = F.regexp_extract(F.col("_metadata.file_path"), r"bucket=(\d+)/[^/]*$", 1)
        rows = spark.read.schema("image_id BIGINT, prediction INT, batch_id BIGINT").option(
            "recursiveFileLookup", True).parquet(*places)
        return rows.select("*", name.cast("int").alias("bucket"))

    def _write(self, rows: DataFrame, folder: str) -> list[int]:
        """One file a bucket. What an attempt that failed left there is overwritten."""
        path = f"{self.path}/data/{folder}"
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        written = rows.sparkSession.read.schema(ROWS).parquet(path)
        return sorted(r[0] for r in written.select("bucket").distinct().collect())

    def _manifest(self, spark: SparkSession) -> tuple[list[tuple], int, int]:
        """Entries, the number of buckets, and the number of the latest commit."""
        lists = spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/*")
        number = lists.agg(F.max("number")).first()[0]
        rows = lists.filter(F.col("number") == number).collect()
        buckets = next(r.buckets for r in rows if r.bucket < 0)
        return [(r.bucket, r.folder, r.batch_id) for r in rows if r.bucket >= 0], buckets, number

    def _publish(self, spark: SparkSession, entries: list[tuple], buckets: int, number: int) -> None:
        rows = [(-1, None, None, buckets, number), *((*e, buckets, number) for e in entries)]
        spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(
            f"{self.path}/manifest/{number}")


def _bucket(id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(id.cast("bigint")), F.lit(buckets)).cast("int")


def _per_bucket(entries: list[tuple]) -> dict[int, list[str]]:
    held = defaultdict(list)
    for bucket, folder, _ in entries:
        held[bucket].append(folder)
    return held
