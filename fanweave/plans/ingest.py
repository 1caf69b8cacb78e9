"""Scans, row ids, chunks, vectors and blobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fanweave.functions import affine, decode_vectors, encode_vectors, number_text
from fanweave.operators.rows import chunk, global_id, limit_rows, split_label, with_row_id
from fanweave.plans import query
from fanweave.plans.tables import CELLS_SQL, exploded, images, table
from fanweave.session import new_path
from fanweave.sources import scan_features, scan_labels, scan_vector_blobs

CHUNK = 50

ROW_IDS_SQL = f"""{CELLS_SQL},
ids AS (SELECT vec_id AS image_id, row_number() OVER (ORDER BY vec_id) - 1 AS row_id, label
        FROM embeddings)"""


def _double_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("image_id"), F.col("embedding").cast("array<double>").alias(
            "features"), "label",
    )


RAW_CELLS_SQL = """
raw AS (
  SELECT vec_id AS image_id, CAST(label AS INTEGER) AS label,
         CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS slot,
         CAST(unnest(embedding) AS DOUBLE) AS value
  FROM embeddings
)"""


@query(
    "scan_features",
    f"""WITH {RAW_CELLS_SQL},
    ids AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS row_id FROM embeddings)
    SELECT CAST(row_id AS BIGINT) AS image_id, label, slot, value
    FROM raw JOIN ids ON raw.image_id = ids.vec_id""",
)
def q_scan_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the vectors as a wide CSV in id order, then scan it; ids are file positions."""
    vectors = _double_vectors(spark, sf_dir)
    width = vectors.agg(F.max(F.size("features")).alias("w")).first()["w"]
    path = new_path(spark, "wide-csv")
    pixels = [F.col("features")[i].alias(f"pixel_{i}") for i in range(width)]
    vectors.orderBy("image_id").select(*pixels, "label").write.csv(path, header=True)
    return exploded(scan_features(spark, path), "image_id", "label")


@query("scan_labels", "SELECT vec_id AS image_id, CAST(label AS INTEGER) AS label FROM embeddings")
def q_scan_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "labels")
    table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("image_id"), "label"
    ).write.csv(path, header=True)
    return scan_labels(spark, path)


@query("scan_vector_blobs", f"WITH {RAW_CELLS_SQL} SELECT image_id, slot, value FROM raw")
def q_scan_vector_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "blobs")
    encode_vectors(_double_vectors(spark, sf_dir)).write.parquet(path)
    return exploded(scan_vector_blobs(spark, path), "image_id")


@query(
    "row_id",
    "SELECT vec_id AS image_id, CAST(row_number() OVER (ORDER BY vec_id) - 1 AS BIGINT) AS row_id "
    "FROM embeddings",
)
def q_row_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"))
    return with_row_id(ids, ["image_id"])


@query(
    "event_row_id",
    "SELECT event_id, CAST(row_number() OVER (ORDER BY user_id, ts, event_id) - 1 AS BIGINT) "
    "AS row_id FROM events",
)
def q_event_row_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return with_row_id(events, ["user_id", "ts", "event_id"]).select("event_id", "row_id")


@query(
    "head_rows",
    f"""WITH {RAW_CELLS_SQL} SELECT image_id, slot, value FROM raw
    WHERE image_id IN (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 100)""",
)
def q_head_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(limit_rows(_double_vectors(spark, sf_dir), 100), "image_id")


@query("split_label", f"WITH {RAW_CELLS_SQL} SELECT image_id, label, slot, value FROM raw")
def q_split_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = F.concat("features", F.array(F.col("label").cast("double")))
    rows = _double_vectors(spark, sf_dir).select("image_id", labelled.alias("row"))
    return exploded(split_label(rows), "image_id", "label")


@query("normalize", f"WITH {CELLS_SQL} SELECT image_id, slot, (x - 0.5::DOUBLE) / 0.5::DOUBLE AS value FROM cells")
def q_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = images(spark, sf_dir).withColumn("features", affine(F.col("features")))
    return exploded(scaled, "image_id")


@query(
    "chunk_rows",
    f"""WITH {ROW_IDS_SQL} SELECT image_id, CAST(row_id AS BIGINT) AS row_id,
    CAST(row_id // {CHUNK} AS BIGINT) AS chunk_id, CAST(row_id % {CHUNK} AS INTEGER) AS pos
    FROM ids""",
)
def q_chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk(q_row_id(spark, sf_dir), CHUNK)


@query(
    "chunk_roundtrip",
    f"WITH {ROW_IDS_SQL} SELECT image_id, CAST(row_id AS BIGINT) AS global_id FROM ids",
)
def q_chunk_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = global_id(F.col("chunk_id"), F.col("pos"), CHUNK)
    return q_chunk_rows(spark, sf_dir).select("image_id", back.alias("global_id"))


@query(
    "vector_blob_roundtrip",
    f"""WITH {RAW_CELLS_SQL}
    SELECT encoding, image_id, slot, value
    FROM raw, (VALUES ('raw'), ('hex'), ('base64')) AS e(encoding)""",
)
def q_vector_blob_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _double_vectors(spark, sf_dir)
    result = None
    for encoding in ("raw", "hex", "base64"):
        back = decode_vectors(encode_vectors(vectors, encoding), encoding)
        rows = exploded(
            back.withColumn("encoding", F.lit(encoding)), "encoding", "image_id"
        )
        result = rows if result is None else result.unionByName(rows)
    return result


@query("format_roundtrip", "SELECT event_id, value FROM events")
def q_format_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = number_text(F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", text.cast("double").alias("value"))
