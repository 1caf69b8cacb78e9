import os

import pytest
from pyspark.sql import functions as F

from fanweave.operators.rows import (
    chunk,
    global_id,
    limit_rows,
    split_label,
    with_file_row_id,
    with_row_id,
)
from fanweave.session import new_path, shared_dir, stage
from fanweave.sinks import (
    compact_upserts,
    latest_predictions,
    pending,
    read_upserts,
    upsert_predictions,
    write_predictions,
)
from fanweave.sources import scan_features, scan_labels, scan_predictions


def test_row_ids_follow_the_order(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"))
    got = {r.k: r.row_id for r in with_row_id(df, ["k"]).collect()}
    assert got == {k: k for k in range(1000)}


def test_row_ids_with_a_hot_key_are_complete(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("k"))
    rows = with_row_id(df, ["k"]).orderBy("row_id").collect()
    assert [r.row_id for r in rows] == list(range(3000))
    keys = [r.k for r in rows]
    assert keys == sorted(keys)


def test_file_row_ids_follow_path_and_line_order(spark, tmp_path):
    for part in range(3):
        lines = ["n"] + [str(part * 500 + i) for i in range(500)]
        (tmp_path / f"part-{part}.csv").write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        scan = spark.read.schema("n INT").csv(str(tmp_path), header=True)
        assert scan.rdd.getNumPartitions() > 3
        got = with_file_row_id(scan).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == 1500 and all(r.row_id == r.n for r in got)


def test_scan_features_takes_the_last_column_as_label(spark, tmp_path):
    path = tmp_path / "wide.csv"
    path.write_text("a,b,label\n1,2.5,7\n-3,1e-7,0\n")
    rows = sorted(scan_features(spark, str(path)).collect())
    assert [tuple(r) for r in rows] == [(0, [1.0, 2.5], 7), (1, [-3.0, 1e-7], 0)]
    by_name = sorted(scan_features(spark, str(path), label_col="a").collect())
    assert [(r.features, r.label) for r in by_name] == [([2.5, 7.0], 1), ([1e-7, 0.0], -3)]


def test_chunks_of_five_rows_and_of_one(spark):
    df = spark.range(5).withColumnRenamed("id", "row_id")
    rows = chunk(df, 2).withColumn("back", global_id(F.col("chunk_id"), F.col("pos"), 2)).collect()
    assert sorted((r.row_id, r.chunk_id, r.pos, r.back) for r in rows) == [
        (0, 0, 0, 0), (1, 0, 1, 1), (2, 1, 0, 2), (3, 1, 1, 3), (4, 2, 0, 4),
    ]
    single = chunk(df.limit(1), 10).first()
    assert (single.chunk_id, single.pos) == (0, 0)


def test_split_label_and_limit(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 9.0]), (0, [3.0, 4.0, 8.0])],
                               "image_id BIGINT, row ARRAY<DOUBLE>")
    first = limit_rows(split_label(df), 1).first()
    assert (first.image_id, first.features, first.label) == (0, [3.0, 4.0], 8)


def test_prediction_files_are_short_and_have_headers(spark):
    folder = new_path(spark, "test-predictions")
    df = spark.range(1201).select(
        F.col("id").alias("image_id"), (F.col("id") % 10).cast("int").alias("prediction")
    )
    write_predictions(df.coalesce(1), folder)
    files = [f for f in os.listdir(folder) if f.endswith(".csv")]
    assert len(files) == 3
    for name in files:
        lines = open(f"{folder}/{name}").read().splitlines()
        assert lines[0] == "image_id,prediction" and len(lines) <= 501
    assert scan_predictions(spark, folder).exceptAll(df).count() == 0
    assert scan_predictions(spark, folder).count() == 1201


def test_prediction_scan_skips_other_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("image_id,prediction\n1,2\n")
    (tmp_path / "b.txt").write_text("image_id,prediction\n3,4\n")
    assert [tuple(r) for r in scan_predictions(spark, str(tmp_path)).collect()] == [(1, 2)]


def test_scan_labels(spark, tmp_path):
    (tmp_path / "labels.csv").write_text("image_id,label\n0,7\n1,3\n")
    rows = scan_labels(spark, str(tmp_path / "labels.csv")).collect()
    assert sorted(map(tuple, rows)) == [(0, 7), (1, 3)]


def test_upserts_survive_a_replay(spark):
    path = new_path(spark, "test-upserts")
    one = spark.createDataFrame([(1, 5, 0), (1, 6, 1), (2, 7, 0)],
                                "image_id BIGINT, prediction INT, seq INT")
    two = spark.createDataFrame([(2, 8, 0)], one.schema)
    for batch, batch_id in ((one, 0), (two, 1), (two, 1), (one, 0)):
        upsert_predictions(batch, batch_id, path, seq="seq")
    assert sorted(map(tuple, read_upserts(spark, path).collect())) == [(1, 6), (2, 8)]
    short = new_path(spark, "test-upserts")
    compact_upserts(spark, path, short)
    assert spark.read.parquet(short).count() == 2
    assert sorted(map(tuple, read_upserts(spark, short).collect())) == [(1, 6), (2, 8)]


def test_the_last_write_of_a_batch_counts(spark):
    path = new_path(spark, "test-upserts")
    batch = spark.createDataFrame([(1, 9, 0), (1, 3, 1)], "image_id BIGINT, prediction INT, seq INT")
    upsert_predictions(batch, 0, path, "seq")
    assert [tuple(r) for r in read_upserts(spark, path).collect()] == [(1, 3)]


def test_a_scan_moves_no_rows(spark, tmp_path):
    path = tmp_path / "wide.csv"
    path.write_text("a,b,label\n" + "1,2,3\n" * 50)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = scan_features(spark, str(path))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    assert "SortMergeJoin" not in plan


def test_a_million_blocks_move_no_rows(spark):
    """The same plan for any number of blocks, and starts that are right for all of them."""
    from fanweave.operators.rows import _attach_starts, _block_starts

    block = ["_file", "_block"]
    counts = spark.range(1_000_000).select(
        F.concat(F.lit("file "), F.lpad((F.col("id") / 100).cast("int").cast("string"), 6, "0")).alias("_file"),
        (F.col("id") % 100).alias("_block"), (F.col("id") % 7).alias("count"),
        F.lit(0).cast("bigint").alias("_first"))
    starts = stage(_block_starts(counts, block), "starts")
    number = F.substring("_file", 6, 6).cast("bigint") * 100 + F.col("_block")
    whole, rest = F.call_function("div", number, F.lit(7)), number % 7
    wrong = starts.filter(F.col("_start") != whole * 21 + F.call_function("div", rest * (rest - 1), F.lit(2)))
    assert starts.count() == 1_000_000 and wrong.isEmpty()
    rows = spark.range(5).select(F.lit("file 000001").alias("_file"), F.col("id").alias("_block"))
    plan = _attach_starts(rows, starts, block)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "SortMerge" not in plan


def test_first_rows_are_found_on_the_id_alone(spark):
    rows = [(k % 40, [float(k)]) for k in range(200)]
    df = spark.createDataFrame(rows, "image_id BIGINT, features ARRAY<DOUBLE>").repartition(3)
    assert [r.image_id for r in limit_rows(df, 7).collect()] == [0] * 5 + [1] * 2
    assert limit_rows(df, 500).count() == 200 and limit_rows(df.limit(0), 5).count() == 0


def test_latest_and_pending(spark):
    df = spark.createDataFrame([(1, 4, 1), (1, 3, 2), (2, 9, 1)],
                               "image_id BIGINT, prediction INT, seq INT")
    assert sorted(map(tuple, latest_predictions(df).collect())) == [(1, 3), (2, 9)]
    finished = spark.createDataFrame([(1,), (1,)], "image_id BIGINT")
    assert [r.image_id for r in pending(df, finished).collect()] == [2]


def test_shared_folder_is_the_named_one(spark):
    assert new_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_stage_returns_the_written_rows(spark):
    assert stage(spark.range(10), "test").agg(F.sum("id")).first()[0] == 45


def test_wrong_number_in_features_fails(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("a,label\nx,1\n")
    with pytest.raises(Exception):
        scan_features(spark, str(path)).collect()
