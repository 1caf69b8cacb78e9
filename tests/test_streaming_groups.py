"""Groups by count or time across micro-batches."""

import os

import pytest
from pyspark.sql import functions as F
from test_streaming import put

from fanweave.session import new_path
from fanweave.streaming.groups import RowGroups, with_ticks
from fanweave.streaming.io import drain, read_messages, start

SCHEMA = "image_id BIGINT, prediction INT"


def groups_of(spark, path, size, **options):
    return RowGroups(f"{path}-out", f"{path}-state", size, ["image_id"], **options)


def sizes(spark, groups):
    rows = groups.read(spark, SCHEMA).groupBy("group").agg(
        F.count(F.lit(1)).alias("n"), F.min("image_id").alias("low"), F.max("image_id").alias("high"))
    return [tuple(r) for r in rows.orderBy("group").collect()]


def part(spark, begin, end):
    return spark.range(begin, end).select(
        F.col("id").alias("image_id"), (F.col("id") % 10).cast("int").alias("prediction"))


def test_seven_batches_fill_files_of_500(spark):
    path = new_path(spark, "groups")
    write = groups_of(spark, path, 500, format="csv", options={"header": "true"})
    bounds = [0, 100, 100, 450, 1020, 1021, 1199, 1200]
    for n in range(7):
        write(part(spark, *bounds[n:n + 2]), n)
        if n in (2, 3):  # a replay leaves the same files and state
            write(part(spark, *bounds[n:n + 2]), n)
    assert sizes(spark, write) == [(0, 500, 0, 499), (1, 500, 500, 999)]
    assert write.close(spark, SCHEMA) == 200
    assert write.close(spark, SCHEMA) == 0
    assert sizes(spark, write)[2] == (2, 200, 1000, 1199)
    files = [f"{at}/{f}" for at, _, names in os.walk(f"{path}-out") for f in names if f.endswith(".csv")]
    assert len(files) == 3
    for name in files:
        ids = [int(x.split(",")[0]) for x in open(name).read().splitlines()[1:]]
        assert ids == list(range(ids[0], ids[0] + len(ids)))
    write(part(spark, 1200, 1210), 7)  # goes on after the end with the next group
    assert write.close(spark, SCHEMA) == 10
    assert sizes(spark, write)[3] == (3, 10, 1200, 1209)


def test_time_closes_a_short_group(spark):
    path = new_path(spark, "groups")
    times = iter([0.0, 100.0, 179.0, 181.0, 200.0, 362.0])
    write = groups_of(spark, path, 500, wait_s=180, clock=lambda: next(times))
    write(part(spark, 0, 20), 0)
    write(part(spark, 20, 30), 1)
    write(part(spark, 30, 30), 2)  # 179 s: still open
    assert sizes(spark, write) == []
    write(part(spark, 30, 40), 3)  # its rows open the next group
    assert sizes(spark, write) == [(0, 30, 0, 29)]
    write(part(spark, 40, 600), 4)  # full after 19 s; the rest waits from now on
    assert sizes(spark, write)[1] == (1, 500, 30, 529)
    write(part(spark, 0, 0), 5)  # 162 s
    assert len(sizes(spark, write)) == 2


def test_ticks_close_a_group_without_further_rows(spark, tmp_path):
    put(tmp_path, 0, [(n, 1) for n in range(12)], ("image_id", "prediction"))
    src = read_messages(spark, path=str(tmp_path), schema=SCHEMA)
    path = new_path(spark, "groups")
    write = groups_of(spark, path, 10, wait_s=1)
    drain(start(with_ticks(src), f"{path}-c", each_batch=write, trigger="500 milliseconds"), timeout=12)
    assert [r[1] for r in sizes(spark, write)] == [10, 2]


def test_restart_goes_on_in_the_middle_of_a_group(spark, tmp_path):
    path = new_path(spark, "groups")
    for n in range(3):
        put(tmp_path, n, [(k, 1) for k in range(n * 70, n * 70 + 70)], ("image_id", "prediction"))
        src = read_messages(spark, path=str(tmp_path), schema=SCHEMA, rate=1)
        write = groups_of(spark, path, 50)
        drain(start(src, f"{path}-c", each_batch=write))
    assert write.close(spark, src.schema) == 10
    assert sizes(spark, write) == [
        (n, 50 if n < 4 else 10, n * 50, min(n * 50 + 49, 209)) for n in range(5)]


def test_repeated_and_null_rows(spark):
    path = new_path(spark, "groups")
    write = groups_of(spark, path, 3)
    rows = spark.createDataFrame([(None, 1), (1, 2), (1, 2), (None, None)], SCHEMA)
    write(rows, 0)
    write(rows, 1)
    assert write.close(spark, SCHEMA) == 2
    assert sorted(r[1] for r in sizes(spark, write)) == [2, 3, 3]
    with pytest.raises(ValueError):
        groups_of(spark, path, 0)
