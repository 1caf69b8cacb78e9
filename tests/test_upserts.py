"""The bucketed upsert table against a dictionary."""

import random

import pytest

from fanweave.session import new_path
from fanweave.sinks.upserts import UpsertTable, create_upserts

SCHEMA = "image_id BIGINT, prediction INT, seq BIGINT"


def current(spark, table):
    rows = [tuple(r) for r in table.read(spark).collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


def test_batches_replays_and_compaction(spark):
    rng = random.Random(5)
    table = create_upserts(spark, new_path(spark, "upsert-table"), buckets=8)
    assert current(spark, table) == {}
    batches = [[(rng.randrange(40) if k % 3 else 7, rng.randrange(10), k) for k in range(60)]
               for _ in range(4)]
    want = {}
    for number, rows in enumerate(batches):
        table.upsert(spark.createDataFrame(rows, SCHEMA), number, "seq")
        want.update({i: p for i, p, _ in rows})
        if number == 2:
            table.upsert(spark.createDataFrame(rows, SCHEMA), number, "seq")
            assert current(spark, table) == want
            assert table.compact(spark)
    assert current(spark, table) == want
    # a batch that was compacted comes again and still loses to later ones
    table.upsert(spark.createDataFrame(batches[1], SCHEMA), 1, "seq")
    assert current(spark, table) == want
    assert table.compact(spark)
    assert table.compact(spark) == []
    assert current(spark, table) == want
    assert dict(map(tuple, table.read(spark, [7, 3, 99]).collect())) == {
        k: v for k, v in want.items() if k in (7, 3)}


def test_a_batch_touches_only_its_buckets(spark):
    table = create_upserts(spark, new_path(spark, "upsert-table"), buckets=16)
    assert table.upsert(spark.range(500).selectExpr(
        "id AS image_id", "1 AS prediction", "id AS seq"), 0, "seq") == list(range(16))
    one = spark.createDataFrame([(3, 9, 0), (3, 8, 1), (None, 5, 2)], SCHEMA)
    touched = table.upsert(one, 1, "seq")
    assert len(touched) == 1
    assert table.compact(spark) == touched
    # merged buckets are read as they are
    plan = table.read(spark)._jdf.queryExecution().optimizedPlan().toString()
    assert current(spark, table)[3] == 8
    files = table.read(spark).inputFiles()
    assert len(files) == 16 and sum("commit-3" in f for f in files) == 1
    assert plan.count("Aggregate") <= 1  # of the empty side only
    found = table.read(spark, [3])
    assert found.collect() == [(3, 8)] and len(found.inputFiles()) == 1


def test_a_failed_commit_does_not_count(spark):
    table = create_upserts(spark, new_path(spark, "upsert-table"), buckets=2)
    one = spark.createDataFrame([(1, 1, 0), (2, 2, 0)], SCHEMA)
    table.upsert(one, 0, "seq")
    publish, table._publish = table._publish, lambda *a: 1 / 0
    with pytest.raises(ZeroDivisionError):
        table.upsert(spark.createDataFrame([(1, 5, 0)], SCHEMA), 1, "seq")
    table._publish = publish
    assert current(spark, table) == {1: 1, 2: 2}
    table.upsert(spark.createDataFrame([(1, 6, 0)], SCHEMA), 1, "seq")
    assert current(spark, UpsertTable(table.path)) == {1: 6, 2: 2}
    table.upsert(one.limit(0), 2, "seq")
    assert current(spark, table) == {1: 6, 2: 2}
    with pytest.raises(Exception, match="(?i)exists"):
        create_upserts(spark, table.path)
    with pytest.raises(ValueError):
        create_upserts(spark, new_path(spark, "upsert-table"), buckets=0)
