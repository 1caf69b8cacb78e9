"""Fan-in by micro-batches as tables: equal to the batch rules, with an id that has most rows."""

import random

import models
import pytest
from pyspark.sql import functions as F

from fanweave.operators.skew import hot_keys
from fanweave.session import new_path
from fanweave.streaming.batches import fan_in_batches, read_fan_in

N = 3
SCHEMA = "id BIGINT, slot INT, value DOUBLE, seq BIGINT"


def messages(seed, rows, slots=(0, N)):
    """Four fifths belong to one id."""
    rng = random.Random(seed)
    return [(7 if k % 5 else rng.randrange(4), rng.randrange(*slots), float(k), k + 1)
            for k in range(rows)]


def run(spark, rows, batches, **options):
    path = new_path(spark, "batches-test")
    write = fan_in_batches(
        f"{path}-out", f"{path}-state", "id", "slot", "value", "seq", N, **options)
    size = -(-len(rows) // batches)
    for k in range(batches):
        part = spark.createDataFrame(rows[k * size: (k + 1) * size], SCHEMA)
        write(part, k)
        if k == 1:  # a replay leaves the same results and state
            write(part, k)
    got = read_fan_in(spark, f"{path}-out", "id", "BIGINT").collect()
    assert len(got) == len({(r.id, r.completed_seq) for r in got})
    return {(r.id, r.cycle, r.completed_seq, tuple(r.vector)) for r in got}


@pytest.mark.parametrize("dup", ["first", "last"])
def test_distinct_cycles_go_on_across_batches(spark, dup):
    rows = messages(1, 160) + [(None, 0, 1.0, 900), (7, 5, 1.0, 901), (7, None, 1.0, 902)]
    known = [r for r in rows if r[0] is not None and r[1] is not None]
    assert run(spark, rows, 3, dup=dup) == models.distinct(known, N, dup)


@pytest.mark.parametrize("fill", [None, 0.5])
def test_arrivals_go_on_across_batches(spark, fill):
    rows = messages(2, 160, (-1, N + 1))
    assert run(spark, rows, 3, dup="last", complete="arrivals", fill=fill) == models.arrivals(
        rows, N, fill)


def test_forgotten_ids_start_again(spark):
    rows = [(1, k, float(k), k) for k in range(N)]
    rows += [(1, k, float(k), 10 + k) for k in range(N)]
    got = run(spark, rows, 2, forget=True)
    assert {(r[0], r[1], r[2]) for r in got} == {(1, 0, 2), (1, 0, 12)}


def test_wrong_options():
    for wrong in ({"complete": "arrivals"}, {"dup": "any"}, {"complete": "batch_arrivals"}):
        with pytest.raises(ValueError):
            fan_in_batches("o", "s", "id", "slot", "value", "seq", N, **wrong)


def test_a_hot_id_is_cut_into_ranges_of_arrivals(spark):
    """No task of the rank computation has more than twice the median of rows."""
    from fanweave.operators.fanin import _rank_spread

    rows = spark.range(20_000).select(
        F.when(F.col("id") % 5 == 0, F.col("id")).otherwise(-1).alias("_id"),
        F.lit(0).alias("_slot"), F.lit(1.0).alias("_value"), F.lit(1).alias("_age"),
        F.col("id").alias("_seq"))
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        hot = _rank_spread(rows.filter("_id = -1"), ["_age", "_seq"])
        assert hot.agg(F.min("_rank"), F.max("_rank"), F.countDistinct("_rank")).first()[:] == (
            0, 15_999, 16_000)
        parts = rows.repartitionByRange("_id", "_age", "_seq").groupBy(F.spark_partition_id()).count()
        sizes = sorted(r["count"] for r in parts.collect())
        assert len(sizes) > 2 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    finally:
        spark.conf.unset(name)


def test_an_id_that_would_fill_a_task_is_hot(spark):
    """An id of a million messages is no single sort of one task; one of a thousand is."""
    rows = spark.range(1_001_000).select(F.when(F.col("id") < 1_000, 1).otherwise(-1).alias("_id"))
    found = hot_keys(rows, "_id")
    assert found is not None and [r["_id"] for r in found.collect()] == [-1]
