"""Grouped arrivals and renewed expiry, with ids that fill several partitions."""

import json
import os
import random

import models
import numpy as np
import pytest
from pyspark.sql import functions as F

from fanweave.operators.fanin import fan_in
from fanweave.operators.rounds import group_effect, grouped_cycles, with_rounds
from fanweave.session import new_path
from fanweave.streaming.fanin import fan_in_stream
from fanweave.streaming.io import drain, read_messages, start

N = 4


@pytest.fixture(autouse=True)
def many_parts(spark):
    """Small inputs stay cut into parts, which adaptive execution would put together."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


SCHEMA = "id BIGINT, slot INT, value DOUBLE, seq BIGINT, grp INT"


def messages(seed, rows=900, groups=60):
    """Two thirds of the rows belong to one id; times have gaps."""
    rng, out, seq = random.Random(seed), [], 0
    for k in range(rows):
        seq += rng.choice([1, 1, 1, 2, 9, 30])
        out.append((7 if k % 3 else rng.randrange(5), rng.randrange(-1, N + 1), float(k), seq,
                    k * groups // rows))
    return out


def got(df, *names):
    return {(*(r[c] for c in names), tuple(r.vector)) for r in df.collect()}


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("fill", [None, 0.0])
def test_grouped_arrivals(spark, seed, fill):
    rows = messages(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    done = fan_in(df, "id", "slot", "value", "seq", N, "last", "batch_arrivals", fill, group="grp")
    want = models.batch_arrivals(rows, N, fill)
    assert got(done, "id", "cycle", "completed_seq") == want and len(want) > 40


def test_grouped_arrivals_as_on_a_stream(spark, tmp_path):
    rows = messages(8, 300, 12)
    for group in range(12):
        path = os.path.join(tmp_path, f"{group:02}.json")
        with open(path, "w") as out:
            out.writelines(json.dumps(dict(zip(("id", "slot", "value", "seq"), r))) + "\n"
                           for r in rows if r[4] == group)
        os.utime(path, (1_700_000_000 + group, 1_700_000_000 + group))
    src = read_messages(spark, path=str(tmp_path), rate=1,
                        schema="id BIGINT, slot INT, value DOUBLE, seq BIGINT")
    out = fan_in_stream(src, "id", "slot", "value", "seq", N, "last", "batch_arrivals")
    path = new_path(spark, "grouped")
    drain(start(out, f"{path}-checkpoint", path=f"{path}-out"))
    streamed = spark.read.schema(out.schema).parquet(f"{path}-out")
    df = spark.createDataFrame(rows, SCHEMA)
    batch = fan_in(df, "id", "slot", "value", "seq", N, "last", "batch_arrivals", group="grp")
    names = ("id", "cycle", "completed_seq")
    assert got(streamed, *names) == got(batch, *names)


@pytest.mark.parametrize("n", [1, 3, 7])
def test_effects_compose(n):
    rng = np.random.default_rng(n)
    for _ in range(60):
        sizes = rng.integers(1, 2 * n, rng.integers(1, 12))
        left, full = group_effect(sizes, n)
        for held in range(n):
            count, cycles = held, 0
            for size in sizes:
                count += size
                if count >= n:
                    count, cycles = 0, cycles + 1
            assert (left[held], full[held]) == (count, cycles)
        cut = len(sizes) // 2
        if cut:
            first, second = group_effect(sizes[:cut], n), group_effect(sizes[cut:], n)
            assert (second[0][first[0]] == left).all()
            assert (first[1] + second[1][first[0]] == full).all()


def test_a_hot_id_is_cut_into_parts(spark):
    """One id has nearly all groups; every part has about as many of them."""
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 50 == 0, F.col("id")).otherwise(-1).alias("_id"),
        F.col("id").alias("_group"))
    parts = grouped_cycles(rows, N).withColumn("part", F.spark_partition_id())
    sizes = [r["count"] for r in parts.groupBy("part").count().collect()]
    assert len(sizes) > 2 and max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("cycles", ["first", "all"])
@pytest.mark.parametrize("dup", ["first", "last"])
def test_rounds(spark, seed, cycles, dup):
    rows = [r[:4] for r in messages(seed) if 0 <= r[1] < N]
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA).repartition(3)
    done = fan_in(df, "id", "slot", "value", "seq", N, dup, cycles=cycles, ttl=20, renew=True)
    want = {(*key, *rest) for key, *rest in models.distinct(models.rounds(rows, 20), N, dup, cycles)}
    assert got(done, "id", "round", "cycle", "completed_seq") == want
    assert len({w[1] for w in want}) > 5


def test_rounds_with_arrival_counts(spark):
    rows = [r[:4] for r in messages(5)]
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    done = fan_in(df, "id", "slot", "value", "seq", N, "last", "arrivals", ttl=20, renew=True)
    want = {(*key, *rest) for key, *rest in models.arrivals(models.rounds(rows, 20), N)}
    assert got(done, "id", "round", "cycle", "completed_seq") == want


def test_text_ids_empty_input_and_wrong_options(spark):
    rows = spark.createDataFrame(
        [("a", 1), ("a", 2), ("a", 30), ("b", 5), ("b", 99), ("c", 1)], "id STRING, t BIGINT")
    found = {(r.id, r.t, r._round) for r in with_rounds(rows, "id", "t", ["t"], 10).collect()}
    assert found == {("a", 1, 0), ("a", 2, 0), ("a", 30, 1), ("b", 5, 0), ("b", 99, 1), ("c", 1, 0)}
    none = spark.createDataFrame([], SCHEMA)
    args = (none, "id", "slot", "value", "seq", N)
    assert fan_in(*args, ttl=5, renew=True).count() == 0
    assert fan_in(*args, "last", "batch_arrivals", group="grp").count() == 0
    for wrong in ({"renew": True}, {"group": "grp"}, {"complete": "batch_arrivals", "dup": "last"},
                  {"complete": "batch_arrivals", "group": "grp"}):
        with pytest.raises(ValueError):
            fan_in(*args, **wrong)
