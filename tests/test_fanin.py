import random

import models
import pytest
from pyspark.sql import functions as F

from fanweave.operators import fanin as fanin_module
from fanweave.operators.fanin import (
    arrival_seq,
    completed_ids,
    completeness,
    fan_in,
    misplaced,
    oversized_reports,
    stack_columns,
    strict_check,
    within_ttl,
)
from fanweave.operators.skew import attach_per_key, hot_keys

SCHEMA = "id BIGINT, slot INT, value DOUBLE, seq BIGINT"


def random_messages(seed, n, rows=600, outside=False):
    """A third of all rows on one id; repeats, gaps and shuffled order."""
    rng = random.Random(seed)
    out = []
    for seq in range(rows):
        id = 7 if seq % 3 == 0 else rng.randrange(20)
        slot = rng.randrange(-1, n + 1) if outside else rng.randrange(n)
        out.append((id, slot, round(rng.uniform(-9, 9), 3), seq))
    rng.shuffle(out)
    return out


def run(spark, messages, n, **options):
    df = spark.createDataFrame(messages, SCHEMA).repartition(5)
    rows = fan_in(df, "id", "slot", "value", "seq", n, **options).collect()
    got = {(r.id, r.cycle, r.completed_seq, tuple(r.vector)) for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("n", [1, 3, 20])
@pytest.mark.parametrize("dup", ["first", "last"])
@pytest.mark.parametrize("hot_rows", [1, 10**9])
def test_first_completion(spark, n, dup, hot_rows):
    messages = random_messages(n, n, outside=True)
    expected = models.distinct(messages, n, dup, "first")
    assert expected
    assert run(spark, messages, n, dup=dup, hot_rows=hot_rows) == expected


@pytest.mark.parametrize("n", [1, 3, 20])
@pytest.mark.parametrize("dup", ["first", "last"])
def test_all_completions(spark, n, dup):
    messages = random_messages(n + 50, n, rows=3000, outside=True)
    expected = models.distinct(messages, n, dup)
    assert len(expected) > 5
    assert run(spark, messages, n, dup=dup, cycles="all") == expected


def test_one_id_over_many_partitions(spark):
    messages = [(1, s, v, q) for _, s, v, q in random_messages(5, 4, rows=4000)]
    for dup in ("first", "last"):
        assert run(spark, messages, 4, dup=dup, cycles="all") == models.distinct(messages, 4, dup)


def test_a_cycle_longer_than_a_partition(spark):
    messages = [(1, q % 2, float(q), q) for q in range(900)] + [(1, 2, 5.0, 900)]
    assert run(spark, messages, 3, cycles="all") == {(1, 0, 900, (0.0, 1.0, 5.0))}
    last = run(spark, messages, 3, dup="last", cycles="all")
    assert last == {(1, 0, 900, (898.0, 899.0, 5.0))}


@pytest.mark.parametrize("n", [1, 3, 20])
@pytest.mark.parametrize("hot_rows", [1, 100, 10**9])
@pytest.mark.parametrize("fill", [None, 0.0])
def test_arrivals(spark, monkeypatch, n, hot_rows, fill):
    monkeypatch.setattr(fanin_module, "CYCLES_PER_SPAN", 7)
    messages = random_messages(n + 9, n)
    got = run(spark, messages, n, dup="last", complete="arrivals", fill=fill, hot_rows=hot_rows)
    assert got == models.arrivals(messages, n, fill)


def test_arithmetic_sequence(spark):
    base = 2.423847923324892
    rows = [(-1, k, base + k, k) for k in range(128)]
    (only,) = run(spark, rows, 128)
    assert list(only[3]) == [base + k for k in range(128)]


def test_duplicate_slot_cases(spark):
    rows = [(1, 0, 1.5, 1), (1, 0, 9.0, 2), (1, 1, 3.5, 3)]
    assert run(spark, rows, 2) == {(1, 0, 3, (1.5, 3.5))}
    assert run(spark, rows, 2, dup="last") == {(1, 0, 3, (9.0, 3.5))}
    fired = run(spark, rows, 2, dup="last", complete="arrivals")
    assert fired == {(1, 0, 2, (9.0, None))}


def test_missing_slot_cases(spark):
    rows = [(1, 0, 1.0, 1), (1, 2, 3.0, 2), (1, 2, 4.0, 3)]
    assert run(spark, rows, 3) == set()
    filled = run(spark, rows, 3, dup="last", complete="arrivals", fill=0.0)
    assert filled == {(1, 0, 3, (1.0, 0.0, 4.0))}


@pytest.mark.parametrize("hot_rows", [1, 10**9])
def test_ttl_counts_from_the_first_message(spark, hot_rows):
    rows = [(1, 0, 1.0, 10), (1, 1, 2.0, 19), (2, 0, 1.0, 10), (2, 1, 2.0, 20)]
    assert run(spark, rows, 2, ttl=10, hot_rows=hot_rows) == {(1, 0, 19, (1.0, 2.0))}
    df = spark.createDataFrame(rows, SCHEMA)
    live = within_ttl(df, "id", "seq", 10, hot_rows).collect()
    assert sorted((r.id, r.seq) for r in live) == [(1, 10), (1, 19), (2, 10)]


def test_wrong_options(spark):
    df = spark.createDataFrame([], SCHEMA)
    with pytest.raises(ValueError):
        fan_in(df, "id", "slot", "value", "seq", 2, dup="middle")
    with pytest.raises(ValueError):
        fan_in(df, "id", "slot", "value", "seq", 2, cycles="two")
    with pytest.raises(ValueError):
        fan_in(df, "id", "slot", "value", "seq", 2, dup="first", complete="arrivals")


def test_empty_and_null_ids(spark):
    assert run(spark, [(None, 0, 1.0, 1), (None, 1, 1.0, 2)], 2) == set()
    for options in ({}, {"cycles": "all"}, {"dup": "last", "complete": "arrivals"}):
        assert run(spark, [], 2, **options) == set()


def test_strict_reasons(spark):
    rows = [
        (1, 0, 1.0), (1, 1, 2.0),
        (2, 0, 1.0),
        (3, 0, 1.0), (3, 5, 2.0),
        (4, 0, 1.0), (4, None, 2.0),
        (5, 0, 1.0), (5, 1, None),
        (6, 0, 1.0), (6, 0, 2.0),
    ]
    df = spark.createDataFrame(rows, "id INT, slot INT, value DOUBLE")
    got = {r.id: (r.vector, r.reason) for r in strict_check(df, "id", "slot", "value", 2).collect()}
    assert got == {
        1: ([1.0, 2.0], None),
        2: (None, "expected 2 entries, got 1"),
        3: (None, "slot out of range"),
        4: (None, "bad slot"),
        5: (None, "bad value"),
        6: (None, "repeated slot"),
    }


def test_completeness_and_completed(spark):
    rows = [(1, 0, 1.0, 1), (1, 0, 1.0, 2), (1, 1, 1.0, 3), (2, 0, 1.0, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, completeness(df, "id", "slot", 2).collect()))
    assert got == [(1, 3, 2, True), (2, 1, 1, False)]
    done = completed_ids(fan_in(df, "id", "slot", "value", "seq", 2), "id").collect()
    assert [tuple(r) for r in done] == [(1, 0)]


def test_stack_columns_with_a_short_chunk(spark):
    rows = [(0, 0, [1.0, 2.0]), (0, 1, [3.0, 4.0]), (1, 0, [5.0]), (1, 1, [6.0]), (2, 0, [9.0])]
    df = spark.createDataFrame(rows, "chunk INT, neuron INT, out ARRAY<DOUBLE>")
    df = df.withColumn("seq", F.lit(1))
    got = sorted(map(tuple, stack_columns(df, "chunk", "neuron", "out", 2, 2, "seq").collect()))
    assert got == [(0, 0, [1.0, 3.0]), (0, 1, [2.0, 4.0]), (1, 0, [5.0, 6.0])]


def test_stack_columns_takes_the_first_report_and_lists_the_oversized(spark):
    rows = [(0, 0, [9.0], 5), (0, 0, [1.0], 2), (0, 1, [3.0, 4.0], 1), (0, 1, [7.0], 3)]
    df = spark.createDataFrame(rows, "chunk INT, neuron INT, out ARRAY<DOUBLE>, seq INT").repartition(3)
    got = [tuple(r) for r in stack_columns(df, "chunk", "neuron", "out", 2, 1, "seq").collect()]
    assert got == [(0, 0, [1.0, 7.0])]
    bad = [(r.neuron, r.reason) for r in oversized_reports(df, "out", 1).collect()]
    assert bad == [(1, "expected at most 1 outputs, got 2")]


@pytest.mark.parametrize("n", [2, 20])
@pytest.mark.parametrize("hot_rows", [1, 10**9])
def test_arrivals_outside_the_vector_count(spark, n, hot_rows):
    rows = [(1, None, 5.0, 0), (1, n + 7, 5.0, 1)] + [(1, k % n, float(k), k + 2) for k in range(2 * n - 2)]
    got = run(spark, rows, n, dup="last", complete="arrivals", fill=0.0, hot_rows=hot_rows)
    assert got == models.arrivals(rows, n, 0.0)
    assert {(c, s) for _, c, s, _ in got} == {(0, n - 1), (1, 2 * n - 1)}
    df = spark.createDataFrame([*rows, (None, 0, 1.0, 99)], SCHEMA)
    assert sorted(r.reason for r in misplaced(df, "id", "slot", n).collect()) == [
        "no id", "no slot", "slot out of range"]


def test_hot_keys_and_the_split_join(spark):
    df = spark.range(900).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"))
    hot = hot_keys(df, "k", 100)
    assert [r.k for r in hot.collect()] == [1] and hot_keys(df, "k", 1000) is None
    assert hot_keys(df, "k", 1).count() == 600  # no number of hot keys is too large
    facts = df.groupBy("k").count()
    joined = attach_per_key(df, facts, "k", hot)
    assert joined.count() == 900
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan


def test_arrival_seq_orders_by_time_then_tie(spark):
    df = spark.createDataFrame([(2, 1), (1, 9), (1, 2)], "t BIGINT, e BIGINT")
    seq = arrival_seq(F.col("t"), F.col("e"))
    assert [tuple(r) for r in df.orderBy(seq).collect()] == [(1, 2), (1, 9), (2, 1)]
    early = spark.createDataFrame([(-1, 1)], df.schema).select(seq)
    with pytest.raises(Exception, match="from 0 on"):
        early.collect()
