import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fanweave.operators.evaluate import (
    accuracy,
    cross_entropy,
    evaluate,
    missing_predictions,
    split,
    verdicts,
)
from fanweave.functions.permutation import permuted, permuted_numbers
from fanweave.operators.train import EPSILON, Network, epoch_batches, train

LABELS = [(0, 5), (1, 6), (2, 7), (3, 8)]
PREDICTIONS = [(0, 5, 1), (1, 0, 1), (0, 5, 2), (9, 1, 1)]


@pytest.fixture
def labels(spark):
    return spark.createDataFrame(LABELS, "image_id BIGINT, label INT")


@pytest.fixture
def predictions(spark):
    return spark.createDataFrame(PREDICTIONS, "image_id BIGINT, prediction INT, seq INT")


def values(df):
    return tuple(df.first())


def test_bases(labels, predictions):
    assert values(accuracy(labels, predictions)) == (2, 3, 2 / 3, "66.67%")
    assert values(accuracy(labels, predictions, "labels")) == (1, 4, 0.25, "25.00%")
    assert values(accuracy(labels, predictions, "predictions", seq="seq"))[:2] == (1, 3)
    assert values(accuracy(labels, predictions, limit=1)) == (2, 2, 1.0, "100.00%")


def test_nothing_to_count(labels, predictions):
    none = predictions.filter("image_id > 99")
    assert values(accuracy(labels, none)) == (0, 0, None, None)
    assert values(accuracy(labels, none, "predictions")) == (0, 0, None, None)
    assert values(accuracy(labels.filter("label < 0"), none, "labels")) == (0, 0, 0.0, "0.00%")


def test_latest_prediction_counts(spark, labels):
    changed = spark.createDataFrame([(0, 5, 1), (0, 4, 2)],
                                    "image_id BIGINT, prediction INT, seq INT")
    assert values(accuracy(labels, changed, "labels", seq="seq"))[0] == 0


def test_verdicts_and_missing(labels, predictions):
    got = {r.image_id: r.verdict for r in verdicts(labels, predictions).collect()}
    assert got == {0: "correct", 1: "wrong", 2: "missing", 3: "missing"}
    assert sorted(map(tuple, missing_predictions(labels, predictions).collect())) == [
        (2, 7), (3, 8),
    ]


def test_split_is_complete_and_repeatable(spark):
    train_rows, test_rows = split(spark.range(100), "id", 5)
    assert (train_rows.count(), test_rows.count()) == (80, 20)


def test_cross_entropy(spark):
    df = spark.createDataFrame([([0.0, 0.0], 1), ([0.0, math.log(3)], 1)],
                               "features ARRAY<DOUBLE>, label INT")
    row = cross_entropy(df).first()
    assert row["loss"] == pytest.approx((math.log(2) - math.log(0.75)) / 2)


def clusters(spark, rows=600, parts=3):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(4, 6)) * 3
    data = [(i, (centres[i % 4] + rng.normal(size=6)).tolist(), i % 4) for i in range(rows)]
    return spark.createDataFrame(
        data, "image_id BIGINT, features ARRAY<DOUBLE>, label INT"
    ).repartition(parts, "image_id")


def test_training_learns_and_reports(spark):
    images = clusters(spark)
    neurons, losses = train(images, hidden=16, epochs=6, batch=16, lr=0.01, report_every=5)
    by_epoch = {}
    for r in losses.collect():
        by_epoch.setdefault(r.epoch, []).append(r.loss)
    assert np.mean(by_epoch[6]) < 0.3 * np.mean(by_epoch[1])
    assert evaluate(images, neurons).first()["accuracy"] > 0.95
    shapes = sorted((r.layer, len(r.weights), r.neuron_count) for r in neurons.collect())
    assert shapes == [(0, 6, 16)] * 16 + [(1, 16, 4)] * 4


def test_gradient_matches_differences():
    net = Network(3, 4, 2)
    flat = net.initial(0)
    x, y = np.random.default_rng(0).normal(size=(5, 3)), np.array([0, 1, 1, 0, 1])
    _, gradient = net.loss_and_gradient(flat, x, y)
    for i in range(net.size):
        step = np.zeros(net.size)
        step[i] = 1e-6
        up, down = (net.loss_and_gradient(flat + s, x, y)[0] for s in (step, -step))
        assert gradient[i] == pytest.approx((up - down) / 2e-6, abs=1e-6)


@pytest.mark.parametrize("parts,form", [(1, "jobs"), (8, "jobs"), (8, "barrier")])
def test_training_is_plain_adam_however_rows_are_partitioned(spark, parts, form):
    """Against a direct loop over the same mini-batches, for sorted and for spread rows."""
    images = clusters(spark, rows=100, parts=parts).sortWithinPartitions("label")
    rows = sorted(images.collect(), key=lambda r: r.image_id)
    neurons, losses = train(
        images, hidden=5, epochs=2, batch=32, lr=0.01, seed=4, report_every=1, form=form,
        tasks=3)
    net = Network(6, 5, 4)
    flat, m, v, t = net.initial(4), np.zeros(net.size), np.zeros(net.size), 0
    expected = []
    for epoch in range(2):
        places = permuted_numbers(np.arange(100), 100, "epoch", 4, epoch)
        order = np.argsort(places)
        for step in range(1, 5):
            here = [rows[i] for i in order[(step - 1) * 32: step * 32]]
            x, y = np.array([r.features for r in here]), np.array([r.label for r in here])
            loss, g = net.loss_and_gradient(flat, x, y)
            expected.append((epoch + 1, step, round(loss, 9)))
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            flat = flat - 0.01 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + EPSILON)
    assert sorted((r.epoch, r.step, round(r.loss, 9)) for r in losses.collect()) == expected
    w1, b1, _, _ = net.parts(flat)
    got = {r.neuron: r for r in neurons.filter("layer = 0").collect()}
    for k in range(5):
        np.testing.assert_allclose(got[k].weights, w1[:, k], rtol=1e-7)
        assert got[k].bias == pytest.approx(b1[k], rel=1e-7)


def test_many_tasks_are_summed_in_a_tree(spark, monkeypatch):
    from fanweave.operators import train as module

    images = clusters(spark, rows=200, parts=6)
    plain, _ = train(images, hidden=3, epochs=1, batch=200)
    monkeypatch.setattr(module, "FAN_IN", 1)
    monkeypatch.setattr(module, "BLOCK_ROWS", 60)  # a mini-batch of several files
    tree, _ = train(images, hidden=3, epochs=1, batch=200)
    for a, b in zip(plain.orderBy("layer", "neuron").collect(), tree.orderBy("layer", "neuron").collect()):
        np.testing.assert_allclose(a.weights, b.weights, rtol=1e-9)


def test_tasks_without_rows_take_part(spark):
    """An exchange among more tasks than a mini-batch has rows."""
    images = clusters(spark, rows=9, parts=2)
    jobs, _ = train(images, hidden=3, epochs=1, batch=3)
    one, losses = train(images, hidden=3, epochs=1, batch=3, form="barrier", tasks=4, report_every=1)
    for a, b in zip(*(m.orderBy("layer", "neuron").collect() for m in (jobs, one))):
        np.testing.assert_allclose(a.weights, b.weights, rtol=1e-9)
    assert losses.count() == 3
    with pytest.raises(ValueError):
        train(images, form="local")


def test_an_epoch_is_one_job_between_barriers(spark):
    """The number of jobs does not depend on the number of steps."""
    images = clusters(spark, rows=12, parts=2)
    tracker = spark.sparkContext.statusTracker()

    def jobs(batch):
        spark.sparkContext.setJobGroup(f"batch {batch}", "")
        train(images, hidden=3, epochs=1, batch=batch, form="barrier", tasks=2)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(tracker.getJobIdsForGroup(f"batch {batch}"))

    assert jobs(12) == jobs(3)


def test_small_steps_share_a_job(spark, monkeypatch):
    """The number of jobs follows the blocks of rows, not the steps, with the same result."""
    from fanweave.operators import train as module

    images = clusters(spark, rows=101, parts=3)
    tracker = spark.sparkContext.statusTracker()

    def trained(name, batch, **limits):
        for limit, value in limits.items():
            monkeypatch.setattr(module, limit, value)
        spark.sparkContext.setJobGroup(name, "")
        neurons, losses = train(images, hidden=3, epochs=2, batch=batch, lr=0.01, report_every=1)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        jobs = len(tracker.getJobIdsForGroup(name))
        return jobs, neurons.orderBy("layer", "neuron").collect(), losses.orderBy("epoch", "step").collect()

    many, few = trained("steps of 4", 4), trained("steps of 50", 50)
    assert len(many[2]) == 2 * 26 and len(few[2]) == 2 * 3 and many[0] == few[0]
    for name, limits in (("a job a step", {"CHAIN_WORK": 0}), ("blocks", {"CHAIN_WORK": 1 << 26, "CHAIN_ROWS": 30})):
        jobs, neurons, losses = trained(name, 4, **limits)
        assert jobs > many[0]
        for a, b in zip(many[1], neurons):
            np.testing.assert_allclose(a.weights, b.weights, rtol=1e-9)
            assert a.bias == pytest.approx(b.bias, rel=1e-9)
        assert [r[:2] for r in many[2]] == [r[:2] for r in losses]
        np.testing.assert_allclose([r.loss for r in many[2]], [r.loss for r in losses], rtol=1e-9)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 64, 97, 1000, 4097])
def test_permutation(spark, n):
    numbers = np.arange(n)
    for key in (("a", 1), ("a", 2), (3,)):
        places = permuted_numbers(numbers, n, *key)
        assert sorted(places.tolist()) == numbers.tolist()
        got = spark.range(n).select("id", permuted(F.col("id"), n, *key).alias("at")).collect()
        assert {r.id: r["at"] for r in got} == dict(enumerate(places.tolist()))
    if n > 50:
        one, two = (permuted_numbers(numbers, n, k) for k in (1, 2))
        assert abs(np.corrcoef(one, numbers)[0, 1]) < 0.3 > abs(np.corrcoef(one, two)[0, 1])
        assert (np.diff(one) == np.diff(one)[0]).mean() < 0.2


def test_epochs_have_exact_batches_in_new_orders(spark):
    rows = spark.range(130).withColumnRenamed("id", "row_id")
    seen = []
    for epoch in range(3):
        got = epoch_batches(rows, 130, 64, epoch, seed=2).collect()
        sizes = [sum(r.batch == k for r in got) for k in range(3)]
        assert sizes == [64, 64, 2] and sorted(r.batch * 64 + r.pos for r in got) == list(range(130))
        seen.append([r.row_id for r in sorted(got, key=lambda r: (r.batch, r.pos))])
    assert seen[0] != seen[1] != seen[2]
    again = epoch_batches(rows, 130, 64, 1, seed=2).collect()
    assert [r.row_id for r in sorted(again, key=lambda r: (r.batch, r.pos))] == seen[1]
