import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fanweave.llm import quality as q
from fanweave.llm.labels import in_fold, platt, sigmoid

SCHEMA = "doc_id long, text string, score string, y int"


def docs(n=900, seed=1):
    rng = random.Random(seed)
    words = "the and of a to in stones river walks under light house carries every".split()
    rows = []
    for i in range(n):
        line = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        good = rng.random() < 0.7
        text = " ".join(line) + "." if good else "!! ".join(w.upper() for w in line)
        rows.append((i, text, "clash", int(good)))
    return rows


def test_risk_and_its_gradient():
    fp, fu = np.array([2.0, -1.0]), np.array([0.5, -0.5, 3.0])
    first, second = q.risk_parts(fp, fu, 0.6)
    assert first == pytest.approx(0.6 * np.mean(1 / (1 + np.exp(fp))))
    assert second == pytest.approx(np.mean(1 / (1 + np.exp(-fu))) - 0.6 * np.mean(1 / (1 + np.exp(-fp))))
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 5))
    y = x[:, 0] + 0.5 * x[:, 1] > 0.3
    w, b = q.fit_nnpu(x[y][:200], x, float(y.mean()))
    assert ((x @ w + b > 0) == y).mean() > 0.93


def test_platt_recovers_a_curve():
    rng = np.random.default_rng(1)
    s = rng.normal(size=20_000) * 3 + 1
    y = (rng.random(20_000) < sigmoid(0.8 * s - 1.5)).astype(float)
    a, b = platt(s, y)
    assert a == pytest.approx(0.8, abs=0.05) and b == pytest.approx(-1.5, abs=0.1)


def test_held_out_accuracy(spark):
    rows = docs()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    labels = df.filter("doc_id % 2 = 0").select("doc_id", F.col("y").alias("quality"))
    # a third of the labels exists only in the held-out fold and says the opposite
    wrong = labels.filter(in_fold("doc_id", 5, 0)).withColumn("quality", 1 - F.col("quality"))
    labels = labels.filter(~in_fold("doc_id", 5, 0)).unionByName(wrong)
    model = q.fit_quality(df, labels, ~in_fold("doc_id", 5, 0))
    again = q.fit_quality(df.repartition(7), labels, ~in_fold("doc_id", 5, 0))
    assert np.allclose(model.weights, again.weights) and model.prior == again.prior
    got = q.score_quality(df, model)
    assert got.columns == ["doc_id", "text", "y", "score"]
    hits = [(r.score >= 0.3) == (r.y == 1) for r in got.collect()]
    assert sum(hits) / len(hits) > 0.98


def test_odd_rows(spark):
    rows = docs(200) + [(None, "no id", "", 1), (3, None, "", 1), (3, "", "", 0), (4, "x" * 200_000, "", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    labels = df.select("doc_id", F.when(F.col("doc_id") < 100, F.col("y")).alias("quality"))
    model = q.fit_quality(df, labels, ~in_fold("doc_id", 5, 0))
    scores = [r.score for r in q.score_quality(df, model).collect()]
    assert len(scores) == len(rows) and all(0 <= s <= 1 for s in scores)
    none = q.fit_quality(df, labels.limit(0), ~in_fold("doc_id", 5, 0))
    assert {r.score for r in q.score_quality(df, none).collect()} == {0.5}
    empty = df.limit(0)
    model = q.fit_quality(empty, labels, ~in_fold("doc_id", 5, 0))
    assert q.score_quality(empty, model).collect() == []
    only = df.filter("doc_id < 100")  # every document is labelled
    q.fit_quality(only, labels, ~in_fold("doc_id", 5, 0))


def test_repeated_ids_count_once_in_a_sample(spark):
    """An id with a third of all rows is one text of the sample, not thousands."""
    from fanweave.llm.labels import sampled_texts

    rows = docs(600)
    hot = [(5000, f"copy {n % 7} of the hot text", "x", 1) for n in range(300)]
    df = spark.createDataFrame(rows + hot + [(7, "another text of seven", "x", 1)], SCHEMA)
    texts = df.select(F.col("doc_id").alias("id"), "text")
    wanted = spark.createDataFrame([(5000, -1), (7, 1), (8, 0), (9999, 1)], "id long, y int")
    got = sorted(tuple(r) for r in sampled_texts(texts, wanted).collect())
    assert [y for y, _ in got] == [-1, 0, 1] and "hot" in got[0][1]
    assert got == sorted(tuple(r) for r in sampled_texts(texts.repartition(7), wanted).collect())
    # all unlabelled ids fit into the sample, so the hot one changes nothing but its own share
    labels = df.filter("doc_id < 300").select("doc_id", F.col("y").alias("quality")).distinct()
    once = df.dropDuplicates(["doc_id"]).filter("doc_id <> 5000")
    extra = spark.createDataFrame([(5000, "copy 1 of the hot text", "x", 1)] * 200, SCHEMA)
    many = q.fit_quality(once.unionByName(extra), labels, F.lit(True), max_unlabelled=100_000)
    one = q.fit_quality(once.unionByName(extra.limit(1)), labels, F.lit(True), max_unlabelled=100_000)
    assert np.allclose(many.weights, one.weights) and many.offset == pytest.approx(one.offset)


def test_best_bin_and_calibration_of_known_mixtures():
    """Two normal clouds in known shares; the negatives' part is known to the test only."""
    rng = np.random.default_rng(3)
    for share in (0.2, 0.5, 0.85):
        p = rng.normal(2.0, 1.0, 6000)
        is_p = rng.random(9000) < share
        u = np.where(is_p, rng.normal(2.0, 1.0, 9000), rng.normal(-2.0, 1.0, 9000))
        assert q.best_bin(p, u) == pytest.approx(share, abs=0.06)
        slope, shift = q.calibrated(p, u, share)
        chance = sigmoid(slope * u + shift)
        for low, high in ((0.05, 0.5), (0.5, 0.95)):
            here = (chance >= low) & (chance < high)
            if here.sum() > 100:
                assert chance[here].mean() == pytest.approx(is_p[here].mean(), abs=0.12)


@pytest.mark.parametrize("keep", [0.25, 1.0])
def test_prior_is_that_of_the_unlabelled_text(spark, keep):
    """Nine of ten labels are positive; the share in the unlabelled text is another one."""
    rng = random.Random(8)
    rows = [r for r in docs(4000, 7) if r[0] < 1000 or r[3] == 0 or rng.random() < keep]
    df = spark.createDataFrame(rows, SCHEMA)
    labelled = [r for r in rows if r[0] < 1000 and (r[3] == 1 or rng.random() < 0.25)]
    labels = spark.createDataFrame([(r[0], r[3]) for r in labelled], "doc_id long, quality int")
    known = [r[3] for r in labelled]
    rest = [r[3] for r in rows if r[0] not in {x[0] for x in labelled}]
    share, biased = sum(rest) / len(rest), sum(known) / len(known)
    model = q.fit_quality(df, labels, F.lit(True))
    assert abs(model.prior - share) < 0.1 and (keep == 1.0 or abs(biased - share) > 0.3)
    hits = [(r.score >= 0.3) == (r.y == 1) for r in q.score_quality(df, model).collect()]
    assert sum(hits) / len(hits) > 0.97
    # labelled negatives say nothing
    positives = q.fit_quality(df, labels, F.lit(True), max_unlabelled=500)
    turned = labels.filter("quality = 1").unionByName(
        labels.filter("quality = 0").withColumn("quality", F.lit(None).cast("int")))
    assert np.allclose(
        positives.weights, q.fit_quality(df, turned, F.lit(True), max_unlabelled=500).weights)
