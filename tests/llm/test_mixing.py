import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fanweave.llm import mixing as m

SCHEMA = "doc_id long, text string, rate string, tokens int, quality int, toxic int"


def test_softmax_regression_and_missing_classes():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 4))
    y = np.where(x[:, 0] > 0.5, 2, np.where(x[:, 1] > 0, 0, 3))
    p = m.softmax(np.hstack([x, np.ones((900, 1))]) @ m.fit_softmax(x, y, 4))
    assert (p.argmax(1) == y).mean() > 0.93 and p[:, 1].max() < 1e-9


def facts_of(spark, p, t):
    rows = [(int(n), [float(v) for v in row]) for n, row in zip(t, p)]
    return spark.createDataFrame(rows, "tokens long, posteriors array<double>").repartition(3)


def brute_rates(p, t, share, rounds):
    """Projected gradient with a stored rate per document."""
    present = t @ p
    wanted = share * (present[2] + present[3])
    w = np.ones(len(p))
    for _ in range(rounds):
        r = (((w * t) @ p) - wanted) / present
        w = np.maximum(0, w - (p @ r + m.RIDGE * (w - 1)) / (1 + m.RIDGE))
    return w, wanted


def dual_rates(p, t, share, least=0.0):
    """The optimum from its dual, whose only unknowns are the domains' relative residuals.

    Best rates for residuals r are ``max(least, 1 - p r / ridge)``; Newton steps find the r
    that these rates leave, which proves the optimum.
    """
    size, present = p.shape[1], t @ p
    wanted = share * (present[2] + present[3])
    r = np.zeros(size)

    def left(r):
        w = np.maximum(least, 1 - p @ r / m.RIDGE)
        return w, (w * t) @ p - wanted - present * r

    def value(r):
        w, _ = left(r)
        return t @ (w * (p @ r) + m.RIDGE / 2 * (w - 1) ** 2) - r @ wanted - (present * r * r).sum() / 2

    for _ in range(200):
        w, slope = left(r)
        if np.abs(slope / present).max() < 1e-10:
            break
        free = 1 - p @ r / m.RIDGE >= least
        curve = (p[free].T * t[free]) @ p[free] / m.RIDGE + np.diag(present)
        step = np.linalg.solve(curve, slope)
        trials = [r + step * 0.5**k for k in range(30)]
        r = max(trials, key=value)
    return left(r)[0], wanted, r


def test_rates_meet_the_targets(spark):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.2, 0.1, 0.9, 0.2], 600)
    t = rng.integers(1, 900, 600).astype(float)
    targets = {"low": 0.1, "low_toxic": 0.05, "good": 1.3, "good_toxic": 0.2}
    steps, wanted, reached = m.solve_rates(facts_of(spark, p, t), targets)
    assert np.abs(reached - wanted).max() < 0.02 * wanted.sum()
    w, share = m.rates(p, steps), np.array(list(targets.values()))
    slow, same = brute_rates(p, t, share, 20_000)
    assert np.allclose(wanted, same) and np.allclose(w, slow, atol=1e-3)
    proven, _, _ = dual_rates(p, t, share)
    assert np.allclose(w, proven, atol=1e-5) and np.allclose(reached, (w * t) @ p)
    assert (w >= 0).all()
    # no other nonnegative rates are better: the projected gradient is about zero
    r = (reached - wanted) / (t @ p)
    slope = p @ r + m.RIDGE * (w - 1)
    assert np.where(w > 0, np.abs(slope), np.maximum(-slope, 0)).max() < 1e-3


def docs(n=500):
    rng = random.Random(6)
    words = [a + b for a in ("re", "th", "on", "sa") for b in ("an", "er", "ou", "st")]
    rows = []
    for i in range(n):
        line = [rng.choice(words) for _ in range(rng.randint(5, 80))]
        toxic, good = rng.random() < 0.2, rng.random() < 0.7
        if toxic:
            line.insert(3, rng.choice(["idiot", "scum"]))
        text = " ".join(line) if good else "!! ".join(w.upper() for w in line)
        rows.append((i, text, "clash", 5, int(good), int(toxic)))
    return rows


def test_copies_follow_the_rates(spark):
    rows = docs() + [(None, "no id here", "x", 1, 1, 0), (None, None, "x", 1, None, None),
                     (3, "", "y", 1, 1, 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    labels = df.select("doc_id", "quality", "toxic")
    model = m.fit_domains(df, labels)
    got = m.mix(df, model).collect()
    assert len(got) == len(rows)
    for r in got:
        assert np.isclose(sum(r.posteriors), 1) and r.copies in (int(r.rate), int(r.rate) + 1)
    label = {i: 2 * q + t for i, _, _, _, q, t in rows if i is not None and i != 3}
    right = [int(np.argmax(r.posteriors)) == label[r.doc_id] for r in got if r.doc_id in label]
    assert sum(right) / len(right) > 0.95
    clean = [r for r in got if label.get(r.doc_id) == 2 and r.posteriors[2] > 0.9]
    assert clean and all(r.rate >= 1 and r.copies >= 1 for r in clean)
    bad = [r.copies for r in got if label.get(r.doc_id) == 0]
    assert sum(bad) < 0.2 * len(bad)
    mixed = m.resample(df, model)
    assert mixed.columns == df.columns
    times = {}
    for r in mixed.collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert {i: times.get(i, 0) for i in label} == {r.doc_id: r.copies for r in got if r.doc_id in label}


def test_empty_and_unlabelled(spark):
    df = spark.createDataFrame(docs(40), SCHEMA)
    labels = df.select("doc_id", "quality", "toxic")
    none = m.fit_domains(df, labels.limit(0))
    assert {tuple(r.posteriors) for r in m.mix(df, none).collect()} == {(0.25,) * 4}
    empty = df.limit(0)
    model = m.fit_domains(empty, labels)
    assert m.mix(empty, model).collect() == [] and m.resample(empty, model).collect() == []
    blank = df.withColumn("text", F.lit(None).cast("string"))
    assert {r.tokens for r in m.mix(blank, none).collect()} == {0}


@pytest.mark.parametrize("rate,low,high", [(0.0, 0, 0), (1.0, 1, 1), (2.25, 2, 3)])
def test_rounding(spark, rate, low, high):
    got = [r[0] for r in spark.range(4000).select(m.copies(F.lit(rate), F.col("id"))).collect()]
    assert set(got) <= {low, high} and abs(np.mean(got) - rate) < 0.03


def soft_docs(spark, monkeypatch, p, t):
    """Documents whose texts are their posteriors, which stand in for the classifier's."""
    monkeypatch.setattr(
        m, "domain_posteriors", lambda docs, model, text, name, left_out: docs.withColumn(
            name, F.split(F.col(text), " ").cast("array<double>")).drop(*left_out))
    rows = [(i, " ".join(map(repr, map(float, v))), "x", int(n), 0, 0)
            for i, (v, n) in enumerate(zip(p, t))]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_rates_are_the_best_for_diffuse_domains(spark, monkeypatch):
    """Low documents hide among the good ones, so plain gradient rounds hardly move them."""
    rng = np.random.default_rng(12)
    p = rng.dirichlet([1.2, 0.4, 16, 0.8], 900)
    p[::9] = rng.dirichlet([6, 3, 9, 2], 100)
    t = rng.integers(1, 900, 900).astype(float)
    df = soft_docs(spark, monkeypatch, p, t)
    rows = sorted(m.mix(df, None, tokens=F.col("tokens")).collect())
    w, present = np.array([r.rate for r in rows]), t @ p
    wanted = np.array(list(m.TARGETS.values())) * (present[2] + present[3])
    residual = ((w * t) @ p - wanted) / present
    # the condition of the optimum, which is the only one
    assert np.abs(w - np.maximum(0, 1 - p @ residual / m.RIDGE)).max() < 1e-3
    slow, _ = brute_rates(p, t, np.array(list(m.TARGETS.values())), 20_000)

    def loss(w):
        return (((w * t) @ p - wanted) ** 2 / present).sum() + m.RIDGE * t @ (w - 1) ** 2

    assert loss(w) <= loss(slow) * (1 + 1e-9)
    proven, same, _ = dual_rates(p, t, np.array(list(m.TARGETS.values())))
    assert np.allclose(same, wanted) and np.allclose(w, proven, atol=1e-4)


def test_query_meets_its_targets(spark, sf_dir):
    from fanweave.llm.queries import op3_mixing

    rows = op3_mixing(spark, sf_dir).collect()
    p = np.array([[r[f"p_{d}"] for d in m.DOMAINS] for r in rows])
    w, t = (np.array([r[c] for r in rows], float) for c in ("rate", "tokens"))
    present = t @ p
    wanted = np.array(list(m.TARGETS.values())) * (present[2] + present[3])
    reached = (w * t) @ p
    assert np.abs(reached - wanted).max() < 0.01 * wanted.sum()
    real = present > 1e-9 * present.sum()
    residual = np.where(real, (reached - wanted) / np.where(real, present, 1), 0)
    assert np.abs(w - np.maximum(0, 1 - p @ residual / m.RIDGE)).max() < 1e-3


def test_clean_documents_stay(spark, monkeypatch):
    """Clean documents that share mass with a domain that must shrink have no rate below 1."""
    rng = np.random.default_rng(21)
    p = rng.dirichlet([2.5, 0.4, 6, 0.8], 900)
    t = rng.integers(1, 900, 900).astype(float)
    df = soft_docs(spark, monkeypatch, p, t)
    plain = {r.doc_id for r in m.resample(df, None, tokens=F.col("tokens")).collect()}
    good = set(np.flatnonzero(p.argmax(1) == 2).tolist())
    assert good - plain  # without the bound some of them go
    labels = spark.createDataFrame(
        [(i, 1, 0) for i in range(0, 900, 7)] + [(1, 1, 0), (1, 0, 0), (2, 0, 0), (3, 1, 1)],
        "doc_id long, quality int, toxic int")
    known = m.clean_ids(labels)
    clean = good | set(range(0, 900, 7))
    assert {r.id for r in known.collect()} == set(range(0, 900, 7))
    got = m.resample(df, None, tokens=F.col("tokens"), clean=known)
    assert got.columns == df.columns
    times = {}
    for r in got.collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert clean <= times.keys() < set(range(900))
    # the other rates are still the best ones
    least = np.isin(np.arange(900), list(clean)).astype(float)
    facts = spark.createDataFrame(
        [(int(n), [float(v) for v in row], float(x)) for n, row, x in zip(t, p, least)],
        "tokens long, posteriors array<double>, least double").repartition(3)
    steps, wanted, reached = m.solve_rates(facts, m.TARGETS)
    w = m.rates(p, steps, m.RIDGE, least)
    assert (w >= least).all() and np.allclose(reached, (w * t) @ p)
    proven, same, _ = dual_rates(p, t, np.array(list(m.TARGETS.values())), least)
    assert np.allclose(same, wanted) and np.allclose(w, proven, atol=1e-4)


def test_no_clean_document_goes_on_a_large_table(spark):
    """Every labelled clean document passes the stage."""
    import corpus_pipeline

    folder = "/root/testdata/sf0.1"
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    clean = {r.id for r in m.clean_ids(labels).join(
        documents.select(F.col("doc_id").alias("id")), "id", "left_semi").collect()}
    mixed = corpus_pipeline.mixing_stage(spark, documents, folder)
    assert clean and clean <= {r.doc_id for r in mixed.select("doc_id").distinct().collect()}


@pytest.mark.parametrize("seed", [28, 37, 1656, 1990])
def test_the_search_ends_whatever_part_of_the_tokens_moves(spark, seed):
    """Half of the documents have next to no tokens, as one document of a large table has."""
    rng = np.random.default_rng(seed)
    p = rng.dirichlet([2.5, 0.4, 6, 0.8], 60)
    t = np.where(rng.random(60) < 0.5, 1.0, 1e10)
    steps, wanted, reached = m.solve_rates(facts_of(spark, p, t), m.TARGETS)
    w = m.rates(p, steps)
    residual = (reached - wanted) / (t @ p)
    # the condition of the optimum, which is the only one
    assert np.abs(w - np.maximum(0, 1 - p @ residual / m.RIDGE)).max() < 1e-4
    assert np.allclose(reached, (w * t) @ p)
