import numpy as np
import pytest
from pyspark.sql import functions as F

from fanweave import schemas
from fanweave.functions.activations import register_activation
from fanweave.operators.forward import (
    argmax_rows,
    fan_out,
    layer_forward,
    logits,
    model_bytes,
    neuron_sums,
    predict,
    route,
    tag_vectors,
)

RNG = np.random.default_rng(3)
IMAGES = RNG.normal(size=(60, 7))
SHAPES = [(7, 5), (5, 4), (4, 3)]
WEIGHTS = [(RNG.normal(size=s), RNG.normal(size=s[1])) for s in SHAPES]


def network(spark, names=("relu", "sigmoid", None)):
    rows = []
    for layer, ((w, b), name) in enumerate(zip(WEIGHTS, names)):
        final = layer == len(WEIGHTS) - 1
        for k in range(w.shape[1]):
            rows.append((layer, k, w[:, k].tolist(), float(b[k]), name, final, w.shape[1]))
    return spark.createDataFrame(rows, schemas.NEURONS)


def images(spark):
    rows = [(i, x.tolist()) for i, x in enumerate(IMAGES)]
    return spark.createDataFrame(rows, "image_id BIGINT, features ARRAY<DOUBLE>")


def expected(middle=lambda z: np.maximum(z, 0)):
    x = IMAGES
    for layer, (w, b) in enumerate(WEIGHTS):
        x = x @ w + b
        if layer == 0:
            x = np.maximum(x, 0)
        elif layer == 1:
            x = middle(x)
    return x


def outputs(df):
    return np.array([r.features for r in df.orderBy("image_id").collect()])


@pytest.mark.parametrize("form", ["arrow", "hof", "blocks"])
def test_forms_agree_with_numpy(spark, form):
    got = outputs(logits(images(spark), network(spark), form=form))
    np.testing.assert_allclose(got, expected(), rtol=1e-12, atol=1e-12)
    chosen = predict(images(spark), network(spark), form=form).orderBy("image_id").collect()
    assert [r.prediction for r in chosen] == expected().argmax(axis=1).tolist()


def test_model_above_the_limit_is_not_broadcast(spark):
    df = predict(images(spark), network(spark), limit=150)
    got = [r.prediction for r in df.orderBy("image_id").collect()]
    assert got == expected().argmax(axis=1).tolist()


def test_no_form_joins_or_moves_rows(spark):
    for form in ("arrow", "hof", "blocks"):
        plan = predict(images(spark), network(spark), form=form)._jdf.queryExecution()
        text = plan.executedPlan().toString().split("Subqueries")[0]
        assert "Join" not in text and "CartesianProduct" not in text
        assert form == "hof" or "Exchange" not in text


FORMS = [("arrow", 1 << 20), ("hof", 1 << 20), ("blocks", 1 << 20), ("arrow", 150), ("arrow", 0)]


@pytest.mark.parametrize("form,limit", FORMS)
def test_all_forms_mean_the_same(spark, form, limit):
    """Repeated ids stay apart, all columns stay, wrong vectors are errors, nulls are NaN."""
    rows = [(1, [1.0] * 7, "a", 5), (1, [2.0] * 7, "b", 6), (None, [0.5] * 7, "c", 7)]
    schema = "image_id BIGINT, features ARRAY<DOUBLE>, tag STRING, label INT"
    df = spark.createDataFrame(rows, schema)
    model = network(spark)
    got = logits(df, model, form=form, limit=limit)
    assert set(got.columns) == set(df.columns)
    by_tag = {r.tag: r for r in got.collect()}
    plain = {r.tag: r.features for r in logits(df, model).collect()}
    assert {t: (r.image_id, r.label) for t, r in by_tag.items()} == {
        "a": (1, 5), "b": (1, 6), "c": (None, 7)}
    for tag, r in by_tag.items():
        np.testing.assert_allclose(r.features, plain[tag], rtol=1e-12)
    chosen = predict(df, model, form=form, limit=limit)
    assert set(chosen.columns) == {"image_id", "tag", "label", "prediction"} and chosen.count() == 3
    for bad in ([1.0] * 6, [1.0] * 8, [], None):
        wrong = spark.createDataFrame([(1, bad, "a", 5)], schema)
        with pytest.raises(Exception, match="vector lengths differ"):
            logits(wrong, model, form=form, limit=limit).collect()
    hole = spark.createDataFrame([(1, [None] + [1.0] * 6, "a", 5)], schema)
    assert np.isnan(logits(hole, model, form=form, limit=limit).first().features).all()
    mixed = network(spark).withColumn(
        "activation", F.when((F.col("layer") == 0) & (F.col("neuron") == 1), "softmax")
        .otherwise(F.col("activation")))
    with pytest.raises(ValueError, match="softmax must cover the whole layer"):
        logits(df, mixed, form=form, limit=limit)


def test_sums_carry_no_vectors(spark):
    for limit in (1 << 20, 0):
        out = neuron_sums(images(spark), network(spark), 1 - 1, limit=limit)
        assert set(out.columns) == {"image_id", "layer", "neuron", "z", "activation", "is_final"}
        got = {(r.image_id, r.neuron): r.z for r in out.collect()}
        w, b = WEIGHTS[0]
        want = IMAGES @ w + b
        assert len(got) == want.size
        assert all(abs(got[i, k] - want[i, k]) < 1e-12 for i, k in got)


@pytest.mark.parametrize("form", ["arrow", "hof", "blocks"])
def test_hidden_softmax_layer(spark, form):
    def softmax(z):
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    model = network(spark, ("relu", "softmax", None))
    got = outputs(logits(images(spark), model, form=form))
    np.testing.assert_allclose(got, expected(softmax), rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("form", ["arrow", "hof", "blocks"])
def test_unknown_activation_rules(spark, form):
    got = outputs(logits(images(spark), network(spark), form=form, unknown="identity"))
    np.testing.assert_allclose(got, expected(lambda z: z), rtol=1e-12, atol=1e-12)
    with pytest.raises(Exception, match="unknown activation: sigmoid"):
        logits(images(spark), network(spark), form=form, unknown="error").collect()


def test_registered_activation_without_arrays_takes_the_column_form(spark):
    register_activation("half", lambda z: z / 2)
    got = outputs(logits(images(spark), network(spark, ("relu", "half", None))))
    np.testing.assert_allclose(got, expected(lambda z: z / 2), rtol=1e-12, atol=1e-12)
    register_activation("half", lambda z: z / 2, lambda z: z / 2)
    got = outputs(logits(images(spark), network(spark, ("relu", "half", None))))
    np.testing.assert_allclose(got, expected(lambda z: z / 2), rtol=1e-12, atol=1e-12)


def test_wrong_width_is_an_error(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0])], "image_id BIGINT, features ARRAY<DOUBLE>")
    for form in ("arrow", "hof", "blocks"):
        with pytest.raises(Exception, match="vector lengths differ"):
            predict(df, network(spark), form=form).collect()


def test_one_layer_and_other_columns_stay(spark):
    df = images(spark).withColumn("tag", F.lit("t"))
    out = layer_forward(df, network(spark), 0)
    assert set(out.columns) == {"image_id", "tag", "features"}
    w, b = WEIGHTS[0]
    np.testing.assert_allclose(outputs(out), np.maximum(IMAGES @ w + b, 0), rtol=1e-12)


def test_fan_out_reaches_every_neuron(spark):
    for limit in (1 << 20, 0):
        out = fan_out(images(spark).select("image_id"), network(spark), 1, limit=limit)
        assert out.count() == 60 * 4
        assert out.select("image_id", "neuron").distinct().count() == 60 * 4


def test_route_and_size(spark):
    assert route(network(spark), 2).count() == 3
    assert model_bytes(network(spark)) == sum((i + 1) * o * 8 for i, o in SHAPES)


def test_argmax_rows_ties_and_nan(spark):
    rows = [(1, 0, 1.0), (1, 1, 3.0), (1, 2, 3.0), (2, 0, 5.0), (2, 1, float("nan")),
            (2, 2, float("nan"))]
    df = spark.createDataFrame(rows, "id INT, slot INT, value DOUBLE")
    assert sorted(map(tuple, argmax_rows(df, "id").collect())) == [(1, 1), (2, 1)]


def test_empty_input(spark):
    none = images(spark).filter("image_id < 0")
    assert predict(none, network(spark)).count() == 0


def test_blocks_take_one_pass_and_write_nothing(spark, monkeypatch):
    """Eight blocks, one Python stage, no table but the model."""
    from fanweave.operators import forward

    written = []
    monkeypatch.setattr(forward, "stage", lambda df, label: written.append(label) or df.cache())
    df = logits(images(spark), network(spark), limit=130)
    assert len(forward._blocks(route(network(spark), 0), 130)) == 3
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and written == ["model"]
    np.testing.assert_allclose(outputs(df), expected(), rtol=1e-12, atol=1e-12)


def test_workers_let_blocks_go(spark):
    from fanweave.operators.forward import _loaded

    shared = spark.sparkContext.broadcast((1, 2))

    def run(batches):
        for batch in batches:
            first, second = _loaded(shared), _loaded(shared)
            assert first == second == (1, 2) and "_value" not in vars(shared)
            yield batch

    assert spark.range(10).mapInArrow(run, "id bigint").count() == 10
    assert _loaded(shared) == (1, 2) and shared.value == (1, 2)


def test_bad_vectors_are_tagged_where_the_forward_pass_would_fail(spark):
    rows = [(0, None), (1, []), (2, [1.0] * 6), (3, [1.0] * 7), (4, [1.0] * 8), (5, [None] * 7)]
    df = spark.createDataFrame(rows, "image_id BIGINT, features ARRAY<DOUBLE>")
    tagged = tag_vectors(df, network(spark))
    reasons = {r.image_id: r.reason for r in tagged.collect()}
    assert reasons == {
        0: "no vector", 1: "vector lengths differ: 0 and 7", 2: "vector lengths differ: 6 and 7",
        3: None, 4: "vector lengths differ: 8 and 7", 5: None}
    good = tagged.filter("reason is null").drop("reason")
    assert predict(good, network(spark)).count() == 2
    for bad in (0, 1, 2, 4):
        with pytest.raises(Exception):
            predict(df.filter(F.col("image_id") == bad), network(spark)).collect()
