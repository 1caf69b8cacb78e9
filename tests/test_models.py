import json

import pytest

from fanweave import schemas
from fanweave.operators.models import (
    assign_activations,
    flatten_neurons,
    layers_to_nodes,
    order_layers,
    parse_neuron,
    summarize_model,
    tensors_to_layers,
)
from fanweave.session import new_path
from fanweave.sources import (
    load_model,
    save_layer_document,
    save_model,
    save_neuron_records,
    scan_model,
    scan_neuron_records,
    scan_node_model,
)

TENSORS = [
    (0, "fc1.weight", [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]]),
    (1, "fc1.bias", [[0.1, 0.2, 0.3]]),
    (2, "fc2.weight", [[7.0, 8.0, 9.0]]),
    (3, "fc2.bias", [[0.5]]),
    (4, "other.scale", [[1.0]]),
]


def layers(spark, rows=None):
    return tensors_to_layers(spark.createDataFrame(rows or TENSORS, schemas.TENSORS))


def test_biases_close_layers(spark):
    got = {r.layer: (r.weights, r.biases) for r in layers(spark).collect()}
    assert got == {
        0: ([[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]], [0.1, 0.2, 0.3]),
        1: ([[7.0, 8.0, 9.0]], [0.5]),
    }


def test_activation_names(spark):
    def names(n):
        df = spark.range(n).selectExpr("cast(id as int) layer")
        return [r.activation for r in assign_activations(df).orderBy("layer").collect()]

    assert names(1) == ["relu"]
    assert names(2) == ["relu", "softmax"]
    assert names(4) == ["relu", "sigmoid", "sigmoid", "softmax"]


def test_node_ids_collide_but_keys_do_not(spark):
    rows = [(11, [[1.0], [1.0]], [0.0, 0.0], "relu"), (1, [[1.0]] * 12, [0.0] * 12, "relu")]
    nodes = layers_to_nodes(spark.createDataFrame(rows, schemas.LAYERS)).collect()
    assert sum(r.id == "v1_111" for r in nodes) == 2
    assert len({(r.layer, r.neuron) for r in nodes}) == 14


def test_model_through_documents_and_tables(spark):
    full = assign_activations(layers(spark))
    doc = new_path(spark, "test-model")
    save_layer_document(full, doc, version="v7")
    again = scan_model(spark, doc)
    assert sorted(map(str, again.collect())) == sorted(
        map(str, full.select(again.columns).collect())
    )
    records = new_path(spark, "test-records")
    save_neuron_records(flatten_neurons(layers_to_nodes(again)), records)
    neurons = parse_neuron(scan_neuron_records(spark, records))
    got = sorted((r.layer, r.neuron, r.weights, r.bias, r.activation, r.is_final, r.neuron_count)
                 for r in neurons.collect())
    assert got == [
        (0, 0, [1.0, 2.0], 0.1, "relu", False, 3),
        (0, 1, [3.0, 4.0], 0.2, "relu", False, 3),
        (0, 2, [5.0, 6.0], 0.3, "relu", False, 3),
        (1, 0, [7.0, 8.0, 9.0], 0.5, None, True, 1),
    ]
    table = new_path(spark, "test-table")
    save_model(neurons, table)
    assert load_model(spark, table).exceptAll(neurons).count() == 0
    summary = sorted(map(tuple, summarize_model(neurons).collect()), key=str)
    assert summary == sorted(
        [("input", None, 2, None), ("hidden", 0, 3, 2), ("output", 1, 1, 3)], key=str
    )


def test_node_document(spark, tmp_path):
    path = tmp_path / "nodes.json"
    path.write_text(
        '{"layer_0": {"nodes": [{"id": "v_00", "weights": [1, 2.5], "biases": 0.25,'
        ' "activation": "relu"}]}}'
    )
    row = scan_node_model(spark, str(path)).first()
    assert (row.layer, row.neuron, row.id, row.weights, row.bias, row.activation) == (
        0, 0, "v_00", [1.0, 2.5], 0.25, "relu",
    )


def test_missing_final_flag_means_final(spark):
    rows = [("layer_0", "0", flag, "0", "[1.0]", "0.5", "relu", "1") for flag in ("0", "1", None)]
    got = parse_neuron(spark.createDataFrame(rows, schemas.FLAT_NEURONS)).collect()
    assert [(r.is_final, r.activation) for r in got] == [
        (False, "relu"), (True, None), (True, None),
    ]


def test_layers_are_ordered_by_number(spark):
    df = spark.createDataFrame([("layer_10",), ("layer_2",), ("layer_2",)], "layer_name STRING")
    got = sorted((r.position, r.layer_name, r.is_final) for r in order_layers(df).collect())
    assert got == [(0, "layer_2", False), (1, "layer_10", True)]


def test_a_document_is_cut_at_its_layers(spark, tmp_path):
    body = {"weights": [[0.5, -1.0]] * 20, "biases": [0.25] * 20, "activation": "relu"}
    document = {"version": "v1", **{f"layer_{k}": body for k in range(100)}, "note": "the end"}
    (tmp_path / "a.json").write_text(json.dumps(document, indent=1) + "\n")
    (tmp_path / "b.json").write_text('{"layer_100" : ' + json.dumps(body) + "}")
    (tmp_path / "c.json").write_text("{}")
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "4k")
    try:
        layers = scan_model(spark, str(tmp_path))
        assert layers.rdd.getNumPartitions() > 4  # a document is split between tasks
        rows = layers.collect()
    finally:
        spark.conf.set(name, before)
    assert sorted(r.layer for r in rows) == list(range(101))
    assert all(r.weights == body["weights"] and r.biases == body["biases"] for r in rows)


@pytest.mark.parametrize("text", [
    '{"layer_0": {"weights": [[1.0]], "biases": [1.0], "activation": "layer_x"}}',
    '{"version": "a \\"layer_0\\": 1", "layer_1": {}}',
    '{"layer_0": {"weights": [[1.0]], "biases": [1.0',
])
def test_half_a_layer_is_an_error(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception, match="(?i)document of layers|malformed"):
        scan_model(spark, str(tmp_path / "a.json")).collect()
