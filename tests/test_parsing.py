import json
import struct

import pytest

from fanweave.operators.parsing import lookup_values, parse_messages


def parse(spark, layout, *messages, **options):
    df = spark.createDataFrame([(k, v) for k, v in messages], "key STRING, value STRING")
    good, bad = parse_messages(df, layout, **options)
    return ([r.asDict() for r in good.collect()],
            [(r.key, r.value, r.reason) for r in bad.collect()])


@pytest.mark.parametrize(
    "layout, text, expected",
    [
        ("P2", "3|42|-1.5", {"slot": 3, "image_id": 42, "value": -1.5}),
        ("P3", "42|3|1e-7", {"slot": 3, "image_id": 42, "value": 1e-7}),
        ("P6", "3|8|50", {"slot": 3, "batch_id": 8, "batch_size": 50}),
        ("P7", "layer_2|42", {"layer": 2, "image_id": 42}),
        ("P7", "2|42", {"layer": 2, "image_id": 42}),
        ("P8", "layer_1|8|50|784", {"layer": 1, "batch_id": 8, "batch_size": 50, "columns": 784}),
        ("P10", "42|7", {"image_id": 42, "prediction": 7}),
    ],
)
def test_layouts(spark, layout, text, expected):
    good, bad = parse(spark, layout, (None, text))
    assert good == [expected] and bad == []


def test_key_layout_and_its_dead_letters(spark):
    good, bad = parse(
        spark, "P1", ("5", "1|2.5"), ("5", "7|1.0"), ("5", "1|x"), ("5", "abc"), ("x", "1|1"),
        ("5", None), ("5", "-1|1.0"), ("5", "1|1|1"), n=3,
    )
    assert good == [{"image_id": 5, "slot": 1, "value": 2.5}]
    assert sorted(bad, key=str) == sorted(
        [
            ("5", "7|1.0", "slot out of range"),
            ("5", "1|x", "bad value"),
            ("5", "abc", "missing field"),
            ("x", "1|1", "bad image_id"),
            ("5", None, "no value"),
            ("5", "-1|1.0", "slot out of range"),
            ("5", "1|1|1", "bad value"),
        ],
        key=str,
    )


def test_json_layouts(spark):
    hexed = struct.pack("<d", 2.75).hex()
    text = json.dumps({"neuron_id": 2, "image_id": 9, "output": hexed})
    good, _ = parse(spark, "P4", (None, text), encoding="hex")
    assert good == [{"slot": 2, "image_id": 9, "value": 2.75}]
    text = json.dumps({"neuron_id": "2", "image_id": "9", "output": 2.75})
    good, bad = parse(spark, "P4", (None, text), (None, "{"), (None, '{"neuron_id": 1}'))
    assert good == [{"slot": 2, "image_id": 9, "value": 2.75}]
    assert sorted(r for _, _, r in bad) == ["bad image_id", "not JSON"]
    good, _ = parse(spark, "P7_JSON", (None, '{"layer": "layer_1", "image_id": 4}'),
                    (None, '{"layer": 0}'))
    assert good == [{"layer": 1, "image_id": 4}, {"layer": 0, "image_id": None}]


def test_notice_finds_its_value(spark):
    df = spark.createDataFrame([(None, '{"neuron_id": 2, "image_id": 9}')],
                               "key STRING, value STRING")
    good, _ = parse_messages(df, "P5")
    outputs = spark.createDataFrame([(9, 2, 0.5), (9, 3, 0.7)],
                                    "image_id BIGINT, slot INT, value DOUBLE")
    assert [r.value for r in lookup_values(good, outputs).collect()] == [0.5]


@pytest.mark.parametrize("layout, head", [("P6_VECTOR", "3|8|1|2|"), ("P9", "layer_0|8|")])
def test_vectors_in_messages(spark, layout, head):
    import base64

    blob = base64.b64encode(struct.pack("<2d", 1.5, -2.0)).decode()
    good, bad = parse(spark, layout, (None, head + blob), (None, head + "?"))
    assert [r["vector"] for r in good] == [[1.5, -2.0]]
    assert [reason for _, _, reason in bad] == ["bad vector"]


def test_unknown_layout(spark):
    with pytest.raises(ValueError):
        parse(spark, "P99", (None, ""))
