import json
import os
import random

import models
import pytest
from pyspark.sql import functions as F

from fanweave import schemas
from fanweave.operators.fanin import fan_in
from fanweave.operators.forward import predict
from fanweave.operators.parsing import tag_messages
from fanweave.session import new_path
from fanweave.sinks import read_upserts, upsert_predictions
from fanweave.sources import scan_predictions
from fanweave.streaming.fanin import fan_in_stream
from fanweave.streaming.io import (
    as_messages,
    drain,
    filter_key,
    mirror,
    read_messages,
    route_dead_letters,
    start,
    write_messages,
)
from fanweave.streaming.predict import predict_stream, predictions_by_messages

SCHEMA = "id BIGINT, slot INT, value DOUBLE, seq BIGINT"


def put(folder, name, rows, keys=("id", "slot", "value", "seq")):
    """One file of the source; files are read in the order of their times."""
    path = os.path.join(folder, f"{name}.json")
    with open(path, "w") as out:
        out.writelines(json.dumps(dict(zip(keys, r))) + "\n" for r in rows)
    stamp = 1_700_000_000 + len(os.listdir(folder))
    os.utime(path, (stamp, stamp))


def messages(seed, n, rows):
    rng = random.Random(seed)
    return [(7 if q % 3 == 0 else rng.randrange(4), rng.randrange(n), float(q), q)
            for q in range(rows)]


def stream(spark, folder, rate=1):
    return read_messages(spark, path=str(folder), schema=SCHEMA, rate=rate)


def run(spark, df, checkpoint=None, out=None):
    path = new_path(spark, "stream-test")
    drain(start(df, checkpoint or f"{path}-checkpoint", path=out or f"{path}-out"))
    rows = spark.read.schema(df.schema).parquet(out or f"{path}-out").collect()
    return {(r.id, r.cycle, r.completed_seq, tuple(r.vector)) for r in rows}


@pytest.mark.parametrize(
    "options, expected",
    [
        ({"once": True}, lambda m: models.distinct(m, 3, "first", "first")),
        ({}, lambda m: models.distinct(m, 3, "first")),
        ({"dup": "last"}, lambda m: models.distinct(m, 3, "last")),
        ({"dup": "last", "complete": "arrivals", "fill": 0.0}, lambda m: models.arrivals(m, 3, 0.0)),
    ],
)
def test_stream_equals_model_over_several_batches(spark, tmp_path, options, expected):
    all_messages = messages(1, 3, 120)
    for part in range(3):
        rows = all_messages[part * 40:(part + 1) * 40]
        random.Random(part).shuffle(rows)
        put(tmp_path, part, rows)
    df = stream(spark, tmp_path)
    got = run(spark, fan_in_stream(df, "id", "slot", "value", "seq", 3, **options))
    assert got == expected(all_messages)


def test_restart_goes_on_without_repeats(spark, tmp_path):
    all_messages = messages(2, 4, 60)
    put(tmp_path, "a", all_messages[:25])
    path = new_path(spark, "restart")
    for part in (None, all_messages[25:]):
        if part:
            put(tmp_path, "b", part)
        df = fan_in_stream(stream(spark, tmp_path), "id", "slot", "value", "seq", 4)
        got = run(spark, df, f"{path}-checkpoint", f"{path}-out")
    assert got == models.distinct(all_messages, 4, "first")
    again = run(spark, df, f"{path}-checkpoint", f"{path}-out")
    assert again == got
    batch = fan_in(spark.createDataFrame(all_messages, SCHEMA), "id", "slot", "value", "seq", 4,
                   cycles="all")
    assert {(r.id, r.cycle, r.completed_seq, tuple(r.vector)) for r in batch.collect()} == got


def test_arrivals_counted_per_batch_overshoot(spark, tmp_path):
    put(tmp_path, 0, [(1, 0, 1.0, 0)])
    put(tmp_path, 1, [(1, 0, 2.0, 1), (1, 1, 3.0, 2), (1, 1, 4.0, 3)])
    put(tmp_path, 2, [(1, 0, 5.0, 4)])
    df = fan_in_stream(stream(spark, tmp_path), "id", "slot", "value", "seq", 2, dup="last",
                       complete="batch_arrivals")
    assert run(spark, df) == {(1, 0, 3, (2.0, 4.0))}


def random_with_outside(seed, n, rows):
    rng = random.Random(seed)
    return [(rng.randrange(3), rng.randrange(-1, n + 2), float(q), q) for q in range(rows)]


@pytest.mark.parametrize("n", [2, 20])
@pytest.mark.parametrize(
    "options", [{}, {"dup": "last"}, {"dup": "last", "complete": "arrivals", "fill": 0.0}])
def test_stream_equals_batch_with_slots_outside(spark, tmp_path, n, options):
    rows = random_with_outside(n, n, 600)
    for part in range(2):
        put(tmp_path, part, rows[part * 300:part * 300 + 300])
    df = fan_in_stream(stream(spark, tmp_path), "id", "slot", "value", "seq", n, **options)
    cycles = {} if "complete" in options else {"cycles": "all"}
    batch = fan_in(spark.createDataFrame(rows, SCHEMA), "id", "slot", "value", "seq", n,
                   **options, **cycles)
    want = {(r.id, r.cycle, r.completed_seq, tuple(r.vector)) for r in batch.collect()}
    assert want and run(spark, df) == want


def test_finished_ids_leave_no_state(spark, tmp_path):
    put(tmp_path, 0, [(i, s, 1.0, s) for i in range(50) for s in range(2)] + [(99, 0, 1.0, 9)])
    left = {}
    for forget in (False, True):
        df = fan_in_stream(stream(spark, tmp_path), "id", "slot", "value", "seq", 2, forget=forget)
        path = new_path(spark, "state-test")
        query = start(df, f"{path}-c", path=f"{path}-out")
        drain(query)
        left[forget] = max(state_rows_of(p) for p in query.recentProgress)
        assert len(spark.read.parquet(f"{path}-out").collect()) == 50
    assert left == {False: 51, True: 1}
    with pytest.raises(ValueError):
        fan_in_stream(stream(spark, tmp_path), "id", "slot", "value", "seq", 2, once=True, forget=True)


def state_rows_of(progress):
    return sum(op["numRowsTotal"] for op in progress["stateOperators"])


def test_wrong_stream_options(spark, tmp_path):
    put(tmp_path, 0, [(1, 0, 1.0, 0)])
    df = stream(spark, tmp_path)
    with pytest.raises(ValueError):
        fan_in_stream(df, "id", "slot", "value", "seq", 2, complete="arrivals")
    with pytest.raises(ValueError):
        fan_in_stream(df, "id", "slot", "value", "seq", 2, complete="never")


def test_state_with_a_time_to_live_runs(spark, tmp_path):
    put(tmp_path, 0, [(1, 0, 1.0, 0), (1, 1, 2.0, 1)])
    df = fan_in_stream(stream(spark, tmp_path), "id", "slot", "value", "seq", 2, ttl_ms=60_000)
    path = new_path(spark, "ttl-test")
    query = start(df, f"{path}-c", path=f"{path}-out", trigger="500 milliseconds")
    assert drain(query, timeout=90, idle=4) is False
    rows = spark.read.schema(df.schema).parquet(f"{path}-out").collect()
    assert [(r.id, r.vector) for r in rows] == [(1, [1.0, 2.0])]


def keyed(folder, *rows):
    put(folder, "m", rows, ("key", "value"))


def test_mirror_and_key_filter(spark, tmp_path):
    keyed(tmp_path, ("a", "1"), ("b", "2"))
    src = read_messages(spark, path=str(tmp_path), schema="key STRING, value STRING")
    path = new_path(spark, "mirror-test")
    drain(mirror(src, f"{path}-c", path=f"{path}-out", format="json"), timeout=120)
    copied = spark.read.schema("key STRING, value STRING").json(f"{path}-out")
    assert sorted(map(tuple, copied.collect())) == [("a", "1"), ("b", "2")]
    assert [tuple(r) for r in filter_key(copied, "b").collect()] == [("b", "2")]


def test_dead_letters_are_kept_apart(spark, tmp_path):
    keyed(tmp_path, ("1", "0|2.5"), ("1", "9|1"), ("1", "x"))
    src = read_messages(spark, path=str(tmp_path), schema="key STRING, value STRING")
    path = new_path(spark, "letters-test")
    writer = route_dead_letters(f"{path}-good", f"{path}-bad")
    drain(start(tag_messages(src, "P1", n=2), f"{path}-c", each_batch=writer))
    good = spark.read.parquet(f"{path}-good").select("image_id", "slot", "value")
    assert [tuple(r) for r in good.collect()] == [(1, 0, 2.5)]
    bad = spark.read.parquet(f"{path}-bad").select("key", "value", "reason")
    assert sorted(map(tuple, bad.collect())) == [
        ("1", "9|1", "slot out of range"), ("1", "x", "missing field"),
    ]


def test_written_messages_come_back(spark):
    df = spark.createDataFrame([(1, "a", 0), (2, "b", 1)], "key INT, value STRING, p INT")
    path = new_path(spark, "messages-test")
    write_messages(df, path=path, partition_by="p")
    back = spark.read.schema("key STRING, value STRING, partition INT").json(path)
    assert sorted(map(tuple, back.collect())) == [("1", "a", 0), ("2", "b", 1)]
    assert as_messages(df).columns == ["key", "value"]


def network(spark):
    rows = [
        (0, k, [float((3 * k + i) % 5 - 2) for i in range(4)], 0.5 - k, "relu", False, 3)
        for k in range(3)
    ] + [(1, k, [float(k - i) for i in range(3)], 0.25 * k, None, True, 2) for k in range(2)]
    return spark.createDataFrame(rows, schemas.NEURONS)


@pytest.mark.parametrize("by_messages", [False, True])
def test_streamed_predictions_equal_batch(spark, tmp_path, by_messages):
    rows = [(i, [((i * 7 + j * 3) % 11) / 4 - 1 for j in range(4)]) for i in range(30)]
    schema = "image_id BIGINT, features ARRAY<DOUBLE>"
    for part in range(2):
        put(tmp_path, part, rows[part * 15:part * 15 + 15], ("image_id", "features"))
    src = read_messages(spark, path=str(tmp_path), schema=schema, rate=1)
    path = new_path(spark, "predict-test")
    drain(predict_stream(src, network(spark), f"{path}-out", f"{path}-c", by_messages=by_messages))
    expected = predict(spark.createDataFrame(rows, schema), network(spark))
    got = scan_predictions(spark, f"{path}-out")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))


def test_streamed_prediction_files_are_short(spark, tmp_path):
    rows = [(i, [float(i % 5), 1.0, 0.0, -1.0]) for i in range(30)]
    put(tmp_path, 0, rows, ("image_id", "features"))
    src = read_messages(spark, path=str(tmp_path), schema="image_id BIGINT, features ARRAY<DOUBLE>")
    path = new_path(spark, "rotate-test")
    drain(predict_stream(src, network(spark), f"{path}-out", f"{path}-c", rows_per_file=7))
    sizes = [len(open(f"{path}-out/{f}").read().splitlines()) - 1
             for f in os.listdir(f"{path}-out") if f.endswith(".csv")]
    assert sum(sizes) == 30 and max(sizes) <= 7


def test_upserts_from_a_stream(spark, tmp_path):
    columns = ("image_id", "prediction", "seq")
    put(tmp_path, 0, [(1, 9, 1), (1, 3, 2), (2, 4, 1)], columns)
    put(tmp_path, 1, [(1, 5, 3)], columns)
    schema = f"{schemas.PREDICTIONS}, seq BIGINT"
    src = read_messages(spark, path=str(tmp_path), schema=schema, rate=1)
    path = new_path(spark, "upsert-test")
    drain(start(src, f"{path}-c", each_batch=lambda df, i: upsert_predictions(df, i, path, "seq")))
    assert sorted(map(tuple, read_upserts(spark, path).collect())) == [(1, 5), (2, 4)]


def test_the_topic_reader_asks_for_its_connector(spark):
    """The connector is not part of a plain installation; the options reach it."""
    with pytest.raises(Exception, match="(?i)kafka"):
        read_messages(spark, topic="layer-0", servers="broker:9092", start="latest", rate=50,
                      fail_on_data_loss=False).select(F.col("key"))


@pytest.mark.parametrize("rate", [1, 5])
@pytest.mark.parametrize("version", ["arrival", None])
def test_vectors_of_one_id_do_not_mix(spark, tmp_path, rate, version):
    """Different vectors of an id in one micro-batch, and again in later ones."""
    neurons = network(spark)
    rng = random.Random(4)
    rows = [(i % 3, [rng.uniform(-1, 1) for _ in range(4)], n * 100 + i)
            for n in range(3) for i in range(20)]
    for n in range(3):
        put(tmp_path, f"v{n}", [r for r in rows if r[2] // 100 == n],
            ("image_id", "features", "arrival"))
    src = read_messages(
        spark, path=str(tmp_path), rate=rate,
        schema="image_id BIGINT, features ARRAY<DOUBLE>, arrival BIGINT")
    out = predictions_by_messages(src, neurons, version=version)
    path = new_path(spark, "versions")
    drain(start(out, f"{path}-checkpoint", path=f"{path}-out"))
    got = spark.read.schema(out.schema).parquet(f"{path}-out").collect()
    df = spark.createDataFrame(rows, "image_id BIGINT, features ARRAY<DOUBLE>, arrival BIGINT")
    want = predict(df, neurons).collect()
    names = ["image_id", "arrival", "prediction"] if version else ["image_id", "prediction"]
    assert sorted(tuple(r[c] for c in names) for r in got) == sorted(
        tuple(r[c] for c in names) for r in want)
