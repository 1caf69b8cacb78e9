"""Accuracy, prediction logs, splits, loss and training."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fanweave.functions import argmax
from fanweave.functions.permutation import PRIME, round_keys
from fanweave.operators.evaluate import (
    accuracy,
    cross_entropy,
    evaluate,
    missing_predictions,
    split,
    verdicts,
)
from fanweave.operators.forward import logits, predict
from fanweave.operators.rows import with_row_id
from fanweave.operators.train import epoch_batches, train
from fanweave.plans import query
from fanweave.plans.tables import (
    CENTROID_SQL,
    FORWARD_SQL,
    STATISTICS_SQL,
    centroid_neurons,
    formula_neurons,
    images,
    table,
)
from fanweave.session import new_path
from fanweave.sinks import latest_predictions, write_predictions
from fanweave.sources import scan_predictions

CONFIDENT_SQL = f"WITH {STATISTICS_SQL}, {CENTROID_SQL}"
BOTH_SQL = f"""WITH {FORWARD_SQL},
{STATISTICS_SQL.split("cells AS", 1)[1].split("),", 1)[1]}, {CENTROID_SQL},
log AS (
  SELECT image_id, prediction, 1 AS seq FROM formula
  UNION ALL SELECT image_id, prediction, 2 FROM confident
)"""
TEXT_SQL = "printf('%.2f%%', accuracy * 100) AS accuracy_text"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), "label")


def _confident(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-mean predictions with a positive score; other images have none."""
    vectors = images(spark, sf_dir)
    scored = logits(vectors.select("image_id", "features"), centroid_neurons(vectors))
    return scored.filter(F.array_max("features") > 0).select(
        "image_id", argmax(F.col("features")).alias("prediction")
    )


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of two models in order; an id can occur twice."""
    first = predict(images(spark, sf_dir).select("image_id", "features"), formula_neurons(spark))
    return first.withColumn("seq", F.lit(1)).unionByName(
        _confident(spark, sf_dir).withColumn("seq", F.lit(2))
    )


def _accuracy_sql(head: str, sums: str, empty: str = "NULL") -> str:
    return f"""{head}, sums AS ({sums}),
    ratio AS (SELECT CAST(correct AS BIGINT) AS correct, CAST(total AS BIGINT) AS total,
                     CASE WHEN total > 0 THEN correct / total::DOUBLE ELSE {empty} END AS accuracy
              FROM sums)
    SELECT correct, total, accuracy, {TEXT_SQL} FROM ratio"""


@query(
    "accuracy_inner",
    _accuracy_sql(
        BOTH_SQL,
        "SELECT count(*) FILTER (WHERE label = prediction) AS correct, count(*) AS total "
        "FROM log JOIN embeddings ON vec_id = image_id",
    ),
)
def q_accuracy_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accuracy(_labels(spark, sf_dir), _log(spark, sf_dir))


@query(
    "accuracy_all_labels",
    _accuracy_sql(
        CONFIDENT_SQL,
        "SELECT count(*) FILTER (WHERE label = prediction) AS correct, count(*) AS total "
        "FROM embeddings LEFT JOIN confident ON vec_id = image_id", "0",
    ),
)
def q_accuracy_all_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accuracy(_labels(spark, sf_dir), _confident(spark, sf_dir), base="labels")


@query(
    "accuracy_limited",
    _accuracy_sql(
        CONFIDENT_SQL,
        "SELECT count(*) FILTER (WHERE label = prediction) AS correct, count(*) AS total "
        "FROM (SELECT * FROM embeddings ORDER BY vec_id LIMIT 100) "
        "JOIN confident ON vec_id = image_id",
    ),
)
def q_accuracy_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accuracy(_labels(spark, sf_dir), _confident(spark, sf_dir), limit=100)


@query(
    "accuracy_predicted",
    _accuracy_sql(
        BOTH_SQL,
        "SELECT count(*) FILTER (WHERE label = prediction) AS correct, count(*) AS total "
        "FROM (SELECT image_id, arg_max(prediction, seq) AS prediction FROM log GROUP BY image_id) "
        "LEFT JOIN embeddings ON vec_id = image_id",
    ),
)
def q_accuracy_predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accuracy(_labels(spark, sf_dir), _log(spark, sf_dir), base="predictions", seq="seq")


@query(
    "verdicts",
    f"""{CONFIDENT_SQL}
    SELECT vec_id AS image_id, CAST(e.label AS INTEGER) AS label, prediction,
           CASE WHEN prediction IS NULL THEN 'missing' WHEN e.label = prediction THEN 'correct'
                ELSE 'wrong' END AS verdict
    FROM embeddings e LEFT JOIN confident ON vec_id = image_id""",
)
def q_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(_labels(spark, sf_dir), _confident(spark, sf_dir))


@query(
    "missing_predictions",
    f"""{CONFIDENT_SQL}
    SELECT vec_id AS image_id, CAST(label AS INTEGER) AS label FROM embeddings
    WHERE vec_id NOT IN (SELECT image_id FROM confident)""",
)
def q_missing_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing_predictions(_labels(spark, sf_dir), _confident(spark, sf_dir))


@query(
    "evaluate",
    f"""{CONFIDENT_SQL}
    SELECT count(*) FILTER (WHERE label = prediction) AS correct, count(*) AS total,
           count(*) FILTER (WHERE label = prediction) / count(*)::DOUBLE AS accuracy
    FROM embeddings JOIN centroid ON vec_id = image_id""",
)
def q_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = images(spark, sf_dir)
    return evaluate(vectors, centroid_neurons(vectors))


@query(
    "latest_prediction",
    f"{BOTH_SQL} SELECT image_id, arg_max(prediction, seq) AS prediction FROM log GROUP BY image_id",
)
def q_latest_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_predictions(_log(spark, sf_dir))


@query("predictions_roundtrip",
       f"WITH {FORWARD_SQL} SELECT image_id, prediction FROM formula")
def q_predictions_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "predictions")
    vectors = images(spark, sf_dir).select("image_id", "features")
    write_predictions(predict(vectors, formula_neurons(spark)), folder)
    return scan_predictions(spark, folder)


@query(
    "train_test_split",
    "SELECT vec_id AS image_id, CASE WHEN vec_id % 5 = 0 THEN 'test' ELSE 'train' END AS part "
    "FROM embeddings",
)
def q_train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    train_rows, test_rows = split(_labels(spark, sf_dir).select("image_id"), "image_id", 5)
    return train_rows.withColumn("part", F.lit("train")).unionByName(
        test_rows.withColumn("part", F.lit("test"))
    )


@query(
    "cross_entropy",
    f"""WITH {FORWARD_SQL},
    shifted AS (SELECT image_id, label, slot, z - max(z) OVER (PARTITION BY image_id) AS s FROM z1),
    p AS (SELECT label, slot, exp(s) / sum(exp(s)) OVER (PARTITION BY image_id) AS p FROM shifted)
    SELECT round(avg(-ln(p)), 9) AS loss, count(*) AS rows FROM p WHERE slot = label""",
)
def q_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = logits(images(spark, sf_dir), formula_neurons(spark))
    return cross_entropy(scored).withColumn("loss", F.round("loss", 9))


# one full-batch Adam step from the formula network, and the loss before and after it
TRAIN_SQL = f"""WITH {FORWARD_SQL},
shifted AS (SELECT image_id, label, slot, z - max(z) OVER (PARTITION BY image_id) AS s FROM z1),
probs AS (SELECT image_id, label, slot, exp(s) / sum(exp(s)) OVER (PARTITION BY image_id) AS p
          FROM shifted),
delta AS (SELECT image_id, slot AS k,
            (p - CASE WHEN slot = label THEN 1 ELSE 0 END) / (SELECT count(*) FROM embeddings) AS d
          FROM probs),
back AS (SELECT d.image_id, w.slot AS j, sum(d.d * w.w) AS d
         FROM delta d JOIN w1 w ON w.neuron = d.k
         JOIN z0 z ON z.image_id = d.image_id AND z.neuron = w.slot WHERE z.z > 0
         GROUP BY d.image_id, w.slot),
g1 AS (SELECT h.slot, d.k AS neuron, sum(h.x * d.d) AS g
       FROM h0 h JOIN delta d ON h.image_id = d.image_id GROUP BY h.slot, d.k),
gb1 AS (SELECT k AS neuron, sum(d) AS g FROM delta GROUP BY k),
g0 AS (SELECT c.slot, b.j AS neuron, sum(c.x * b.d) AS g
       FROM cells c JOIN back b ON c.image_id = b.image_id GROUP BY c.slot, b.j),
gb0 AS (SELECT j AS neuron, sum(d) AS g FROM back GROUP BY j),
u0 AS (SELECT w.slot, w.neuron, w.w - 0.01 * coalesce(g.g, 0) / (abs(coalesce(g.g, 0)) + 1e-8) AS w,
         w.bias - 0.01 * coalesce(b.g, 0) / (abs(coalesce(b.g, 0)) + 1e-8) AS bias
       FROM w0 w LEFT JOIN g0 g USING (slot, neuron) LEFT JOIN gb0 b ON b.neuron = w.neuron),
u1 AS (SELECT w.slot, w.neuron, w.w - 0.01 * coalesce(g.g, 0) / (abs(coalesce(g.g, 0)) + 1e-8) AS w,
         w.bias - 0.01 * coalesce(b.g, 0) / (abs(coalesce(b.g, 0)) + 1e-8) AS bias
       FROM w1 w LEFT JOIN g1 g USING (slot, neuron) LEFT JOIN gb1 b ON b.neuron = w.neuron),
y0 AS (SELECT image_id, label, neuron AS slot, greatest(sum(x * w) + any_value(bias), 0) AS x
       FROM cells JOIN u0 USING (slot) GROUP BY image_id, label, neuron),
y1 AS (SELECT image_id, label, neuron AS slot, sum(x * w) + any_value(bias) AS z
       FROM y0 JOIN u1 USING (slot) GROUP BY image_id, label, neuron),
after_shift AS (SELECT image_id, label, slot, z - max(z) OVER (PARTITION BY image_id) AS s FROM y1),
after AS (SELECT label, slot, exp(s) / sum(exp(s)) OVER (PARTITION BY image_id) AS p FROM after_shift)
SELECT CAST(1 AS INTEGER) AS epoch, CAST(1 AS INTEGER) AS step, round(avg(-ln(p)), 6) AS loss
FROM probs WHERE slot = label
UNION ALL SELECT CAST(2 AS INTEGER), CAST(1 AS INTEGER), round(avg(-ln(p)), 6)
FROM after WHERE slot = label"""


@query("train_epoch_loss", TRAIN_SQL)
def q_train_epoch_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses before and after one step over all rows."""
    _, losses = train(
        images(spark, sf_dir), epochs=2, batch=1 << 40, lr=0.01, initial=formula_neurons(spark))
    return losses.withColumn("loss", F.round("loss", 6))


def _permutation_sql(number: str, *key: object) -> str:
    """One pass of the network over ``number``; ``a`` and ``b`` are columns."""
    left, right = f"({number} // b)", f"({number} % b)"
    for k, (factor, offset) in enumerate(round_keys(*key)):
        if k % 2 == 0:
            left = f"(({left} + ({right} * {factor} + {offset}) % {PRIME}) % a)"
        else:
            right = f"(({right} + ({left} * {factor} + {offset}) % {PRIME}) % b)"
    return f"{left} * b + {right}"


EPOCH_SQL = f"""WITH RECURSIVE grid AS (
  SELECT n, a, CAST(ceil(n / a) AS BIGINT) AS b FROM (
    SELECT count(*) AS n, CAST(floor(sqrt(count(*) - 1)) AS BIGINT) + 1 AS a FROM embeddings)),
numbered AS (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS i, n, a, b FROM embeddings, grid),
walk AS (
  SELECT e AS epoch, vec_id, n, a, b,
         CASE e WHEN 0 THEN {_permutation_sql("i", "epoch", 7, 0)}
                ELSE {_permutation_sql("i", "epoch", 7, 1)} END AS place
  FROM numbered, range(2) AS r(e)
  UNION ALL
  SELECT epoch, vec_id, n, a, b,
         CASE epoch WHEN 0 THEN {_permutation_sql("place", "epoch", 7, 0)}
                    ELSE {_permutation_sql("place", "epoch", 7, 1)} END
  FROM walk WHERE place >= n)
SELECT CAST(epoch AS INTEGER) AS epoch, vec_id AS image_id, place // 64 AS batch, place % 64 AS pos
FROM walk WHERE place < n"""


@query("epoch_batches", EPOCH_SQL)
def q_epoch_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mini-batches of 64 rows in the orders of two epochs."""
    rows = with_row_id(images(spark, sf_dir).select("image_id"), ["image_id"])
    n = rows.count()
    first, second = (
        epoch_batches(rows, n, 64, epoch, seed=7).withColumn("epoch", F.lit(epoch))
        for epoch in (0, 1))
    return first.unionByName(second).select("epoch", "image_id", "batch", "pos")


@query("train_mini_batches")
def q_train_mini_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses of mini-batches of 200 rows; tested against a loop over the same rows."""
    _, losses = train(images(spark, sf_dir), hidden=32, epochs=2, batch=200, report_every=1)
    return losses
