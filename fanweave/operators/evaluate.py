"""Evaluation of predictions against labels.

Copies of an id are counted before any join, so a repeated id costs one row per
distinct value and not one per copy, nor their product.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanweave.functions.vectors import percent_text, softmax
from fanweave.operators.forward import BROADCAST_LIMIT, predict
from fanweave.sinks.predictions import latest_predictions


def _counted(df: DataFrame, value: str, count: str) -> DataFrame:
    return df.groupBy("image_id", value).agg(F.count(F.lit(1)).alias(count))


def _one_per_id(predictions: DataFrame, seq: str | None) -> DataFrame:
    """One prediction per id: the latest, or the largest if no order is known."""
    return latest_predictions(predictions, "image_id", seq or "prediction")


def accuracy(
    labels: DataFrame, predictions: DataFrame, base: str = "inner",
    limit: int | None = None, seq: str | None = None,
) -> DataFrame:
    """One row ``(correct, total, accuracy, accuracy_text)``.

    * ``inner``: labels joined with predictions; ids on one side only do not
      count, repeated ids count once per pair.
    * ``labels``: all labels; a missing prediction is wrong; 0 without labels.
    * ``predictions``: all predicted ids; a missing label is wrong.

    ``limit`` keeps the first labels by id. With the last two bases an id has one
    prediction: the latest by ``seq``, or the largest if no ``seq`` is given.
    """
    if limit is not None:
        labels = labels.orderBy("image_id").limit(limit)
    right = F.coalesce(F.col("label") == F.col("prediction"), F.lit(False))
    if base == "inner":
        pairs = _counted(labels, "label", "cl").join(
            _counted(predictions, "prediction", "cp"), "image_id"
        )
        weight = F.col("cl") * F.col("cp")
    elif base == "labels":
        pairs = _counted(labels, "label", "cl").join(
            _one_per_id(predictions, seq), "image_id", "left"
        )
        weight = F.col("cl")
    elif base == "predictions":
        pairs = _one_per_id(predictions, seq).join(
            labels.select("image_id", "label").distinct(), "image_id", "left"
        )
        weight = F.lit(1)
    else:
        raise ValueError("base is 'inner', 'labels' or 'predictions'")
    sums = pairs.agg(
        F.coalesce(F.sum(F.when(right, weight)), F.lit(0)).cast("bigint").alias("correct"),
        F.coalesce(F.sum(weight), F.lit(0)).cast("bigint").alias("total"),
    )
    ratio = F.when(F.col("total") > 0, F.col("correct") / F.col("total"))
    if base == "labels":
        ratio = F.coalesce(ratio, F.lit(0.0))
    return sums.withColumn("accuracy", ratio).withColumn(
        "accuracy_text", F.when(F.col("accuracy").isNotNull(), percent_text(F.col("accuracy")))
    )


def verdicts(labels: DataFrame, predictions: DataFrame, seq: str | None = None) -> DataFrame:
    """``correct``, ``wrong`` or ``missing`` for every label."""
    verdict = (
        F.when(F.col("prediction").isNull(), "missing")
        .when(F.col("label") == F.col("prediction"), "correct")
        .otherwise("wrong")
    )
    return (
        labels.select("image_id", "label")
        .join(_one_per_id(predictions, seq), "image_id", "left")
        .withColumn("verdict", verdict)
    )


def missing_predictions(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """Labels whose id has no prediction."""
    known = predictions.select("image_id").distinct()
    return labels.select("image_id", "label").join(known, "image_id", "left_anti")


def evaluate(images: DataFrame, neurons: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Accuracy of the model on labelled images, scored in place without a join."""
    scored = predict(images.select("label", "features"), neurons, limit=limit)
    right = F.when(F.col("label") == F.col("prediction"), 1)
    return scored.agg(
        F.count(right).alias("correct"), F.count(F.lit(1)).alias("total")
    ).withColumn("accuracy", F.when(F.col("total") > 0, F.col("correct") / F.col("total")))


def split(df: DataFrame, id: str, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """``(train, test)``: one id in ``k`` is for testing; the same on every run."""
    is_test = F.pmod(F.col(id), F.lit(k)) == 0
    return df.filter(~is_test), df.filter(is_test)


def cross_entropy(scored: DataFrame, logits: str = "features", label: str = "label") -> DataFrame:
    """Mean ``-log softmax(logits)[label]`` over all rows."""
    p = F.element_at(softmax(F.col(logits)), F.col(label) + 1)
    return scored.agg(F.avg(-F.log(p)).alias("loss"), F.count(F.lit(1)).alias("rows"))
