"""Training folds and bounded samples of labelled and unlabelled documents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id: str, folds: int) -> Column:
    """The fold of a row, from the CRC-32 of its id as text; null for a null id."""
    return F.pmod(F.crc32(F.col(id).cast("string")), F.lit(folds))


def in_fold(id: str, folds: int, number: int) -> Column:
    """Whether a row is in that fold; rows without an id are in none."""
    return F.coalesce(fold(id, folds) == number, F.lit(False))


def clear_labels(labels: DataFrame, id: str, label: str) -> DataFrame:
    """``(id, y)`` of every id whose label is 0 or 1 in all its rows."""
    y = F.col(label).cast("int")
    return (
        labels.filter(F.col(id).isNotNull() & y.isin(0, 1))
        .groupBy(F.col(id).alias("id"))
        .agg(F.min(y).alias("y"), F.max(y).alias("y_max"))
        .filter("y = y_max")
        .select("id", "y")
    )


def hash_sample(ids: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows, chosen by a hash of the id; planned as a top-n."""
    return ids.orderBy(F.xxhash64("id"), "id").limit(most)


def sampled_texts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(y, text)`` of the sampled ids, one row each however many rows an id has.

    ``texts`` has ``(id, text)`` and ``wanted`` ``(id, y)``, each id once. Of different texts
    of an id, that with the least hash is taken, already in the tasks that read them.
    """
    one = F.min_by("text", F.xxhash64("text")).alias("text")
    return texts.join(F.broadcast(wanted), "id").groupBy("id", "y").agg(one).select("y", "text")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def platt(s: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and offset of the logistic curve that turns a score into a probability."""
    weight = np.ones(len(s)) if weight is None else weight
    centre, spread = float(s.mean()), float(s.std()) + 1e-9
    x, total = (s - centre) / spread, weight.sum()
    a, b = 1.0, 0.0
    for _ in range(100):
        p = sigmoid(a * x + b)
        pull, curve = weight * (p - y), weight * p * (1 - p)
        gradient = np.array([(pull * x).sum() / total + 1e-3 * a, pull.sum() / total])
        cross = (curve * x).sum() / total
        hessian = np.array([[(curve * x * x).sum() / total + 1e-3, cross],
                            [cross, curve.sum() / total + 1e-6]])
        step = np.clip(np.linalg.solve(hessian, gradient), -2, 2)
        a, b = a - step[0], b - step[1]
    return a / spread, b - a * centre / spread
