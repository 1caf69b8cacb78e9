"""Quality classifier by positive-unlabelled learning.

The model is linear over statistics of the whole text (``text_stats``). It is fitted to
trusted positives P (label 1) and unlabelled documents U by minimising the non-negative
unbiased risk

    prior * E_P[l(f)] + max(0, E_U[l(-f)] - prior * E_P[l(-f)])

with the sigmoid loss; where the second part turns negative, its gradient is reversed.
The prior is estimated from P and U alone (``estimated_prior``): margins of held-out rows tell which
part of U lies where only positives are. A logistic curve that turns the margin into a
probability is fitted to P and U with that prior. So no labelled negative is ever looked at.

Fitting uses at most ``MAX_LABELLED`` positives and ``MAX_UNLABELLED`` unlabelled documents, chosen
by a hash of their id; an id counts once, however many rows have it. Scoring is one narrow pass
over all documents.

Defined results: a null text counts as empty and is scored. Rows with a null id are
scored and in no fold. Ids with contradictory labels are not learned from. Without
positives every score is 0.5; without unlabelled documents the labelled ones of the training fold,
whatever their label, stand in.
An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fanweave.llm.labels import clear_labels, hash_sample, sampled_texts, sigmoid
from fanweave.llm.rows import small_batches
from fanweave.llm.text_stats import N_FEATURES, features
from fanweave.session import stage

#: bounds of what a fit reads
MAX_LABELLED = 12_000
MAX_UNLABELLED = 12_000
STEPS = 600
#: a document is accepted from this score on
ACCEPT = 0.3
#: the prior of the margins that the estimate is made with, and of too few rows
UNKNOWN_PRIOR = 0.5
FOLDS = 4
#: small parts need a smoother margin
FOLD_DECAY = 1e-2
#: standard errors of the bound that chooses the estimate's threshold
ERRORS = 2.0
#: the least part of the positives above a threshold
LEAST_PART = 0.2


@dataclass
class QualityModel:
    """Scaling, weights and calibration; a few hundred numbers."""

    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    offset: float
    slope: float
    shift: float
    prior: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.spread, -6, 6)
        return z @ self.weights + self.offset

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * self.margin(x) + self.shift)


def risk_parts(fp: np.ndarray, fu: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the unbiased risk for margins of P and U, sigmoid loss."""
    return float(prior * sigmoid(-fp).mean()), float(
        sigmoid(fu).mean() - prior * sigmoid(fp).mean()
    )


def fit_nnpu(
    p: np.ndarray, u: np.ndarray, prior: float, steps: int = STEPS, rate: float = 0.03,
    decay: float = 1e-3,
) -> tuple[np.ndarray, float]:
    """Weights and offset with the least non-negative risk, by Adam on full batches."""
    theta = np.zeros(p.shape[1] + 1)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        fp, fu = p @ theta[:-1] + theta[-1], u @ theta[:-1] + theta[-1]
        curve_p, curve_u = sigmoid(fp) * sigmoid(-fp) / len(p), sigmoid(fu) * sigmoid(-fu) / len(u)
        if risk_parts(fp, fu, prior)[1] >= 0:
            pull_p, pull_u = -2 * prior * curve_p, curve_u
        else:
            pull_p, pull_u = prior * curve_p, -curve_u
        gradient = np.concatenate(
            [p.T @ pull_p + u.T @ pull_u + decay * theta[:-1], [pull_p.sum() + pull_u.sum()]]
        )
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        theta -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def best_bin(p: np.ndarray, u: np.ndarray) -> float:
    """The share of positives in ``u`` from margins of held-out positives and unlabelled rows.

    Above any threshold, the part of ``u`` is at least the share times the part of ``p``, and about
    equal to it where no negative is above, so low ratios of the two parts come near the share.
    Few rows make a ratio low by chance: the bound is the least ratio plus ``ERRORS`` standard
    errors, and of the thresholds whose ratio agrees with the bound the lowest is taken, which
    has most rows above.
    """
    p, u = np.sort(p), np.sort(u)
    cuts = np.unique(p)
    above_p = 1 - np.searchsorted(p, cuts) / len(p)
    above_u = 1 - np.searchsorted(u, cuts) / len(u)
    ratio = above_u / above_p
    error = ERRORS / above_p * np.sqrt(
        above_u * (1 - above_u) / len(u) + ratio**2 * above_p * (1 - above_p) / len(p))
    # the errors of few rows are not known well enough
    error[above_p < LEAST_PART] = np.inf
    agrees = ratio - error <= (ratio + error).min()
    return float(ratio[np.flatnonzero(agrees)[0]])


def estimated_prior(p: np.ndarray, u: np.ndarray) -> float:
    """The class prior from positives and unlabelled rows alone.

    Every row gets its margin from a fit without it: the rows are dealt into ``FOLDS`` parts, and
    the margins of a part come from the others. Margins of different fits are made alike by
    the centre and spread of those fits' unlabelled rows.
    """
    if min(len(p), len(u)) < 2 * FOLDS:
        return UNKNOWN_PRIOR
    of_p, of_u = np.arange(len(p)) % FOLDS, np.arange(len(u)) % FOLDS
    margin_p, margin_u = np.zeros(len(p)), np.zeros(len(u))
    for k in range(FOLDS):
        weights, offset = fit_nnpu(
            p[of_p != k], u[of_u != k], UNKNOWN_PRIOR, steps=STEPS // 2, decay=FOLD_DECAY)
        seen = u[of_u != k] @ weights
        for rows, part, out in ((p, of_p == k, margin_p), (u, of_u == k, margin_u)):
            out[part] = (rows[part] @ weights - seen.mean()) / (seen.std() + 1e-9)
    return float(np.clip(best_bin(margin_p, margin_u), 0.02, 0.98))


def calibrated(fp: np.ndarray, fu: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and offset of the curve that makes probabilities of margins, without negatives.

    The logistic risk of P and U is ``E_u log(1 + exp f) - prior E_p f``, which is convex.
    """
    centre, spread = float(fu.mean()), float(fu.std()) + 1e-9
    xp, xu = (np.stack([(f - centre) / spread, np.ones(len(f))], 1) for f in (fp, fu))
    theta = np.array([1.0, 0.0])
    for _ in range(100):
        q = sigmoid(xu @ theta)
        gradient = (xu * q[:, None]).mean(0) - prior * xp.mean(0) + 1e-3 * theta * [1, 0]
        hessian = (xu.T * (q * (1 - q))) @ xu / len(xu) + np.diag([1e-3, 1e-6])
        theta = theta - np.clip(np.linalg.solve(hessian, gradient), -2, 2)
    return float(theta[0] / spread), float(theta[1] - theta[0] * centre / spread)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = features(batch.column("text"))
        packed = pa.array([row.tobytes() for row in x], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("y"), packed], ["y", "x"])


def fit_quality(
    docs: DataFrame, labels: DataFrame, training: Column, id: str = "doc_id",
    text: str = "text", label: str = "quality", max_labelled: int = MAX_LABELLED,
    max_unlabelled: int = MAX_UNLABELLED,
) -> QualityModel:
    """Fit on the positives for which ``training`` (over the label table) holds, and on rows
    that the label table does not know. Labelled negatives are not looked at."""
    trusted = clear_labels(labels.filter(training), id, label).filter("y = 1")
    known = hash_sample(trusted, max_labelled)
    named = docs.select(F.col(id).alias("id")).filter("id is not null")
    marked = labels.select(F.col(id).alias("id"))
    free = hash_sample(named.join(marked, "id", "left_anti").distinct(), max_unlabelled)
    unlabelled = F.lit(-1).alias("y")
    wanted = stage(known.unionByName(free.select("id", unlabelled)), "quality-sample")
    if wanted.filter("y < 0").isEmpty():
        known_ids = labels.filter(training & F.col(id).isNotNull()).select(F.col(id).alias("id"))
        stand_in = hash_sample(known_ids.distinct(), max_unlabelled)
        wanted = wanted.unionByName(stand_in.select("id", unlabelled))
    texts = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    # the sample's size is bounded by the two parameters
    chosen = sampled_texts(texts, wanted)
    rows = small_batches(chosen).mapInArrow(_feature_rows, "y int, x binary").toPandas()
    x = np.frombuffer(b"".join(rows["x"]), np.float32).reshape(-1, N_FEATURES).astype(np.float64)
    y = rows["y"].to_numpy(np.int64) if len(rows) else np.zeros(0, np.int64)
    order = np.lexsort((*x.T[:8], y))  # the result must not depend on the order of arrival
    x, y = x[order], y[order]
    positive = y == 1
    if not positive.any():
        flat = np.zeros(N_FEATURES)
        return QualityModel(flat, flat + 1, flat, 0.0, 0.0, 0.0, 0.5)
    pool = ~positive if not positive.all() else positive
    centre, spread = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - centre) / spread, -6, 6)
    prior = estimated_prior(z[positive], z[pool])
    weights, offset = fit_nnpu(z[positive], z[pool], prior)
    model = QualityModel(centre, spread, weights, offset, 1.0, 0.0, prior)
    margin = z @ weights + offset
    model.slope, model.shift = calibrated(margin[positive], margin[pool], prior)
    return model


def score_quality(
    docs: DataFrame, model: QualityModel, text: str = "text", score: str = "score"
) -> DataFrame:
    """All columns of ``docs`` and the score; an existing column of that name is replaced."""
    kept = [c for c in docs.columns if c.lower() != score.lower()]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = model.score(features(batch.column(text)).astype(np.float64))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(values)], [*kept, score]
            )

    return small_batches(docs).mapInArrow(run, schema)
