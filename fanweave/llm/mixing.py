"""Mixing to target weights with soft domain membership.

A classifier, learned from the label table, gives every document posterior
probabilities of its domains. Documents get nonnegative rates w such that the expected
tokens of each domain, the sum of w * tokens * posterior, meet the targets as well as
they can: the least value of

    1/2 * sum_d (sum_i w_i t_i p_id - T_d)^2 / (S E_d) + ridge/2 * sum_i (t_i / S) (w_i - 1)^2

with the tokens t_i, posteriors p_i, targets T_d, S the sum of all tokens and E_d the
expected tokens of a domain at rate 1, so that domains count by their relative error.
Measured in the weights t_i / S the gradient for a document is
``p_i . r + ridge * (w_i - 1)`` with the relative residuals r of all domains. The rates are found
by projected gradient steps, ``w_i <- max(0, w_i - length * step_i)``. Plain steps would need
thousands of rounds where posteriors are diffuse, so the gradient is preconditioned with the Hessian
over the rates that are free to move. It is ``ridge`` times the identity plus a matrix of the rank
of the domains, so a few numbers describe the step of every document:
``step_i = p_i . pull / ridge + (w_i - 1)``. A rate at its bound whose gradient pushes on stays there.

A round is two narrow passes: one sums the Hessian and finds the norm of the projected gradient, one
tries a few lengths at once and sums the expected tokens and by how much the loss changes. No length
makes progress where rates just above their bounds are in the way of the preconditioned step; a third
pass then tries a plain one. No rate is stored between rounds: a
task replays the rounds, each of two vectors and a length. Nothing is shuffled but the sums of a
task. The search ends when the projected gradient is below ``TOLERANCE`` for every
document, which proves that no other rates are better; there is no limit of rounds.

The whole number of copies of a document is its rate, rounded up or down by a hash of its
id so that the expectation is the rate.

Domains are the combinations of the labels: low, low and toxic, good, good and toxic. The
classifier is a softmax regression over statistics of the text and the toxicity score,
fitted to at most ``MAX_LABELLED`` labelled documents, chosen by a hash of their id.

Defined results: a null text counts as empty and has no tokens; its rate is computed, too.
Null and repeated ids are allowed. Ids with contradictory labels are not learned from.
Without labels all posteriors are equal. Domains that no document can belong to are left
out of the targets. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fanweave.llm.labels import clear_labels, hash_sample, sampled_texts
from fanweave.llm.packing import word_count
from fanweave.llm.rows import fresh, small_batches
from fanweave.llm.text_stats import N_FEATURES, features
from fanweave.llm.toxicity import ToxicityModel, fit_toxicity
from fanweave.llm.words import text_slices
from fanweave.session import stage

#: in the order of 2 * quality + toxic
DOMAINS = ("low", "low_toxic", "good", "good_toxic")
#: wanted tokens of each domain, as multiples of the tokens of all good documents
TARGETS = {"low": 0.02, "low_toxic": 0.0, "good": 1.1, "good_toxic": 0.02}
MAX_LABELLED = 12_000
RIDGE = 1e-3
#: of the projected gradient of every document at the end
TOLERANCE = 1e-8
#: lengths of a preconditioned step that one pass tries
LENGTHS = 0.5 ** np.arange(12)


# --- posteriors ------------------------------------------------------------------------------


@dataclass
class DomainModel:
    """Softmax regression over text statistics and the toxicity score."""

    toxicity: ToxicityModel = field(default_factory=ToxicityModel)
    centre: np.ndarray | None = None
    spread: np.ndarray | None = None
    weights: np.ndarray | None = None

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full((len(x), len(DOMAINS)), 1.0 / len(DOMAINS))
        z = np.clip((x - self.centre) / self.spread, -6, 6)
        return softmax(np.hstack([z, np.ones((len(z), 1))]) @ self.weights)


def softmax(logits: np.ndarray) -> np.ndarray:
    powers = np.exp(logits - logits.max(1, keepdims=True))
    return powers / powers.sum(1, keepdims=True)


def fit_softmax(
    x: np.ndarray, y: np.ndarray, classes: int, steps: int = 400, rate: float = 0.05,
    decay: float = 1e-3,
) -> np.ndarray:
    """Weights (features and offset x classes); classes that do not occur stay impossible."""
    z = np.hstack([x, np.ones((len(x), 1))])
    wanted = np.eye(classes)[y]
    present = wanted.any(0)
    w = np.zeros((z.shape[1], classes))
    w[-1, ~present] = -30.0
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        gradient = z.T @ (softmax(z @ w) - wanted) / len(z) + decay * w
        gradient[:, ~present] = 0.0
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w


def _inputs(texts: pa.Array, toxic: np.ndarray) -> np.ndarray:
    score = np.clip(toxic, 1e-6, 1 - 1e-6)
    return np.hstack([features(texts).astype(np.float64), np.log(score / (1 - score))[:, None]])


def _input_rows(toxicity: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = toxicity.scorer()
        for batch in batches:
            texts = batch.column("text")
            rows = pa.array([row.tobytes() for row in _inputs(texts, score(texts))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("y"), rows], ["y", "x"])

    return run


def fit_domains(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text",
    quality: str = "quality", toxic: str = "toxic", max_labelled: int = MAX_LABELLED,
) -> DomainModel:
    """Learn the domains' posteriors from the label table."""
    good, bad = clear_labels(labels, id, quality), clear_labels(labels, id, toxic)
    known = good.join(bad.withColumnRenamed("y", "t"), "id").select(
        "id", (F.col("y") * 2 + F.col("t")).alias("y")
    )
    wanted = stage(hash_sample(known, max_labelled), "labelled-sample")
    model = DomainModel(fit_toxicity(docs, labels, F.lit(True), id, text, toxic))
    texts = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    # the sample's size is bounded by the parameter
    chosen = sampled_texts(texts, wanted)
    rows = chosen.mapInArrow(_input_rows(model.toxicity), "y int, x binary").toPandas()
    if not len(rows):
        return model
    x = np.frombuffer(b"".join(rows["x"]), np.float64).reshape(-1, N_FEATURES + 1)
    y = rows["y"].to_numpy(np.int64)
    order = np.lexsort((*x.T[:8], y))  # the result must not depend on the order of arrival
    x, y = x[order], y[order]
    model.centre, model.spread = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - model.centre) / model.spread, -6, 6)
    model.weights = fit_softmax(z, y, len(DOMAINS))
    return model


def clean_ids(
    labels: DataFrame, id: str = "doc_id", quality: str = "quality", toxic: str = "toxic"
) -> DataFrame:
    """The ids (``id``) that the label table calls good and not toxic."""
    good, bad = clear_labels(labels, id, quality), clear_labels(labels, id, toxic)
    return good.filter("y = 1").join(bad.filter("y = 0"), "id", "left_semi").select("id")


def domain_posteriors(
    docs: DataFrame, model: DomainModel, text: str = "text", name: str = "posteriors",
    left_out: tuple[str, ...] = (),
) -> DataFrame:
    """The columns of ``docs`` but those ``left_out``, and the posteriors of ``DOMAINS``.

    One narrow pass scores toxicity, counts features and applies the model.
    """
    kept = [c for c in docs.columns if c.lower() != name.lower()]
    schema = T.StructType([
        *(docs.schema[c] for c in kept), T.StructField(name, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.toxicity.scorer()
        for batch in batches:
            # parts of bounded bytes, whatever the number of rows
            for begin, end in text_slices(batch.column(text)):
                part = batch.slice(begin, end - begin)
                texts = part.column(text)
                p = model.posteriors(_inputs(texts, score(texts)))
                offsets = pa.array(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32))
                out = pa.ListArray.from_arrays(offsets, pa.array(p.reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in kept if c not in left_out), out],
                    [*(c for c in kept if c not in left_out), name])

    left = [f for f in schema.fields if f.name not in left_out]
    return small_batches(docs).mapInArrow(run, T.StructType(left))


# --- rates -----------------------------------------------------------------------------------


@dataclass
class Step:
    """A round: the residuals before it, the preconditioned pull of each domain, the length."""

    residual: np.ndarray
    pull: np.ndarray
    length: float


def _moved(
    p: np.ndarray, w: np.ndarray, step: Step, lengths: np.ndarray, ridge: float,
    least: np.ndarray | float,
) -> np.ndarray:
    """The rates after a step of each length, one row a length."""
    held = (w <= least) & (p @ step.residual + ridge * (w - 1.0) > 0)
    move = np.where(held, 0.0, p @ step.pull / ridge + (w - 1.0))
    return np.maximum(least, w - lengths[:, None] * move)


def rates(
    p: np.ndarray, steps: list[Step], ridge: float = RIDGE, least: np.ndarray | float = 0.0
) -> np.ndarray:
    """The rates after these rounds, from 1 on; ``least`` is 1 at most."""
    w = np.ones(len(p))
    for step in steps:
        w = _moved(p, w, step, np.array([step.length]), ridge, least)[0]
    return w


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _least(batch: pa.RecordBatch, name: str = "least") -> np.ndarray | float:
    return np.asarray(batch.column(name)) if name in batch.schema.names else 0.0


def _summed(facts: DataFrame, width: int, of_batch) -> tuple[np.ndarray, float]:
    """Sums of ``width`` numbers over all documents, and the greatest of one number.

    ``of_batch(p, t, least)`` gives both for a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, most = np.zeros(width), 0.0
        for batch in batches:
            if batch.num_rows:
                p, t = _matrix(batch.column("posteriors")), np.asarray(batch.column("tokens"))
                sums, top = of_batch(p, t.astype(np.float64), _least(batch))
                total, most = total + sums, max(most, top)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(width, dtype=np.int32)), pa.array(total),
             pa.array(np.full(width, most))], ["place", "value", "most"])

    rows = facts.mapInArrow(run, "place int, value double, most double").groupBy("place").agg(
        F.sum("value").alias("value"), F.max("most").alias("most"))
    sums, most = np.zeros(width), 0.0
    for row in rows.collect():
        sums[row["place"]], most = row["value"], max(most, row["most"])
    return sums, most


def _trial_sums(
    facts: DataFrame, steps: list[Step], step: Step, lengths: np.ndarray, ridge: float
) -> np.ndarray:
    """For each length of ``step``: the expected tokens, their change, and what the loss changes
    by apart from the square of that change.

    The loss of a large table is rounded to more than what a few documents that still move change
    it by, so the documents' changes are summed, not the losses subtracted.
    """
    size = len(DOMAINS)

    def of_batch(p: np.ndarray, t: np.ndarray, least) -> tuple[np.ndarray, float]:
        w = rates(p, steps, ridge, least)
        tried = _moved(p, w, step, lengths, ridge, least)
        change = tried - w
        slope = p @ step.residual + ridge * (w - 1.0)
        own = (change * (slope + ridge / 2 * change)) @ t
        return np.hstack([(tried * t) @ p, (change * t) @ p, own[:, None]]).reshape(-1), 0.0

    sums, _ = _summed(facts, len(lengths) * (2 * size + 1), of_batch)
    return sums.reshape(len(lengths), 2 * size + 1)


def _free_sums(
    facts: DataFrame, steps: list[Step], residual: np.ndarray, ridge: float
) -> tuple[np.ndarray, np.ndarray, float]:
    """Over the rates that are free: the sums of ``t p p^T`` and of ``t p`` times the gradient;
    and the norm of the projected gradient of all rates."""
    size = len(DOMAINS)

    def of_batch(p: np.ndarray, t: np.ndarray, least) -> tuple[np.ndarray, float]:
        w = rates(p, steps, ridge, least)
        slope = p @ residual + ridge * (w - 1.0)
        free = ~((w <= least) & (slope > 0))
        weighted = p[free] * t[free, None]
        norm = float(np.abs(w - np.maximum(least, w - slope)).max())
        return np.concatenate([(weighted.T @ p[free]).reshape(-1), weighted.T @ slope[free]]), norm

    sums, norm = _summed(facts, size * (size + 1), of_batch)
    return sums[: size * size].reshape(size, size), sums[size * size:], norm


def solve_rates(
    facts: DataFrame, targets: dict[str, float], ridge: float = RIDGE
) -> tuple[list[Step], np.ndarray, np.ndarray]:
    """The rounds of the search, the targets in tokens, and the expected tokens reached.

    ``facts`` has ``tokens`` and ``posteriors``; a column ``least`` bounds the rates, by 1 at most,
    else 0 does. Targets are multiples of the expected tokens of all documents in good
    domains. If the tolerance cannot be met, which only rounding could cause, an error tells so.
    """
    size = len(DOMAINS)
    steps: list[Step] = []
    still = Step(np.zeros(size), np.zeros(size), 0.0)
    at = _trial_sums(facts, steps, still, np.zeros(1), ridge)[0][:size]
    present = at
    share = np.array([targets.get(d, 0.0) for d in DOMAINS])
    exists = present > 1e-9 * max(present.sum(), 1.0)
    wanted = np.where(exists, share * (present[2] + present[3]), 0.0)
    if not exists.any():
        return steps, wanted, present
    scale = np.where(exists, present, 1.0)
    # measured in the roots of the domains' tokens, so that rare domains count
    root = np.sqrt(scale)

    def gain(sums: np.ndarray) -> float:
        """How much less the loss is, from the changes that were summed."""
        moved = np.where(exists, sums[size: 2 * size], 0.0)
        return -float((moved * moved / scale).sum() / 2 + sums[-1]) / present.sum()

    def tried(step: Step, lengths: np.ndarray) -> tuple[float, np.ndarray]:
        """The gain and the expected tokens of the best length, which the step gets."""
        sums = _trial_sums(facts, steps, step, lengths, ridge)
        best = int(np.argmax([gain(x) for x in sums]))
        step.length = float(lengths[best])
        return gain(sums[best]), sums[best, :size]

    while True:
        r = np.where(exists, (at - wanted) / scale, 0.0)
        free, slope, norm = _free_sums(facts, steps, r, ridge)
        if norm <= TOLERANCE:
            return steps, wanted, at
        # the Hessian over the free rates is inverted through this small matrix
        inner = np.eye(size) * ridge + free / np.outer(root, root)
        inverse = np.where(exists, np.linalg.solve(inner, slope / root) / root, 0.0)
        step = Step(r, r - inverse, 1.0)
        better, sums = tried(step, LENGTHS)
        if better <= 0:
            # rates just above their bounds are in the way of all these lengths, not of a plain
            # step: no curvature is above 1 + ridge, so it always makes progress
            step = Step(r, r, 1.0)
            better, sums = tried(step, np.array([ridge / (1.0 + ridge)]))
        if better <= 0:
            raise RuntimeError(f"rates are off by {norm:.1e} and do not improve")
        steps.append(step)
        at = sums


def copies(rate: Column, key: Column) -> Column:
    """The rate rounded up or down by a hash of the key, so that its mean is the rate."""
    chance = F.pmod(F.xxhash64(F.lit("mixing"), key), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + (chance < rate - F.floor(rate)).cast("long")).cast("long")


def _with_least(
    placed: DataFrame, clean: DataFrame, id: str, posteriors: str, least: str
) -> DataFrame:
    """``placed`` and the least rate: 1 for clean documents, 0 for others.

    Clean are ids in ``clean`` and documents for which good is the likeliest domain. Only
    the few ids that the classifier gets wrong are joined with all rows.
    """
    good = F.col(posteriors)[DOMAINS.index("good")] >= F.array_max(posteriors)
    wrong = placed.filter(~good).select(F.col(id).alias("id")).distinct()
    known = stage(wrong.join(clean.select("id"), "id", "left_semi"), "clean-ids")
    of_known = fresh("clean_id", placed.columns)
    known = known.select(F.col("id").alias(of_known))
    joined = placed.join(known, F.col(id) == F.col(of_known), "left")
    bound = (good | F.col(of_known).isNotNull()).cast("double")
    return joined.withColumn(least, bound).drop(of_known)


def _rated(
    docs: DataFrame, model: DomainModel, targets: dict[str, float] | None, id: str, text: str,
    tokens: Column | None, keep_text: bool, clean: DataFrame | None = None,
) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with tokens, posteriors, rate and copies under names that are free in it.

    The posteriors are written once, beside the columns that are kept.
    """
    names = {n: fresh(n, docs.columns) for n in ("tokens", "posteriors", "rate", "copies", "no", "least")}
    length = word_count(text) if tokens is None else tokens
    sized = docs.withColumn(names["tokens"], F.coalesce(length, F.lit(0)).cast("long"))
    left_out = () if keep_text else (text,)
    scored = domain_posteriors(sized, model, text, names["posteriors"], left_out)
    placed = stage(scored.withColumn(names["no"], F.monotonically_increasing_id()), "domain-facts")
    if clean is not None:
        placed = _with_least(placed, clean, id, names["posteriors"], names["least"])
    wanted = ("tokens", "posteriors", *(["least"] if clean is not None else []))
    # a small table of its own: the rounds read nothing else
    facts = stage(placed.select(*(F.col(names[n]).alias(n) for n in wanted)), "rate-facts")
    steps, _, _ = solve_rates(facts, TARGETS if targets is None else targets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p = _matrix(batch.column(names["posteriors"]))
                rate = pa.array(rates(p, steps, RIDGE, _least(batch, names["least"])))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, rate], [*batch.schema.names, names["rate"]])

    schema = T.StructType(
        [*placed.schema.fields, T.StructField(names["rate"], T.DoubleType())])
    rated = placed.mapInArrow(run, schema)
    key = F.coalesce(F.col(id).cast("string"), F.concat(F.lit("row "), F.col(names["no"])))
    return rated.withColumn(names["copies"], copies(F.col(names["rate"]), key)), names


def mix(
    docs: DataFrame, model: DomainModel, targets: dict[str, float] | None = None,
    id: str = "doc_id", text: str = "text", tokens: Column | None = None,
) -> DataFrame:
    """``doc_id, tokens, posteriors, rate, copies`` of every document."""
    named = docs.select(
        F.col(id).alias("doc_id"), F.col(text).alias("text"),
        (word_count(text) if tokens is None else tokens).alias("length"),
    )
    rated, names = _rated(
        named, model, targets, "doc_id", "text", F.col("length"), keep_text=False)
    return rated.select(
        "doc_id", *(F.col(names[n]).alias(n) for n in ("tokens", "posteriors", "rate", "copies"))
    )


def resample(
    docs: DataFrame, model: DomainModel, targets: dict[str, float] | None = None,
    id: str = "doc_id", text: str = "text", tokens: Column | None = None,
    clean: DataFrame | None = None,
) -> DataFrame:
    """The rows of ``docs``, each as often as its number of copies says, with their columns.

    With ``clean``, a table of ids (``id``) known to be good and not toxic, their rows and
    those whose likeliest domain is good have rates of 1 at least, so none of them goes.
    The targets are then met as well as that allows.
    """
    rated, names = _rated(docs, model, targets, id, text, tokens, keep_text=True, clean=clean)
    times = F.explode(F.array_repeat(F.lit(1), F.col(names["copies"]).cast("int")))
    return rated.withColumn(names["no"], times).select(*docs.columns)
