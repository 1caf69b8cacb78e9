"""Mini-batch training of a Linear-ReLU-Linear classifier as Spark jobs.

The rows are numbered and written once. Every epoch deals them in a new order, a keyed permutation
of the row numbers, so each mini-batch but the last has exactly the wanted size and any epoch can
be computed again on its own. Two forms run an epoch and give the same result, which does
not depend on how the rows are partitioned, but for rounding:

* ``jobs``: the epoch's rows are written in blocks of mini-batches, about ``BLOCK_ROWS`` rows each,
  so their number follows the rows and not the mini-batches. A step is a job over one
  mini-batch: tasks sum packed gradients, the sums are added in a tree, the driver updates.
  Steps follow one another, so a step that one task computes faster than Spark starts a job
  (``CHAIN_WORK``) is not worth a job: then a job is the chain of all steps of a block of about
  ``CHAIN_ROWS`` rows, and hands the state on to the next block's.
* ``barrier``: the epoch is one job. A shuffle gives every task its share of the rows in the order
  of the epoch, and a barrier stage runs all tasks side by side. In a step they exchange their
  sums and each makes the same update. Spark looks for the end of an exchange once a second, so
  a step takes a second at least: for steps that are long, or clusters where starting the
  tasks of a job takes longer. A lost task runs the epoch again from its beginning.

A task holds one Arrow batch of rows and the network, whatever the table's size.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from copy import copy

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from fanweave import schemas
from fanweave.functions.permutation import permuted
from fanweave.operators.forward import BROADCAST_LIMIT, _matrix
from fanweave.operators.rows import with_row_id
from fanweave.session import new_path, stage

BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-8
#: at most so many packed gradients reach the driver in a step
FAN_IN = 32
PACKED = "gradient binary, loss double, rows long"
#: rows of a written block of mini-batches; a larger mini-batch is a block of several files
BLOCK_ROWS = 65_536
#: rows of a block whose steps are a chain
CHAIN_ROWS = 16_384
#: rows of a mini-batch times weights up to which steps are chained; a core takes about 0.2 s for so many
CHAIN_WORK = 1 << 26
FORMS = ("jobs", "barrier")
STATE = "weights binary, first binary, second binary, losses array<double>"


def epoch_batches(
    df: DataFrame, n: int, batch: int, epoch: int, seed: int = 0, row_id: str = "row_id"
) -> DataFrame:
    """``df`` with the ``batch`` of each row in an epoch and its place ``pos`` in it.

    ``row_id`` numbers the ``n`` rows from 0 on. All mini-batches but the last have ``batch``
    rows. No row moves: a row's place follows from its number, the seed and the epoch.
    """
    place = permuted(F.col(row_id), n, "epoch", seed, epoch)
    return (
        df.withColumn("_place", place)
        .withColumn("batch", F.call_function("div", F.col("_place"), F.lit(batch)))
        .withColumn("pos", F.pmod("_place", F.lit(batch)))
        .drop("_place")
    )


class Network:
    """Weights as one flat array, so that averaging is a sum per position."""

    def __init__(self, width: int, hidden: int, classes: int):
        self.width, self.hidden, self.classes = width, hidden, classes
        self.cuts = np.cumsum([width * hidden, hidden, hidden * classes, classes])

    @property
    def size(self) -> int:
        return int(self.cuts[-1])

    def initial(self, seed: int) -> np.ndarray:
        rng = np.random.default_rng(seed)
        near, far = 1 / np.sqrt(self.width), 1 / np.sqrt(self.hidden)
        inner = rng.uniform(-near, near, self.cuts[1])
        outer = rng.uniform(-far, far, self.size - self.cuts[1])
        return np.concatenate([inner, outer])

    def parts(self, flat: np.ndarray) -> tuple[np.ndarray, ...]:
        w1, b1, w2, b2 = np.split(flat, self.cuts[:-1])
        return (w1.reshape(self.width, self.hidden), b1,
                w2.reshape(self.hidden, self.classes), b2)

    def loss_and_gradient(
        self, flat: np.ndarray, x: np.ndarray, y: np.ndarray
    ) -> tuple[float, np.ndarray]:
        """Mean cross-entropy of one mini-batch and its gradient."""
        w1, b1, w2, b2 = self.parts(flat)
        z = x @ w1 + b1
        a = np.maximum(z, 0.0)
        scores = a @ w2 + b2
        scores -= scores.max(axis=1, keepdims=True)
        log_p = scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))
        rows = np.arange(len(y))
        loss = float(-log_p[rows, y].mean())
        delta = np.exp(log_p)
        delta[rows, y] -= 1.0
        delta /= len(y)
        back = (delta @ w2.T) * (z > 0)
        gradient = [x.T @ back, back.sum(axis=0), a.T @ delta, delta.sum(axis=0)]
        return loss, np.concatenate([g.reshape(-1) for g in gradient])

    def flat(self, units: list) -> np.ndarray:
        """The flat array of neuron rows ordered by layer and number."""
        parts = []
        for layer in (0, 1):
            here = [u for u in units if u.layer == layer]
            parts.append(np.array([u.weights for u in here]).T.reshape(-1))
            parts.append(np.array([u.bias for u in here]))
        return np.concatenate(parts)


class _State:
    """Weights and the two moments of Adam, alike in all tasks."""

    def __init__(self, flat: np.ndarray):
        self.flat, self.t = flat, 0
        self.first, self.second = np.zeros(len(flat)), np.zeros(len(flat))

    def update(self, g: np.ndarray, lr: float) -> None:
        self.t += 1
        self.first = BETA1 * self.first + (1 - BETA1) * g
        self.second = BETA2 * self.second + (1 - BETA2) * g * g
        step = self.first / (1 - BETA1**self.t)
        self.flat = self.flat - lr * step / (np.sqrt(self.second / (1 - BETA2**self.t)) + EPSILON)


# --- a job a step ---------------------------------------------------------------------------


def _packed(gradient: np.ndarray, loss: float, rows: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([gradient.tobytes()], pa.binary()), pa.array([loss]), pa.array([rows])],
        names=["gradient", "loss", "rows"],
    )


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The element-wise sum of packed gradients; one row a task."""
    total, loss, rows = None, 0.0, 0
    for batch in batches:
        for row in batch.to_pylist():
            gradient = np.frombuffer(row["gradient"])
            total = gradient.copy() if total is None else total + gradient
            loss, rows = loss + row["loss"], rows + row["rows"]
    if rows:
        yield _packed(total, loss, rows)


def _gradient(batch: DataFrame, net: Network, flat: np.ndarray) -> tuple[np.ndarray, float]:
    """Mean gradient and mean loss over all rows of one mini-batch."""
    shared = batch.sparkSession.sparkContext.broadcast(flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, loss, rows = np.zeros(net.size), 0.0, 0
        for part in batches:
            if part.num_rows:
                x = _matrix(part.column("features"), net.width)
                y = part.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
                mean_loss, mean = net.loss_and_gradient(shared.value, x, y)
                total += mean * len(y)
                loss, rows = loss + mean_loss * len(y), rows + len(y)
        if rows:
            yield _packed(total, loss, rows)

    sums = batch.mapInArrow(run, PACKED)
    fan = max(1, min(FAN_IN, BROADCAST_LIMIT // (8 * net.size)))
    if batch.rdd.getNumPartitions() > fan:
        sums = sums.repartition(fan).mapInArrow(_summed, PACKED)
    found = sums.collect()
    rows = sum(r["rows"] for r in found)
    gradient = np.sum([np.frombuffer(r["gradient"]) for r in found], axis=0)
    shared.unpersist()
    return gradient / rows, sum(r["loss"] for r in found) / rows


def _in_blocks(dealt: DataFrame, size: int, block_rows: int) -> tuple[str, int]:
    """Write an epoch's rows by block; the folder, and the mini-batches of a block."""
    per_block = max(1, block_rows // size)
    files = max(1, size // block_rows)
    path = new_path(dealt.sparkSession, "mini-batches")
    blocks = dealt.select(
        "features", "label", "batch", "pos", F.call_function("div", F.col("batch"), F.lit(
            per_block)).alias("block"), F.pmod("pos", F.lit(files)).alias("_file"))
    blocks.repartition("block", "_file").drop("_file").write.partitionBy("block").parquet(path)
    return path, per_block


def _epoch_in_jobs(
    dealt: DataFrame, net: Network, state: _State, size: int, steps: int, lr: float
) -> tuple[_State, list[float]]:
    chained = size <= CHAIN_ROWS and size * net.size <= CHAIN_WORK
    path, per_block = _in_blocks(dealt, size, CHAIN_ROWS if chained else BLOCK_ROWS)
    read = dealt.sparkSession.read.schema(
        "features ARRAY<DOUBLE>, label INT, batch BIGINT, pos BIGINT")
    losses = []
    if chained:
        for begin in range(0, steps, per_block):
            block = read.parquet(f"{path}/block={begin // per_block}")
            state, found = _chain(block, net, state, begin, min(begin + per_block, steps), lr)
            losses += found
        return state, losses
    for step in range(steps):
        rows = read.parquet(f"{path}/block={step // per_block}").filter(F.col("batch") == step)
        g, loss = _gradient(rows.drop("batch", "pos"), net, state.flat)
        state.update(g, lr)
        losses.append(loss)
    return state, losses


# --- many steps in a task ---------------------------------------------------------------------


class _Rows:
    """The rows of a task in the order of the epoch, read as they are needed."""

    def __init__(self, batches: Iterator[pa.RecordBatch], width: int):
        self.batches, self.width = batches, width
        self.batch = np.zeros(0, np.int64)
        self.x, self.y = np.zeros((0, width)), np.zeros(0, np.int64)
        self.at = 0

    def parts(self, number: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The rows of one mini-batch, in parts; mini-batches are asked for in order."""
        while True:
            end = int(np.searchsorted(self.batch, number, side="right"))
            if end > self.at:
                yield self.x[self.at: end], self.y[self.at: end]
                self.at = end
            if end < len(self.batch):
                return
            part = next(self.batches, None)
            if part is None:
                return
            self.batch = part.column("batch").to_numpy(zero_copy_only=False)
            self.x = _matrix(part.column("features"), self.width)
            self.y = part.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
            self.at = 0


def _steps(
    batches: Iterator[pa.RecordBatch], net: Network, state: _State, numbers: range, lr: float,
    total: Callable[[np.ndarray], np.ndarray],
) -> pa.RecordBatch:
    """The state after the steps over a task's rows, and their losses; ``total`` adds what
    other tasks have of a mini-batch."""
    # a task that runs again in the same process must find the broadcast state as it was
    held, own, losses = copy(state), _Rows(batches, net.width), []
    for step in numbers:
        # gradient, loss and number of rows in one array
        sums = np.zeros(net.size + 2)
        for x, y in own.parts(step):
            loss, mean = net.loss_and_gradient(held.flat, x, y)
            sums[:-2] += mean * len(y)
            sums[-2:] += loss * len(y), len(y)
        sums = total(sums)
        held.update(sums[:-2] / sums[-1], lr)
        losses.append(float(sums[-2] / sums[-1]))
    return pa.RecordBatch.from_arrays(
        [pa.array([x.tobytes()], pa.binary()) for x in (held.flat, held.first, held.second)]
        + [pa.array([losses], pa.list_(pa.float64()))],
        names=["weights", "first", "second", "losses"])


def _after(found: Row, t: int) -> tuple[_State, list[float]]:
    after = _State(np.frombuffer(found["weights"]).copy())
    after.first, after.second = (np.frombuffer(found[c]).copy() for c in ("first", "second"))
    after.t = t
    return after, list(found["losses"])


def _chain(
    block: DataFrame, net: Network, state: _State, begin: int, end: int, lr: float
) -> tuple[_State, list[float]]:
    """The steps ``begin`` to ``end`` over a block's rows: the state after them, and their losses."""
    shared = block.sparkSession.sparkContext.broadcast(state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _steps(batches, net, shared.value, range(begin, end), lr, lambda sums: sums)

    ordered = block.coalesce(1).sortWithinPartitions("batch", "pos")
    (found,) = ordered.select("batch", "features", "label").mapInArrow(run, STATE).collect()
    shared.unpersist()
    return _after(found, state.t + end - begin)


# --- a job an epoch --------------------------------------------------------------------------


def _exchange(context: BarrierTaskContext, sums: np.ndarray | None) -> np.ndarray:
    """The element-wise total of the sums of all tasks; tasks without rows send nothing."""
    message = "" if sums is None else base64.b64encode(sums.tobytes()).decode()
    total: np.ndarray | None = None
    for other in context.allGather(message):
        if other:
            part = np.frombuffer(base64.b64decode(other))
            total = part.copy() if total is None else total + part
    return total


def _epoch_in_one_job(
    rows: DataFrame, net: Network, state: _State, steps: int, lr: float, tasks: int
) -> tuple[_State, list[float]]:
    """One epoch over ``(batch, pos, features, label)``: the state after it, and all losses."""
    shared = rows.sparkSession.sparkContext.broadcast(state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = BarrierTaskContext.get()
        after = _steps(batches, net, shared.value, range(steps), lr,
                       lambda sums: _exchange(context, sums if sums[-1] else None))
        if context.partitionId() == 0:
            yield after

    dealt = rows.repartition(tasks, "batch", "pos").sortWithinPartitions("batch", "pos")
    (found,) = dealt.select("batch", "features", "label").mapInArrow(run, STATE, barrier=True).collect()
    shared.unpersist()
    return _after(found, state.t + steps)


def train(
    images: DataFrame, hidden: int = 128, epochs: int = 5, batch: int = 64, lr: float = 0.001,
    seed: int = 0, report_every: int = 100, id: str = "image_id",
    initial: DataFrame | None = None, form: str = "jobs", tasks: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Train on ``(id, features, label)``; returns the neurons table and ``(epoch, step, loss)``.

    A mini-batch has ``batch`` rows, the last of an epoch what is left. ``loss`` is the mean over
    the mini-batch before its update. ``initial``: a neurons table of two layers to start from;
    without it the start is random. ``form``: see the module text. A barrier stage runs ``tasks`` at
    the same time, as many as the cluster has cores unless given; it needs that many free, and
    no dynamic allocation.
    """
    if form not in FORMS:
        raise ValueError(f"form must be one of {FORMS}")
    spark = images.sparkSession
    shape = images.agg(
        F.max(F.size("features")).alias("w"), F.max("label").alias("c"),
        F.count(F.lit(1)).alias("n"),
    ).first()
    start = None if initial is None else sorted(initial.collect(), key=lambda r: (r.layer, r.neuron))
    if start is not None:
        hidden = sum(r.layer == 0 for r in start)
    classes = shape["c"] + 1 if start is None else sum(r.layer == 1 for r in start)
    net = Network(shape["w"], hidden, classes)
    if 3 * 8 * net.size > BROADCAST_LIMIT:
        raise ValueError("the network is too large to broadcast")
    flat = net.initial(seed) if start is None else net.flat(start)
    n = shape["n"]
    size = max(1, min(batch, n))
    steps = -(-n // size)
    rows = stage(with_row_id(images.select(
        id, F.col("features").cast("array<double>").alias("features"),
        F.col("label").cast("int").alias("label")), [id]), "training-rows")
    tasks = max(1, min(tasks or spark.sparkContext.defaultParallelism, n))
    state, losses = _State(flat), []
    for epoch in range(epochs):
        dealt = epoch_batches(rows, n, size, epoch, seed)
        if form == "jobs":
            state, found = _epoch_in_jobs(dealt, net, state, size, steps, lr)
        else:
            state, found = _epoch_in_one_job(dealt, net, state, steps, lr, tasks)
        losses += [(epoch + 1, k, loss) for k, loss in enumerate(found, 1)
                   if k == 1 or k % report_every == 0]
    return _neurons(spark, net, state.flat), spark.createDataFrame(
        losses, "epoch INT, step INT, loss DOUBLE")


def _neurons(spark, net: Network, flat: np.ndarray) -> DataFrame:
    w1, b1, w2, b2 = net.parts(flat)
    rows = [
        (layer, k, w[:, k].tolist(), float(b[k]), None if final else "relu", final, len(b))
        for layer, w, b, final in ((0, w1, b1, False), (1, w2, b2, True))
        for k in range(len(b))
    ]
    return spark.createDataFrame(rows, schemas.NEURONS)
