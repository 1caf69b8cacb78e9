"""Forward pass of a dense network over a table of vectors.

Three physical forms of one layer mean the same for every row: all columns stay, rows with
equal ids stay apart, a null vector or one of another width than the model is an error, and
a null element counts as NaN.

* ``arrow``: numpy matrix products on Arrow batches, the model as a broadcast
  variable. No shuffle. The default.
* ``hof``: higher-order functions on arrays, JVM only, each layer a constant from a
  scalar subquery. No join and no shuffle.
* ``blocks``: a tiled product. The neurons of every layer come in blocks below the size limit,
  each a broadcast variable of its own. One narrow pass takes a batch of rows through all
  layers: it loops over the blocks of a layer and joins their outputs in memory. A worker loads
  a block from its executor's disk for a batch and lets it go again, so it holds one block at
  a time. No row moves, nothing is exploded or written.

The model is written once and measured before anything is broadcast; above the limit the
form is ``blocks``, whatever was asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fanweave.functions.activations import activate, array_functions, columns_only
from fanweave.functions.vectors import argmax, dot, softmax
from fanweave.session import stage

#: largest model, in bytes of weights, that may be broadcast
BROADCAST_LIMIT = 256 * 1024 * 1024

#: what a neuron needs to compute; sorted by its first field
UNIT = ("neuron", "weights", "bias", "activation", "is_final")

FORMS = ("arrow", "hof", "blocks")


def model_bytes(neurons: DataFrame) -> int:
    """Size of the weights and biases; one small aggregate."""
    size = neurons.agg(F.sum((F.size("weights") + 1) * F.lit(8)).alias("bytes")).first()
    return int(size["bytes"] or 0)


def fits_broadcast(neurons: DataFrame, limit: int = BROADCAST_LIMIT) -> bool:
    return model_bytes(neurons) <= limit


# --- routing and fan-out ---------------------------------------------------------------------


def route(df: DataFrame, layer: int, column: str = "layer") -> DataFrame:
    """Rows addressed to one layer."""
    return df.filter(F.col(column) == layer)


def fan_out(
    images: DataFrame, neurons: DataFrame, layer: int, limit: int = BROADCAST_LIMIT,
) -> DataFrame:
    """Send every row to every neuron of a layer: work for a layer meets its neurons.

    The output is rows x neurons by definition of the operator. Neurons are exploded from
    constants of at most ``limit`` bytes, so no row moves; a layer above the limit takes
    one pass over the rows for each block of its neurons.
    """
    model = stage(route(neurons, layer).select("layer", *UNIT), "layer")
    parts = [
        images.withColumn("_unit", F.explode(_units(block, layer))).select(
            *images.columns, F.lit(layer).alias("layer"), "_unit.*")
        for block in _blocks(model, limit)
    ]
    return reduce(DataFrame.unionAll, parts)


def neuron_sums(
    images: DataFrame, neurons: DataFrame, layer: int, limit: int = BROADCAST_LIMIT,
) -> DataFrame:
    """``z`` of every row and neuron of a layer, before the activation.

    A row carries the neuron's number, activation and ``is_final``, but neither vector.
    """
    model = stage(route(neurons, layer).select("layer", *UNIT), "layer")
    kept = [c for c in images.columns if c != "features"]

    def sums(u: Column) -> Column:
        z = dot(F.col("features"), u["weights"], u["bias"])
        return F.struct(u["neuron"].alias("neuron"), z.alias("z"),
                        u["activation"].alias("activation"), u["is_final"].alias("is_final"))

    parts = [
        images.withColumn("_units", _units(block, layer)).select(
            *kept, F.lit(layer).alias("layer"), F.inline(F.transform("_units", sums)))
        for block in _blocks(model, limit)
    ]
    return reduce(DataFrame.unionAll, parts)


def _blocks(layer: DataFrame, limit: int) -> list[DataFrame]:
    """The neurons of one layer in consecutive parts of at most ``limit`` bytes each.

    A part has one neuron at least. Neurons are numbered 0, 1, 2, ... in a layer.
    """
    size = layer.agg(
        F.max(F.size("weights") + 1).alias("width"), F.max("neuron").alias("last")
    ).first()
    if size["last"] is None:
        return [layer]
    per_block = max(1, limit // (8 * size["width"]))
    if size["last"] < per_block:
        return [layer]
    return [
        layer.filter(F.col("neuron").between(begin, begin + per_block - 1))
        for begin in range(0, size["last"] + 1, per_block)
    ]


# --- shared by all forms ---------------------------------------------------------------------


def _layer_plan(neurons: DataFrame) -> list[Row]:
    """The layers in order: ``layer``, ``soft`` (a hidden softmax layer), ``nodes``, ``width``."""
    is_soft = (F.col("activation") == "softmax") & ~F.col("is_final")
    plan = neurons.groupBy("layer").agg(
        F.count(F.when(is_soft, 1)).alias("soft"),
        F.count(F.lit(1)).alias("nodes"),
        F.max(F.size("weights")).alias("width"),
    )
    layers = sorted(plan.collect(), key=lambda row: row["layer"])
    for row in layers:
        if row["soft"] not in (0, row["nodes"]):
            raise ValueError(f"layer {row['layer']}: softmax must cover the whole layer")
    return layers


def _scalar(z: Column, activation: Column, is_final: Column, unknown: str, soft: bool) -> Column:
    """One neuron's output; a softmax layer is normalised later, over its vector."""
    return z if soft else activate(z, activation, is_final, unknown)


# --- higher-order-function form --------------------------------------------------------------


def _units(neurons: DataFrame, layer: int) -> Column:
    """The neurons of one layer in order, as a constant array in every row.

    A scalar subquery: the layer is read once and needs no join. Only for a layer
    of checked size.
    """
    listed = F.sort_array(F.collect_list(F.struct(*UNIT)))
    return route(neurons, layer).agg(listed.alias("units")).scalar()


def _unit_output(unknown: str, soft: bool) -> Callable[[Column], Column]:
    def output(u: Column) -> Column:
        z = dot(F.col("features"), u["weights"], u["bias"])
        return _scalar(z, u["activation"], u["is_final"], unknown, soft)

    return output


def _checked(vector: str, width: int) -> Column:
    """The vector with nulls as NaN; an error if it is null or has another width."""
    v = F.col(vector)
    size = F.coalesce(F.size(v), F.lit(-1))
    message = F.concat(
        F.lit("vector lengths differ: "), size.cast("string"), F.lit(f" and {width}")
    )
    whole = F.transform(v, lambda x: F.coalesce(x.cast("double"), F.lit(float("nan"))))
    return F.when(v.isNotNull() & (size == width), whole).otherwise(
        F.raise_error(message).cast("array<double>")
    )


def _hof_forward(images: DataFrame, neurons: DataFrame, unknown: str) -> DataFrame:
    columns = images.columns
    for plan in _layer_plan(neurons):
        layer, soft = plan["layer"], plan["soft"] > 0
        images = images.withColumn("features", _checked("features", plan["width"]))
        outputs = F.transform("_units", _unit_output(unknown, soft))
        images = (
            images.withColumn("_units", _units(neurons, layer))
            .withColumn("features", softmax(outputs) if soft else outputs)
            .select(*columns)
        )
    return images


# --- block form ------------------------------------------------------------------------------


def _loaded(shared: Broadcast) -> tuple:
    """The value of a broadcast block, which this worker does not keep."""
    value = shared.value
    # a worker reads the value again from the executor's disk; the driver keeps its own
    if TaskContext.get() is not None:
        vars(shared).pop("_value", None)
    return value


def _tiled_forward(
    images: DataFrame, neurons: DataFrame, unknown: str, limit: int, predict: bool
) -> DataFrame:
    """Run all layers on Arrow batches, block by block, keeping the other columns."""
    context = images.sparkSession.sparkContext
    plan = []
    for row in _layer_plan(neurons):
        # the driver holds one block at a time as well
        blocks = [
            context.broadcast(_local_model(block)[0])
            for block in _blocks(route(neurons, row["layer"]), limit)
        ]
        plan.append((row["width"], row["soft"] > 0, blocks))

    def outputs(x: np.ndarray, functions: dict) -> np.ndarray:
        for width, soft, blocks in plan:
            if x.shape[1] != width:
                raise ValueError(f"vector lengths differ: {[x.shape[1]]} and {width}")
            x = np.hstack([
                _apply_layer(x, _loaded(block), functions, unknown, whole=False)
                for block in blocks
            ])
            if soft:
                x = _softmax_rows(x)
        return x

    return _on_batches(images, plan[0][0], outputs, predict)


# --- Arrow form ------------------------------------------------------------------------------


def _local_model(neurons: DataFrame) -> list[tuple]:
    """The layers as numpy arrays on the driver; call only for a model of checked size."""
    table = neurons.select("layer", "neuron", "weights", "bias", "activation", "is_final")
    by_layer: dict[int, list] = {}
    for row in table.collect():
        by_layer.setdefault(row.layer, []).append(row)
    model = []
    for layer in sorted(by_layer):
        units = sorted(by_layer[layer], key=lambda r: r.neuron)
        model.append(
            (
                layer,
                np.array([u.weights for u in units], dtype=np.float64).T,
                np.array([u.bias for u in units], dtype=np.float64),
                [None if u.is_final else u.activation for u in units],
                [bool(u.is_final) for u in units],
            )
        )
    return model


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """An Arrow list column as a rows x width matrix; another width is an error."""
    lengths = np.diff(column.offsets.to_numpy())
    if column.null_count or (lengths != width).any():
        raise ValueError(f"vector lengths differ: {sorted(set(lengths.tolist()))} and {width}")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(
        -1, width
    )


def _lists(x: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as a list column."""
    offsets = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(x.reshape(-1)))


def _apply_layer(
    x: np.ndarray, layer: tuple, functions: dict, unknown: str, whole: bool = True
) -> np.ndarray:
    """Outputs of a layer; of a softmax layer the sums only, if it is not ``whole``."""
    _, weights, bias, names, finals = layer
    z = x @ weights + bias
    hidden = [n for n, final in zip(names, finals) if not final]
    if hidden and set(hidden) == {"softmax"} and len(hidden) == len(names):
        if not whole:
            return z
        return _softmax_rows(z)
    for name in set(hidden):
        units = [i for i, (n, f) in enumerate(zip(names, finals)) if n == name and not f]
        if name in functions:
            z[:, units] = functions[name](z[:, units])
        elif unknown == "relu":
            z[:, units] = np.maximum(z[:, units], 0.0)
        elif unknown == "error":
            raise ValueError(f"unknown activation: {name}")
    return z


def _softmax_rows(z: np.ndarray) -> np.ndarray:
    powers = np.exp(z - z.max(axis=1, keepdims=True))
    return powers / powers.sum(axis=1, keepdims=True)


def _on_batches(
    images: DataFrame, width: int, outputs: Callable[[np.ndarray, dict], np.ndarray], predict: bool
) -> DataFrame:
    """``features`` becomes ``outputs`` of it, or the place of the largest of them."""
    functions = array_functions()
    kept = [c for c in images.columns if c != "features"]
    kept_fields = [images.schema[c] for c in kept]
    result = (
        T.StructField("prediction", T.IntegerType())
        if predict
        else T.StructField("features", T.ArrayType(T.DoubleType()))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = outputs(_matrix(batch.column("features"), width), functions)
            out = pa.array(np.argmax(x, axis=1).astype(np.int32)) if predict else _lists(x)
            columns = [batch.column(c) for c in kept] + [out]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, result.name])

    return images.select(*kept, "features").mapInArrow(run, T.StructType([*kept_fields, result]))


def _arrow_forward(
    images: DataFrame, model: list[tuple], unknown: str, predict: bool
) -> DataFrame:
    """Run all layers of ``model`` on Arrow batches, keeping the other columns."""
    shared = images.sparkSession.sparkContext.broadcast(model)

    def outputs(x: np.ndarray, functions: dict) -> np.ndarray:
        for layer in shared.value:
            x = _apply_layer(x, layer, functions, unknown)
        return x

    return _on_batches(images, model[0][1].shape[0], outputs, predict)


# --- public operators ------------------------------------------------------------------------


def _choose(neurons: DataFrame, form: str, unknown: str, limit: int) -> str:
    """The form to run for a staged model."""
    if form not in FORMS:
        raise ValueError(f"form must be one of {FORMS}")
    if unknown not in ("relu", "identity", "error"):
        raise ValueError("unknown must be 'relu', 'identity' or 'error'")
    size = neurons.agg(
        F.sum((F.size("weights") + 1) * F.lit(8)).alias("bytes"),
        F.collect_set(F.when(~F.col("is_final"), F.col("activation"))).alias("names"),
    ).first()
    if form == "blocks" or int(size["bytes"] or 0) > limit:
        missing = set(columns_only()) & set(size["names"])
        if missing:
            raise ValueError(f"activations without an array form: {sorted(missing)}")
        return "blocks"
    return "hof" if set(columns_only()) & set(size["names"]) else form


def _forward(
    images: DataFrame, neurons: DataFrame, form: str, unknown: str, limit: int, scored: bool
) -> DataFrame:
    """``features`` becomes the outputs of the last layer, or ``prediction`` if ``scored``."""
    model = stage(neurons.select("layer", *UNIT), "model")
    form = _choose(model, form, unknown, limit)
    if form == "arrow":
        _layer_plan(model)
        return _arrow_forward(images, _local_model(model), unknown, scored)
    if form == "blocks":
        return _tiled_forward(images, model, unknown, limit, scored)
    out = _hof_forward(images, model, unknown)
    if scored:
        out = out.withColumn("prediction", argmax(F.col("features"))).drop("features")
    return out


def logits(
    images: DataFrame, neurons: DataFrame, form: str = "arrow", unknown: str = "relu",
    limit: int = BROADCAST_LIMIT,
) -> DataFrame:
    """All layers: ``features`` becomes the final layer's outputs.

    Layer 0 reads the images, every other layer the one before it.
    """
    return _forward(images, neurons, form, unknown, limit, scored=False)


def layer_forward(
    images: DataFrame, neurons: DataFrame, layer: int, form: str = "arrow",
    unknown: str = "relu", limit: int = BROADCAST_LIMIT,
) -> DataFrame:
    """One layer: ``features`` becomes the vector of the layer's outputs."""
    return logits(images, route(neurons, layer), form, unknown, limit)


def predict(
    images: DataFrame, neurons: DataFrame, form: str = "arrow", unknown: str = "relu",
    limit: int = BROADCAST_LIMIT,
) -> DataFrame:
    """The slot of the largest logit as ``prediction`` for every row."""
    return _forward(images, neurons, form, unknown, limit, scored=True)


def tag_vectors(images: DataFrame, neurons: DataFrame, name: str = "reason") -> DataFrame:
    """Every row with the reason why the forward pass would fail on it, null if it would not.

    A job need not end for one bad row: predict the rows without a reason and keep the others.
    """
    width = _layer_plan(neurons)[0]["width"]
    size = F.size("features")
    wrong = F.concat(
        F.lit("vector lengths differ: "), size.cast("string"), F.lit(f" and {width}"))
    reason = F.when(F.col("features").isNull(), "no vector").when(size != width, wrong)
    return images.withColumn(name, reason)


def argmax_rows(df: DataFrame, id: str, slot: str = "slot", value: str = "value") -> DataFrame:
    """Argmax over ``(id, slot, value)`` rows: lowest slot on a tie, first NaN if any."""
    best = F.max(F.struct(F.col(value).alias("v"), (-F.col(slot)).alias("s")))
    return df.groupBy(id).agg((-best["s"]).cast("int").alias("prediction"))
