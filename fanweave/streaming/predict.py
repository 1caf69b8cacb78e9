"""Streaming inference: vectors in, predictions out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fanweave.functions.activations import activate
from fanweave.functions.vectors import argmax
from fanweave.operators.forward import BROADCAST_LIMIT, fits_broadcast, neuron_sums, predict
from fanweave.sinks.predictions import ROWS_PER_FILE
from fanweave.streaming.fanin import fan_in_stream
from fanweave.streaming.groups import RowGroups, with_ticks
from fanweave.streaming.io import start


def predictions_of(src: DataFrame, neurons: DataFrame, *kept: str) -> DataFrame:
    """Whole vectors arrive, so a row needs no state: the batch operator on a stream.

    ``kept`` are the columns beside the prediction, else ``image_id``.
    """
    if not fits_broadcast(neurons):
        raise ValueError("streaming inference needs a model that can be broadcast")
    return predict(src.select(*(kept or ("image_id",)), "features"), neurons)


def neuron_messages(
    vectors: DataFrame, neurons: DataFrame, layer: int, id: str | list[str] = "image_id",
    unknown: str = "relu", limit: int = BROADCAST_LIMIT,
) -> DataFrame:
    """Partial outputs of one layer: ``(id, slot, value)``, one message per neuron."""
    ids = [id] if isinstance(id, str) else list(id)
    sums = neuron_sums(vectors.select(*ids, "features"), neurons, layer, limit)
    return sums.select(
        *ids,
        F.col("neuron").alias("slot"),
        activate(F.col("z"), F.col("activation"), F.col("is_final"), unknown).alias("value"),
    )


def predictions_by_messages(
    src: DataFrame, neurons: DataFrame, id: str = "image_id", ttl_ms: int | None = None,
    version: str | None = None,
) -> DataFrame:
    """The message form: every layer is a fan-out and a stateful fan-in by id and version.

    ``version`` names a column that tells the vectors of an id apart, such as their arrival
    number or offset in the source; it stays in the result. Every message carries both, so
    vectors of one id never mix, in one micro-batch or across several, and each has its
    prediction. The state is one row per (id, version): it goes when the version's vector is
    complete, or after ``ttl_ms`` without a message for it.

    Without ``version`` the content of the vector is its version: different vectors of an id
    stay apart, and equal ones, whose messages are the same, may count as one if they come in one
    micro-batch.
    """
    widths = {
        r["layer"]: r["n"]
        for r in neurons.groupBy("layer").agg(F.count(F.lit(1)).alias("n")).collect()
    }
    name = version or "_version"
    if version is None:
        src = src.withColumn(name, F.xxhash64("features"))
    keys = [id, name]
    vectors = src.select(*keys, "features")
    for layer in sorted(widths):
        messages = neuron_messages(vectors, neurons, layer, keys).withColumn("seq", F.lit(0))
        vectors = fan_in_stream(
            messages, keys, "slot", "value", "seq", widths[layer], ttl_ms=ttl_ms,
            forget=True,
        ).select(*keys, F.col("vector").alias("features"))
    kept = keys if version else [id]
    return vectors.select(*kept, argmax(F.col("features")).alias("prediction"))


def predict_stream(
    src: DataFrame, neurons: DataFrame, folder: str, checkpoint: str, id: str = "image_id",
    trigger: str | None = None, by_messages: bool = False, rows_per_file: int = ROWS_PER_FILE,
    version: str | None = None,
) -> StreamingQuery:
    """Write ``id,prediction`` CSV files with a header as vectors arrive.

    With ``version`` the files have ``id,version,prediction``; see
    :func:`predictions_by_messages`.

    A file has at most ``rows_per_file`` rows and is closed with its micro-batch, so
    ``trigger`` bounds how long rows wait.
    """
    kept = [id] if version is None else [id, version]
    if by_messages:
        out = predictions_by_messages(src, neurons, id, version=version)
    else:
        out = predictions_of(src, neurons, *kept)
    out = out.select(*kept, "prediction")
    return start(
        out, checkpoint, path=folder, format="csv", trigger=trigger,
        options={"header": "true", "maxRecordsPerFile": str(rows_per_file)},
    )


#: a file of predictions waits no longer for further rows
WAIT_S = 180.0


def predict_to_files(
    src: DataFrame, neurons: DataFrame, folder: str, state: str, checkpoint: str,
    id: str = "image_id", trigger: str | None = None, rows_per_file: int = ROWS_PER_FILE,
    wait_s: float = WAIT_S,
) -> tuple[StreamingQuery, RowGroups]:
    """CSV files of exactly ``rows_per_file`` predictions, filled across micro-batches.

    A file is closed earlier when its first row has waited for ``wait_s`` seconds; with a ``trigger`` also
    if no vector comes any more. ``RowGroups.close`` writes the last one of a stopped stream.
    """
    files = RowGroups(
        folder, state, rows_per_file, [id], wait_s, format="csv", options={"header": "true"})
    out = predictions_of(src, neurons, id)
    out = out.select(id, "prediction")
    query = start(
        with_ticks(out) if trigger else out, checkpoint, each_batch=files, trigger=trigger)
    return query, files
