"""Model documents and model tables on disk.

A model document is one JSON object with an entry per layer. It is read as text that is cut
before every layer's name, so a row holds one layer, and a large document is split between tasks
like a file of lines. Writing collects a document in one task; large models are better
written as the parquet table of :func:`save_model`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fanweave import schemas


#: what the name of a layer begins with, its quotation mark included
LAYER_MARK = '"layer_'


def _document_layers(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """One row per layer of the documents below ``path``.

    A piece is the rest of a layer's name, its body, and entries up to the next layer. Text
    before the first layer is skipped. Where the mark stands in another place than in
    front of a name, the job fails instead of giving half a layer.
    """
    pieces = spark.read.option("lineSep", LAYER_MARK).text(path)
    is_layer = F.col("value").rlike(r'^[^"\\]*"\s*:')
    # a comma parts the entry from the next layer; the last piece has the document's end
    entry = F.concat(F.lit("{" + LAYER_MARK), F.regexp_replace("value", r",\s*\z", "}"))
    broken = F.raise_error(F.lit("not a document of layers")).cast("string")
    is_head = F.ltrim("value").startswith("{") | (F.trim("value") == "")
    whole = F.when(is_layer, entry).when(is_head, F.lit(None)).otherwise(broken)
    entries = pieces.select(whole.alias("entry")).select(
        F.explode(F.from_json("entry", "MAP<STRING, STRING>", {"mode": "FAILFAST"})).alias(
            "layer_name", "body"))
    return entries.filter(F.col("layer_name").startswith("layer_")).select(
        "layer_name",
        F.regexp_extract("layer_name", r"(\d+)$", 1).cast("int").alias("layer"),
        F.from_json("body", layout).alias("body"),
    )


def scan_model(spark: SparkSession, path: str) -> DataFrame:
    """Scan a ``{layer_k: {weights, biases, activation}}`` document as a layers table.

    Entries other than layers (a version string) are skipped.
    """
    return _document_layers(spark, path, schemas.LAYER_DOCUMENT).select("layer", "body.*")


def scan_node_model(spark: SparkSession, path: str) -> DataFrame:
    """Scan a ``{layer_k: {nodes: [...]}}`` document as ``(layer, neuron, id, ...)``."""
    return (
        _document_layers(spark, path, schemas.NODE_DOCUMENT)
        .select("layer", F.posexplode("body.nodes").alias("neuron", "node"))
        .select(
            "layer", "neuron", "node.id", "node.weights",
            F.col("node.biases").alias("bias"), "node.activation",
        )
    )


def scan_neuron_records(spark: SparkSession, path: str) -> DataFrame:
    """Scan a JSON list of flat neuron records; every field is text."""
    return spark.read.schema(schemas.FLAT_NEURONS).json(path, multiLine=True)


def save_layer_document(layers: DataFrame, path: str, version: str | None = None) -> None:
    """Write a layers table as one JSON document."""
    body = F.struct("weights", "biases", "activation")
    entry = F.struct(F.concat(F.lit("layer_"), F.col("layer")).alias("key"), body.alias("value"))
    layer_list = F.map_from_entries(F.sort_array(F.collect_list(entry)))
    text = layers.agg(F.to_json(layer_list).alias("value"))
    if version is not None:
        head = F.lit('{"version":"' + version + '",')
        text = text.select(F.concat(head, F.expr("substring(value, 2)")).alias("value"))
    text.write.text(path)


def save_neuron_records(flat: DataFrame, path: str) -> None:
    """Write flat neuron records as one JSON list."""
    records = F.to_json(F.collect_list(F.struct(*flat.columns)))
    flat.agg(records.alias("value")).write.text(path)


def save_model(neurons: DataFrame, path: str) -> None:
    """Write a neurons table."""
    neurons.write.parquet(path)


def load_model(spark: SparkSession, path: str) -> DataFrame:
    """Read a neurons table."""
    return spark.read.schema(schemas.NEURONS).parquet(path)
