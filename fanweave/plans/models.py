"""Model tables derived from the images: tensors, layers, nodes, neurons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fanweave.operators.models import (
    assign_activations,
    flatten_neurons,
    layers_to_nodes,
    order_layers,
    parse_neuron,
    summarize_model,
    tensors_to_layers,
)
from fanweave.plans import query
from fanweave.plans.tables import STATISTICS_SQL, images, label_statistics, table
from fanweave.session import new_path
from fanweave.sources import (
    load_model,
    save_layer_document,
    save_model,
    save_neuron_records,
    scan_model,
    scan_neuron_records,
)

ACTIVATION_SQL = (
    "CASE layer WHEN 0 THEN 'relu' WHEN (SELECT max(layer) FROM units) THEN 'softmax' "
    "ELSE 'sigmoid' END"
)
WEIGHTS_SQL = f"""WITH {STATISTICS_SQL}
SELECT layer, neuron, slot AS input, w AS weight, bias FROM units JOIN biases USING (layer, neuron)"""

NEURONS_SQL = f"""WITH {STATISTICS_SQL}
SELECT layer, neuron, slot AS input, w AS weight, bias,
       CASE WHEN layer < (SELECT max(layer) FROM units) THEN {ACTIVATION_SQL} END AS activation,
       layer = (SELECT max(layer) FROM units) AS is_final,
       CAST(count(DISTINCT neuron) OVER (PARTITION BY layer) AS INTEGER) AS neuron_count
FROM units JOIN biases USING (layer, neuron)"""


def _layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_activations(tensors_to_layers(label_statistics(images(spark, sf_dir))))


def _neurons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_neuron(flatten_neurons(layers_to_nodes(_layers(spark, sf_dir))))


def _by_weight(neurons: DataFrame) -> DataFrame:
    others = [c for c in neurons.columns if c != "weights"]
    return neurons.select(*others, F.posexplode("weights").alias("input", "weight"))


@query("model_layers", WEIGHTS_SQL)
def q_model_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers = tensors_to_layers(label_statistics(images(spark, sf_dir)))
    rows = layers.select("layer", F.posexplode(F.arrays_zip("weights", "biases"))).select(
        "layer", F.col("pos").alias("neuron"), F.col("col.weights"),
        F.col("col.biases").alias("bias"),
    )
    return _by_weight(rows)


@query("model_activations",
       f"WITH {STATISTICS_SQL} SELECT DISTINCT layer, {ACTIVATION_SQL} AS activation FROM units")
def q_model_activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _layers(spark, sf_dir).select("layer", "activation")


@query(
    "model_nodes",
    f"""WITH {STATISTICS_SQL}
    SELECT layer, neuron, 'v1_' || layer || neuron AS id, slot AS input, w AS weight, bias,
           {ACTIVATION_SQL} AS activation
    FROM units JOIN biases USING (layer, neuron)""",
)
def q_model_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through a model document with a version entry, as another tool would hand it over."""
    path = new_path(spark, "model-document")
    save_layer_document(_layers(spark, sf_dir), path, version="v1")
    return _by_weight(layers_to_nodes(scan_model(spark, path)))


@query("model_neurons", NEURONS_SQL)
def q_model_neurons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through flat neuron records on disk."""
    path = new_path(spark, "neuron-records")
    save_neuron_records(flatten_neurons(layers_to_nodes(_layers(spark, sf_dir))), path)
    return _by_weight(parse_neuron(scan_neuron_records(spark, path)))


@query("model_roundtrip", NEURONS_SQL)
def q_model_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "model")
    save_model(_neurons(spark, sf_dir), path)
    return _by_weight(load_model(spark, path))


@query(
    "model_summary",
    f"""WITH {STATISTICS_SQL},
    shapes AS (SELECT layer, CAST(count(DISTINCT neuron) AS INTEGER) AS nodes,
                      CAST(max(slot) + 1 AS INTEGER) AS input_dim FROM units GROUP BY layer)
    SELECT CASE WHEN layer = (SELECT max(layer) FROM shapes) THEN 'output' ELSE 'hidden' END AS role,
           layer, nodes, input_dim FROM shapes
    UNION ALL SELECT 'input', NULL, input_dim, NULL FROM shapes WHERE layer = 0""",
)
def q_model_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarize_model(_neurons(spark, sf_dir))


@query(
    "layer_order",
    """WITH names AS (SELECT DISTINCT 'layer_' || (label + 5) AS layer_name, label FROM embeddings)
    SELECT layer_name, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS position,
           label = (SELECT max(label) FROM names) AS is_final FROM names""",
)
def q_layer_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("layer_"), F.col("label") + 5).alias("layer_name")
    )
    return order_layers(names)


@query(
    "model_document",
    """WITH v AS (SELECT vec_id % 100 AS layer, label, embedding FROM embeddings),
    c AS (SELECT layer, label, i - 1 AS input,
                 floor(CAST(embedding[i] AS DOUBLE) * 1024) / 1024 AS x
          FROM v, range(1, 65) AS r(i)),
    s AS (SELECT layer, label, input, sum(x) AS weight, count(*) AS n FROM c GROUP BY ALL)
    SELECT CAST(layer AS INTEGER) AS layer,
           CAST(dense_rank() OVER (PARTITION BY layer ORDER BY label) - 1 AS INTEGER) AS neuron,
           CAST(input AS INTEGER) AS input, weight, CAST(n AS DOUBLE) AS bias
    FROM s""",
)
def q_model_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document of 100 layers, with a neuron per label, written and scanned layer by layer."""
    named = images(spark, sf_dir).withColumn("layer", (F.col("image_id") % 100).cast("int"))
    sums = named.select("layer", "label", F.posexplode("features").alias("input", "x")).groupBy(
        "layer", "label", "input").agg(F.sum("x").alias("w"), F.count(F.lit(1)).alias("n"))
    neurons = sums.groupBy("layer", "label").agg(
        F.sort_array(F.collect_list(F.struct("input", "w"))).alias("cells"),
        F.max("n").cast("double").alias("bias"))
    held = F.sort_array(F.collect_list(F.struct("label", F.col("cells.w").alias("w"), "bias")))
    layers = neurons.groupBy("layer").agg(held.alias("held")).select(
        "layer", F.col("held.w").alias("weights"), F.col("held.bias").alias("biases"),
        F.lit("relu").alias("activation"))
    path = new_path(spark, "model-document")
    save_layer_document(layers, path, version="v1")
    rows = scan_model(spark, path).select(
        "layer", F.posexplode(F.arrays_zip("weights", "biases")).alias("neuron", "unit"))
    return rows.select(
        "layer", "neuron", F.posexplode("unit.weights").alias("input", "weight"),
        F.col("unit.biases").alias("bias"))
