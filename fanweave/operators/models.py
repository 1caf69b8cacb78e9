"""Model tables: tensors -> layers -> nodes -> flat records -> neurons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def tensors_to_layers(tensors: DataFrame) -> DataFrame:
    """Pair weights and biases of a state dict in ``ordinal`` order.

    A bias closes its layer. Only names take part in the running count, so the
    weight matrices do not pass through the single-task window over the names.
    """
    is_weight = F.col("name").contains("weight")
    is_bias = ~is_weight & F.col("name").contains("bias")
    before = W.orderBy("ordinal").rowsBetween(W.unboundedPreceding, -1)
    places = tensors.select(
        "ordinal",
        F.coalesce(F.sum(is_bias.cast("int")).over(before), F.lit(0)).cast("int").alias("layer"),
    )
    weight_at, bias_at = F.when(is_weight, F.col("ordinal")), F.when(is_bias, F.col("ordinal"))
    return (
        tensors.filter(is_weight | is_bias)
        .join(places, "ordinal")
        .groupBy("layer")
        .agg(
            F.max_by("value", weight_at).alias("weights"),
            F.element_at(F.max_by("value", bias_at), 1).alias("biases"),
        )
    )


def assign_activations(layers: DataFrame) -> DataFrame:
    """First layer relu, last layer softmax, the rest sigmoid; a lone layer is relu."""
    last = F.max("layer").over(W.orderBy("layer").rowsBetween(
        W.unboundedPreceding, W.unboundedFollowing))
    first = F.min("layer").over(W.orderBy("layer").rowsBetween(
        W.unboundedPreceding, W.unboundedFollowing))
    names = layers.select("layer").select(
        "layer",
        F.when(F.col("layer") == first, "relu")
        .when(F.col("layer") == last, "softmax")
        .otherwise("sigmoid")
        .alias("activation"),
    )
    return layers.drop("activation").join(names, "layer")


def layers_to_nodes(layers: DataFrame, version: str = "v1") -> DataFrame:
    """One row per neuron.

    ``id`` is version, layer and index written without a separator, so two
    neurons may share it; ``(layer, neuron)`` is the key.
    """
    neuron = F.col("neuron")
    return layers.select(
        "layer", "weights", "activation", F.posexplode("biases").alias("neuron", "bias")
    ).select(
        "layer",
        "neuron",
        F.concat(F.lit(f"{version}_"), F.col("layer"), neuron).alias("id"),
        F.element_at("weights", neuron + 1).alias("weights"),
        "bias",
        "activation",
    )


def flatten_neurons(nodes: DataFrame) -> DataFrame:
    """Flat all-text neuron records with layer number, final flag and layer width."""
    widths = nodes.groupBy("layer").agg(F.count(F.lit(1)).alias("width"))
    # one row per layer
    everything = W.orderBy("layer").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    facts = widths.select("layer", "width", F.max("layer").over(everything).alias("last"))
    return nodes.join(facts, "layer").select(
        F.concat(F.lit("layer_"), F.col("layer")).alias("layer_id"),
        F.col("layer").cast("string").alias("layer_id_num"),
        (F.col("layer") == F.col("last")).cast("int").cast("string").alias("is_final_layer"),
        F.col("neuron").cast("string").alias("neuron_id"),
        F.to_json("weights").alias("weights"),
        F.col("bias").cast("string").alias("bias"),
        "activation",
        F.col("width").cast("string").alias("neuron_count"),
    )


def parse_neuron(flat: DataFrame) -> DataFrame:
    """Typed neurons from flat text records.

    Any final flag but ``"0"``, a missing one included, marks the final layer,
    whose neurons have no activation.
    """
    is_final = ~F.col("is_final_layer").eqNullSafe("0")
    return flat.select(
        F.col("layer_id_num").cast("int").alias("layer"),
        F.col("neuron_id").cast("int").alias("neuron"),
        F.from_json("weights", "array<double>").alias("weights"),
        F.col("bias").cast("double").alias("bias"),
        F.when(~is_final, F.col("activation")).alias("activation"),
        is_final.alias("is_final"),
        F.col("neuron_count").cast("int").alias("neuron_count"),
    )


def summarize_model(neurons: DataFrame) -> DataFrame:
    """Nodes and input width per layer; the input row repeats the first layer's shape.

    The ``input`` row has as nodes the first layer's input width and as ``input_dim``
    null.
    """
    shapes = neurons.groupBy("layer").agg(
        F.count(F.lit(1)).cast("int").alias("nodes"),
        F.max(F.size("weights")).alias("input_dim"),
        F.max("is_final").alias("is_final"),
    )
    roles = F.when(F.col("layer") == 0, F.array(F.lit("input"), _role())).otherwise(
        F.array(_role())
    )
    is_input = F.col("role") == "input"
    return shapes.withColumn("role", F.explode(roles)).select(
        "role",
        F.when(~is_input, F.col("layer")).alias("layer"),
        F.when(is_input, F.col("input_dim")).otherwise(F.col("nodes")).alias("nodes"),
        F.when(~is_input, F.col("input_dim")).alias("input_dim"),
    )


def _role() -> Column:
    return F.when(F.col("is_final"), F.lit("output")).otherwise(F.lit("hidden"))


def order_layers(layers: DataFrame, name: str = "layer_name") -> DataFrame:
    """Layers in the order of their numeric suffix, the last one marked final.

    The windows run over the layer names, one row per layer.
    """
    number = F.regexp_extract(name, r"(\d+)$", 1).cast("int")
    names = layers.select(name).distinct().withColumn("number", number)
    order = W.orderBy("number")
    return names.select(
        name,
        (F.row_number().over(order) - 1).cast("int").alias("position"),
        F.lead("number").over(order).isNull().alias("is_final"),
    )
