"""Vector functions and the forward pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fanweave.functions import activate, argmax, relu, softmax
from fanweave.operators.forward import (
    argmax_rows,
    fan_out,
    layer_forward,
    logits,
    neuron_sums,
    predict,
    tag_vectors,
)
from fanweave.plans import query
from fanweave.plans.tables import (
    CELLS_SQL,
    FORWARD_SQL,
    WIDTHS,
    cells,
    exploded,
    formula_neurons,
    images,
)

LAYER_SQL = f"WITH {FORWARD_SQL} SELECT image_id, CAST(slot AS INTEGER) AS slot, x AS value FROM h0"
PREDICT_SQL = f"WITH {FORWARD_SQL} SELECT image_id, prediction FROM formula"
LOGITS_SQL = f"WITH {FORWARD_SQL} SELECT image_id, CAST(slot AS INTEGER) AS slot, z AS value FROM z1"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images(spark, sf_dir).select("image_id", "features")


@query("act_relu", f"WITH {CELLS_SQL} SELECT image_id, slot, greatest(x, 0) AS value FROM cells")
def q_act_relu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(images(spark, sf_dir)).select("image_id", "slot", relu(F.col("x")).alias("value"))


@query(
    "act_softmax",
    f"""WITH {CELLS_SQL},
    powers AS (SELECT image_id, slot, exp(x - max(x) OVER (PARTITION BY image_id)) AS e FROM cells)
    SELECT image_id, slot, round(e / sum(e) OVER (PARTITION BY image_id), 9) AS value FROM powers""",
)
def q_act_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exploded(
        _vectors(spark, sf_dir).withColumn("features", softmax(F.col("features"))), "image_id"
    )
    return rows.withColumn("value", F.round("value", 9))


@query(
    "act_fallback",
    f"""WITH {CELLS_SQL}
    SELECT image_id, slot,
           CASE label % 3 WHEN 2 THEN 1.0::DOUBLE ELSE greatest(x, 0) END AS as_relu,
           CASE label % 3 WHEN 0 THEN greatest(x, 0) WHEN 1 THEN x ELSE 1.0::DOUBLE END AS as_identity,
           x AS as_final
    FROM cells""",
)
def q_act_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """relu, an unregistered sigmoid and scalar softmax, by label."""
    names = F.array(F.lit("relu"), F.lit("sigmoid"), F.lit("softmax"))
    name = F.get(names, F.col("label") % 3)
    x, hidden = F.col("x"), F.lit(False)
    return cells(images(spark, sf_dir)).select(
        "image_id", "slot",
        activate(x, name, hidden).alias("as_relu"),
        activate(x, name, hidden, unknown="identity").alias("as_identity"),
        activate(x, name, F.lit(True)).alias("as_final"),
    )


@query(
    "argmax",
    f"""WITH {CELLS_SQL}
    SELECT image_id, slot AS by_vector, slot AS by_rows
    FROM cells QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY x DESC, slot) = 1""",
)
def q_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = images(spark, sf_dir)
    by_rows = argmax_rows(cells(vectors), "image_id", "slot", "x")
    return vectors.select("image_id", argmax(F.col("features")).alias("by_vector")).join(
        by_rows.withColumnRenamed("prediction", "by_rows"), "image_id"
    )


@query("fan_out", f"SELECT vec_id AS image_id, CAST(0 AS INTEGER) AS layer, CAST(n AS INTEGER) AS neuron "
                  f"FROM embeddings, range({WIDTHS[1]}) AS r(n)")
def q_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = images(spark, sf_dir).select("image_id")
    return fan_out(work, formula_neurons(spark), 0).select("image_id", "layer", "neuron")


@query("neuron_dot", f"WITH {FORWARD_SQL} SELECT image_id, neuron, z FROM z0")
def q_neuron_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neuron_sums(_vectors(spark, sf_dir), formula_neurons(spark), 0).select(
        "image_id", "neuron", "z"
    )


@query("layer_forward", LAYER_SQL)
def q_layer_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = layer_forward(_vectors(spark, sf_dir), formula_neurons(spark), 0, form="hof")
    return exploded(out, "image_id")


@query("layer_forward_arrow", LAYER_SQL)
def q_layer_forward_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = layer_forward(_vectors(spark, sf_dir), formula_neurons(spark), 0, form="arrow")
    return exploded(out, "image_id")


@query("layer_forward_long", LAYER_SQL)
def q_layer_forward_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = layer_forward(_vectors(spark, sf_dir), formula_neurons(spark), 0, form="blocks")
    return exploded(out, "image_id")


@query("logits", LOGITS_SQL)
def q_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(logits(_vectors(spark, sf_dir), formula_neurons(spark)), "image_id")


@query("predict", PREDICT_SQL)
def q_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict(_vectors(spark, sf_dir), formula_neurons(spark))


@query("predict_hof", PREDICT_SQL)
def q_predict_hof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict(_vectors(spark, sf_dir), formula_neurons(spark), form="hof")


@query("predict_long", PREDICT_SQL)
def q_predict_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict(_vectors(spark, sf_dir), formula_neurons(spark), form="blocks")


@query("predict_unbroadcast", PREDICT_SQL)
def q_predict_unbroadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of a model above the broadcast limit, a few neurons in a block."""
    return predict(_vectors(spark, sf_dir), formula_neurons(spark), limit=5000)


@query(
    "logits_unbroadcast",
    f"""WITH {FORWARD_SQL}
    SELECT image_id, e.label, CAST(slot AS INTEGER) AS slot, z AS value
    FROM z1 JOIN embeddings AS e ON image_id = vec_id
    UNION ALL
    SELECT image_id, e.label, CAST(slot AS INTEGER), z
    FROM z1 JOIN embeddings AS e ON image_id = vec_id WHERE image_id % 10 = 0""",
)
def q_logits_unbroadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Above the limit, with labels and with every tenth id twice."""
    labelled = images(spark, sf_dir).select("image_id", "label", "features")
    rows = labelled.unionByName(labelled.filter("image_id % 10 = 0"))
    return exploded(
        logits(rows, formula_neurons(spark), limit=5000), "image_id", "label")


@query(
    "predict_dead_letters",
    f"""WITH {FORWARD_SQL}
    SELECT image_id,
           CASE WHEN image_id % 7 <> 0 AND image_id % 5 <> 0 THEN prediction END AS prediction,
           CASE WHEN image_id % 7 = 0 THEN 'no vector'
                WHEN image_id % 10 = 0 THEN 'vector lengths differ: 65 and 64'
                WHEN image_id % 5 = 0 THEN 'vector lengths differ: 60 and 64' END AS reason
    FROM formula""",
)
def q_predict_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that are null, short or long go aside with a reason; the others are predicted."""
    v, i = F.col("features"), F.col("image_id")
    broken = (
        F.when(i % 7 == 0, F.lit(None)).when(i % 10 == 0, F.array_append(v, F.lit(0.0)))
        .when(i % 5 == 0, F.slice(v, 1, 60)).otherwise(v))
    neurons = formula_neurons(spark)
    tagged = tag_vectors(_vectors(spark, sf_dir).withColumn("features", broken), neurons)
    good = predict(tagged.filter("reason is null").drop("reason"), neurons)
    bad = tagged.filter("reason is not null").select(
        "image_id", F.lit(None).cast("int").alias("prediction"), "reason")
    return good.select(
        "image_id", "prediction", F.lit(None).cast("string").alias("reason")).unionByName(bad)
