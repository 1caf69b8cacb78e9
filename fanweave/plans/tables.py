"""The given tables in the shapes the operators take, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fanweave import schemas
from fanweave.operators.fanin import arrival_seq, micros_of

#: widths of the test network; fixed values
WIDTHS = (64, 32, 10)
#: event types in slot order; fixed values
SLOTS = ("click", "error", "purchase", "signup", "view")
#: columns that order the arrivals
ARRIVAL = ("at", "event_id")
#: three days in microseconds
TTL_MICROS = 3 * 24 * 3600 * 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as images; inputs on a 1/1024 grid, so that sums are exact in any order."""
    return as_images(table(spark, sf_dir, "embeddings"))


def as_images(embeddings: DataFrame) -> DataFrame:
    return embeddings.select(
        F.col("vec_id").alias("image_id"),
        F.transform("embedding", _on_grid).alias("features"),
        "label",
    )


def _on_grid(x: Column) -> Column:
    return F.floor(x.cast("double") * F.lit(1024.0)).cast("double") / F.lit(1024.0)


def cells(images: DataFrame) -> DataFrame:
    """One row per vector element."""
    return images.select("image_id", "label", F.posexplode("features").alias("slot", "x"))


def exploded(df: DataFrame, *keys: str, vector: str = "features") -> DataFrame:
    """A vector result as comparable rows."""
    return df.select(*keys, F.posexplode(vector).alias("slot", "value"))


def formula_neurons(spark: SparkSession) -> DataFrame:
    """The test network: weights and biases by formula, on a 1/64 grid."""
    shapes = F.array(*[
        F.struct(
            F.lit(layer).alias("layer"), F.lit(n_in).alias("n_in"), F.lit(n_out).alias("n_out"),
            F.lit(layer == len(WIDTHS) - 2).alias("is_final"),
        )
        for layer, (n_in, n_out) in enumerate(zip(WIDTHS, WIDTHS[1:]))
    ])
    layers = spark.range(1).select(F.inline(shapes))
    weight = F.expr(
        "transform(sequence(0, n_in - 1), "
        "i -> cast(((31 * layer + 17 * neuron + 7 * i) % 23) - 11 as double) / 64D)"
    )
    return layers.withColumn("neuron", F.explode(F.expr("sequence(0, n_out - 1)"))).select(
        "layer",
        "neuron",
        weight.alias("weights"),
        F.expr("cast(((5 * layer + 3 * neuron) % 7) - 3 as double) / 64D").alias("bias"),
        F.when(~F.col("is_final"), "relu").alias("activation"),
        "is_final",
        F.col("n_out").alias("neuron_count"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as partial outputs: ``(event_id, id, slot, value, at, seq)``.

    ``(at, event_id)`` orders the arrivals; ``seq`` is the same as one number.
    """
    return as_partial_outputs(table(spark, sf_dir, "events"))


def as_partial_outputs(events: DataFrame) -> DataFrame:
    slot = F.array_position(F.array(*[F.lit(s) for s in SLOTS]), F.col("event_type")) - 1
    at = micros_of("ts")
    return events.select(
        "event_id",
        F.col("user_id").alias("id"),
        slot.cast("int").alias("slot"),
        "value",
        arrival_seq(at, F.col("event_id")).alias("seq"),
        at.alias("at"),
    )


def event_of(seq: str) -> Column:
    """The event id inside an arrival number."""
    step = F.lit("10000000000000000000").cast("decimal(20,0)")
    return F.pmod(F.col(seq), step).cast("bigint")


def label_statistics(images: DataFrame) -> DataFrame:
    """Mean, greatest and least vector of every label as a three-layer state dict.

    The table is aggregated to one row per label and element in the map tasks;
    what is left has the size of the model.
    """
    per_cell = cells(images).groupBy("label", "slot").agg(
        (F.floor(F.sum("x") / F.count("x") * F.lit(1024.0)).cast("double") / F.lit(1024.0)).alias(
            "mean"
        ),
        F.max("x").alias("top"),
        F.min("x").alias("low"),
    )
    per_label = per_cell.groupBy("label").agg(
        F.sort_array(F.collect_list(F.struct("slot", "mean", "top", "low"))).alias("s")
    )
    # a field of an array of structs is the array of that field
    vectors = F.array("s.mean", "s.top", "s.low")
    squares = F.aggregate("weights", F.lit(0.0), lambda acc, w: acc + w * w)
    units = per_label.select("label", F.posexplode(vectors).alias("layer", "weights")).select(
        "layer", F.struct("label", "weights", (squares * F.lit(-0.5)).alias("bias")).alias("unit")
    )
    stacked = units.groupBy("layer").agg(F.sort_array(F.collect_list("unit")).alias("units"))
    prefix = F.concat(F.lit("fc"), F.col("layer") + 1)
    weights = F.struct(
        (F.col("layer") * 2).alias("ordinal"),
        F.concat(prefix, F.lit(".weight")).alias("name"),
        F.transform("units", lambda u: u["weights"]).alias("value"),
    )
    biases = F.struct(
        (F.col("layer") * 2 + 1).alias("ordinal"),
        F.concat(prefix, F.lit(".bias")).alias("name"),
        F.array(F.transform("units", lambda u: u["bias"])).alias("value"),
    )
    return stacked.select(F.inline(F.array(weights, biases)))


def centroid_neurons(images: DataFrame) -> DataFrame:
    """Nearest mean as a one-layer network: weights are the mean, bias -|mean|^2 / 2."""
    named = {r: F.col(r) for r in ("layer", "neuron", "weights", "bias")}
    tensors = label_statistics(images).filter(F.col("ordinal") < 2)
    pair = tensors.agg(
        F.max_by("value", F.when(F.col("ordinal") == 0, 1)).alias("w"),
        F.max_by("value", F.when(F.col("ordinal") == 1, 1)).alias("b"),
    )
    rows = pair.select(
        F.lit(0).alias("layer"),
        F.posexplode(F.arrays_zip(F.col("w").alias("w"), F.element_at("b", 1).alias("b"))).alias(
            "neuron", "u"
        ),
    ).select("layer", "neuron", F.col("u.w").alias("weights"), F.col("u.b").alias("bias"))
    return rows.select(
        *named.values(),
        F.lit(None).cast("string").alias("activation"),
        F.lit(True).alias("is_final"),
        F.lit(10).alias("neuron_count"),
    )


NEURON_COLUMNS = [part.strip().split()[0] for part in schemas.NEURONS.split(",")]

# --- the same shapes in SQL ------------------------------------------------------------------

CELLS_SQL = """
cells AS (
  SELECT image_id, label, CAST(generate_subscripts(features, 1) - 1 AS INTEGER) AS slot,
         unnest(features) AS x
  FROM (SELECT vec_id AS image_id, label,
               list_transform(embedding, lambda e: floor(CAST(e AS DOUBLE) * 1024) / 1024) AS features
        FROM embeddings)
)"""


def weights_sql(layer: int) -> str:
    n_in, n_out = WIDTHS[layer], WIDTHS[layer + 1]
    return f"""
w{layer} AS (
  SELECT CAST(n AS INTEGER) AS neuron, CAST(i AS INTEGER) AS slot,
         CAST(((31 * {layer} + 17 * n + 7 * i) % 23) - 11 AS DOUBLE) / 64 AS w,
         CAST(((5 * {layer} + 3 * n) % 7) - 3 AS DOUBLE) / 64 AS bias
  FROM range({n_out}) AS a(n), range({n_in}) AS b(i)
)"""


FORWARD_SQL = f"""{CELLS_SQL}, {weights_sql(0)}, {weights_sql(1)},
z0 AS (
  SELECT image_id, label, neuron, sum(x * w) + any_value(bias) AS z
  FROM cells JOIN w0 USING (slot) GROUP BY image_id, label, neuron
),
h0 AS (SELECT image_id, label, neuron AS slot, greatest(z, 0) AS x FROM z0),
z1 AS (
  SELECT image_id, label, neuron AS slot, sum(x * w) + any_value(bias) AS z
  FROM h0 JOIN w1 USING (slot) GROUP BY image_id, label, neuron
),
formula AS (
  SELECT image_id, CAST(slot AS INTEGER) AS prediction
  FROM z1 QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY z DESC, slot) = 1
)"""

STATISTICS_SQL = f"""{CELLS_SQL},
stats AS (
  SELECT label, slot, floor(sum(x) / count(x) * 1024) / 1024 AS mean, max(x) AS top, min(x) AS low
  FROM cells GROUP BY label, slot
),
units AS (
  SELECT 0 AS layer, label AS neuron, slot, mean AS w FROM stats
  UNION ALL SELECT 1, label, slot, top FROM stats
  UNION ALL SELECT 2, label, slot, low FROM stats
),
biases AS (SELECT layer, neuron, -0.5 * sum(w * w) AS bias FROM units GROUP BY layer, neuron)"""

CENTROID_SQL = """
scores AS (
  SELECT c.image_id, c.label, u.neuron, sum(c.x * u.w) + any_value(b.bias) AS z
  FROM cells c JOIN units u ON c.slot = u.slot AND u.layer = 0
  JOIN biases b ON b.layer = 0 AND b.neuron = u.neuron
  GROUP BY c.image_id, c.label, u.neuron
),
centroid AS (
  SELECT image_id, CAST(neuron AS INTEGER) AS prediction, z
  FROM scores QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY z DESC, neuron) = 1
),
confident AS (SELECT image_id, prediction FROM centroid WHERE z > 0)"""

MESSAGES_SQL = """
m AS (
  SELECT event_id, user_id AS id,
         CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2
              WHEN 'signup' THEN 3 WHEN 'view' THEN 4 END AS INTEGER) AS slot,
         value, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq
  FROM events
)"""
