"""Table layouts shared by all operators."""

from pyspark.sql import types as T

VECTOR = T.ArrayType(T.DoubleType())

#: one row per input vector
IMAGES = "image_id BIGINT, features ARRAY<DOUBLE>, label INT"

#: one row per state-dict tensor; a bias is a matrix with one row
TENSORS = "ordinal INT, name STRING, value ARRAY<ARRAY<DOUBLE>>"

#: one row per layer
LAYERS = "layer INT, weights ARRAY<ARRAY<DOUBLE>>, biases ARRAY<DOUBLE>, activation STRING"

#: one row per neuron, with what a forward pass needs
NEURONS = (
    "layer INT, neuron INT, weights ARRAY<DOUBLE>, bias DOUBLE, "
    "activation STRING, is_final BOOLEAN, neuron_count INT"
)

#: one layer of the nested model document
LAYER_DOCUMENT = (
    "STRUCT<weights: ARRAY<ARRAY<DOUBLE>>, biases: ARRAY<DOUBLE>, activation: STRING>"
)

#: one layer of the node document
NODE_DOCUMENT = (
    "STRUCT<nodes: ARRAY<STRUCT<id: STRING, weights: ARRAY<DOUBLE>, "
    "biases: DOUBLE, activation: STRING>>>"
)

#: flat neuron records carry every field as text
FLAT_NEURONS = (
    "layer_id STRING, layer_id_num STRING, is_final_layer STRING, neuron_id STRING, "
    "weights STRING, bias STRING, activation STRING, neuron_count STRING"
)

LABELS = "image_id BIGINT, label INT"
PREDICTIONS = "image_id BIGINT, prediction INT"

#: a keyed text message as a log source delivers it
MESSAGES = (
    "key STRING, value STRING, topic STRING, partition INT, offset BIGINT, timestamp TIMESTAMP"
)
