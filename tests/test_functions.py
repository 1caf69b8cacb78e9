import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fanweave import functions as fn
from fanweave.functions.blobs import blob_to_vector, vector_to_blob


def vectors(spark, *rows):
    return spark.createDataFrame([(list(map(float, r)),) for r in rows], "v ARRAY<DOUBLE>")


def one(df, column):
    return df.select(column.alias("r")).first()["r"]


def test_dot_adds_bias(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, -1.0])], "x ARRAY<DOUBLE>, w ARRAY<DOUBLE>")
    assert one(df, fn.dot(F.col("x"), F.col("w"), F.lit(0.5))) == 1.5


def test_dot_of_unequal_lengths_is_an_error(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0])], "x ARRAY<DOUBLE>, w ARRAY<DOUBLE>")
    with pytest.raises(Exception, match="vector lengths differ: 2 and 1"):
        one(df, fn.dot(F.col("x"), F.col("w")))


def test_relu_keeps_nan(spark):
    df = spark.createDataFrame([(float("nan"),), (-1.0,), (2.0,)], "z DOUBLE")
    got = [r.r for r in df.select(fn.relu(F.col("z")).alias("r")).collect()]
    assert math.isnan(got[0]) and got[1:] == [0.0, 2.0]


@pytest.mark.parametrize(
    "vector, expected",
    [([1, 3, 3], 1), ([1, float("nan"), 2], 1), ([-5], 0), ([-0.0, 0.0], 0), ([2, 1, 2], 0)],
)
def test_argmax(spark, vector, expected):
    assert one(vectors(spark, vector), fn.argmax(F.col("v"))) == expected


def test_softmax_is_shifted_and_scalar_is_one(spark):
    big = one(vectors(spark, [1000, 1001, 999]), fn.softmax(F.col("v")))
    e = np.exp(np.array([-1.0, 0.0, -2.0]))
    assert big == pytest.approx((e / e.sum()).tolist(), rel=1e-14)
    assert one(vectors(spark, [-7]), fn.softmax(F.col("v"))) == [1.0]


def test_activation_fallbacks(spark):
    df = spark.createDataFrame([(-2.0, "sigmoid")], "z DOUBLE, a STRING")
    z, a, hidden = F.col("z"), F.col("a"), F.lit(False)
    assert one(df, fn.activate(z, a, hidden)) == 0.0
    assert one(df, fn.activate(z, a, hidden, unknown="identity")) == -2.0
    assert one(df, fn.activate(z, a, F.lit(True))) == -2.0
    assert one(df, fn.activate(z, F.lit("softmax"), hidden)) == 1.0
    with pytest.raises(Exception, match="unknown activation: sigmoid"):
        one(df, fn.activate(z, a, hidden, unknown="error"))


def test_number_text_reads_back(spark):
    values = [0.1, 1e-7, 1 / 3, -123456.789, 1e300, 5e-324]
    df = spark.createDataFrame([(v,) for v in values], "d DOUBLE")
    text = fn.number_text(F.col("d"))
    assert [r.r for r in df.select(text.cast("double").alias("r")).collect()] == values


def test_percent_text(spark):
    assert one(spark.range(1), fn.percent_text(F.lit(0.9725))) == "97.25%"


@pytest.mark.parametrize("encoding", ["raw", "hex", "base64"])
def test_blobs_come_back_unchanged(spark, encoding):
    v = [0.0, -1.5, 1e-7]
    blob = vector_to_blob(F.col("v"), encoding)
    assert one(vectors(spark, v), blob_to_vector(blob, encoding)) == v


def test_blob_bytes_are_little_endian_doubles(spark):
    blob = one(vectors(spark, [1.5, -2.0]), vector_to_blob(F.col("v")))
    assert bytes(blob) == np.array([1.5, -2.0], dtype="<f8").tobytes()


def test_broken_blob_is_null(spark):
    df = spark.createDataFrame([("abc",)], "b STRING")
    assert one(df, blob_to_vector(F.col("b"), "base64")) is None
