"""Vectors as little-endian float64 blobs: raw bytes, hex or base64 text.

Spark has no expression that turns bytes into doubles, so the conversion runs
on Arrow batches; hex and base64 are handled by native expressions around it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOAT64 = "<f8"
WIDTH = 8


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _bytes_to_vector(blobs: pa.Array) -> pa.Array:
    """View the bytes of all blobs as doubles; the lists are the blobs' offsets by eight."""
    lengths = pc.fill_null(pc.binary_length(blobs), 1).to_numpy(zero_copy_only=False)
    whole = pa.array(lengths % WIDTH == 0)
    kept = pc.if_else(whole, blobs, pa.scalar(b"", blobs.type))
    offsets = np.concatenate([[0], np.cumsum(np.where(lengths % WIDTH == 0, lengths, 0))])
    data = b"".join(kept.to_pylist()) if kept.offset else kept.buffers()[2]
    values = np.frombuffer(data or b"", dtype=FLOAT64, count=offsets[-1] // WIDTH)
    return pa.ListArray.from_arrays(
        pa.array((offsets // WIDTH).astype(np.int32)), pa.array(values), mask=pc.invert(whole)
    )


@F.arrow_udf(T.BinaryType())
def _vector_to_bytes(vectors: pa.Array) -> pa.Array:
    """The doubles of all vectors as one buffer, cut at the vectors' offsets."""
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(FLOAT64)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32) * WIDTH
    blobs = pa.BinaryArray.from_buffers(
        pa.binary(), len(vectors), [None, pa.py_buffer(offsets), pa.py_buffer(values)]
    )
    return pc.if_else(vectors.is_valid(), blobs, pa.scalar(None, pa.binary()))


def blob_to_vector(blob: Column, encoding: str = "raw") -> Column:
    """Decode one column; a blob that is no whole number of doubles gives null."""
    readers = {
        "raw": lambda c: c,
        "hex": F.unhex,
        "base64": lambda c: F.try_to_binary(c, F.lit("base64")),
    }
    return _bytes_to_vector(readers[encoding](blob))


def vector_to_blob(vector: Column, encoding: str = "raw") -> Column:
    """Encode one column."""
    writers = {"raw": lambda c: c, "hex": F.hex, "base64": F.base64}
    return writers[encoding](_vector_to_bytes(vector))


def decode_vectors(
    df: DataFrame, encoding: str = "raw", column: str = "blob", into: str = "features"
) -> DataFrame:
    """Replace a blob column by the vector it holds."""
    return df.withColumn(into, blob_to_vector(F.col(column), encoding)).drop(column)


def encode_vectors(
    df: DataFrame, encoding: str = "raw", column: str = "features", into: str = "blob"
) -> DataFrame:
    """Replace a vector column by its blob."""
    return df.withColumn(into, vector_to_blob(F.col(column), encoding)).drop(column)
