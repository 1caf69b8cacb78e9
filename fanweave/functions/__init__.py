"""Column functions."""

from fanweave.functions.activations import activate, register_activation, relu
from fanweave.functions.blobs import decode_vectors, encode_vectors
from fanweave.functions.vectors import (
    affine,
    argmax,
    dot,
    number_text,
    percent_text,
    softmax,
    split_fields,
)

__all__ = [
    "activate", "affine", "argmax", "decode_vectors", "dot", "encode_vectors",
    "number_text", "percent_text", "register_activation", "relu", "softmax", "split_fields",
]
