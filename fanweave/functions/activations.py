"""Activation registry: a name stands for a Column -> Column function.

A function on numpy arrays may be registered beside it for the Arrow form of the
forward pass.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def relu(z: Column) -> Column:
    """``max(0, z)``; NaN stays NaN, as Spark ranks NaN above every number."""
    return F.greatest(F.lit(0.0), z)


def _one(z: Column) -> Column:
    # softmax of a single scalar
    return F.when(z.isNotNull(), F.lit(1.0))


def _identity(z: Column) -> Column:
    return z


_ACTIVATIONS: dict[str, Callable[[Column], Column]] = {"relu": relu, "softmax": _one}
_ON_ARRAYS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "relu": lambda z: np.maximum(z, 0.0),
    "softmax": np.ones_like,
}


def register_activation(
    name: str,
    fn: Callable[[Column], Column],
    on_arrays: Callable[[np.ndarray], np.ndarray] | None = None,
) -> None:
    """Make an activation available; without ``on_arrays`` the Arrow form cannot use it."""
    _ACTIVATIONS[name] = fn
    _ON_ARRAYS.pop(name, None)
    if on_arrays is not None:
        _ON_ARRAYS[name] = on_arrays


def array_functions() -> dict[str, Callable[[np.ndarray], np.ndarray]]:
    return dict(_ON_ARRAYS)


def columns_only() -> set[str]:
    """Names registered for columns but not for arrays."""
    return set(_ACTIVATIONS) - set(_ON_ARRAYS)


def activate(z: Column, name: Column, is_final: Column, unknown: str = "relu") -> Column:
    """Apply the activation called ``name`` to the scalar ``z``.

    A final-layer neuron passes its logit through whatever its activation is.
    A name that is not registered acts as ``unknown``: relu, identity or error.
    """
    result = F.when(is_final, z)
    for known, fn in _ACTIVATIONS.items():
        result = result.when(name == known, fn(z))
    if unknown == "relu":
        return result.otherwise(relu(z))
    if unknown == "identity":
        return result.otherwise(_identity(z))
    if unknown == "error":
        text = F.concat(F.lit("unknown activation: "), F.coalesce(name, F.lit("null")))
        return result.otherwise(F.raise_error(text).cast("double"))
    raise ValueError("unknown must be 'relu', 'identity' or 'error'")
