"""Vector and text functions built from native Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(x: Column, w: Column, bias: Column | None = None) -> Column:
    """``sum(x[i] * w[i]) + bias``; vectors of unequal length are an error.

    ``zip_with`` pads the shorter side with nulls, so lengths are checked first.
    """
    products = F.zip_with(x, w, lambda a, b: a * b)
    total = F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)
    if bias is not None:
        total = total + bias
    message = F.concat(
        F.lit("vector lengths differ: "), F.size(x).cast("string"),
        F.lit(" and "), F.size(w).cast("string"),
    )
    return F.when(F.size(x) == F.size(w), total).otherwise(F.raise_error(message).cast("double"))


def argmax(v: Column) -> Column:
    """0-based slot of the largest element: first slot on a tie, first NaN if any."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def softmax(v: Column) -> Column:
    """Max-shifted softmax over one vector; a vector of one element gives 1.0."""
    top = F.array_max(v)
    powers = F.transform(v, lambda x: F.exp(x - top))
    # the one-element outer array lets the powers be computed once and used twice
    return F.element_at(
        F.transform(
            F.array(powers),
            lambda e: F.transform(
                e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda acc, y: acc + y)
            ),
        ),
        1,
    )


def affine(v: Column, mean: float = 0.5, std: float = 0.5) -> Column:
    """``(x - mean) / std`` for every element."""
    return F.transform(v, lambda x: (x - F.lit(float(mean))) / F.lit(float(std)))


def split_fields(v: Column, n: int) -> Column:
    """Split on ``|`` into at most ``n`` fields; the last one keeps the rest."""
    return F.split(v, r"\|", n)


def number_text(d: Column) -> Column:
    """Shortest text that reads back as the same double."""
    return d.cast("string")


def percent_text(ratio: Column) -> Column:
    """A ratio as a percentage with two decimals, e.g. ``97.25%``."""
    return F.format_string("%.2f%%", ratio * 100.0)
