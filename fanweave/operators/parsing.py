"""Text message layouts as column expressions.

``tag_messages`` adds the parsed fields and a ``reason`` that is null for a good
row; ``parse_messages`` splits the result into good rows and dead letters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fanweave.functions.blobs import blob_to_vector
from fanweave.functions.vectors import split_fields

#: fields of the delimited layouts, in order; fixed values
LAYOUTS: dict[str, tuple[str, ...]] = {
    "P1": ("slot", "value"),
    "P2": ("slot", "image_id", "value"),
    "P3": ("image_id", "slot", "value"),
    "P6": ("slot", "batch_id", "batch_size"),
    "P6_VECTOR": ("slot", "batch_id", "batch_size", "columns", "vector"),
    "P7": ("layer", "image_id"),
    "P8": ("layer", "batch_id", "batch_size", "columns"),
    "P9": ("layer", "image_id", "vector"),
    "P10": ("image_id", "prediction"),
}

#: types of the fields; fixed values
FIELD_TYPES: dict[str, str] = {
    "slot": "int",
    "layer": "int",
    "columns": "int",
    "batch_size": "int",
    "prediction": "int",
    "image_id": "bigint",
    "batch_id": "bigint",
    "value": "double",
}

#: fields of the JSON layouts; ``output`` is a number or a hex float64
JSON_LAYOUTS: dict[str, str] = {
    "P4": "neuron_id STRING, image_id STRING, output STRING",
    "P5": "neuron_id STRING, image_id STRING",
    "P7_JSON": "layer STRING, image_id STRING",
}


def _typed(text: Column, field: str) -> Column:
    return text.try_cast(FIELD_TYPES[field])


def _layer_number(text: Column) -> Column:
    """A layer as ``3`` or ``layer_3``."""
    return F.regexp_extract(text, r"^(?:layer[-_])?(\d+)$", 1).try_cast("int")


def _first_reason(checks: list[tuple[Column, str]]) -> Column:
    return F.coalesce(*[F.when(bad, F.lit(text)) for bad, text in checks])


def _delimited(df: DataFrame, layout: str) -> tuple[dict[str, Column], list]:
    names = LAYOUTS[layout]
    parts = split_fields(F.col("value"), len(names))
    fields: dict[str, Column] = {}
    if layout == "P1":
        fields["image_id"] = F.col("key").try_cast("bigint")
    for place, name in enumerate(names):
        text = F.get(parts, F.lit(place))
        if name == "vector":
            fields[name] = blob_to_vector(text, "base64")
        elif name == "layer":
            fields[name] = _layer_number(text)
        else:
            fields[name] = _typed(text, name)
    checks = [(F.col("value").isNull(), "no value"), (F.size(parts) < len(names), "missing field")]
    return fields, checks


def _json(df: DataFrame, layout: str, encoding: str | None) -> tuple[dict[str, Column], list]:
    body = F.from_json("value", JSON_LAYOUTS[layout])
    fields: dict[str, Column] = {}
    if layout == "P7_JSON":
        fields["layer"] = _layer_number(body["layer"])
    else:
        fields["slot"] = body["neuron_id"].try_cast("int")
    # the earliest form of the layer message has no image id
    fields["image_id"] = body["image_id"].try_cast("bigint")
    if layout == "P4":
        fields["value"] = (
            F.element_at(blob_to_vector(body["output"], encoding), 1)
            if encoding
            else body["output"].try_cast("double")
        )
    checks = [(F.col("value").isNull(), "no value"), (F.get_json_object("value", "$").isNull(),
                                                      "not JSON")]
    return fields, checks


def tag_messages(
    df: DataFrame, layout: str, n: int | None = None, encoding: str | None = None
) -> DataFrame:
    """Parse ``value`` (and ``key``) by ``layout``; other columns stay.

    ``n`` is the layer width: a slot outside ``0 .. n-1`` is a dead letter.
    ``encoding`` is ``hex`` for P4 messages with hex float64 outputs.
    """
    if layout in LAYOUTS:
        fields, checks = _delimited(df, layout)
    elif layout in JSON_LAYOUTS:
        fields, checks = _json(df, layout, encoding)
    else:
        raise ValueError(f"unknown layout: {layout}")
    raw = {"raw_key": F.col("key"), "raw_value": F.col("value")}
    others = [c for c in df.columns if c not in ("key", "value", *fields)]
    values = F.struct(
        *[c.alias(name) for name, c in raw.items()],
        _first_reason(checks).alias("_shape"),
        *[c.alias(name) for name, c in fields.items()],
    )
    # one element: later filters stay above it, so a message is parsed once
    parsed = df.select(*others, F.inline(F.array(values)))
    optional = {"image_id"} if layout == "P7_JSON" else set()
    bad = [(F.col(name).isNull(), f"bad {name}") for name in fields if name not in optional]
    if n is not None and "slot" in fields:
        bad.append(((F.col("slot") < 0) | (F.col("slot") >= n), "slot out of range"))
    reason = F.coalesce(F.col("_shape"), _first_reason(bad))
    return parsed.withColumn("reason", reason).drop("_shape")


def good_rows(tagged: DataFrame) -> DataFrame:
    return tagged.filter(F.col("reason").isNull()).drop("reason", "raw_key", "raw_value")


def bad_rows(tagged: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Dead letters: the message as it came, with a reason."""
    return tagged.filter(F.col("reason").isNotNull()).select(
        *(keep or []), F.col("raw_key").alias("key"), F.col("raw_value").alias("value"), "reason"
    )


def parse_messages(
    df: DataFrame, layout: str, n: int | None = None, encoding: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(good, bad)`` rows of one layout."""
    tagged = tag_messages(df, layout, n, encoding)
    return good_rows(tagged), bad_rows(tagged)


def lookup_values(
    messages: DataFrame, outputs: DataFrame, keys: tuple[str, ...] = ("image_id", "slot")
) -> DataFrame:
    """Values of P5 notices from the table the neurons wrote them to.

    The key is unique in ``outputs``; a hot image spreads over its neurons, and
    adaptive skew-join handling splits what is left.
    """
    return messages.join(outputs, list(keys))
