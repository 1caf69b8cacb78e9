"""Row identity for tables whose ids may be null or repeated."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanweave.session import stage


def fresh(name: str, taken: Iterable[str]) -> str:
    """``name``, or a variant of it that no column in ``taken`` has."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def numbered(docs: DataFrame, label: str) -> tuple[DataFrame, str]:
    """The table written once with a unique row number, and that column's name.

    The number tells rows apart whose ids are equal or null. It is written, so it
    stays the same when a lost task runs again.
    """
    row = fresh("row_no", docs.columns)
    return stage(docs.withColumn(row, F.monotonically_increasing_id()), label), row


#: rows that one Arrow batch may hold in the operators on texts
BATCH_ROWS = 1000


def small_batches(df: DataFrame, rows: int = BATCH_ROWS) -> DataFrame:
    """``df``, after lowering the session's rows per Arrow batch to ``rows`` at most.

    Spark bounds a batch by rows only, and both sides of a Python task hold one; texts
    of a hundred thousand characters must not come ten thousand at a time.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(key)) <= rows:
        conf.set(key, rows)
    return df
