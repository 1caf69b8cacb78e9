"""Hot keys: finding them and keeping them from filling one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanweave.session import stage

#: a key with at least this many rows is treated as hot; others are sorted in one task, at about 200 bytes a row
HOT_ROWS = 500_000
#: tables of at most so many keys are broadcast; larger ones are joined ordinarily
BROADCAST_KEYS = 1_000_000


def hot_keys(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """All keys with ``hot_rows`` rows or more as a written table; None if there are none.

    Rows are counted with a partial aggregate. No number of keys is too large: a table of
    T rows has at most T / ``hot_rows`` of them.
    """
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    hot = stage(counts.filter(F.col("_rows") >= hot_rows).select(key), "hot-keys")
    return None if hot.isEmpty() else hot


def _small(table: DataFrame, keys: int) -> DataFrame:
    return F.broadcast(table) if keys <= BROADCAST_KEYS else table


def split_hot(df: DataFrame, key: str, hot: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """The rows of the other keys, and the rows of hot keys (None if there are none)."""
    if hot is None:
        return df, None
    keys = _small(hot, hot.count())
    return df.join(keys, key, "left_anti"), df.join(keys, key, "left_semi")


def attach_per_key(
    df: DataFrame, facts: DataFrame, key: str, hot: DataFrame | None
) -> DataFrame:
    """Inner join with a table of one row per key.

    The facts of hot keys are broadcast up to ``BROADCAST_KEYS`` of them, so the rows of
    these keys stay spread over the map tasks. All other keys take the ordinary join.
    """
    cold, apart = split_hot(df, key, hot)
    joined = cold.join(facts, key)
    if hot is None:
        return joined
    n = hot.count()
    hot_facts = facts.join(_small(hot, n), key, "left_semi")
    return joined.unionByName(apart.join(_small(hot_facts, n), key))
