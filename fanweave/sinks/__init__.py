"""Table sinks."""

from fanweave.sinks.predictions import (
    compact_upserts,
    latest_predictions,
    pending,
    read_upserts,
    upsert_predictions,
    write_predictions,
)

__all__ = [
    "compact_upserts", "latest_predictions", "pending", "read_upserts", "upsert_predictions",
    "write_predictions",
]
