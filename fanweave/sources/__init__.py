"""Table scans."""

from fanweave.sources.features import scan_features, scan_labels, scan_vector_blobs
from fanweave.sources.models import (
    load_model,
    save_layer_document,
    save_model,
    save_neuron_records,
    scan_model,
    scan_neuron_records,
    scan_node_model,
)
from fanweave.sources.predictions import scan_predictions

__all__ = [
    "load_model", "save_layer_document", "save_model", "save_neuron_records", "scan_features",
    "scan_labels", "scan_model", "scan_neuron_records", "scan_node_model", "scan_predictions",
    "scan_vector_blobs",
]
