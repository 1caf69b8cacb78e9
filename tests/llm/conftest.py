import os

import pytest

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SF_DIR):
        pytest.skip("no test data")
    return SF_DIR


@pytest.fixture(scope="session")
def texts_of():
    """The documents of a test-data folder as ``{doc_id: text}``."""
    import pyarrow.parquet as pq

    def read(folder):
        t = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"])
        return dict(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))

    return read
