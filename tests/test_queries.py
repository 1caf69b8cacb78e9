"""Every registered query against its SQL on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry_points

duckdb = pytest.importorskip("duckdb")
SF_DIR = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
         "boolean": "BOOLEAN"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in os.listdir(SF_DIR):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS "
                    f"SELECT * FROM '{SF_DIR}/{name}'")
    return con


def comparable(rows, columns):
    def text(v):
        return "nan" if isinstance(v, float) and math.isnan(v) else repr(v)

    return sorted(tuple(text(r[c]) for c in columns) for r in rows)


@pytest.mark.parametrize("name", sorted(entry_points.queries()))
def test_query(spark, sql, name):
    df = entry_points.queries()[name](spark, SF_DIR)
    rows = [r.asDict() for r in df.collect()]
    assert rows
    text = entry_points.oracle_sql().get(name)
    if text is None:
        return
    result = sql.execute(text)
    types = {d[0]: str(d[1]) for d in result.description}
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema} == types
    expected = [dict(zip(types, r)) for r in result.fetchall()]
    columns = sorted(types)
    assert comparable(rows, columns) == comparable(expected, columns)


def test_entry(spark):
    assert entry_points.entry(spark).columns == ["image_id", "prediction"]
