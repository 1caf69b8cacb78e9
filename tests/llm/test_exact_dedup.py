import hashlib
import random
import re

import pytest

from fanweave.llm.exact_dedup import drop_exact_duplicates, exact_duplicates

SCHEMA = "doc_id long, text string, row_no string, kept int"


def expected(rows):
    """By brute force over whole texts."""
    groups = {}
    for n, (i, text) in enumerate(rows):
        norm = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        groups.setdefault(norm, []).append((len(text or ""), i, n))
    out = []
    for norm, members in groups.items():
        best = min(members, key=lambda m: (-m[0], m[1] is None, m[1] or 0, m[2]))
        sha = hashlib.sha256(norm.encode()).hexdigest()
        out += [(m[1], best[1], len(members), m == best, sha) for m in members]
    return sorted(out, key=repr)


def cases():
    rng = random.Random(3)
    words = ["the", "and", "intest ", "börk", " x", "\U0001F600", "\n", "\t\x0b\x0c\r", "ends"]
    long = " ".join(rng.choice(words) for _ in range(60_000))
    base = " ".join(rng.choice(words) for _ in range(900))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "ab"), (6, "a b"), (6, "ab"),
            (None, "ab"), (None, None), (7, long), (8, long.replace(" ", "  ")), (9, long[:-1]),
            (10, "x" * 30_000), (11, "x" * 30_001), (12, "x" * 8192), (13, "x" * 1024)]
    rows += [(100 + k, base.replace(" ", "\n", k)) for k in range(60)]
    rows += [(200 + k, base[k:] + base[:k]) for k in range(30)]
    return rows


@pytest.mark.parametrize("bits", [64, 3])
def test_groups_by_whole_texts(spark, bits):
    rows = cases()
    df = spark.createDataFrame([(i, t, "clash", 0) for i, t in rows], SCHEMA).repartition(3)
    got = exact_duplicates(df, bits=bits).drop("row_no").collect()
    plain = sorted((tuple(r) for r in got), key=repr)
    if bits == 64:
        assert plain == expected(rows)
    else:  # forced collisions change nothing
        assert plain == expected(rows)


def test_rows_that_stay_keep_their_columns(spark):
    rows = cases()
    df = spark.createDataFrame([(i, t, f"r{n}", n) for n, (i, t) in enumerate(rows)], SCHEMA)
    got = drop_exact_duplicates(df)
    assert got.columns == df.columns
    kept = got.collect()
    assert len(kept) == len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows})
    assert {(r.doc_id, r.text, r.row_no, r.kept) for r in kept} <= {
        (i, t, f"r{n}", n) for n, (i, t) in enumerate(rows)}


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert exact_duplicates(df).collect() == []
    assert drop_exact_duplicates(df).collect() == []


def test_plan_is_native(spark):
    df = spark.createDataFrame([(1, "a", "", 0)], SCHEMA)
    plan = exact_duplicates(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan
