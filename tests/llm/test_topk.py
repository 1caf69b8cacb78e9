import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fanweave.llm.topk import search_block, segments, top_k

SCHEMA = "vec_id long, embedding array<float>, id int, v string"


def brute(rows, k, scale):
    clean = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        clean.append((i, [int(max(-2**53, min(2**53, math.floor(scale * float(np.float32(x)))))) for x in v]))
    out = []
    for q, qv in clean:
        if q % 20 == 0:
            scores = [(-max(-2**63, min(2**63 - 1, sum(a * b for a, b in zip(qv, v)))), i)
                      for i, v in clean if i != q]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def rows_of(rng, n, d=12):
    rows = [(i, (rng.normal(size=d) / 4).tolist()) for i in range(n)]
    rows[40] = (40, rows[3][1])
    rows += [(i, rows[3][1]) for i in range(n, n + 60)]  # ties
    rows += [(500, [0.5] * 3), (501, []), (520, [1.0] * 20), (502, None), (503, [None] + [1.0] * 11),
             (504, [float("nan")] * 12), (540, [float("inf")] * 12), (None, [1.0] * 12),
             (20, rows[5][1]), (7, rows[9][1])]
    return rows


@pytest.mark.parametrize("block,asked", [(50, 5), (1000, 1000)])
def test_against_brute_force(spark, block, asked):
    rows = rows_of(np.random.default_rng(1), 300)
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA).repartition(3)
    got = top_k(df, F.col("vec_id") % 20 == 0, k=20, block_rows=block, query_rows=asked)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, 20, 64)


def test_few_and_huge(spark):
    rows = [(0, [1e30, 3.0]), (1, [1e30, 1.0]), (2, [-1e30, 1.0]), (20, [2.0, 1.0]), (3, [3e7, 3e7])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)
    got = top_k(df, F.col("vec_id") % 20 == 0, k=20)
    assert sorted(map(tuple, got.collect())) == brute(rows, 20, 64)
    assert top_k(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []
    assert top_k(df.filter("vec_id = 0"), F.col("vec_id") % 20 == 0).collect() == []


def test_segments_partition_the_postings():
    v = np.array([[0, 5, -9.0], [1, -1, 64]])
    index = segments(v)
    assert sorted(x for s in index for x in s.values) == sorted(v[v != 0])
    highest = [int(np.frexp(np.abs(s.values))[1].max()) for s in index]
    assert highest == sorted(set(highest), reverse=True)
    whole = np.zeros_like(v)
    for s in index:
        whole[:, s.used()] += s.matrix(2)
        assert np.allclose(s.left, np.sqrt(((v - whole) ** 2).sum(1)))
    assert (whole == v).all()


@pytest.mark.parametrize("floored", [False, True])
def test_search_stops_early_and_stays_exact(floored):
    rng = np.random.default_rng(3)
    v = np.floor(rng.normal(size=(4000, 64)) * 8)
    ids = np.arange(4000)
    q = np.floor(v[:30] + rng.normal(size=(30, 64)))
    scores = v @ q.T
    scores[np.arange(30), np.arange(30)] = -np.inf
    floors = np.sort(scores[:1000], axis=0)[-10] if floored else None
    index = segments(v)
    hits, work = search_block(q, ids[:30], index, ids, 10, floors)
    assert work <= 0.9 * 30 * len(index)  # segments are left out
    for n, (place, score) in enumerate(hits):
        want = np.lexsort((ids, -scores[:, n]))[:10]
        assert (place == want).all() and (score == scores[want, n]).all()


def test_segments_are_left_out_on_the_given_vectors(spark):
    """Also a threshold of another block, which leaves out hits below it and no others."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").toPandas()
    v = np.floor(64 * np.stack(rows["embedding"]).astype(np.float64))
    ids = rows["vec_id"].to_numpy()
    asked = v[ids % 20 == 0]
    own = ids[ids % 20 == 0]
    first, second = v[:1000], v[1000:]
    scores = np.where(own[:, None] == ids[None, :1000], -np.inf, asked @ first.T)
    floors = np.sort(scores, axis=1)[:, -20]
    index = segments(second)
    alone, work = search_block(asked, own, index, ids[1000:], 20)
    found, less = search_block(asked, own, index, ids[1000:], 20, floors)
    assert max(less, work) <= 0.9 * len(own) * len(index)
    for (place, score), (at, few), bar in zip(alone, found, floors):
        assert list(place[score >= bar]) == list(at) and list(score[score >= bar]) == list(few)
