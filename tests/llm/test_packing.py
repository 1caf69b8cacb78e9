import random

import pytest
from pyspark.sql import functions as F

from fanweave.llm.packing import best_fit, pack_group, word_count

SCHEMA = "doc_id long, size long, source string, cluster long, bin string, row_no int"


def naive(pieces, capacity):
    """Try every bin for every piece."""
    bins, out = [], [None] * len(pieces)
    for at in sorted(range(len(pieces)), key=lambda n: (-pieces[n][0], n)):
        size, source, cluster = pieces[at]
        fits = [(b["left"], n) for n, b in enumerate(bins) if b["left"] >= size
                and (source is None or source not in b["sources"])
                and (cluster is None or cluster not in b["clusters"])]
        if not fits:
            bins.append({"left": capacity, "sources": set(), "clusters": set()})
            fits = [(capacity, len(bins) - 1)]
        _, n = min(fits)
        b = bins[n]
        out[at] = (n, capacity - b["left"])
        b["left"] -= size
        b["sources"].add(source)
        b["clusters"].add(cluster)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_same_bins_as_trying_all(seed):
    rng = random.Random(seed)
    pieces = [(rng.choice([0, 1, 5, 30, 50, 51, 100, rng.randint(0, 100)]),
               rng.choice([None, "hot", "hot", "hot", *map(str, range(rng.choice([3, 40])))]),
               rng.choice([None, *range(rng.choice([4, 90]))])) for _ in range(500)]
    assert pack_group(pieces, 100) == naive(pieces, 100)
    assert pack_group([], 100) == []


def rows_of(n=700):
    rng = random.Random(3)
    rows = [(i, rng.choice([1, 40, 90, 100, 101, 250, 0, None, -4]), rng.choice([None, "a", "a", "b", "c"]),
             rng.choice([None, i, i, 7]), "clash", 1) for i in range(n)]
    return rows + [(None, 60, "a", 1, "", 1), (None, 60, "a", 1, "", 1), (3, 60, None, None, "", 1),
                   (9999, 100_000, "long", 5, "", 1)]


def test_nothing_is_lost_and_no_conflict(spark):
    rows = rows_of()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = best_fit(df, F.col("size"), F.col("source"), F.col("cluster"), capacity=100, group_rows=150)
    assert got.columns == ["doc_id", "piece", "start", "size", "bin", "bin_offset"]
    got = got.collect()
    totals = {}
    for r in got:
        totals[r.doc_id] = totals.get(r.doc_id, 0) + r.size
        assert r.start == 100 * r.piece and 0 <= r.size <= 100
    want = {}
    for i, size, *_ in rows:
        want[i] = want.get(i, 0) + max(0, size or 0)
    assert totals == want
    facts = {i: (s, c) for i, _, s, c, _, _ in rows if i is not None and i != 3}
    bins = {}
    for r in got:
        bins.setdefault(r.bin, []).append(r)
    assert len({b.split("-")[0] for b in bins}) > 1
    for members in bins.values():
        at = 0
        for r in sorted(members, key=lambda r: (r.bin_offset, r.size)):
            assert r.bin_offset == at
            at += r.size
        assert at <= 100
        for n in (0, 1):
            keys = [facts[r.doc_id][n] for r in members if r.doc_id in facts]
            keys = [k for k in keys if k is not None]
            assert len(keys) == len(set(keys))
    assert best_fit(df.limit(0), F.col("size"), F.col("source"), F.col("cluster")).collect() == []


def test_one_group_packs_as_the_local_form(spark):
    rows = [(i, (i * 37) % 100 + 1, "ab"[i % 2], i % 50, "", 1) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = best_fit(df, F.col("size"), F.col("source"), F.col("cluster"), capacity=100).collect()
    pieces = [(r[1], r[2], r[3]) for r in sorted(rows, key=lambda r: -r[1])]
    assert abs(len({r.bin for r in got}) - len({b for b, _ in naive(pieces, 100)})) <= 2


@pytest.mark.parametrize("text,n", [(None, 0), ("", 0), (" \n", 0), ("a", 1), ("a  b\n\tc ", 3),
                                    (" é x y", 2 + 1)])
def test_word_count(spark, text, n):
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(word_count("text")).first()[0] == n
