import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fanweave.llm.repeats import Words, in_buckets, remove_repeats, repeated_paths

SCHEMA = "doc_id bigint, text string"
WORD = re.compile("[^\x20\x09-\x0D]+")


def brute(rows, window=35):
    """``(id, words, removed, kept text, spans)`` of every row."""
    texts = [WORD.findall(text or "") for _, text in rows]
    times = Counter(
        tuple(w[i: i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for (id, _), w in zip(rows, texts):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if times[tuple(w[i: i + window])] > 1:
                gone[i: i + window] = [True] * window
        spans, edges = [], [False, *gone, False]
        for i in range(len(w) + 1):
            if edges[i] != edges[i + 1]:
                spans.append(i)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((id, len(w), sum(gone), kept, [spans[k: k + 2] for k in range(0, len(spans), 2)]))
    return sorted(out, key=repr)


def run(spark, rows, **options):
    got = remove_repeats(spark.createDataFrame(rows, SCHEMA), **options).collect()
    return sorted(
        ((r.doc_id, r.n_words, r.n_removed, r.kept_text, r.spans) for r in got), key=repr)


def test_given_table(spark, sf_dir, texts_of):
    rows = list(texts_of(sf_dir).items())
    found = brute(rows)
    assert run(spark, rows) == found and sum(r[2] for r in found) > 1000


def words(rng, n, kinds=10**6):
    return [f"w{rng.randrange(kinds)}" for _ in range(n)]


def test_passages_overlaps_loops_and_odd_rows(spark):
    rng = random.Random(3)
    shared, other = words(rng, 90), words(rng, 60)
    rows = [(i, " ".join(words(rng, 40) + shared[i % 7: 60 + i % 11] + words(rng, 5))) for i in range(30)]
    rows += [
        (100, " ".join(other)), (101, "\t".join(other[:35])), (102, " ".join(other[:34])),
        (103, " ".join(other[10:45] + other[20:60])),
        (104, " ".join(["a"] * 36)), (105, " ".join(["b"] * 35)), (106, " ".join(["c", "d"] * 60)),
        (107, " ".join((words(rng, 20) * 9)[:130])), (108, "é " * 300 + "end"),
        (109, " ".join(x.upper() for x in other)), (110, None), (111, ""), (112, " \n\t "),
        (113, "one"), (None, " ".join(shared)), (None, " ".join(shared)), (114, "x" * 50_000),
        (115, " ".join(words(rng, 20_000))),
    ]
    rows += [(116, rows[-1][1].replace(" w1", " v1", 3))] * 3
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, window=8, seed=3) == brute(rows, 8)
    assert run(spark, rows, window=5, seed=5, buckets=3) == brute(rows, 5)
    assert run(spark, rows, window=1, seed=1) == brute(rows, 1)


@pytest.mark.parametrize("seed", range(4))
def test_few_words_branch_often(spark, seed):
    """With two or three kinds of words nearly every node branches."""
    rng = random.Random(seed)
    rows = [(i, " ".join(words(rng, rng.randrange(0, 120), 2 + seed))) for i in range(60)]
    assert run(spark, rows, window=9, seed=4) == brute(rows, 9)


def test_hot_passage_does_not_change_the_rest(spark):
    rng = random.Random(5)
    hot = words(rng, 50)
    rows = [(i, " ".join(words(rng, 20) + (hot if i % 3 else []) + words(rng, 20)))
            for i in range(600)]
    assert run(spark, rows) == brute(rows)


def test_empty_table_and_other_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert remove_repeats(empty).count() == 0
    clash = spark.createDataFrame([(1, "a b", 5)], SCHEMA + ", row_no int")
    got = remove_repeats(clash.withColumn("spans", F.lit(0))).first()
    assert (got.doc_id, got.n_words, got.kept_text) == (1, 2, "a b")
    with pytest.raises(ValueError):
        remove_repeats(empty, window=3, seed=4)


def test_texts_do_not_move_again(spark, sf_dir, capsys):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = in_buckets(docs, "doc_id", "text", 4)
    spans = repeated_paths(texts).groupBy("row_no").agg(F.count("*").alias("n"))
    texts.hint("merge").join(spans, "row_no").explain()
    plan = capsys.readouterr().out
    left = plan.split("SortMergeJoin")[1].split("HashAggregate")[0]
    assert "Bucketed: true" in left and "Exchange" not in left


def test_hashes_depend_on_the_words_alone():
    a = Words(pa.array(["x one  two\nthree y", None, "ab"]))
    b = Words(pa.array(["", "one two three", "a b"]))
    for kind in (0, 1):
        assert a.hashes(1, 3, kind) == b.hashes(0, 3, kind)
        assert a.hashes(1, 2, kind) != a.hashes(2, 2, kind)
    assert a.firsts.tolist() == [0, 5, 5, 6] and b.firsts.tolist() == [0, 0, 3, 5]
