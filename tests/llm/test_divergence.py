import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fanweave.llm.divergence import BYTES, _corrections, _counts, divergence, tree_nodes

SCHEMA = "doc_id bigint, text string, lang string, source string"


def f(p, q):
    return (p - q) ** 2 // (p + q)


def brute(rows, least=10, top=10):
    docs, counts, groups = defaultdict(set), Counter(), set()
    for n, (_, text, lang, source) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for term in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or ""):
            term = "".join(c.lower() if "A" <= c <= "Z" else c for c in term)
            docs[lang, term].add(n)
            counts[lang, source, term] += 1
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (x, t), d in docs.items() if x == lang and len(d) >= least]
        own = sorted(s for x, s in groups if x == lang)

        def shares(count):
            total = sum(map(count, kept))
            return {t: 1 + 10**9 * (count(t) + 2) // (total + 2 * len(kept)) for t in kept}

        p = {s: shares(lambda t: counts[lang, s, t]) for s in own}
        q = shares(lambda t: sum(counts[lang, s, t] for s in own))
        for s in own:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o) for o in own if o != s]
            terms = [(-f(p[s][t], q[t]), t) for t in kept
                     if counts[lang, s, t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, len(own)), ("term", terms, top)):
                items.sort(key=lambda x: (x[0], x[1].encode()))
                out += [(lang, s, part, item, -v, k + 1) for k, (v, item) in enumerate(items[:most])]
    return sorted(out)


def run(spark, rows, **options):
    return sorted(map(tuple, divergence(spark.createDataFrame(rows, SCHEMA), **options).collect()))


def test_given_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    assert sorted(map(tuple, divergence(docs).collect())) == brute(rows)


def test_odd_rows(spark):
    rng = random.Random(1)
    vocabulary = ["the", "The", "é", "É", "straße", "日本", "a1b", "x", "Zz", "q'r", "İ", "ſ", "K"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(12))), rng.choice(["en", "", None, "de"]),
             rng.choice(["s1", "s2", "S3", "é", None, ""])) for i in range(300)]
    rows += [(1, None, None, None), (1, "", "xx", "only"), (None, "the", "yy", "a"),
             (None, "1 2 3 \x00 [`{\x7f", "yy", "b"), (3, "the " * 30, "zz", "alone")] * 2
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, least_docs=1, top=2) == brute(rows, 1, 2)


def test_hot_source_and_many_sources(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(f"t{chr(97 + min(25, int(rng.expovariate(.2))))}" for _ in range(20)), "en",
             "hot" if i % 2 else f"s{rng.randrange(40)}") for i in range(400)]
    assert run(spark, rows) == brute(rows)


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert divergence(empty).count() == 0
    rows = [(i, "one two", "en", f"s{i % 2}") for i in range(20)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns(
        {"term": F.lit(1), "p": F.lit(2), "part": F.lit("x")})
    assert sorted(map(tuple, divergence(docs).collect())) == brute(rows)


ROWS = st.lists(
    st.dictionaries(st.sampled_from("abcd"), st.integers(2, 9), min_size=1), min_size=1, max_size=12)


@settings(max_examples=150, deadline=None)
@given(ROWS)
def test_tree_corrections_equal_the_plain_sum(rows):
    paths = Counter(tuple(sorted((s, 10 * p, 10) for s, p in row.items())) for row in rows)
    plain, nodes = Counter(), Counter()
    for path, times in paths.items():
        for i, (a, p, p0) in enumerate(path):
            nodes[path[:i + 1]] += times
            for b, q, q0 in path[i + 1:]:
                plain["x", a, b] += times * (f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0))
    rows = [{"lang": "x", "path": [dict(zip(("source", "p", "p0"), e)) for e in path], "terms": n}
            for path, n in sorted(paths.items())]
    got = [r for b in _corrections([pa.RecordBatch.from_pylist(rows)]) for r in b.to_pylist()]
    assert {(r["lang"], r["a"], r["b"]): r["more"] for r in got} == plain
    # every node once, with the number of terms that go through it
    flat = [e for path in sorted(paths) for e in path]
    starts = np.cumsum([0, *map(len, sorted(paths))])
    number = np.unique(np.array([(ord(s), p) for s, p, _ in flat]), axis=0, return_inverse=True)[1]
    node, depth, times = tree_nodes(
        number.reshape(-1), starts, np.array([n for _, n in sorted(paths.items())]))
    assert len(node) == len(nodes)
    assert {tuple(flat[k - d: k + 1]): n for k, d, n in zip(*map(list, (node, depth, times)))} == nodes


TEXTS = ["The the  é É straße a1b", "", "x", " 12 ", "日本x Y", "İſ K\x00k", "zZ", "[`{\x7f", "é", "a" * 40]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(TEXTS), st.sampled_from(["en", ""]), st.sampled_from("ab")),
                max_size=12), st.integers(1, 4))
def test_partial_counts_add_up_to_the_plain_counts(rows, size):
    batches = [pa.RecordBatch.from_pylist(
        [dict(zip(("text", "lang", "source"), r)) for r in rows[k: k + size]])
        for k in range(0, len(rows), size)]
    times, docs, plain, in_docs = Counter(), Counter(), Counter(), Counter()
    for batch in _counts(iter(batches)):
        for r in batch.to_pylist():
            times[r["lang"], r["source"], r["term"]] += r["times"]
            docs[r["lang"], r["source"], r["term"]] += r["docs"]
    for text, lang, source in rows:
        terms = re.findall(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.encode().lower())
        plain.update((lang, source, t.decode()) for t in terms)
        in_docs.update((lang, source, t.decode()) for t in set(terms))
    assert times == plain and docs == in_docs


def test_a_task_holds_few_texts_and_no_table_of_terms(spark):
    """Many different terms are counted in bounded memory, and sent on in small batches."""
    batches = [pa.RecordBatch.from_pylist(
        [{"text": " ".join(f"{chr(97 + i % 26)}é{'xyz'[j % 3]}{chr(256 + k * 100 + j)}" for j in range(100)),
          "lang": "en", "source": "s"} for i in range(1000)]) for k in range(120)]
    assert sum(b.nbytes for b in batches) > 16 * BYTES
    tracemalloc.start()
    most = max(b.num_rows for b in _counts(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most <= 20_000 and peak < 100 << 20
    # texts do not come ten thousand at a time
    divergence(spark.createDataFrame([(1, "a", "en", "s")], SCHEMA))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
