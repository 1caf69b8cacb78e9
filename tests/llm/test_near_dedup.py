import random
import re

import numpy as np
import pytest

from fanweave.llm import near_dedup as nd
from fanweave.llm import setsketch as sk
from fanweave.llm.components import components

SCHEMA = "doc_id long, text string, n long, root string"


def shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def brute(rows, percent=85):
    """All pairs, by inverted index over exact sets."""
    sets = [shingles(t) if i is not None else set() for i, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for n, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(n)
    for n, s in enumerate(sets):
        for m in {m for g in s for m in where[g] if m < n}:
            common = len(s & sets[m])
            if 100 * common >= percent * len(s | sets[m]):
                parent[find(n)] = find(m)
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[find(n)] = min(i, least.get(find(n), i))
    out = []
    for n, (i, t) in enumerate(rows):
        c = least.get(find(n)) if i is not None else None
        out.append((i, len(shingles(t)), c, i is None or i == c))
    return sorted(out, key=repr)


def make_rows(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{n}" for n in range(400)]

    def text(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    def edited(words, times):
        words = list(words)
        for _ in range(times):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        return words

    out = []
    star = text(200)
    out += [star] + [edited(star, rng.choice([2, 3, 4])) for _ in range(150)]
    chain = text(150)
    for _ in range(40):
        chain = edited(chain, 2)
        out.append(chain)
    for _ in range(60):
        base = text(rng.randint(8, 300))
        out += [base] + [edited(base, rng.randint(0, 6)) for _ in range(rng.randint(0, 5))]
    rows = [(i, " ".join(w)) for i, w in enumerate(out)]
    rows += [(900 + k, rows[0][1].upper().replace(" ", "\n")) for k in range(30)]
    rows += [(2000, None), (2001, ""), (2002, " \t"), (2003, "a b"), (2004, "A  b"), (2005, "a b c"),
             (None, rows[0][1]), (None, None), (5, "w1 w2 other words are here now"), (5, rows[70][1]),
             (2006, "tick " * 60_000), (2007, "tick " * 50_000), (2008, "é É x y z w")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [64, 3])
def test_components_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(nd, "BLOCK", block)
    rows = make_rows()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA).repartition(3)
    got = nd.near_duplicates(df).drop("row_no")
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_without_broadcast(spark, monkeypatch):
    """The join instead of the broadcast gives the same."""
    monkeypatch.setattr(nd, "BROADCAST_IDS", -1)
    rows = make_rows(2)[:250]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA)
    got = nd.near_duplicates(df).drop("row_no").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def test_one_document_of_each_component_stays(spark):
    rows = make_rows(3)
    df = spark.createDataFrame([(i, t, n, "x") for n, (i, t) in enumerate(rows)], SCHEMA)
    got = nd.drop_near_duplicates(df)
    assert got.columns == df.columns
    kept = got.collect()
    want = brute(rows)
    alone = sum(1 for i, t in rows if i is None or not shingles(t))
    groups = {c for i, n, c, _ in want if i is not None and n}
    assert len(kept) == alone + len(groups)
    assert len({r.n for r in kept}) == len(kept)
    assert {r.doc_id for r in kept if r.doc_id is not None and shingles(r.text)} == groups
    assert nd.drop_near_duplicates(df.limit(0)).collect() == []


def test_empty_table(spark):
    assert nd.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_registers_are_mergeable_and_sensitive():
    rng = np.random.default_rng(5)
    a, b = (rng.integers(0, 2**64, 300, dtype=np.uint64) for _ in range(2))
    both = np.unique(np.concatenate([a, b]))
    one, two, union = (sk.registers(x, np.array([0, len(x)])) for x in (a, b, both))
    assert (sk.merge(one, two) == union).all()
    pairs = []
    for _ in range(300):
        x = rng.integers(0, 2**64, 400, dtype=np.uint64)
        y = np.concatenate([x[:360], rng.integers(0, 2**64, 30, dtype=np.uint64)])
        pairs.append((x, y))
    left = sk.registers(np.concatenate([p[0] for p in pairs]), np.arange(0, 400 * 301, 400))
    right = sk.registers(np.concatenate([p[1] for p in pairs]), np.arange(0, 390 * 301, 390))
    true = 360 / 430
    got = sk.joint_similarity(left, right, np.full(300, 400.0), np.full(300, 390.0))
    assert abs(got.mean() - true) < 0.01 and got.std() < 1.3 * np.sqrt(true * (1 - true) / sk.REGISTERS)
    hits = (sk.band_keys(left) == sk.band_keys(right)).mean()
    assert abs(hits - true**sk.ROWS) < 0.03


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, n) for n in range(500, 540)] + [(7, 7), (90, 91), (91, 90)]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = {n: 0 for n in range(61)} | {n: 500 for n in range(500, 540)} | {1000: 500, 90: 90, 91: 90}
    assert {r.node: r.root for r in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("percent", [8, 50, 70, 80, 85, 95, 100])
def test_bands_follow_the_threshold(percent):
    bands, rows = sk.banding(percent)
    assert bands * rows <= sk.REGISTERS and (1 - (percent / 100) ** rows) ** bands <= sk.MISS
    with pytest.raises(ValueError):
        sk.banding(5)


def test_stage_links_from_eighty_percent_on(spark):
    """Copies that are 0.8 to 0.849 similar do not both leave the pipeline's stage."""
    import corpus_pipeline

    rng = random.Random(8)
    rows = []
    for n in range(120):
        words = [f"v{rng.randrange(5000)}" for _ in range(204)]
        near = list(words)
        for k in range(4):  # each change in the middle takes five of 200 shingles
            near[20 + 40 * k] = "changed"
        rows += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(near))]
    rows += [(1000 + i, t) for i, t in make_rows(4)[:200] if i is not None]
    want = sorted(i for i, _, _, stays in brute(rows, 80) if stays)
    assert len(want) < sum(stays for _, _, _, stays in brute(rows))
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA)
    got = corpus_pipeline.near_stage(spark, df, "")
    assert sorted(r.doc_id for r in got.collect()) == want
