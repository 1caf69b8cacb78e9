"""The registered queries without SQL against brute force over the given tables."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from test_near_dedup import brute
from test_secrets import plain_base

import corpus_pipeline
from fanweave.llm import queries as q
from fanweave.llm.mixing import DOMAINS

BIGGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts(sf_dir, texts_of):
    return texts_of(sf_dir)


def labels_of(folder):
    t = pq.read_table(f"{folder}/labels.parquet").to_pylist()
    return {r["doc_id"]: (r["quality"], r["toxic"]) for r in t}


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def test_near_dedup(spark, sf_dir, texts):
    got = sorted((tuple(r) for r in q.op6_near_dedup(spark, sf_dir).collect()), key=repr)
    assert got == brute(list(texts.items()))


def test_secrets(spark, sf_dir, texts):
    got = {r.doc_id: r for r in q.op7_secrets(spark, sf_dir).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        spans = plain_base(text or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        r = got[i]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        kinds = [k for k, _, _ in spans]
        assert [r.n_assign, r.n_access, r.n_hex] == [
            kinds.count(k) for k in ("assign", "access", "hex")]
        assert set(joined.split(",")) <= set(r.spans.split(",")) or not joined


def test_token_records(spark, sf_dir, texts):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    at = 0
    got = sorted(map(tuple, q.op10_token_records(spark, sf_dir).collect()))
    assert len(got) == len(texts)
    for row, (i, text) in zip(got, sorted(texts.items())):
        ids = [*encode(text or "", add_special_tokens=False).ids, 0]
        assert row == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


@pytest.mark.parametrize("name,place,folds,number", [
    ("op2_quality", 0, 5, 0), ("op8_toxicity", 1, 4, 2)])
def test_held_out_labels(spark, name, place, folds, number):
    rows = getattr(q, name)(spark, BIGGER).collect()
    labels, right = labels_of(BIGGER), []
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == number)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        if r.held_out and r.doc_id in labels:
            right.append(r.predicted == labels[r.doc_id][place])
    assert len(right) > 40 and sum(right) / len(right) > 0.9


def test_packing(spark, sf_dir, texts):
    t = pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()
    source = {r["doc_id"]: r["source"] for r in t}
    total, bins = {}, {}
    for r in q.op4_packing(spark, sf_dir).collect():
        total[r.doc_id] = total.get(r.doc_id, 0) + r.size
        bins.setdefault(r.bin, []).append(r)
    assert total == {i: len(words(x)) for i, x in texts.items()}
    for members in bins.values():
        assert sum(r.size for r in members) <= 2048
        names = [source[r.doc_id] for r in members]
        assert len(names) == len(set(names))


def test_mixing(spark, sf_dir, texts):
    rows = q.op3_mixing(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == texts.keys()
    for r in rows:
        assert r.tokens == len(words(texts[r.doc_id])) and r.rate >= 0
        assert np.isclose(sum(r[f"p_{d}"] for d in DOMAINS), 1)
        assert r.copies in (int(r.rate), int(r.rate) + 1)


def test_pipeline_stage_by_stage(spark, sf_dir, texts):
    """Every stage on its own input; the last one's rows are those of the whole run."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept, placed = docs.columns, {}, docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in placed.select("doc_id", "text").collect()}
        placed = corpus_pipeline.stage(step(spark, placed, sf_dir), f"test-{name}")
        assert placed.columns == columns
        kept[name] = (before, [r.doc_id for r in placed.select("doc_id").collect()])
    labels = labels_of(sf_dir)
    before, after = kept["quality_classifier"]
    good = [i for i in before if labels.get(i, (0,))[0] == 1]
    assert sum(i in set(after) for i in good) >= 0.97 * len(good) and len(after) < len(before)
    before, after = kept["exact_dedup"]
    groups = {}
    for i, text in before.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text), []).append((-len(text), i))
    assert sorted(after) == sorted(min(g)[1] for g in groups.values())
    before, after = kept["near_dedup"]
    near = brute(list(before.items()), corpus_pipeline.NEAR_PERCENT)
    assert sorted(after) == sorted(i for i, _, _, stays in near if stays)
    before, after = kept["mixing"]
    clean = [i for i in before if labels.get(i) == (1, 0)]
    assert set(clean) <= set(after) <= set(before)
    packed = corpus_pipeline.STAGES[-1][1](spark, placed, sf_dir).collect()
    total = {}
    for r in packed:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.size
    assert total == {i: after.count(i) * len(words(texts[i])) for i in set(after)}
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.piece, r.size) for r in whole) == sorted(
        (r.doc_id, r.piece, r.size) for r in packed)


def test_nothing_runs_on_made_up_input(sf_dir):
    names = {n.split("_")[0] for n in q.query.__globals__["QUERIES"]}
    assert {f"op{n}" for n in range(1, 14)} | {"pipeline"} <= names
