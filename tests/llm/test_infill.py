import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fanweave.llm.infill import (
    MARKS, SENTINEL_BUFFER, TEXT, arrange, characters, cut, infill, restore, streams,
)

SCHEMA = "doc_id bigint, text string"


def plainly(id, text):
    """The contract on strings."""
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if id is None else id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k: k + 8], 16) for k in range(0, 32, 8))
    n = len(tokens)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b, c = ("".join(x) for x in (tokens[:low], tokens[low:high], tokens[high:]))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return n, "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


def check(rows, got):
    assert sorted(
        ((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=repr
    ) == sorted(((i, *plainly(i, text)) for i, text in rows), key=repr)
    texts = {i: text or "" for i, text in rows}
    for r in got:
        assert r.output_sha256 == hashlib.sha256(r.output.encode()).hexdigest()
        if r.doc_id is not None:
            assert r.restored_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_odd_texts(spark):
    odd = ["", None, "a", " ", "abc def", "<P>", "x <M> y", "é", "日本語 text 中", "<", "<P", "S>",
           "a\x00b\n\r\t", "𝔘𝔫𝔦 code", "<p><s><m>", "word " * 5000, "<<<>>>PSM", "ǅabcé1é2"]
    rows = [(i, odd[i % len(odd)]) for i in range(40 * len(odd))] + [(None, "abc def"), (None, "")]
    got = infill(spark.createDataFrame(rows, SCHEMA)).collect()
    check(rows, got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_given_table(spark, sf_dir, texts_of):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(list(texts_of(sf_dir).items()), infill(docs).collect())


def test_repeated_rows_other_names_and_empty(spark):
    rows = spark.createDataFrame([(7, "one two three")] * 3, "n bigint, output string")
    got = infill(rows, "n", "output").collect()
    assert len(got) == 3 and len({r.output for r in got}) == 1
    named = spark.createDataFrame([("k1", "one two")], "doc_id string, text string")
    assert infill(named.withColumn("form", F.lit(1))).first().doc_id == "k1"
    assert infill(spark.createDataFrame([], SCHEMA)).count() == 0


def test_plan_is_one_narrow_pass(spark, sf_dir, capsys):
    infill(spark.read.parquet(f"{sf_dir}/documents.parquet")).explain()
    plan = capsys.readouterr().out
    assert "Exchange" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab<>PSMé", max_size=30), st.integers(0, 60), st.integers(0, 60),
       st.sampled_from(["psm", "spm"]))
def test_pieces_come_back(text, one, two, form):
    data = text.encode()
    low, high = sorted((min(one, len(data)), min(two, len(data))))
    prefix, rest = cut([(TEXT, 0, len(data))], low)
    middle, suffix = cut(rest, high - low)
    output = b"".join(streams(arrange([prefix, middle, suffix], form), data, SENTINEL_BUFFER))
    if any(m in data for m in MARKS):
        return
    assert b"".join(streams(restore(output, form), output)) == data


def test_cut_splits_across_pieces():
    pieces = [(0, 5, 3), (1, 0, 2), (0, 9, 4)]
    assert cut(pieces, 4) == ([(0, 5, 3), (1, 0, 1)], [(1, 1, 1), (0, 9, 4)])
    assert cut(pieces, 0) == ([], pieces) and cut(pieces, 9) == (pieces, [])
    assert characters("aé日".encode()) == 3


def test_damaged_output_is_an_error():
    for output in (b"abc", b"<P>a<S>b", b"<P>ab"):
        with pytest.raises(ValueError):
            restore(output, "psm")
