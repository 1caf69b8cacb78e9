import glob
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from fanweave.llm import token_records as tr
from fanweave.session import new_path

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text, add_special_tokens=False).ids


def texts():
    rng = random.Random(5)
    bits = ["the", " ", "  ", "\n", "\n ", " \n", " ", "  x", "it's", " 's", "'s", "12", "a1",
            "<|endoftext|>", " <|endoftext|>", "!?", "börk", "\U0001F600", " ", "\t", "​",
            "x" * 40, "\x1c", " \x85", "é", "\r\n", "　"]
    out = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    plain = [b for b in bits if all(c < "\u0240" and c not in "\x1c\x85\xa0\xad×" for c in b)]
    out += ["".join(rng.choice(plain) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    return out + [None, "", " ", "   ", "a ", " a", "a  b", "x y z " * 50_000, "q" * 200_000]


def test_pieces_give_the_ids_of_whole_texts(whole):
    all_texts = texts()
    ids, counts = tr.Encoder(PATH).encode(pa.array(all_texts))
    parts = np.split(ids, np.cumsum(counts)[:-1])
    for text, part in zip(all_texts, parts):
        assert part.tolist() == whole(text or ""), repr((text or "")[:80])


def test_written_files_hold_all_documents_in_order(spark, whole):
    rng = random.Random(2)
    all_texts = texts()[-300:]
    rows = [(i, t) for i, t in enumerate(all_texts)] + [(None, "no id"), (3, "again"), (3, "again")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows],
                               "doc_id long, text string, hash int, tie string").repartition(3)
    path = new_path(spark, "records")
    tr.write_token_records(df, path, PATH, shard_bytes=8_000)
    got = sorted(tr.read_index(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted([i for i, _ in rows], key=lambda i: (i is not None, i))
    at = 0
    wanted = {}
    for i, t in rows:
        ids = whole(t or "") + [0]
        raw = np.array(ids, "<u4").tobytes()
        wanted.setdefault(i, []).append((len(ids), zlib.crc32(raw)))
    for r in got:
        assert r.start == at
        at += r.n_tokens
        wanted[r.doc_id].remove((r.n_tokens, r.ids_crc32))
    files = glob.glob(path.removeprefix("file:") + "/shards/part-*")
    assert len(files) > 3
    shuffled = tr.read_shuffled(spark, path, 7).collect()
    assert sorted((repr(r.doc_id), tuple(r.ids)) for r in shuffled) == sorted(
        (repr(i), tuple(whole(t or "") + [0])) for i, t in rows)
    assert [r.doc_id for r in shuffled] != [r.doc_id for r in got]
    few = tr.read_index(spark, path).filter("doc_id in (5, 6)")
    assert sorted(r.doc_id for r in tr.read_shuffled(spark, path, 1, few).collect()) == [5, 6]


def test_damage_is_noticed():
    good = tr.frame(tr.MAGIC + bytes(24)) + tr.frame(b"abc") + tr.CLOSING
    assert [bytes(d) for _, d in tr.frames(good)][1:] == [b"abc", b""]
    for n in range(len(good)):
        bad = bytearray(good)
        bad[n] ^= 0x10
        with pytest.raises(ValueError):
            list(tr.frames(bytes(bad)))
    with pytest.raises(ValueError):
        list(tr.frames(good[:-3]))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    path = new_path(spark, "records")
    tr.write_token_records(df, path, PATH)
    assert tr.read_index(spark, path).collect() == []
    assert tr.read_shuffled(spark, path, 1).collect() == []
