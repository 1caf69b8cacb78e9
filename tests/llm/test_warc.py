import random

import pytest
import zstandard

from fanweave.llm import warc
from fanweave.session import new_path

SCHEMA = "page_id long, url string, html string, row_no int, sha1 string"


def pages():
    rng = random.Random(1)
    bodies = ["", None, "a", "été \U0001F600", "\r\n\r\nWARC/1.1\r\n\r\n", "<p>" * 300_000]
    bodies += ["".join(rng.choice("abc <p>\n") for _ in range(rng.randint(1, 3000)))
               for _ in range(150)]
    rows = [(n, f"http://h{n % 7}/ü?q={n}\r\nX: 1", rng.choice(bodies)) for n in range(400)]
    return rows + [(None, None, "a"), (None, "u", None), (7, "again", "twin"), (7, "again", "twin")]


def test_round_trip(spark):
    rows = pages()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    path = new_path(spark, "archives")
    warc.write_archives(df, path, archive_bytes=30_000)
    got = warc.read_archives(spark, path).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, _, html in rows:
        groups.setdefault((html or "").encode(), []).append(i)
    want = []
    for payload, ids in groups.items():
        best = max(ids, key=lambda i: (i is not None, i or 0))
        ids.remove(best)
        digest = warc.digest_of(payload)
        want.append((best, payload, len(payload), digest, "response", None))
        want += [(i, None, len(payload), digest, "revisit", best) for i in ids]
    plain = [(r.page_id, None if r.payload is None else bytes(r.payload), r.payload_bytes,
              r.payload_digest, r.record_type, r.refers_to) for r in got]
    assert sorted(plain, key=repr) == sorted(want, key=repr)
    assert {r.url is None for r in got if r.page_id is None} == {True, False}
    short = new_path(spark, "archives")
    warc.write_archives(df, short, least_bytes=2)
    kinds = {r.payload_bytes: r.record_type for r in warc.read_archives(spark, short).collect()
             if r.payload_bytes < 2}
    assert set(kinds.values()) == {"response"}


def archive(spark):
    df = spark.createDataFrame([(*r, 1, "x") for r in pages()[:5]], SCHEMA).coalesce(1)
    path = new_path(spark, "archives")
    warc.write_archives(df, path)
    return bytes(warc.read_shards(spark, path).first().content)


def test_foreign_readers_and_damage(spark):
    good = archive(spark)
    assert len(list(warc.archive_records(good))) == 6
    # a plain streaming decoder reads the same records, frame by frame
    size = int.from_bytes(good[4:8], "little")
    dictionary = zstandard.ZstdCompressionDict(good[8: 8 + size])
    reader = zstandard.ZstdDecompressor(dict_data=dictionary)
    whole = reader.stream_reader(good, read_across_frames=True).read()
    assert whole == b"".join(warc.archive_records(good))
    for n in [0, 5, 8 + size, 8 + size + 4, len(good) // 2, len(good) - 20, len(good) - 8]:
        bad = bytearray(good)
        bad[n] ^= 0x55
        with pytest.raises(ValueError):
            [warc.parse_record(r) for r in warc.archive_records(bytes(bad))]
    for cut in (3, 9, 200):
        with pytest.raises(ValueError):
            list(warc.archive_records(good[:-cut]))


def test_compressed_dictionary():
    record = warc.record_bytes([(k, "x") for k in warc.MANDATORY if k != "Content-Length"], b"abc")
    raw = b"WARC/1.1 Content-Length " * 40
    packed = warc.dictionary_frame(zstandard.ZstdCompressor().compress(raw))
    frame = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw)).compress(record)
    assert list(warc.archive_records(packed + frame + warc.CLOSING)) == [record]


@pytest.mark.parametrize("change", [
    (b"WARC/1.1", b"WARC/2.9"), (b"Content-Length: 3", b"Content-Length: 4"),
    (b"Content-Length: 3", b"Content-Length: -3"), (b"WARC-Date", b"WARC-Dote"),
    (b"abc\r\n\r\n", b"abc\r\n\n\n"),
])
def test_bad_records(change):
    record = warc.record_bytes([(k, "x") for k in warc.MANDATORY if k != "Content-Length"], b"abc")
    assert warc.parse_record(record)[1] == b"abc"
    with pytest.raises(ValueError):
        warc.parse_record(record.replace(*change))


def test_empty_table(spark):
    path = new_path(spark, "archives")
    warc.write_archives(spark.createDataFrame([], SCHEMA), path)
    assert warc.read_archives(spark, path).collect() == []


def foreign(records, dictionary=b"WARC-Type: response WARC-Date: 2024 Content-Length: " * 20):
    """An archive as a streaming compressor writes it: no content sizes, no closing frame."""
    out = [warc.dictionary_frame(dictionary)]
    packer = zstandard.ZstdCompressor(
        dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False)
    for record in records:
        stream = packer.compressobj()
        out.append(stream.compress(record) + stream.flush())
    return b"".join(out)


def record(kind, block, *more, version=b"WARC/1.0"):
    lines = [version, b"warc-type:" + kind, b"WARC-RECORD-ID: <urn:x>", b"Warc-Date:  2020-01-01T00:00:00Z",
             b"content-length:%d" % len(block), *more]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_archives_of_other_writers(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    body, kind = "<p>ü</p>".encode(), b"Content-Type: application/http; msgtype=response"
    digest = b"WARC-Payload-Digest: sha1:" + warc.digest_of(body).encode()
    twice = b"WARC-Concurrent-To: <urn:a>", b"warc-concurrent-to: <urn:b>"
    records = [
        record(b"warcinfo", b"x: y"), record(b"request", b"GET / HTTP/1.1\r\n\r\n"),
        record(b"response", http + body, kind, digest, b"WARC-Target-URI: http://a/", *twice),
        record(b"metadata", b""), record(b"resource", b"plain", b"WARC-Target-URI:http://b/"),
        record(b"revisit", http, kind, b"WARC-Refers-To: <urn:x>", version=b"WARC/1.1"),
        record(b"response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n1\r\na", kind, digest),
        record(b"response", b"", kind),
    ]
    good = foreign(records)
    assert zstandard.frame_content_size(good[good.index(b"\x28\xb5\x2f\xfd"):][:18]) == -1
    assert list(warc.archive_records(good, sealed=False)) == records
    (tmp_path / "a.warc.zst").write_bytes(good)
    (tmp_path / "b.txt").write_bytes(b"other file")
    got = warc.read_records(spark, str(tmp_path)).collect()
    assert [(r.record_type, r.url, r.status, r.payload and bytes(r.payload)) for r in got] == [
        ("response", "http://a/", 200, body), ("resource", "http://b/", None, b"plain"),
        ("revisit", None, 200, None), ("response", None, 200, b"1\r\na"),
        ("response", None, None, b"")]
    assert got[0].headers["warc-concurrent-to"] == ["<urn:a>", "<urn:b>"]
    assert got[2].refers_to == "<urn:x>" and got[0].date == "2020-01-01T00:00:00Z"
    # own archives are archives, too
    assert len(list(warc.archive_records(archive(spark), sealed=False))) == 6


def test_damage_in_archives_of_other_writers():
    body = b"HTTP/1.1 200 OK\r\n\r\nabc"
    kind = b"Content-Type: application/http"
    wrong = record(b"response", body, kind, b"WARC-Payload-Digest: sha1:" + b"A" * 32)
    with pytest.raises(ValueError, match="digest"):
        warc.parse_any(*warc.parse_record(wrong))
    good = foreign([record(b"response", body, kind)] * 3)
    for cut in (1, 5, 40):
        with pytest.raises(ValueError):
            list(warc.archive_records(good[:-cut], sealed=False))
    for bad in (record(b"response", body, b"Content-Length: 3"), record(b"response", body, b"no colon"),
                record(b"response", body).replace(b"content-length:", b"content-length:+")):
        with pytest.raises(ValueError):
            warc.parse_record(bad)
    folded = warc.parse_headers([b"A: one", b"  two", b"a:three"])
    assert folded == {"a": ["one two", "three"]}
