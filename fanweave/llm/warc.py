"""Web archives of one Zstandard frame per record, with a shared dictionary.

An archive file starts with a skippable frame that holds the dictionary (magic number
0x184D2A5D). Then follow a ``warcinfo`` record and one frame per page record, each with
its own checksum, and an empty skippable frame that closes the file. Of pages with equal
payloads one is written as ``response``, the others as ``revisit`` records without
payload that name it.

The reader takes the dictionary from the first frame, finds each frame's end from its
block headers, decodes one record at a time, and checks version, mandatory headers,
lengths, the closing line ends and the payload digest. Anything wrong is an error.
``read_archives`` reads what ``write_archives`` wrote, ``read_records`` archives of any writer:
frames without a content size, header names in any case, repeated headers, and no closing frame.

Payloads are equal when SHA-1 and length are. The response of a group is found by a
partial aggregate; a group of any size is joined back by an ordinary join that Spark can
split, so no task holds a group.

Defined results: a null payload counts as empty; payloads shorter than ``least_bytes``
are all responses. A null page id orders below every other; of rows with equal ids one is
the response. A null url leaves the header out. An empty table gives no archive and no
rows. Other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fanweave.llm.rows import numbered, small_batches
from fanweave.llm.shards import read_shards, write_shards

#: fixed values of the format
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
CLOSING = struct.pack("<II", 0x184D2A50, 0)
VERSION = b"WARC/1.1"
VERSIONS = (b"WARC/1.0", VERSION)
#: record types that hold something fetched; others are passed over
FETCHED = ("response", "revisit", "resource")
MANDATORY = ("WARC-Record-ID", "Content-Length", "WARC-Date", "WARC-Type")

#: an archive is closed when it has this many compressed bytes
ARCHIVE_BYTES = 8 << 20
#: the dictionary is trained on at most this many pages, this much of each
SAMPLE_PAGES = 400
SAMPLE_CHARS = 8192
DICTIONARY_BYTES = 32 << 10
DATE = "2024-01-01T00:00:00Z"

PAGE_SCHEMA = (
    "page_id long, url string, payload binary, payload_bytes long, payload_digest string, "
    "record_type string, refers_to long"
)
RECORD_SCHEMA = (
    "record_id string, record_type string, url string, date string, refers_to string, "
    "status int, payload binary, headers map<string, array<string>>"
)


# --- records ---------------------------------------------------------------------------------


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION.decode(), *(f"{k}: {v}" for k, v in headers),
             f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _uri(url: str) -> str:
    """The url without characters that would end a header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _name(page_id: int | None, row: int) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}:{row}>"


def _page_of(name: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(none|-?\d+):\d+>", name)
    if not found:
        raise ValueError(f"not a page record: {name}")
    return None if found[1] == "none" else int(found[1])


def page_record(page: dict, date: str) -> bytes:
    payload = page["payload"]
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {page['payload_bytes']}\r\n\r\n"
    ).encode()
    headers = [
        ("WARC-Type", "response" if page["refers_row"] is None else "revisit"),
        ("WARC-Record-ID", _name(page["page_id"], page["row_no"])),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha1:{page['payload_digest']}"),
        ("X-Payload-Length", str(page["payload_bytes"])),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if page["url"] is not None:
        headers.append(("WARC-Target-URI", _uri(page["url"])))
    if page["refers_row"] is None:
        return record_bytes(headers, http + payload)
    headers += [
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ("WARC-Refers-To", _name(page["refers_to"], page["refers_row"])),
    ]
    return record_bytes(headers, http)


class Headers(dict[str, list[str]]):
    """Values by lower-case name, in order; names count in any case and may repeat."""

    def one(self, name: str) -> str | None:
        """The first value of a header, None if it is not there."""
        return (self.get(name.lower()) or [None])[0]

    def need(self, name: str) -> str:
        value = self.one(name)
        if value is None:
            raise ValueError(f"missing header {name}")
        return value


def parse_headers(lines: list[bytes]) -> Headers:
    """Header lines; a line that begins with white space goes on with the one before."""
    out, last = Headers(), None
    for line in lines:
        text = line.decode("utf-8", "replace")
        if last is not None and text[:1] in (" ", "\t"):
            out[last][-1] += " " + text.strip()
            continue
        key, colon, value = text.partition(":")
        last = key.strip().lower()
        if not colon or not last:
            raise ValueError(f"bad header line {line[:60]!r}")
        out.setdefault(last, []).append(value.strip())
    return out


def parse_record(record: bytes) -> tuple[Headers, bytes]:
    """Headers and block; an error if the version, a header or the length is wrong."""
    head, found, rest = record.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("record without an end of its headers")
    version, *lines = head.split(b"\r\n")
    if version not in VERSIONS:
        raise ValueError(f"not a record: {version[:20]!r}")
    headers = parse_headers(lines)
    for name in MANDATORY:
        if len(headers.get(name.lower(), [])) != 1:
            raise ValueError(f"header {name} is not there once")
    if not re.fullmatch("[0-9]+", headers.need("Content-Length")):
        raise ValueError("bad Content-Length")
    length = int(headers.need("Content-Length"))
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError("the block has another length than its header says")
    return headers, rest[:length]


def parse_page(headers: Headers, block: bytes) -> tuple:
    """A row of ``PAGE_SCHEMA``; checks digest and lengths."""
    http, found, payload = block.partition(b"\r\n\r\n")
    declared = re.search(rb"\r\nContent-Length: (\d+)(\r\n|$)", http)
    size = int(headers.need("X-Payload-Length"))
    if not found or not declared or int(declared[1]) != size:
        raise ValueError("bad response head")
    digest = headers.need("WARC-Payload-Digest").removeprefix("sha1:")
    kind, refers = headers.need("WARC-Type"), None
    if kind == "response":
        if len(payload) != size or digest_of(payload) != digest:
            raise ValueError("payload and digest differ")
    elif kind == "revisit" and not payload:
        payload, refers = None, _page_of(headers.need("WARC-Refers-To"))
    else:
        raise ValueError(f"unexpected record type {kind}")
    return (_page_of(headers.need("WARC-Record-ID")), headers.one("WARC-Target-URI"), payload, size,
            digest, kind, refers)


def parse_any(headers: Headers, block: bytes) -> tuple:
    """A row of ``RECORD_SCHEMA``. The digest of a whole block is checked, that of a payload where
    the payload stands in the block as it is."""
    kind = headers.need("WARC-Type")
    _check_digest(headers.one("WARC-Block-Digest"), block)
    status, payload = None, block
    if (headers.one("Content-Type") or "").lower().startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        first, *lines = head.split(b"\r\n")
        found = re.match(rb"HTTP/\S+ (\d{3})", first)
        status = int(found[1]) if found else None
        coding = parse_headers(lines).one("Transfer-Encoding")
        if kind == "response" and coding is None:
            _check_digest(headers.one("WARC-Payload-Digest"), payload)
    return (headers.need("WARC-Record-ID"), kind, headers.one("WARC-Target-URI"),
            headers.need("WARC-Date"), headers.one("WARC-Refers-To"), status,
            None if kind == "revisit" else payload, dict(headers))


def _check_digest(named: str | None, data: bytes) -> None:
    """An error if the digest is a SHA-1 in base32 and another one; other digests are not checked."""
    if named and named.lower().startswith("sha1:") and len(named) == 37:
        if digest_of(data) != named[5:].upper():
            raise ValueError("data and digest differ")


# --- frames ----------------------------------------------------------------------------------


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


def frame_end(view: memoryview, at: int) -> int:
    """Where the frame at ``at`` ends, from its block headers."""
    descriptor = view[at + 4]
    try:
        end = at + zstandard.frame_header_size(view[at: at + 18])
    except zstandard.ZstdError as bad:
        raise ValueError(f"bad frame header at {at}") from bad
    last = False
    while not last:
        if end + 3 > len(view):
            raise ValueError("truncated frame")
        head = int.from_bytes(view[end: end + 3], "little")
        last, kind, size = head & 1, head >> 1 & 3, head >> 3
        end += 3 + (1 if kind == 1 else size)
    end += 4 if descriptor & 4 else 0
    if end > len(view):
        raise ValueError("truncated frame")
    return end


def archive_records(content: bytes, sealed: bool = True) -> Iterator[bytes]:
    """The records of an archive, one frame after another.

    ``sealed``: the archive ends with this module's closing frame, so that a cut shows even
    between two frames.
    """
    view = memoryview(content)
    if len(view) < 16 or struct.unpack_from("<I", view)[0] != DICTIONARY_MAGIC:
        raise ValueError("no dictionary frame")
    at = 8 + struct.unpack_from("<I", view, 4)[0]
    raw = bytes(view[8:at])
    if raw[:4] == struct.pack("<I", FRAME_MAGIC):  # a dictionary may itself be compressed
        raw = zstandard.ZstdDecompressor().decompress(raw)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    closed = False
    while at < len(view):
        if at + 8 > len(view) or (closed and sealed):
            raise ValueError("truncated archive or data after its end")
        magic, size = struct.unpack_from("<II", view, at)
        if magic in SKIPPABLE:
            closed = size == 0
            at += 8 + size
            continue
        if magic != FRAME_MAGIC:
            raise ValueError(f"no frame at {at}")
        end = frame_end(view, at)
        try:
            # a streaming compressor writes frames without their content's size
            yield reader.decompressobj().decompress(view[at:end])
        except zstandard.ZstdError as bad:
            raise ValueError(f"bad frame at {at}") from bad
        at = end
    if at != len(view) or (sealed and not closed):
        raise ValueError("the archive is cut off")


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary from sample records; few or tiny samples serve as they are."""
    if sum(map(len, samples)) > 4 * DICTIONARY_BYTES:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
        except zstandard.ZstdError:
            pass
    text = record_bytes([(k, "") for k in MANDATORY[:1]], b"") + b"".join(samples)
    return text[:DICTIONARY_BYTES]


# --- tables ----------------------------------------------------------------------------------


def _sample(pages: DataFrame, date: str) -> list[bytes]:
    rows = pages.select(
        "row_no", "page_id", "url", F.substring("html", 1, SAMPLE_CHARS).alias("html")
    ).limit(SAMPLE_PAGES).collect()
    out = []
    for r in rows:
        payload = (r.html or "").encode()
        page = r.asDict() | {"payload": payload, "payload_bytes": len(payload),
                             "payload_digest": digest_of(payload), "refers_row": None}
        out.append(page_record(page, date))
    return out


def _with_roles(pages: DataFrame, least_bytes: int) -> DataFrame:
    """Pages with digest and, for revisits, the id and row of the response."""
    sized = pages.withColumn("html", F.coalesce("html", F.lit(""))).withColumns({
        "payload_bytes": F.octet_length("html").cast("long"), "sha1": F.sha1("html"),
    })
    best = F.max(F.struct(F.col("page_id").isNotNull().alias("named"), "page_id", "row_no"))
    groups = (
        sized.filter(F.col("payload_bytes") >= least_bytes)
        .groupBy("sha1", "payload_bytes")
        .agg(F.count(F.lit(1)).alias("n"), best.alias("best"))
        .filter("n > 1")
        .select("sha1", "payload_bytes", F.col("best.page_id").alias("best_id"),
                F.col("best.row_no").alias("best_row"))
    )
    is_revisit = F.col("best_row") != F.col("row_no")
    return sized.join(groups, ["sha1", "payload_bytes"], "left").select(
        "row_no", "page_id", "url", "payload_bytes", "sha1",
        F.when(is_revisit, F.lit("")).otherwise(F.col("html")).alias("html"),
        F.when(is_revisit, F.col("best_id")).alias("refers_to"),
        F.when(is_revisit, F.col("best_row")).alias("refers_row"),
    )


def _archive_maker(dictionary: bytes, date: str, archive_bytes: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = zstandard.ZstdCompressor(
            level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True
        )
        info = record_bytes(
            [("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:info:1>"), ("WARC-Date", date),
             ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
        start = [dictionary_frame(dictionary), writer.compress(info)]
        frames, size = [], 0
        for batch in batches:
            for n in range(batch.num_rows):
                page = {name: batch.column(name)[n].as_py() for name in batch.schema.names}
                page["payload"] = page.pop("html").encode()
                page["payload_digest"] = base64.b32encode(bytes.fromhex(page["sha1"])).decode()
                frames.append(writer.compress(page_record(page, date)))
                size += len(frames[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([b"".join(start + frames)])], ["archive"])
                    frames, size = [], 0
        if frames:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(start + frames)])], ["archive"])

    return make


def write_archives(
    pages: DataFrame, path: str, id: str = "page_id", url: str = "url", html: str = "html",
    least_bytes: int = 0, date: str = DATE, archive_bytes: int = ARCHIVE_BYTES,
) -> None:
    """Write a record of every page to archives below ``path``."""
    named = pages.select(
        F.col(id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")
    )
    placed, row = numbered(named, "warc-pages")
    placed = placed.withColumnRenamed(row, "row_no")
    dictionary = train_dictionary(_sample(placed, date))
    archives = small_batches(_with_roles(placed, least_bytes)).mapInArrow(
        _archive_maker(dictionary, date, archive_bytes), "archive binary"
    )
    write_shards(archives, "archive", path, CLOSING)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The page records of all archives, checked; ``payload`` is null for revisits."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()),
                  ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                  ("record_type", pa.string()), ("refers_to", pa.int64())]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)]
            return pa.RecordBatch.from_arrays(columns, [n for n, _ in fields])

        for batch in batches:
            for content in batch.column("content").to_pylist():
                rows, size = [], 0
                for record in archive_records(content):
                    headers, block = parse_record(record)
                    if headers.one("WARC-Type") == "warcinfo":
                        continue
                    row = parse_page(headers, block)
                    rows.append(row if payloads else (*row[:2], None, *row[3:]))
                    size += len(row[2] or b"") * payloads + 200
                    if size > 16 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return read_shards(spark, path).select("content").mapInArrow(read, PAGE_SCHEMA)


def read_records(spark: SparkSession, path: str, pattern: str = "*.warc.zst") -> DataFrame:
    """The responses, revisits and resources of the archives of any writer.

    Files are read whole, one at a time in a task. ``payload`` is null for revisits, ``headers`` has
    all values of every header by its lower-case name.
    """
    kinds = [pa.string()] * 5 + [pa.int32(), pa.binary(), pa.map_(pa.string(), pa.list_(pa.string()))]
    names = [part.split()[0] for part in RECORD_SCHEMA.split(", ") if " " in part][:7] + ["headers"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = [list(c) for c in zip(*rows)]
        columns[7] = [list(h.items()) for h in columns[7]]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content").to_pylist():
                rows, size = [], 0
                for record in archive_records(content, sealed=False):
                    headers, block = parse_record(record)
                    if headers.need("WARC-Type") not in FETCHED:
                        continue
                    rows.append(parse_any(headers, block))
                    size += len(record)
                    if size > 16 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.filter("length > 0").select("content").mapInArrow(read, RECORD_SCHEMA)
