"""WARC archives in Zstandard with a dictionary: a writer and a reader over Spark's own file sources.

An archive starts with a skippable frame that holds the dictionary; then comes one frame per record.
Records are written through Spark's text sink, whose line separator here is an empty skippable frame,
and archives are read through the binary file source, so that any store that Spark reaches will do.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sheaf.llm.shared import shared_path

#: Magic numbers of the formats (fixed values): the dictionary's skippable frame, the first of the
#: 16 kinds of skippable frames, a Zstandard frame.
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE_MAGIC = 0x184D2A50
FRAME_MAGIC = 0xFD2FB528
#: An empty skippable frame; all its bytes are ASCII, so it can be the text sink's separator.
SEPARATOR = struct.pack("<II", SKIPPABLE_MAGIC, 0).decode("ascii")
#: Payloads and bytes of them that an archive's dictionary is made from, and the dictionary's size.
SAMPLES, SAMPLE_BYTES, DICTIONARY_BYTES = 64, 1 << 19, 1 << 14
#: Payloads of equal bytes become revisits from this size on.
LEAST_REVISIT = 100
#: An archive is closed when its frames reach this size; a further record begins a new one.
ARCHIVE_BYTES = 1 << 26
#: What a target URI may hold as it is; anything else is escaped, and the page's own URL stands in a field beside it.
URI_SAFE = ":/?#[]@!$&'()*+,;=~-._%"
SOURCE_URL = "X-Source-URL"
VERSION = "WARC/1.1"
DATE = "2024-01-31T00:00:00Z"


def _dictionary(samples: list[bytes]) -> bytes:
    import zstandard

    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=3).as_bytes()
    except zstandard.ZstdError:  # too few or too uniform to train on: their bytes themselves
        return b"".join(samples)[:DICTIONARY_BYTES] or b"\r\n\r\nHTTP/1.1 200 OK\r\n"


def _samples(payloads: pa.Array) -> list[bytes]:
    """The beginnings of payloads, as many as a dictionary is made from."""
    sample, size = [], 0
    for x in payloads:
        sample.append(x.as_py()[:SAMPLE_BYTES])
        if (size := size + len(sample[-1])) >= SAMPLE_BYTES:
            break
    return sample


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record: a response with its payload, or a revisit with the response's HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [VERSION, f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        uri = quote(url, safe=URI_SAFE)
        head.append(f"WARC-Target-URI: {uri}")
        if uri != url:
            head.append(f"{SOURCE_URL}: {quote(url, safe='')}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def frames(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(magic, start, end) of each frame of an archive, by the frames' own lengths."""
    import zstandard

    at = 0
    while at < len(data):
        if at + 8 > len(data):
            raise ValueError(f"archive ends inside a frame at {at}")
        magic, length = struct.unpack_from("<II", data, at)
        start = at
        if magic & 0xFFFFFFF0 == SKIPPABLE_MAGIC:
            at += 8 + length
        elif magic == FRAME_MAGIC:
            head = data[at : at + 18]
            at += zstandard.frame_header_size(head)
            last = False
            while not last:
                if at + 3 > len(data):
                    raise ValueError(f"archive ends inside a frame at {start}")
                b = int.from_bytes(data[at : at + 3], "little")
                last, kind, n = b & 1, b >> 1 & 3, b >> 3
                at += 3 + (1 if kind == 1 else n)
            at += 4 if zstandard.get_frame_parameters(head).has_checksum else 0
        else:
            raise ValueError(f"no frame at byte {start}")
        if at > len(data):
            raise ValueError(f"archive ends inside a frame at {start}")
        yield magic, start, at


def parse(raw: bytes) -> dict:
    """The fields of one record, after checks of version, headers, lengths and, for a response, digest."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    if not gap or not version.startswith("WARC/1."):
        raise ValueError("no WARC header")
    fields = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"header without a colon: {line[:80]!r}")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"record without {name}")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"record of {len(rest) - 4} bytes says {length}")
    http, gap, payload = rest[:length].partition(b"\r\n\r\n")
    if not gap or not http.startswith(b"HTTP/"):
        raise ValueError("record without an HTTP header")
    declared = next((int(h.split(b":")[1]) for h in http.split(b"\r\n")[1:] if h.lower().startswith(b"content-length:")), None)
    kind, digest = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha256:")
    if kind not in ("response", "revisit") or declared is None:
        raise ValueError(f"record of type {kind} or without a payload length")
    if kind == "response" and (len(payload) != declared or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("payload differs from its length or digest")
    number = lambda name: int(x) if (x := fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")) else None
    own = fields.get(SOURCE_URL.lower())
    url = fields.get("warc-target-uri") if own is None else unquote(own)
    return {
        "page_id": number("warc-record-id"), "url": url, "payload_bytes": declared, "payload_digest": digest,
        "record_type": kind, "refers_to": number("warc-refers-to"), "payload": payload if kind == "response" else None,
    }


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write a record per row of ``pages`` (page_id, url, html) as archives in the folder ``path``.

    The payload is the html in UTF-8, null as empty. Of equal payloads of at least LEAST_REVISIT
    bytes the one with the smallest page_id is a response, and the others are revisits of it; smaller
    payloads are all responses. Rows that repeat a page_id and its payload are all written; a null
    page_id never becomes the response of others; a null url leaves out the header. Other columns
    are ignored. A target URI keeps its escapes. Each archive is a file of about ``archive_bytes``
    at most, or of one record that is larger, and has a dictionary of its own; an empty table writes
    no record."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("n", F.length("payload"))
    first = rows.filter(F.col("n") >= LEAST_REVISIT).groupBy("digest", "n").agg(F.min("page_id").alias("first"))
    # A further key, computed after the grouping, has both sides exchanged for the join: AQE can then split a hot payload.
    spot = F.crc32(F.col("digest").cast("binary")).alias("spot")
    joined = rows.select("*", spot).join(first.select("*", spot), ["spot", "digest", "n"], "left")
    joined = joined.select("page_id", "url", "payload", "digest", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        out, held, compress = [], 0, None
        whole = lambda: pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], names=["archive"])
        for b in it:
            for at, (page_id, url, payload, digest, refers_to) in enumerate(zip(*(c.to_pylist() for c in b.columns))):
                if not out:
                    own = _dictionary(_samples(b.column(2).slice(at, SAMPLES)))
                    compress = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(own), write_checksum=True, write_content_size=True)
                    out.append(struct.pack("<II", DICTIONARY_MAGIC, len(own)) + own)
                    held = len(out[0])
                out.append(compress.compress(record(page_id, url, payload, digest, refers_to)))
                held += len(out[-1])
                if held >= archive_bytes:
                    yield whole()
                    out = []
        if out:
            yield whole()

    # a row is an archive, and a file has one row
    archives = joined.mapInArrow(batches, "archive binary").select(F.col("archive").cast("string").alias("value"))
    archives.write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", 1).text(path)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and, with ``payloads``,
    payload (null for revisits) of every record of every archive in ``path``.

    Loads the dictionary of each archive, decodes one frame at a time, and fails on a bad header,
    length or digest rather than skip a record."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payloads
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names=names)
        for b in it:
            for data in b.column(0):
                data, decode, rows, held = data.as_py(), zstandard.ZstdDecompressor(), [], 0
                for magic, start, end in frames(data):
                    if magic == DICTIONARY_MAGIC and start == 0:
                        decode = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8:end]))
                    elif magic == FRAME_MAGIC:
                        rows.append(parse(decode.decompress(data[start:end])))
                        held += rows[-1]["payload_bytes"]
                        if held > 1 << 22:
                            yield pack(rows)
                            rows, held = [], 0
                if rows:
                    yield pack(rows)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(batches, schema)


def archive_digest(pages: DataFrame) -> DataFrame:
    """Write the archives of ``pages`` into the shared folder and read every record back."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_archives(pages, path)
    return read_archives(spark, path, payloads=False)


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY html) END AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""
