"""Zstandard WARC archives: one frame per record behind a dictionary in a leading skippable frame.

The writer trains a dictionary on the first records of each archive and compresses every record as a frame
of its own. The reader loads the dictionary, decodes frame by frame, and checks each record's version line,
header lines, block length, closing line ends, HTTP length and payload digest.

Defined cases: a null html is the empty payload; a null url is the empty URI; of equal payloads of at least
``min_bytes`` bytes the rows with the smallest page_id are responses, so a repeated row of that id is a
response too; a null page_id is a revisit if another row has an id, else a response; an empty table gives
no archive and no row; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namefold.llm.common import join_hot, shuffle_partitions, stored, texts, work_dir

#: Magic number of the skippable frame that holds the dictionary, and of a zstandard frame.
SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
#: Bytes of records in one archive, at most (one record more).
ARCHIVE_BYTES = 16 << 20
#: Bytes of the dictionary, and of the records that it is trained on.
DICTIONARY_BYTES, SAMPLE_BYTES = 16 << 10, 1 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """The bytes of one record; a revisit keeps the HTTP head alone, whose length is the payload's."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    uri = url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The fields of a record; ValueError if its headers or lengths are wrong."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:] if ": " in line)
    if lines[0] != "WARC/1.1" or not mark or len(fields) != len(lines) - 1:
        raise ValueError(f"not a WARC record: {lines[0]!r}")
    kind = fields["WARC-Type"]
    length = int(fields["Content-Length"])
    if kind not in ("response", "revisit") or len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"{kind} record {fields['WARC-Record-ID']}: Content-Length {length}, {len(rest) - 4} bytes")
    http, _, payload = rest[:length].partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    algorithm, _, digest = fields["WARC-Payload-Digest"].partition(":")
    if algorithm != "sha1" or (kind == "response" and (len(payload) != size or payload_digest(payload) != digest)) or (kind == "revisit" and payload):
        raise ValueError(f"{kind} record {fields['WARC-Record-ID']}: the payload does not fit its length or digest")
    number = lambda urn: int(urn[10:-1]) if urn[10:-1] else None
    refers = fields.get("WARC-Refers-To")
    url = fields["WARC-Target-URI"].replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    return {"page_id": number(fields["WARC-Record-ID"]), "url": url, "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number(refers) if refers else None, "payload": payload if kind == "response" else None}


def archive(records: list[bytes]) -> bytes:
    """A whole archive: dictionary frame, then a frame per record."""
    import zstandard

    sample, size = [], 0
    for x in records:
        if size >= SAMPLE_BYTES:
            break
        sample.append(x)
        size += len(x)
    try:
        raw = zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes()
    except zstandard.ZstdError:  # too few or too small samples
        raw = b"".join(sample)[:DICTIONARY_BYTES]
    coder = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=True, write_checksum=True)
    return struct.pack("<II", SKIPPABLE, len(raw)) + raw + b"".join(map(coder.compress, records))


def frames(data: bytes) -> Iterator[bytes]:
    """The decoded frames of an archive, one at a time."""
    import zstandard

    magic, size = struct.unpack_from("<II", data) if len(data) >= 8 else (0, 0)
    if magic != SKIPPABLE or len(data) < 8 + size:
        raise ValueError("no dictionary frame leads the archive")
    raw = data[8 : 8 + size]
    if raw[:4] == struct.pack("<I", FRAME):  # dictionaries may be stored compressed
        raw = zstandard.ZstdDecompressor().decompress(raw)
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    view, at = memoryview(data), 8 + size
    while at < len(data):
        one, parts = decoder.decompressobj(), []
        while not one.eof:
            if at >= len(data):
                raise ValueError("the last frame is cut off")
            piece = view[at : at + (64 << 10)]
            parts.append(one.decompress(piece))
            at += len(piece)
        at -= len(one.unused_data)
        yield b"".join(parts)


def _open(uri: str) -> tuple[pa.fs.FileSystem, str]:
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _marked(pages: DataFrame, min_bytes: int) -> DataFrame:
    """The pages with refers_to and whether they are revisits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [hashlib.sha1(x).digest() + hashlib.sha256(x).digest() if len(x) >= min_bytes else None for x in texts(batch.column("html"))]
            yield pa.RecordBatch.from_pydict({n: batch.column(n) for n in batch.schema.names} | {"key": pa.array(keys, pa.binary())})

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, html string, key binary")
    groups = stored(rows.select("page_id", "key").where("key is not null").groupBy("key").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")))
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    out = join_hot(rows, groups, "key", "n", total, "left")
    return out.select("page_id", "url", "html", "first_id", (F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))).alias("revisit"))


def write(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write the archives below ``folder``; returns their paths. A retried task writes files of other names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        part, held, size = TaskContext.get().partitionId(), [], 0

        def flush() -> pa.RecordBatch:
            path = f"{folder}/part-{part:05d}-{uuid.uuid4().hex}.warc.zst"
            system, local = _open(path)
            system.create_dir(local.rpartition("/")[0], recursive=True)
            with system.open_output_stream(local) as f:
                f.write(archive(held))
            n = len(held)
            held.clear()
            return pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([n], pa.int64())})

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("page_id", "url", "first_id", "revisit"))
            for page, url, first, revisit, payload in zip(*columns, texts(batch.column("html")), strict=True):
                held.append(record(page, url or "", payload, first, revisit))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return stored(_marked(pages, min_bytes).mapInArrow(run, "path string, records long"))


def read(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives in ``archives.path``, each checked; ``archives.records`` is checked too."""
    fields = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())][: 7 if payloads else 6])
        for batch in batches:
            for path, expected in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist(), strict=True):
                system, local = _open(path)
                with system.open_input_stream(local) as f:
                    data = f.read()
                rows, n = [], 0
                for frame in frames(data):
                    row = parse_record(frame)
                    if not payloads:
                        del row["payload"]
                    rows.append(row)
                    n += 1
                    if len(rows) >= 256:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
                if n != expected:
                    raise ValueError(f"{path}: {n} records, {expected} were written")
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return archives.repartition(shuffle_partitions(archives.sparkSession), "path").mapInArrow(run, fields)


def digests(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write all pages, read the archives back, and tell what each record says."""
    archives = write(pages, f"{work_dir(spark)}/warc")
    return read(archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
