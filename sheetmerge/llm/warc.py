"""WARC archives compressed record by record with a dictionary.

An archive is a ``.warc.zst`` file: a skippable frame (magic 0x184D2A5D)
holds a Zstandard dictionary trained on records of the same archive set,
and every record follows as a frame of its own, so that a record can be read
alone and small records still compress well.

1. Pages are written once with their digests and a row number.
2. Payloads of ``revisit_bytes`` or more are grouped by SHA-256 and length,
   combined before the shuffle; only groups of two or more go on. Of each the
   record with the largest id is the response, the others become revisits
   (of rows that repeat that id, the first). The groups meet the pages in a
   broadcast join while they are small, else in a shuffle join whose skewed
   partitions Spark splits. Payloads of revisits go no further.
3. The dictionary is trained on a bounded sample: the first rows of up to
   ``SAMPLE_PARTS`` parts spread over the whole table, ``SAMPLE_BYTES`` of
   each. It steers compression only; every record is written.
4. Every task packs its records into archives of about ``archive_bytes``,
   each begun by the dictionary frame and a ``warcinfo`` record. Archives are
   written by Spark's text writer, one row a file, so they go to any store
   that Spark writes to, and a lost task is written again. The writer's line
   separator is an empty skippable frame, which every reader passes over.

Reading takes whole archives (hence their bound) and checks each payload
against its digest.

Defined results: a null payload is an empty one. A page without a url is
named by its record id; control characters and spaces in a url are written
as %XX. Null ids are allowed: they rank below all others. An empty table
gives no archive.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetmerge.plans.sizing import broadcast_if_small
from sheetmerge.session import scratch_path
from sheetmerge.sources.land import land

ARCHIVE_BYTES = 64 << 20
REVISIT_BYTES = 1000
DICTIONARY_BYTES = 110 << 10
SAMPLE_PARTS, SAMPLE_ROWS, SAMPLE_BYTES = 64, 16, 16 << 10
LEVEL = 3
MAX_BROADCAST_BYTES = 64 << 20
SUFFIX = ".warc.zst"

# fixed values of the formats: frame magics, the revisit profile
_SKIPPABLE, _DICTIONARY_MAGIC, _FRAME = 0x184D2A50, 0x184D2A5D, 0xFD2FB528
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: An empty skippable frame, as text.
_SEPARATOR = struct.pack("<II", _SKIPPABLE, 0).decode("ascii")

_STEP = 1 << 16
_ESCAPED = {c: f"%{c:02X}" for c in (*range(0x21), 0x7F)}

RECORD = (
    "record_id string, record_type string, page_id string, target_uri string, payload_bytes long, payload_digest string, "
    "refers_to string, refers_to_page string, payload binary"
)


def _name(archive_set: str, row: int) -> str:
    digest = hashlib.sha1(f"{archive_set}/{row}".encode()).digest()
    return f"urn:uuid:{uuid.UUID(bytes=digest[:16], version=5)}"


def _head(fields: list[tuple[str, str | None]], block: int) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {block}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def _record(row: dict, archive_set: str, date: str) -> bytes:
    """A response record, or a revisit if the row refers to another one."""
    own, revisit = _name(archive_set, row["row"]), row["of_row"] is not None

    def uri(url: str | None, otherwise: str) -> str:
        return otherwise if url is None else url.translate(_ESCAPED)

    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['size']}\r\n\r\n".encode()
    block = http if revisit else http + row["payload"]
    digest = base64.b32encode(bytes.fromhex(row["sha1"])).decode()
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{own}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", uri(row["url"], own)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Page-ID", row["id"]),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    if revisit:
        of = _name(archive_set, row["of_row"])
        fields += [
            ("WARC-Profile", _PROFILE),
            ("WARC-Refers-To", f"<{of}>"),
            ("WARC-Refers-To-Target-URI", uri(row["of_url"], of)),
            ("WARC-Refers-To-Date", date),
            ("Refers-To-Page-ID", row["of_id"]),
        ]
    return _head(fields, len(block)) + block + b"\r\n\r\n"


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; of few samples, the samples themselves."""
    size = max(256, min(size, sum(map(len, samples)) // 4))
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _lead(dictionary: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return struct.pack("<II", _DICTIONARY_MAGIC, len(packed)) + packed


def _archiver(lead: bytes, dictionary: bytes, archive_set: str, date: str, archive_bytes: int):
    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the frame holds the size and a checksum of each record
        known = zstandard.ZstdCompressionDict(dictionary)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=True, write_content_size=True)
        about = b"software: sheetmerge\r\nformat: WARC File Format 1.1\r\n"
        parts: list[bytes] = []
        size, nth = 0, 0

        def whole() -> pa.RecordBatch:
            return pa.record_batch({"content": pa.array([b"".join(parts)], pa.binary())})

        for batch in batches:
            for row in batch.to_pylist():
                if not parts:
                    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{_name(archive_set, -1 - row['row'])}>")]
                    fields += [("WARC-Date", date), ("Content-Type", "application/warc-fields")]
                    parts += [lead, packer.compress(_head(fields, len(about)) + about + b"\r\n\r\n")]
                    size = sum(map(len, parts))
                parts.append(packer.compress(_record(row, archive_set, date)))
                size += len(parts[-1])
                if size >= archive_bytes:
                    yield whole()
                    parts.clear()
                    nth += 1
        if parts:
            yield whole()

    return archive


def _with_roles(pages: DataFrame, revisit_bytes: int, max_broadcast_bytes: int) -> DataFrame:
    """Adds ``of_row``, ``of_id``, ``of_url``: the response that a revisit refers to (null for responses)."""
    copies = pages.filter(F.col("size") >= revisit_bytes).groupBy("sha256", "size").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.struct("rank_id", (-F.col("row")).alias("first"), "id", "url")).alias("best")
    )
    copies = copies.filter("n > 1").select(
        "sha256", "size", (-F.col("best.first")).alias("of_row"), F.col("best.id").alias("of_id"), F.col("best.url").alias("of_url")
    )
    joined = pages.join(broadcast_if_small(copies, max_broadcast_bytes), ["sha256", "size"], "left")
    revisit = F.col("of_row") != F.col("row")
    return joined.select(
        "row", "id", "url", "size", "sha1", F.when(F.coalesce(revisit, F.lit(False)), None).otherwise(F.col("payload")).alias("payload"),
        *(F.when(revisit, F.col(c)).alias(c) for c in ("of_row", "of_id", "of_url")),
    )


def _sample(pages: DataFrame) -> DataFrame:
    """The first rows of parts spread over the table; the row ranges prune what is read."""
    last = pages.agg(F.max("row")).collect()[0][0]
    parts = 0 if last is None else (last >> 33) + 1
    picked = sorted({k * parts // SAMPLE_PARTS for k in range(SAMPLE_PARTS)}) if parts else []
    here = F.lit(False)
    for k in picked:
        here = here | F.col("row").between(k << 33, (k << 33) + SAMPLE_ROWS - 1)
    none = [F.lit(None).cast(t).alias(c) for c, t in (("of_row", "long"), ("of_id", "string"), ("of_url", "string"))]
    return pages.filter(here).select("row", "id", "url", "size", "sha1", F.substring("payload", 1, SAMPLE_BYTES).alias("payload"), *none)


def write_archives(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    revisit_bytes: int = REVISIT_BYTES,
    archive_bytes: int = ARCHIVE_BYTES,
    dictionary_bytes: int = DICTIONARY_BYTES,
    date: datetime | None = None,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> None:
    """Writes a record for every row of ``pages`` to archives in the folder ``path``, which must be new."""
    spark = pages.sparkSession
    stamp = (date or datetime.now(UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")
    archive_set = uuid.uuid4().hex
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("rank_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select(
        F.monotonically_increasing_id().alias("row"), "rank_id", F.col("rank_id").cast("string").alias("id"), "url",
        F.octet_length("payload").cast("long").alias("size"), F.sha1("payload").alias("sha1"), F.sha2("payload", 256).alias("sha256"), "payload",
    )
    rows = land(spark, rows, "warc-pages")
    samples = {r["sha1"]: _record(r.asDict(), archive_set, stamp) for r in _sample(rows).collect()}
    dictionary = _dictionary(list(samples.values()), dictionary_bytes) if samples else b""
    archives = _with_roles(rows, revisit_bytes, max_broadcast_bytes).mapInArrow(
        _archiver(_lead(dictionary), dictionary, archive_set, stamp, archive_bytes), "content binary"
    )
    # a string of Spark is any bytes; the text writer writes them as they are
    writer = archives.select(F.col("content").cast("string").alias("value")).write.mode("errorifexists")
    writer.option("maxRecordsPerFile", 1).option("lineSep", _SEPARATOR).option("compression", "none").text(path)
    _name_archives(spark, path)


def _name_archives(spark: SparkSession, path: str) -> None:
    """Gives the written files the suffix of archives; a change of names only."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    folder = hadoop(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("part-") and name.endswith(".txt") and status.getLen():
            fs.rename(status.getPath(), hadoop(folder, name.removesuffix(".txt") + SUFFIX))


def _frames(archive: bytes) -> Iterator[bytes]:
    """The records of an archive."""
    view, at = memoryview(archive), 0
    unpacker = zstandard.ZstdDecompressor()
    while at < len(view):
        magic = int.from_bytes(view[at : at + 4], "little")
        if magic & 0xFFFFFFF0 == _SKIPPABLE:
            size = int.from_bytes(view[at + 4 : at + 8], "little")
            if magic == _DICTIONARY_MAGIC and at == 0:
                found = bytes(view[8 : 8 + size])
                if int.from_bytes(found[:4], "little") == _FRAME:
                    found = zstandard.ZstdDecompressor().decompress(found)
                unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(found))
            at += 8 + size
            continue
        frame, parts = unpacker.decompressobj(), []
        while not frame.eof:
            piece = view[at : at + _STEP]
            if not piece:
                raise ValueError("an archive ends inside a record")
            parts.append(frame.decompress(piece))
            at += len(piece) - len(frame.unused_data)
        yield b"".join(parts)


def _parsed(record: bytes, with_payload: bool) -> dict | None:
    """A response or revisit as a row; None for other records."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    kind = fields["WARC-Type"]
    if kind not in ("response", "revisit"):
        return None
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    told = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    if kind == "response" and (len(payload) != int(told["Content-Length"]) or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} doesn't match its digest")
    refers = fields.get("WARC-Refers-To")
    return {
        "record_id": fields["WARC-Record-ID"].strip("<>"),
        "record_type": kind,
        "page_id": fields.get("Page-ID"),
        "target_uri": fields.get("WARC-Target-URI"),
        "payload_bytes": int(told["Content-Length"]),
        "payload_digest": digest,
        "refers_to": refers and refers.strip("<>"),
        "refers_to_page": fields.get("Refers-To-Page-ID"),
        "payload": payload if with_payload and kind == "response" else None,
    }


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row for every response and revisit in the archives of a folder; ``payload`` is null for revisits."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.binary() if n == "payload" else pa.int64() if n == "payload_bytes" else pa.string()) for n in names])
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for record in _frames(content.as_py()):
                    row = _parsed(record, with_payload)
                    if row is not None:
                        rows.append(row)
                        size += len(row["payload"] or b"") + 512
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    names = [field.split()[0] for field in RECORD.split(", ")]
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(path)
    return files.select("content").mapInArrow(read, RECORD)


def archive(pages: DataFrame, **how) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder and reads their records back, without payloads."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path, **how)
    return read_archives(pages.sparkSession, path, with_payload=False)
