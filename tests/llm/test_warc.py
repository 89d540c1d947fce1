"""Archives: round trips, revisits, and the format read without the library's reader."""

import glob
import hashlib
import random
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from sheetmerge.llm import warc
from sheetmerge.session import local_fs_path, scratch_path


def pages_of(spark, rows):
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    return table.withColumn("payload", F.lit(1)).withColumn("row", F.lit("x")).withColumn("of_row", F.lit(2)).repartition(3)


def expected(rows, least=1000):
    groups = {}
    for i, _, html in rows:
        groups.setdefault(html or "", []).append(i)
    out = []
    for html, ids in groups.items():
        data = html.encode()
        digest = hashlib.sha1(data).hexdigest()
        ids = sorted(ids, key=lambda i: (i is not None, i or 0), reverse=True)
        out += [
            (i, len(data), digest, "revisit", ids[0]) if n and len(data) >= least else (i, len(data), digest, "response", None)
            for n, i in enumerate(ids)
        ]
    return sorted(out, key=str)


def digest_rows(read):
    rows = read.select(F.col("page_id").cast("long"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to_page").cast("long"))
    return sorted((tuple(r) for r in rows.collect()), key=str)


def sample_rows():
    rng = random.Random(3)
    words = ["<p>", "</p>", "der", "the", "\u00e9t\u00e9", "\u6f22\u5b57", "and", "<a href=x>"]
    rows = [(i, f"https://e{i % 7}.example/{i}", " ".join(rng.choices(words, k=rng.randrange(1, 900)))) for i in range(200)]
    same = "x" * 1000
    rows += [(1000 + i, "u", same) for i in range(60)] + [(2000 + i, "u", "y" * 999) for i in range(5)]  # a hot payload; one byte short
    rows += [(5, None, None), (6, "a\r\nWARC-Type: b c\u007f", ""), (None, "n", same), (None, "n", "z" * 2000), (None, "n", "z" * 2000)]
    rows += [(3000, "r", "w" * 1500)] * 3  # repeated rows
    rows += [(4000, "long", "abc " * 400_000)]
    return rows


@pytest.mark.parametrize("how", [{}, {"archive_bytes": 20_000}, {"max_broadcast_bytes": 0}])
def test_round_trip(spark, how):
    rows = sample_rows()
    path = scratch_path(spark, "warc-test")
    warc.write_archives(pages_of(spark, rows), path, **how)
    read = warc.read_archives(spark, path)
    assert digest_rows(read) == expected(rows)
    texts = read.filter("record_type = 'response'").select("page_id", F.col("payload").cast("string")).collect()
    want = {(i, h or "") for i, _, h in rows}
    assert {(i and int(i), h) for i, h in texts} <= want and {h for _, h in texts} == {h for _, h in want}
    names = {r["record_id"]: r for r in read.collect()}
    assert len(names) == len(rows)
    for r in names.values():
        if r["record_type"] == "revisit":
            of = names[r["refers_to"]]
            assert of["record_type"] == "response" and of["payload_digest"] == r["payload_digest"] and of["page_id"] == r["refers_to_page"]
    assert any(r["target_uri"] == "a%0D%0AWARC-Type:%20b%20c%7F" for r in names.values())
    if "archive_bytes" in how:
        assert len(glob.glob(f"{local_fs_path(path)}/*.warc.zst")) > 4


def test_files_follow_the_format(spark):
    path = scratch_path(spark, "warc-test")
    warc.write_archives(pages_of(spark, sample_rows()), path)
    for name in glob.glob(f"{local_fs_path(path)}/*.warc.zst"):
        data = open(name, "rb").read()
        magic, size = struct.unpack("<II", data[:8])
        assert magic == 0x184D2A5D
        known = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]))
        assert known.dict_id()  # a trained one
        reader = zstandard.ZstdDecompressor(dict_data=known).stream_reader(data[8 + size :], read_across_frames=True)
        records = reader.read().split(b"WARC/1.1\r\nWARC-Type: ")
        assert records[0] == b"" and records[1].startswith(b"warcinfo") and all(r.endswith(b"\r\n\r\n") for r in records[1:])


def test_damage_is_noticed():
    row = {"row": 1, "id": "1", "url": "u", "size": 3, "sha1": hashlib.sha1(b"abc").hexdigest(), "payload": b"abc", "of_row": None}
    record = warc._record(row, "s", "d")
    assert warc._parsed(record, True)["payload"] == b"abc"
    with pytest.raises(ValueError):
        warc._parsed(record.replace(b"abc", b"abd"), True)
    whole = warc._lead(b"x" * 300) + zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(b"x" * 300)).compress(record)
    assert list(warc._frames(whole)) == [record]
    with pytest.raises(ValueError):
        list(warc._frames(whole[:-1]))


def test_few_rows(spark):
    for rows in ([], [(1, "u", "one")], [(1, None, None), (2, None, None)]):
        assert digest_rows(warc.archive(pages_of(spark, rows))) == expected(rows)
