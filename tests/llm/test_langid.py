"""Language identification: held-out accuracy, and phrases found by plain substring search."""

import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sheetmerge.llm import langid
from sheetmerge.llm.textblocks import blocks

SF = "/root/testdata/sf0.01"


def plain_phrases(text, reference):
    count = 0
    for lo in range(0, len(text), langid.STRETCH):
        piece, at = text[lo : lo + langid.STRETCH], 0
        while at < len(piece):
            n = 1
            while at + n <= len(piece) and piece[at : at + n] in reference:
                n += 1
            at += max(1, n - 1)
            count += 1
    return count


def test_phrases_equal_substring_search():
    reference = b"the cat sat on the mat and the hat of the cat is flat"
    texts = ["the cat and the dog", "", None, "x", "mat" * 400, "the hat " * 100 + "zz", "É mat é", "123 . 45", "the\n\n  mat!"]
    model = langid.Model(["a"], [len(reference)], [langid._transitions(reference)])
    (symbol, table, count), = model.tables()
    for lo, hi, data, offsets in blocks(pa.array(texts), 64):
        x, offsets = langid._plain(data, offsets)
        got = langid._phrases(x, offsets, symbol, table, count)
        for k in range(hi - lo):
            assert got[k] == plain_phrases(x[offsets[k] : offsets[k + 1]].tobytes(), reference), texts[lo + k]
    x, offsets = langid._plain(np.frombuffer(b"  The  mat!1 x", dtype=np.uint8), np.array([0, 14]))
    assert x.tobytes().strip() == b"the mat x"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return langid.train(docs.filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2))


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r.found for r in docs.select("doc_id", langid.identify(model, docs, F.col("text")).alias("found")).collect()}
    rows = duckdb.sql(f"select doc_id, lang from '{SF}/documents.parquet'").fetchall()
    held = [(i, lang) for i, lang in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i].lang == lang for i, lang in held]) >= 0.97
    assert all(0 <= x.score <= 1 for x in got.values())


def test_odd_texts_and_order_of_rows(spark, model):
    rows = [(1, None), (2, ""), (3, "123 !?"), (None, "the"), (4, "漢字"), (4, "漢字"), (5, "the of " * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("zz"))
    got = [(r.doc_id, r.f.lang, r.f.score) for r in docs.withColumn("f", langid.identify(model, docs, F.col("text"))).collect()]
    assert [x for x in got if x[0] in (1, 2, 3)] == [(k, "und", 0.0) for k in (1, 2, 3)]
    assert all(lang in model.names and 0 < s <= 1 for i, lang, s in got if i not in (1, 2, 3))
    labelled = spark.read.parquet(f"{SF}/documents.parquet").limit(200)
    one, two = langid.train(labelled.repartition(2)), langid.train(labelled.repartition(9))
    assert one.names == two.names and all(np.array_equal(a, b) for a, b in zip(one.edges, two.edges, strict=True))


def test_nothing_labelled(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert docs.select(langid.identify(model, docs, F.col("text")).alias("f")).first().f == ("und", 0.0)


def test_every_label_is_learnt_and_no_document_fills_a_sample(spark, monkeypatch):
    monkeypatch.setattr(langid, "TABLE_BYTES", 1)
    names = [f"l{k}" for k in range(7)]
    text = {name: " ".join(f"{c}{d}{c}" for c in "abcdefg"[k:] + "nopqrst"[:k] for d in "uvwxyz"[k % 3 :]) for k, name in enumerate(names)}
    rows = [(10 * k + n, text[name], name) for k, name in enumerate(names) for n in range(9 - k)]
    rows.append((900, "zzqzz " * 100_000, "l0"))
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))
    assert model.names == names and len(model.blocks()) == 7
    docs = spark.createDataFrame([(k, text[name]) for k, name in enumerate(names)], "doc_id long, text string")
    got = {r.doc_id: r.f for r in docs.select("doc_id", langid.identify(model, docs, F.col("text")).alias("f")).collect()}
    assert [got[k].lang for k in range(len(names))] == names
    whole = langid._entropies(model, model.tables(), pa.array(list(text.values())))
    share = 1 / np.exp(whole.min(axis=1)[:, None] - whole).sum(axis=1)
    assert [got[k].score for k in range(len(names))] == pytest.approx(share.tolist())


def test_blocks_hold_all_languages_within_their_bytes():
    texts = [bytes((97 + (7 * k * j + j * j) % 23) for j in range(300 + 40 * k)) for k in range(40)]
    edges = [langid._transitions(t) for t in texts]
    model = langid.Model([f"l{k:02d}" for k in range(40)], [len(t) for t in texts], edges, "k")
    whole = [table.nbytes for _, table, _ in model.tables()]
    langid_bytes, langid.TABLE_BYTES = langid.TABLE_BYTES, 3 * max(whole)
    try:
        parts = model.blocks()
    finally:
        langid.TABLE_BYTES = langid_bytes
    assert [n for p in parts for n in p.names] == model.names and 1 < len(parts) < 40
    assert all(sum(table.nbytes for _, table, _ in p.tables()) <= 3 * max(whole) for p in parts)


def test_empty_table(spark, model):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert none.select(langid.identify(model, none, F.col("text")).alias("f")).count() == 0 and langid.train(none).names == []
