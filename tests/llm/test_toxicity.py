"""Toxicity: held-out accuracy, unseen misspellings, and scores made one n-gram at a time."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sheetmerge.llm import toxicity

BAD = ["dreadful", "horrible", "vicious", "hateful", "nasty"]


def text(rng, bad):
    words = ["".join(rng.choices("abdeilmnorstu", k=rng.randint(2, 7))) for _ in range(rng.randint(5, 120))]
    for _ in range(1 + len(words) // 25 if bad else 0):
        words.insert(rng.randrange(len(words)), rng.choice(BAD))
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(2)
    rows = [(k, text(rng, k % 3 == 0), int(k % 3 == 0)) for k in range(900)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 600] + [(None, 1), (1, None), (2, 0)], "doc_id long, toxic int")
    return rows, docs, labels, toxicity.train(docs, labels)


def test_held_out_accuracy(corpus):
    rows, _, _, model = corpus
    held = rows[600:]
    scores = model.scores(pa.array([t for _, t, _ in held]))
    right = [(s >= 0.5) == bool(y) for s, (_, _, y) in zip(scores, held, strict=True)]
    assert np.mean(right) >= 0.97


def test_unseen_misspellings(corpus):
    *_, model = corpus
    clean = "moonlit sails turned around the island " * 2
    bad = [clean + " ".join(w) for w in (["dreadfull", "horible"], ["hatefuul", "viciouss"], ["horriblle", "nastyy"])]
    assert model.scores(pa.array([clean]))[0] < 0.5
    assert (model.scores(pa.array(bad)) >= 0.5).all()


def test_scores_equal_plain_sums(spark, corpus):
    rows, docs, _, model = corpus
    odd = [None, "", " ?! ", "a", "é" * 50, "same same same same", "x" * 300_000, ("tale " * 50_000) + "end"]
    texts = [t for _, t, _ in rows[:40]] + odd
    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    got = {r.text: r.score for r in frame.withColumn("score", toxicity.score(model, frame, F.col("text"))).collect()}

    def plain(t):
        words, total, count = [], 0.0, toxicity.PRIOR
        low = bytes(b if chr(b).isalnum() and b < 128 or b >= 128 else 32 for b in (t or "").lower().encode())
        for w in low.split(b" "):
            if w and (not words or words[-1] != w):
                words.append(w)
        for w in words:
            marked = b" " + w + b" "
            for n in toxicity.NGRAMS:
                for k in range(len(marked) - n + 1):
                    code = 0
                    for b in marked[k : k + n]:
                        code = (code * int(toxicity._NGRAM_BASE) + b) % 2**64
                    total += float(model.weights[code * int(toxicity._NGRAM_MIX) % 2**64 >> (64 - toxicity.BUCKET_BITS)])
                    count += 1
        return 1 / (1 + np.exp(-(model.bias + total / count)))

    for t in texts:
        if t is None or len(t) < 5000:
            assert got[t] == pytest.approx(plain(t), abs=1e-9)
    assert all(0 <= s <= 1 for s in got.values())


def test_stage_and_odd_labels(spark, corpus):
    rows, docs, labels, model = corpus
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns
    scores = model.scores(pa.array([t for _, t, _ in rows]))
    assert {r.doc_id for r in kept.collect()} == {i for (i, *_), s in zip(rows, scores, strict=True) if s < toxicity.THRESHOLD}
    for given, share in (([], 0.0), ([(1, 0), (2, 0)], 0.0), ([(1, 1), (5000, 0)], 1.0)):
        one = toxicity.train(docs, spark.createDataFrame(given, "doc_id long, toxic int"))
        assert one.scores(pa.array(["text", None])) == pytest.approx([share, share], abs=1e-9)
    again = toxicity.train(docs.repartition(7), labels.repartition(2))
    assert np.array_equal(again.weights, model.weights)


def test_a_long_text_and_absent_documents_leave_the_sample(spark, corpus, monkeypatch):
    rows, docs, labels, _ = corpus
    first = docs.join(labels.filter("toxic = 1"), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").first().doc_id
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 1 << 18)
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 1 << 15, raising=False)
    long = docs.withColumn("text", F.when(F.col("doc_id") == first, F.repeat("text", F.lit(1 << 13))).otherwise(F.col("text")))
    long = long.withColumn("text", F.substring("text", 1, 1 << 19))
    absent = spark.range(10_000, 30_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    model = toxicity.train(long, labels.union(absent))
    held = rows[600:]
    scores = model.scores(pa.array([t for _, t, _ in held]))
    assert np.mean([(s >= 0.5) == bool(y) for s, (_, _, y) in zip(scores, held, strict=True)]) >= 0.95


def test_a_long_text_in_stretches_scores_as_a_whole(monkeypatch):
    rng = np.random.default_rng(4)
    model = toxicity.Model(rng.normal(0, 1, 1 << toxicity.BUCKET_BITS), 0.1)
    words = ["the", "the", "cat", "\u00e9t\u00e9", "sat", "x" * 90, "on", "on", "on", "a", "mat"]
    texts = [" ".join(rng.choice(words, 400)), "on " * 500, "y" * 900, " \n" * 300, "a," * 300 + "  the the" * 60, "on on"]
    want = [float(model.scores(pa.array([t]))[0]) for t in texts]
    for size in (16, 37, 200):
        monkeypatch.setattr(toxicity, "BLOCK_BYTES", size)
        assert [float(model.scores(pa.array([t]))[0]) for t in texts] == pytest.approx(want, abs=1e-9)


def test_empty_table(spark, corpus):
    none = spark.createDataFrame([], "doc_id long, text string, score double")
    assert toxicity.keep_clean(none, corpus[3]).count() == 0
    assert none.select(toxicity.score(corpus[3], none, F.col("text")).alias("s")).count() == 0
