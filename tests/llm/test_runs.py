"""Periodic runs against plain comparison of all words at all distances."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from sheetmerge.llm import queries, runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words):
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            s = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            if i + p - s >= max(12, 2 * p):
                found.setdefault((s, i + p), p)
            i += 1
    return sorted(((s, e - s, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


def plain_collapsed(words, found):
    drop = {i for s, n, p in found for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in drop)


def small_alphabet(rng, kind):
    n = rng.randrange(400)
    if kind == "random":
        return [rng.choice("ab") for _ in range(n)]
    if kind == "fibonacci":
        a, b = "a", "ab"
        while len(b) < n:
            a, b = b, b + a
        return list(b[:n])
    if kind == "nested":
        w = [rng.choice("ab") for _ in range(rng.randrange(1, 4))]
        while len(w) < n:
            w = w * rng.randrange(1, 9) + [rng.choice("ab") for _ in range(rng.randrange(3))]
        return w[:900]
    if kind == "neighbours":  # a run, and the next one of its period in another phase
        u = [rng.choice("abc") for _ in range(rng.randrange(2, 7))]
        w = u * rng.randrange(4, 60) + u[: rng.randrange(len(u))]
        for _ in range(rng.randrange(1, 4)):
            w += u[rng.randrange(len(u)) :] + u * rng.randrange(1, 60) + u[: rng.randrange(len(u))]
        return w
    words = [str(rng.randrange(40)) for _ in range(n + 1)]  # planted
    a = rng.randrange(len(words))
    p = 1 + (len(words) - a) // rng.randrange(2, 9)
    return [words[i if i < a else a + (i - a) % p] for i in range(len(words))]


@pytest.mark.parametrize("kind", ["random", "fibonacci", "nested", "neighbours", "planted"])
def test_against_all_distances(kind):
    rng = random.Random(kind)
    for _ in range(60):
        texts = [small_alphabet(rng, kind) for _ in range(rng.randrange(1, 5))]
        for words, (found, kept) in zip(texts, runs._block([" ".join(t).encode() for t in texts]), strict=True):
            assert found == plain_runs(words)
            assert kept == plain_collapsed(words, found)


def test_defined_results(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a " * 11), (5, "a " * 12), (5, "a " * 12), (None, "x y z " * 9), (7, "\u00e9t\u00e9\u00a0a b " * 6)]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit("mine")).withColumn("found", F.lit(1))
    got = table.select("*", runs.find_runs("text").alias("r")).select("doc_id", "runs", "r.*").toDF("doc_id", "mine", "runs", "kept").collect()
    seen = sorted((r["doc_id"] or 0, [tuple(x) for x in r["runs"]], r["kept"]) for r in got)
    assert seen == [
        (0, [(0, 27, 3)], "x y z"),
        (1, [], ""),
        (2, [], ""),
        (3, [], ""),
        (4, [], "a " * 10 + "a"),
        (5, [(0, 12, 1)], "a"),
        (5, [(0, 12, 1)], "a"),
        (7, [(0, 12, 2)], "\u00e9t\u00e9\u00a0a b"),
    ]
    empty = spark.createDataFrame([], "doc_id long, text string").select(runs.find_runs("text").alias("r"))
    assert empty.count() == 0 and empty.select("r.*").columns == ["runs", "collapsed"]


def test_long_texts():
    rng = random.Random(5)
    base = [str(rng.randrange(10**6)) for _ in range(120_000)]
    planted = [base[i if i < 999 else 999 + (i - 999) % 40_001] for i in range(len(base))]
    one = ["w"] * 300_000
    (a, kept), (b, _) = runs._block([" ".join(planted).encode(), " ".join(one).encode()])
    assert a == [(999, len(base) - 999, 40_001)] and kept == " ".join(base[: 999 + 40_001])
    assert b == [(0, 300_000, 1)]


def test_query_against_plain(spark):
    got = {r["doc_id"]: r for r in queries.op13_runs(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    planted = 0
    for doc_id, text in docs:
        words = WORD.findall(text or "")
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        found = plain_runs(words) if n <= 3000 else None
        r = got[doc_id]
        if found is None:
            continue
        planted += bool(found)
        s, size, p = max(found, key=lambda x: (x[1], -x[0], -x[2]), default=(None, None, None))
        told = "".join(f"{a},{b},{c}\n" for a, b, c in found)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(found), s, size, p)
        assert r["exponent_milli"] == (None if p is None else 1000 * size // p)
        assert r["runs_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(plain_collapsed(words, found).encode()).hexdigest()
    assert planted > 5
