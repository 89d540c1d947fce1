"""Top-k against plain Python integers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sheetmerge.llm import topk


def expected(rows, is_query, k=5):
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for r, (q, a) in enumerate(whole):
        if q is not None and is_query(q):
            scored = [(-max(-(2**63) + 1, min(2**63 - 1, sum(x * y for x, y in zip(a, b)))), c is None, c or 0) for o, (c, b) in enumerate(whole) if o != r]
            out += [(q, n, None if no_id else c, -s) for n, (s, no_id, c) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def run(spark, rows, k=5, every=5):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).repartition(3)
    got = topk.top_k(table, F.col("id") % every == 0, k=k)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted((tuple(r) for r in got.collect()), key=str), expected(rows, lambda q: q % every == 0, k)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_vectors(spark, monkeypatch, seed):
    monkeypatch.setattr(topk, "SEEDS", 20)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 30)
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 0.1 * (1 + i % 7)) for _ in range(12)]) for i in range(400)]
    rows += [(400 + i, rows[3][1]) for i in range(150)]  # a very common vector: ties
    got, want = run(spark, rows)
    assert got == want


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, -1e-20]), (5, [0.5, 0.25]), (7, None), (8, [1.0, None]), (9, [nan, 1.0]), (10, [inf, 1.0]), (None, [9.0, 9.0])]
    rows += [(11, []), (12, [2.0]), (13, [1.0, 2.0, 3.0]), (15, [0.0, 0.0]), (5, [0.5, 0.125]), (5, [0.5, 0.25]), (20, [-1.0, -1.0])]
    got, want = run(spark, rows)
    assert got == want


def test_rows_that_repeat_an_id(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    rows = [(0, [1.0, 0.0]), (1, [0.1, 0.0]), (1, [5.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (10, [3.0, 1.0]), (10, [0.5, 9.0]), (None, [4.0, 0.0])]
    got, want = run(spark, rows, k=3)
    assert got == want
    assert (0, 1, 1, 327680) in got and len([r for r in got if r[0] == 10]) == 6


def test_large_components(spark):
    rows = [(i, [float(10 ** (i % 9)) * (-1) ** i, 3.7e5 * i, float(2**40 + i)]) for i in range(0, 30)]
    got, want = run(spark, rows)
    assert got == want


def test_few_rows(spark):
    for rows in ([], [(5, [1.0])], [(5, [1.0]), (6, [2.0])], [(6, [1.0]), (7, [1.0])]):
        got, want = run(spark, rows)
        assert got == want
