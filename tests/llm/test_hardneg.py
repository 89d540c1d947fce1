"""Hard negatives against plain Python integers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sheetmerge.llm import hardneg


def cut(x):
    return max(-(2**63) + 1, min(2**63 - 1, x))


def expected(rows, is_anchor, k=5, low=80, high=100):
    whole = [
        (i, label, [math.floor(256 * x) for x in v])
        for i, label, v in rows
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for r, (anchor, label, a) in enumerate(whole):
        if anchor is None or not is_anchor(anchor):
            continue
        scored = [(cut(sum(x * y for x, y in zip(a, b))), c, la) for o, (c, la, b) in enumerate(whole) if o != r]
        scored.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        for ps, positive, _ in [s for s in scored if s[2] == label][:k]:
            fits = [s for s in scored if s[2] != label and low * ps <= 100 * s[0] <= high * ps][:k]
            out += [(anchor, positive, n, c, ps, ns) for n, (ns, c, _) in enumerate(fits, 1)]
    return sorted(out, key=str)


def run(spark, rows, every=10, **how):
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    table = table.withColumn("row", F.lit("x")).withColumn("score", F.lit(1)).repartition(3)
    got = hardneg.mine(table, F.col("id") % every == 0, **how)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_vectors(spark, monkeypatch, seed):
    monkeypatch.setattr(hardneg, "_CELLS", 64 * 12)  # blocks of 64 rows
    monkeypatch.setattr(hardneg, "ANCHOR_BLOCK", 20)
    rng = random.Random(seed)
    # label 0 holds a third of all rows; vectors lean towards one direction, so that windows fill
    rows = [(i, rng.choice([0, 0, 0, 1, 2, 3, 4, 5, 6]), [rng.gauss(0.3 if d < 2 else 0, 0.1) for d in range(12)]) for i in range(500)]
    rows += [(500 + i, i % 3, rows[3][2]) for i in range(150)]  # a very common vector: ties
    got = run(spark, rows)
    assert len(got) > 500 and got == expected(rows, lambda i: i % 10 == 0)


def test_other_windows(spark):
    rng = random.Random(9)
    rows = [(i, i % 4, [rng.gauss(0.2, 0.2) for _ in range(9)]) for i in range(200)]
    got = run(spark, rows, min_percent=50, max_percent=120, positives=2, negatives=2)
    assert got and got == expected(rows, lambda i: i % 10 == 0, 2, 50, 120)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.5]), (0, 1, [1.0, 0.25]), (10, None, [1.0, 1.0]), (20, 1, None), (30, 1, [1.0, None]), (40, 2, [nan, 1.0])]
    rows += [(50, 2, [inf, 1.0]), (None, 2, [1.0, 0.5]), (None, 1, [0.9, 0.5]), (60, 2, []), (70, 2, [1.0]), (80, 1, [1.0, 0.4, 3.0])]
    rows += [(90, 2, [-1.0, -1.0]), (91, 2, [-1.0, -0.9]), (92, 3, [1.0, 0.45]), (93, 3, [1.0, 0.45]), (93, 3, [1.0, 0.45])]
    got = run(spark, rows)
    assert got == expected(rows, lambda i: i % 10 == 0) and any(r[3] is None for r in got)


def test_large_components(spark):
    rows = [(i, i % 3, [float(10 ** (i % 9)) * (-1) ** i, 3.7e5 * i, float(2**40 + i)]) for i in range(60)]
    got = run(spark, rows)
    assert got and got == expected(rows, lambda i: i % 10 == 0)


def test_few_rows(spark):
    for rows in ([], [(0, 1, [1.0])], [(0, 1, [1.0]), (1, 1, [1.0])], [(0, 1, [1.0]), (1, 2, [1.0])], [(3, 1, [1.0]), (4, 2, [1.0])]):
        assert run(spark, rows) == []
    assert run(spark, [(0, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.9])]) == [(0, 1, 1, 2, 65536, 58880)]
