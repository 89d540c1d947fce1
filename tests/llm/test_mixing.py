"""Mixing against budgets and prefix sums worked out row by row."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sheetmerge.llm import mixing


def plain_targets(size, weights=(5, 2, 1), share=1.5, most=2):
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    stopped, left = set(), share * sum(size.values())
    while True:
        open_ = [s for s in order if s not in stopped]
        rate = (left - sum(most * size[s] for s in stopped)) / max(1e-9, sum(weight[s] for s in open_))
        over = {s for s in open_ if weight[s] * rate > most * size[s]}
        if not over:
            return {s: most * size[s] if s in stopped else weight[s] * rate for s in order}
        stopped |= over


def frames(spark, rows):
    return spark.createDataFrame([(i, t, s, 9) for i, t, s in rows], "doc_id long, text string, source string, taken long").repartition(5)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for k in range(900):
        source = "hot" if k % 3 == 0 else rng.choice(["a", "Z", "é", "", None, "b", "tiny"][: 7 if k < 100 else 6])
        out.append((k, "w\t" * rng.randint(0, 40) + "x y" * (k % 2), source))
    out += [(5000, "word " * 30_000, "a"), (5001, None, "a"), (5002, "", "zero"), (5003, None, "zero"), (None, "q r s", "b")]
    out += [(6000, "same row", "hot")] * 200
    return out


def test_targets_sizes_and_budgets(spark, rows):
    docs = frames(spark, rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    target = plain_targets(size)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == size[r.source]
        assert r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in size:
        assert abs(taken[s] - target[s]) <= 1 + (200 if s == "hot" else 0)
    sizes = sorted((str(r.doc_id), r.size) for r in got)
    assert sizes == sorted((str(i), len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, _ in rows)


def test_cut_is_the_prefix_by_key(spark, rows):
    docs = frames(spark, rows)
    sizes, cuts = mixing.plan(docs)
    keys = {(r.id, r.source): r.key for r in sizes.collect()}
    got = defaultdict(list)
    for r in mixing.mix(docs).collect():
        got[r.source].append((keys[r.doc_id, r.source] % (1 << 64), r.size, r.taken, r.target, r.source_size))
    for source, docs_ in got.items():
        docs_.sort()
        total = docs_[0][4]
        budget = int(docs_[0][3])
        whole = budget // total if total else 0
        left, extra = budget - whole * total, [t - whole * s for _, s, t, *_ in docs_]
        run = 0
        for (key, s, *_), e in zip(docs_, extra, strict=True):
            if sum(k == key for k, *_ in docs_) == 1:
                assert e == max(0, min(s, left - run)), source
            run += s


def test_reruns_agree_and_stage_keeps_columns(spark, rows):
    first = sorted(map(str, mixing.mix(frames(spark, rows)).collect()))
    again = sorted(map(str, mixing.mix(frames(spark, rows[::-1]).repartition(3)).collect()))
    assert first == again
    docs = frames(spark, rows)
    mixed = mixing.mixed_documents(docs)
    assert set(mixed.columns) == set(docs.columns)
    have = sorted((str(r.doc_id), r.taken) for r in mixed.collect())
    assert have == sorted((str(r.doc_id), r.taken) for r in mixing.mix(docs).collect() if r.taken)


def test_clashing_names_stay(spark, rows):
    docs = frames(spark, rows).withColumn("_mix_doc", F.lit("mine")).withColumn("_mix_cut", F.lit(7)).withColumn("_MIX_CUT_2", F.lit(8))
    mixed = mixing.mixed_documents(docs)
    assert set(mixed.columns) == set(docs.columns) | {"taken"}
    assert {tuple(r) for r in mixed.select("_mix_doc", "_mix_cut", "_MIX_CUT_2").collect()} == {("mine", 7, 8)}


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(none).count() == 0
    assert mixing.mixed_documents(none).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")
    assert [(r.target, r.taken) for r in mixing.mix(blank).collect()] == [(0.0, 0)] * 2
