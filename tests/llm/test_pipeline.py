"""The pipeline, stage by stage, against plain versions over the same rows."""

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from sheetmerge.llm import decontam, secrets, toxicity
from tests.llm.test_secrets import all_of
from tests.llm.test_simhash import plain_groups, plain_print

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """(rows before, rows after) of every stage, each written and read again."""
    folder, out = tmp_path_factory.mktemp("stages"), {}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        result = stage(spark, docs, SF)
        if name != "mixture":
            assert result.columns == docs.columns
        result.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out[name] = before, docs.collect()
    return out


def ids(rows):
    return sorted(r.doc_id for r in rows)


def test_stages_come_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "mixture"]


def test_toxicity_stage(spark, steps):
    before, after = steps["toxicity"]
    model = toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    scores = model.scores(pa.array([r.text.lower() for r in before]))
    assert ids(after) == sorted(r.doc_id for r, s in zip(before, scores, strict=True) if s < 0.7)
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 1").collect()}
    assert len(toxic & set(ids(after))) <= 0.1 * max(1, len(toxic & set(ids(before))))


def test_near_duplicate_stage(steps):
    before, after = steps["near_duplicates"]
    groups = {}
    for r, g in zip(before, plain_groups([plain_print(r.text) for r in before], 2), strict=True):
        groups.setdefault(g, []).append(r.doc_id)
    assert ids(after) == sorted(min(v) for v in groups.values())


def test_decontamination_stage(spark, steps):
    before, after = steps["decontamination"]
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()

    def codes(text):
        return next(iter(decontam._rows_words(pa.array([text.lower()]))))[1]

    seqs = [c for c in (codes(i.text) for i in items) if len(c) >= 5]
    held = set()
    for r in before:
        view = codes(r.text)[None, :]
        for seq in seqs:
            if np.isin(view, seq).sum() >= 0.5 * len(seq):
                score, _ = decontam.align(view, seq)
                if score[0] >= min(np.ceil(0.5 * len(seq)), 50):
                    held.add(r.doc_id)
    assert ids(after) == sorted(set(ids(before)) - held)


def test_secrets_stage(spark, steps):
    before, after = steps["secrets"]
    ratios = secrets.train(spark.createDataFrame(before))
    assert ids(before) == ids(after)
    by_id = {r.doc_id: r for r in after}
    for r in before:
        out, at = "", 0
        for s, _, e in all_of(r.text, ratios):
            if e > at:
                out, at = out + r.text[at : max(s, at)] + secrets.MASK, e
        out += r.text[at:]
        assert by_id[r.doc_id].text == out and by_id[r.doc_id].n_chars == len(out)


def test_mixture_stage(steps):
    before, after = steps["mixture"]
    total = sum(len(r.text.split()) for r in before)
    assert set(ids(after)) <= set(ids(before))
    assert all(0 < r.taken <= 2 * len(r.text.split()) for r in after)
    assert sum(r.taken for r in after) == pytest.approx(1.5 * total, abs=2 * len({r.source for r in before}))


def test_run_gives_the_same_rows(spark, steps):
    got = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.taken) for r in got.collect()) == sorted((r.doc_id, r.taken) for r in steps["mixture"][1])
