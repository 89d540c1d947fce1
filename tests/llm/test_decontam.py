"""Decontamination against a full alignment of every document with every item."""

import random

import numpy as np
import pyarrow as pa
import pytest

from sheetmerge.llm import decontam


def _plain(text):
    out, word = [], ""
    for c in (text or "").lower() + " ":
        if c.isascii() and not c.isalnum():
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out


def _smith_waterman(a, b):
    best, above = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b, 1):
            row.append(max(0, above[j - 1] + (1 if x == y else -1), above[j] - 1, row[-1] - 1))
        best, above = max(best, *row), row
    return best


def _expected(docs, items):
    out = set()
    for d, (doc_id, text) in enumerate(docs):
        for item_id, item in items:
            seq = _plain(item)
            if len(seq) >= 5:
                score = _smith_waterman(seq, _plain(text))
                if score >= min(0.5 * len(seq), 50):
                    out.add((doc_id, item_id, score))
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    vocab = [f"w{k}" for k in range(300)] + ["the", "of", "a", "É", "ß"] * 20
    items = [(k, " ".join(rng.choices(vocab, k=rng.randint(8, 60)))) for k in range(12)]
    items += [(90, "one two"), (91, None), (92, ""), (93, " ".join(rng.choices(vocab, k=300)))]
    docs = []
    for k in range(120):
        body = rng.choices(vocab, k=rng.randint(0, 150))
        if k % 3 == 0:
            words = items[k % 12][1].split()
            for _ in range(k % 9):
                if k % 2:
                    words[rng.randrange(len(words))] = "edit"
                else:
                    words.insert(rng.randrange(len(words)), "more")
            at = rng.randint(0, len(body))
            body[at:at] = [w.upper() + "," * (k % 2) for w in words]
        docs.append((k, " ".join(body)))
    excerpt = " ".join(items[-1][1].split()[100:170])
    docs += [(200, None), (201, ""), (202, excerpt), (None, items[0][1]), (0, items[1][1]), (0, items[1][1])]
    return docs, items


def test_pairs_equal_full_alignment(spark, corpus):
    docs, items = corpus
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    i = spark.createDataFrame(items, "item_id long, text string")
    rows = decontam.find_items(d, i).collect()
    got = {(r.doc_id, r.item_id, r.matched) for r in rows}
    want = _expected(docs, items)
    # a chance alignment without five shared words in a row holds no seed
    assert got <= want
    assert {x for x in want - got if x[2] >= 9} == set()
    assert len([r for r in rows if r.doc_id == 0 and r.item_id == 1]) == 2
    assert (202, 93) in {(r.doc_id, r.item_id) for r in rows}
    spans = {(r.doc_id, r.item_id): r for r in rows}
    words = _plain(dict(docs)[3])
    r = spans[3, 3]
    assert words[r.first_word] in _plain(items[3][1]) and words[r.last_word] in _plain(items[3][1])


def test_blocks_of_items_give_the_same(spark, corpus, monkeypatch):
    docs, items = corpus
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(str, decontam.find_items(d, i).collect()))
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 200)
    assert sorted(map(str, decontam.find_items(d, i).collect())) == one


def test_stage_keeps_clean_rows_and_all_columns(spark, corpus):
    docs, items = corpus
    d = spark.createDataFrame([(k, t, "x", 1.5) for k, t in docs], "doc_id long, text string, item_id string, score double")
    i = spark.createDataFrame(items, "item_id long, text string")
    held = {r.doc_id for r in decontam.find_items(d, i).collect()}
    kept = decontam.keep_uncontaminated(d, i)
    assert kept.columns == d.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, _ in docs} - held
    assert None in held and 200 not in held


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    i = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert decontam.find_items(d, i).count() == 0
    docs = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find_items(docs, none).count() == 0
    assert decontam.keep_uncontaminated(docs, none).count() == 1


def test_alignment_of_one_long_text():
    seq = np.arange(1, 41, dtype=np.uint64)
    view = np.concatenate([np.zeros(30, np.uint64), seq[:20], np.zeros(1, np.uint64), seq[20:], np.zeros(5, np.uint64)])
    score, last = decontam.align(view[None, :], seq)
    assert score[0] == 39 and last[0] == 70


def test_words_across_buffer_steps():
    long_word = "x" * 200_000
    column = pa.array([f"a {long_word} b", f"{'q' * 65_530} {long_word}"])

    both = [c for _, c, _ in decontam._rows_words(column)]
    flat = np.concatenate(both)
    assert flat[1] == flat[-1] and len(set(flat.tolist())) == 4


@pytest.mark.parametrize("verbatim", [0, 1, 20])
def test_copies_with_every_fifth_word_replaced(spark, verbatim):
    items = [(k, " ".join(f"i{k}w{n}" for n in range(size))) for k, size in enumerate((14, 20, 33, 59))]
    docs = [(100 + k, " ".join(f"d{k}w{n}" for n in range(60))) for k in range(20)]
    for k, text in items:
        words = text.split()
        words[4::5] = [f"x{k}y{n}" for n in range(len(words[4::5]))]
        docs.append((k, "before it " + " ".join(words) + " after it"))
        docs += [(1000 + n, text) for n in range(verbatim)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    found = decontam.find_items(d, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found if r.doc_id < 1000} == {(k, k) for k, _ in items}


def test_a_common_phrase_is_no_copy_of_a_short_item(spark):
    items = [(1, "What is the capital of France?"), (2, "the capital of Peru is"), (3, "who wrote the book of the seven hills")]
    clean = ["Oslo is the capital of Norway", "Lima is the capital", "what is the matter", "the book of the week", "he wrote the book of the year"]
    docs = [(10 + k, t) for k, t in enumerate(clean)] + [(k, f"so: {t} yes") for k, t in items]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.find_items(d, i).collect()} == {(1, 1), (2, 2), (3, 3)}
    assert {r.doc_id for r in decontam.keep_uncontaminated(d, i).collect()} == {10, 11, 12, 13, 14}


def test_scripts_without_spaces_marks_and_short_items(spark):
    items = [
        (1, "法国的首都是哪个城市"),
        (2, "日本で一番高い山は何ですか"),
        (3, "เมืองหลวงของประเทศไทยคืออะไร"),
        (4, "he said \"don't go there - not now\" twice"),
        (5, "speed of light"),
        (6, "Mitochondrion"),
        (7, "Ünïcode naïve café déjà vu résumé über"),
        (8, "…"),
    ]
    held = [
        (1, "前文。问题：法国的首都是哪个城市？答案"),
        (2, "質問日本で一番高い山は何ですか富士山"),
        (3, "ถามเมืองหลวงของประเทศไทยคืออะไรตอบ"),
        (4, "He said “don’t go there—not now” twice"),
        (5, "the speed of light, of light"),
        (6, "a “mitochondrion” is"),
        (7, "x ünïcode，naïve…café déjà\u00a0vu résumé über"),
    ]
    docs = held + [(10, "法国的天气很好"), (11, "the speed of the light"), (12, "speed of"), (13, "mitochondrions … "), (14, None), (15, "light speed of")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    rows = decontam.find_items(d, i).collect()
    assert sorted((r.doc_id, r.item_id) for r in rows) == [(k, k) for k, _ in held]
    assert all(r.score == 1 for r in rows)
    assert [(r.first_word, r.last_word) for r in rows if r.item_id == 5] == [(1, 3)]
    assert {r.doc_id for r in decontam.keep_uncontaminated(d, i).collect()} == {10, 11, 12, 13, 14, 15}
