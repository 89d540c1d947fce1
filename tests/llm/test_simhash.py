"""SimHash near-dedup against fingerprints and links made pair by pair."""

import random
import re

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from sheetmerge.llm import components, simhash

SF = "/root/testdata/sf0.001"


def plain_print(text, n=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[k : k + n]) for k in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, d):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= d:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out = [(r[0], r[1]) for r in duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()]
    base = [f"w{rng.randrange(500)}" for _ in range(600)]
    for k in range(60):  # edited copies: a cloud of close fingerprints
        words = list(base)
        for _ in range(k % 4):
            words[rng.randrange(600)] = "edit"
        out.append((1000 + k, " ".join(words)))
    out += [(2000 + k, "the same  text\tagain and AGAIN") for k in range(40)]
    out += [(3000, None), (3001, ""), (3002, " \n\t "), (3003, "one"), (3004, "ONE"), (3005, "one two"), (3006, "Ünï\x85cödé\xa0x y z")]
    out += [(None, "one two"), (None, "a lone text without an id here"), (7, "a row with an id of another"), (3003, "one")]
    out.append((4000, "long " * 400_000 + "tail"))
    return out


def test_groups_equal_all_pairs(spark, rows):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fingerprint string").repartition(6)
    got = simhash.near_dedup(docs).collect()
    prints = [plain_print(t) for _, t in rows]
    groups = plain_groups(prints, 2)
    ids = {}
    for (i, _), g in zip(rows, groups, strict=True):
        ids.setdefault(g, []).append(i)
    low = {g: min([i for i in v if i is not None], default=None) for g, v in ids.items()}
    want = [(i, f"{p:016x}", low[g]) for (i, _), p, g in zip(rows, prints, groups, strict=True)]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.fingerprint, r.component_id)) for r in got)


def test_one_document_of_each_group_stays(spark, rows):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, rep string").repartition(6)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    groups = plain_groups([plain_print(t) for _, t in rows], 2)
    by_print = {}
    for (i, t), g in zip(rows, groups, strict=True):
        by_print.setdefault(g, []).append((i is None, i or 0, t))
    have = kept.collect()
    assert len(have) == len(by_print)
    assert sorted(str(r.doc_id) for r in have) == sorted("None" if min(v)[0] else str(min(x[:2] for x in v)[1]) for v in by_print.values())


@pytest.mark.parametrize("d", [0, 1, 2, 3])
def test_any_distance(spark, d):
    rng = random.Random(d)
    prints = [rng.getrandbits(64) for _ in range(15)]
    for _ in range(45):
        x = rng.choice(prints)
        for _ in range(rng.randint(1, 4)):
            x ^= 1 << rng.randrange(64)
        prints.append(x)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fingerprint long")
    links = simhash.near_links(frame, max_distance=d)
    pairs = {frozenset((r.a, r.b)) for r in links.collect()}
    close = {frozenset((a, b)) for a, x in zip(signed, prints) for b, y in zip(signed, prints) if a != b and (x ^ y).bit_count() <= d}
    assert pairs <= close
    sets = {}
    for r in components.connected_components(links).collect():
        sets.setdefault(r.component, set()).add(r.node)
    groups = {}
    for s, g in zip(signed, plain_groups(prints, d), strict=True):
        groups.setdefault(g, set()).add(s)
    assert {frozenset(v) for v in sets.values()} == {frozenset(v) for v in groups.values() if len(v) > 1}


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(k, k + 1) for k in range(300)]
    random.Random(1).shuffle(chain)
    star = [(1000, 1000 + k) for k in range(1, 500)] + [(7000, 7000)]
    got = components.connected_components(spark.createDataFrame(chain + star + chain[:50], "a long, b long")).collect()
    assert {(r.node, r.component) for r in got} == {(k, 0) for k in range(301)} | {(k, 1000) for k in range(1000, 1500)}


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_dedup(none).count() == 0
    assert simhash.keep_one(none).count() == 0
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hash_is_sparks(spark):
    row = spark.sql("select xxhash64('a b c') as h").first()
    assert row.h & (2**64 - 1) == xxhash.xxh64_intdigest(b"a b c", 42)
    one = spark.createDataFrame([("a b c",)], "text string").select(simhash.fingerprint(F.col("text")).alias("f")).first()
    assert one.f == row.h
