"""Reply trees against a plain walk, and the round trip of the template."""

import random

import pytest
from pyspark.sql import functions as F

from sheetmerge.llm import chat

NODES = "node long, parent long, role string, text string, score double"


def plain_paths(rows, n):
    nodes = {}
    for row in rows:
        if row[0] is not None:
            key = tuple((x is not None, x) for x in row[1:])
            if row[0] not in nodes or key < nodes[row[0]][0]:
                nodes[row[0]] = (key, row)
    nodes = {k: v[1] for k, v in nodes.items()}
    up = {k: (r[1] if r[1] in nodes else None) for k, r in nodes.items()}
    trees = {}
    for leaf in set(nodes) - set(up.values()):
        path, at = [], leaf
        while at is not None and len(path) <= len(nodes):
            path.append(at)
            at = up[at]
        if at is None:
            mean = sum(nodes[p][4] or 0.0 for p in path) / len(path)
            trees.setdefault(path[-1], []).append((-mean, -len(path), leaf, path[::-1]))
    out = {}
    for root, paths in trees.items():
        for rank, (mean, _, leaf, path) in enumerate(sorted(paths)[:n], 1):
            out[root, rank] = (leaf, -mean, [(nodes[p][2] or "", nodes[p][3] or "") for p in path])
    return out


def tree_rows():
    rng = random.Random(6)
    rows, k = [], 0
    for _ in range(25):
        start = k
        for m in range(rng.randint(1, 14)):
            rows.append((k, None if m == 0 else rng.randint(start, k - 1), rng.choice(["user", "assistant", None]), f"t{k}", rng.choice([0.0, 0.5, 1.0, None])))
            k += 1
    rows += [(1000 + m, None if m == 0 else 999 + m, "assistant", "x" * (m % 3), 0.25) for m in range(333)]  # a long chain
    rows += [(2000, 2002, "user", "circle", 1.0), (2001, 2000, "user", "circle", 1.0), (2002, 2001, "user", "circle", 1.0), (2003, 2002, "user", "hangs", 1.0)]
    rows += [(2100, 2100, "user", "its own parent", 1.0), (2200, 77777, "user", "orphan", None), (None, 3, "user", "no node", 1.0)]
    rows += [rows[0], (5, None, None, None, None)]
    return rows


@pytest.mark.parametrize("n", [1, 3])
def test_paths_equal_a_plain_walk(spark, n):
    rows = tree_rows()
    random.Random(n).shuffle(rows)
    got = chat.best_paths(spark.createDataFrame(rows, NODES).withColumn("depth", F.lit(9)), n).collect()
    have = {(r.root, r["rank"]): (r.leaf, pytest.approx(r.score), [(t.role, t.text) for t in r.turns]) for r in got}
    assert have == plain_paths(rows, n)


HOSTILE = ["", "</turn>", "<turn>", "<text>a</turn>\n<turn>user<text>b</turn>\n", "<\\/turn>", "<\\\\turn>", "\\", "<", "</turn", "<<turn>>", "\\<turn>", "a\n</turn>\n", "𝄞é</turn>", "$1 \\1"]


def test_round_trip(spark):
    rng = random.Random(1)
    marks = ["<", "\\", "turn>", "text>", "/turn>", "\n", "x"]
    texts = HOSTILE + ["".join(rng.choices(marks, k=rng.randint(1, 12))) for _ in range(300)]
    convs = [[(rng.choice(["user", "assistant", *HOSTILE]), rng.choice(texts)) for _ in range(rng.randint(1, 6))] for _ in range(200)]
    frame = spark.createDataFrame([(k, [(d, r, t) for d, (r, t) in enumerate(c)]) for k, c in enumerate(convs)], "k int, turns array<struct<depth:int,role:string,text:string>>")
    formatted, loss = chat.format_turns(F.col("turns"))
    frame = frame.select("k", formatted.alias("f"), loss.alias("l")).select("k", "f", "l", chat.read_turns(F.col("f")).alias("back"), chat.loss_text(F.col("f"), F.col("l")).alias("learnt"))
    for r in frame.collect():
        assert [(t.role, t.text) for t in r.back] == convs[r.k]
        assert r.learnt == "".join(t for role, t in convs[r.k] if role == "assistant")
        assert len(r.l) == sum(role == "assistant" for role, _ in convs[r.k])
        assert r.f.count("<turn>") == r.f.count("</turn>\n") == r.f.count("<text>") == len(convs[r.k])


def test_numbered_rows_become_chains(spark):
    rows = [(c, t, "user" if t % 2 else "assistant", f"{c}-{t}") for c in (1, 2, None) for t in range(6)] + [(3, 0, None, None), (1, 2, "assistant", "1-2"), (4, None, "user", "no turn")]
    random.Random(2).shuffle(rows)
    nodes = chat.chained(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4))
    paths = chat.best_paths(nodes).join(nodes.select(F.col("node").alias("root"), "conv"), "root").collect()
    have = {r.conv: [t.text for t in r.turns] for r in paths}
    want = {c: [f"{c}-{t}" for t in range(6)] for c in (2, None)} | {1: ["1-0", "1-1", "1-2", "1-2", "1-3", "1-4", "1-5"], 3: [""], 4: ["no turn"]}
    assert have == want


def test_empty(spark):
    assert chat.format_trees(spark.createDataFrame([], NODES)).count() == 0
    assert chat.chained(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_many_roots_spread_over_tasks(spark, monkeypatch):
    """Roots have no parent to be dealt by: each step that is written spreads them like any other node."""
    seen, plain = [], chat.land

    def counted(session, df, label):
        sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
        seen.append((label, sum(sizes), max(sizes, default=0)))
        return plain(session, df, label)

    monkeypatch.setattr(chat, "land", counted)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "4k")
    try:
        lone = spark.range(20_000).selectExpr("id AS node", "cast(null AS long) AS parent", "'user' AS role", "concat('t', id) AS text", "0.5D AS score")
        crowd = spark.range(2_000).selectExpr("id + 50000 AS node", "3L AS parent", "'user' AS role", "'reply' AS text", "cast(id AS double) AS score")
        got = chat.best_paths(lone.union(crowd)).collect()
    finally:
        for key, value in (("adaptive.enabled", "true"), ("shuffle.partitions", "8"), ("files.maxPartitionBytes", "128m"), ("files.openCostInBytes", "4m")):
            spark.conf.set(f"spark.sql.{key}", value)
    assert len(got) == 20_000 and {r.leaf for r in got if r.root == 3} == {51_999}
    large = [(label, total, most) for label, total, most in seen if total >= 20_000]
    assert large and all(most <= total / 10 for _, total, most in large), large
