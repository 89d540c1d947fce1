"""URL rules: parts, the longest stated rule, and mined rules against brute force."""

import random
from itertools import combinations

from pyspark.sql import functions as F

from sheetmerge.llm import urlrules


def _parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    return host, path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]


def _stated(host, path):
    fits = []
    for verdict, rule in urlrules.RULES:
        name, _, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else (None, None)


URLS = [
    None, "", "no scheme", "://", "http://", "http://org", "http://ORG/", "https://a.example.org/es/1?x=/", "http://example.org/en/12",
    "http://example.org/en/2", "http://b.example.com/de/1#t", "http://x.com/fr/", "http://com/de/9", "http://xcom/de/9", "http://É.ORG/é",
    "a://b://c.org/d", "http://h.net?q=/org/", "http://example.org/en\n/1", "http://" + "x" * 5000 + ".org/" + "y/" * 5000,
]


def test_parts_and_stated_rules(spark):
    rows = [(i if i % 4 else None, u, "x") for i, u in enumerate(URLS * 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    none = urlrules.mine(spark.createDataFrame([], "url string, bad int"))
    got = urlrules.judge(pages, none).collect()
    want = []
    for i, u, _ in rows:
        host, path = _parts(u)
        rule, verdict = _stated(host, path)
        want.append((str(i), host, path, rule, verdict or "allow"))
    assert sorted(map(str, want)) == sorted(str((str(r.page_id), r.host, r.path, r.rule, r.verdict)) for r in got)


def test_mined_rules_equal_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for k in range(400):
        words = rng.sample(["alpha", "beta", "gamma", "delta", "spam", "shop"], 3)
        bad = int(({"spam", "shop"} <= set(words) and rng.random() < 0.9) or rng.random() < 0.1)
        rows.append((f"http://{words[0]}.net/{words[1]}/{k}?{words[2]}=7", bad))
    rows += [(None, 1), ("http://spam.net/", None)]
    labelled = spark.createDataFrame(rows, "url string, bad int")
    index = urlrules.mine(labelled, 0.02, 2.0, 1.0)
    rules = {tuple(r.needs): round(r.confidence, 9) for r in index.collect()}
    sets = [(set(t.tokens), r[1]) for r, t in zip(rows, labelled.select(urlrules.tokens(F.col("url")).alias("tokens")).collect()) if None not in r]
    every = sorted(set().union(*(s for s, _ in sets)))
    found, total = {}, len(sets)
    base = sum(bad for _, bad in sets) / total
    for n in range(1, 6):
        for combo in combinations(every, n):
            have = [bad for s, bad in sets if set(combo) <= s]
            if not have or sum(have) < max(10, 0.02 * total):
                continue
            share = sum(have) / len(have)
            if share >= 2 * base and share - base >= (base * (1 - base) / len(have)) ** 0.5:
                found[combo] = round(share, 9)
    want = {c: p for c, p in found.items() if not any(found.get(tuple(x for x in c if x != y), 0) >= p for y in c)}
    assert rules == want and ("shop", "spam") in rules
    pages = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(rows)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in urlrules.judge(pages, index).collect()}
    tokens = {r.page_id: set(r.t or []) for r in pages.select("page_id", urlrules.tokens(F.col("url")).alias("t")).collect()}
    assert got == {k: "block" if any(set(c) <= t for c in want) else "allow" for k, t in tokens.items()}


def test_a_hot_url_of_many_names_is_one_item(spark):
    names = [f"name{k}" for k in range(40)]
    hot = "http://spam.net/x?" + "&".join(f"{n}=1" for n in names)
    rows = [(f"http://site{k % 9}.org/{'buy' if k % 5 == 0 else 'read'}/{k}", int(k % 5 == 0 and k % 3 > 0)) for k in range(3000)]
    labelled = spark.createDataFrame(rows + [(hot, 1)] * 600 + [(hot.replace("name7=1&", ""), 1)] * 20, "url string, bad int")
    index = urlrules.mine(labelled)
    rules = {tuple(r.needs): r for r in index.collect()}
    alike = max((r.alternatives for r in rules.values()), key=lambda a: len(a[0]))
    assert len(rules) < 20 and set(alike[0]) >= set(names) - {"name7"}
    pages = spark.createDataFrame([(1, "http://a.b/?name3=2"), (2, "http://a.b/?name7=0"), (3, "http://a.b/buy"), (4, "http://a.b/read")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in urlrules.judge(pages, index).collect()} == {1: "block", 2: "block", 3: "block", 4: "allow"}


def test_no_labels_no_bad_labels_and_no_pages(spark):
    empty = spark.createDataFrame([], "url string, bad int")
    clean = spark.createDataFrame([("http://a.net/b", 0)] * 50, "url string, bad int")
    every = spark.createDataFrame([("http://a.net/b", 1)] * 50, "url string, bad int")
    assert [urlrules.mine(t).count() for t in (empty, clean, every)] == [0, 0, 0]  # all bad: no rule is surer than the labels
    assert urlrules.judge(spark.createDataFrame([], "page_id long, url string"), urlrules.mine(empty)).count() == 0
