"""Licence scans against every unit compared with every template."""

import re

import pytest

from sheetmerge.llm import licenses


def plain(rows):
    out = {}
    for i, text in rows:
        if text is None:
            continue
        units = text.split("\n") + [p for p in re.split(r"\n[ \t\r]*\n", text) if "\n" in p]
        for unit in units:
            score, name = best_of(licenses._words(unit), GRAMS)
            if score >= 0.8:
                n, s, _ = out.get((i, name), (0, 0.0, 0))
                out[i, name] = (n + 1, max(s, score), 0)
        words = licenses._words(text)
        for p in range(len(words)):
            key = {words[p], " ".join(words[p : p + 2])}
            windows = [(words[max(0, p - at) : p - at + size], (name, set(grams))) for k, name, grams, at, size in KEYS if k in key]
            score, name = min((-best_of(w, [t])[0], -len(t[1]), t[0]) for w, t in windows)[::2] if windows else (0, "")
            if -score >= 0.8:
                n, s, w = out.get((i, name), (0, 0.0, 0.0))
                out[i, name] = (n, s, max(w, -score))
    return {k: (max(n, 1), s or w) for k, (n, s, w) in out.items()}


GRAMS = [(name, set(licenses._bigrams(licenses._words(text)))) for name, text in licenses.TEMPLATES]
KEYS = licenses.window_keys(licenses.TEMPLATES, licenses.THRESHOLD)


def best_of(words, templates):
    """(score, licence) of the best template; the longer one on a tie."""
    mine = set(licenses._bigrams(words))
    scored = [(-2 * len(mine & theirs) / (len(mine) + len(theirs)), -len(theirs), name) for name, theirs in templates]
    score, _, name = min(scored)
    return -score, name


def template(start, license=None):
    return next(text for name, text in licenses.TEMPLATES if text.startswith(start) and license in (None, name))


@pytest.fixture(scope="module")
def rows():
    out, k = [], 0
    for _, text in licenses.TEMPLATES:
        words = text.split()
        for drop in range(0, 5):
            kept = [w for n, w in enumerate(words) if n % (len(words) // (drop + 1) + 1) != 3 or not drop]
            out.append((k, "some prose first\n# " + " ".join(kept).upper() + "\nand after"))
            k += 1
        half = len(words) // 2
        out.append((k, "before\n\n" + " ".join(words[:half]) + "\n" + " ".join(words[half:]) + "\n \nafter"))
        k += 1
    mit = template("Released under the MIT")
    out += [(500, None), (501, ""), (502, "\n\n\n"), (503, "license"), (None, mit), (None, mit), (3, mit + "\n" + mit), (504, ("filler words here\n" * 20_000) + mit), (505, "licensed " * 50_000)]
    return out


def test_matches_equal_all_pairs(spark, rows):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, license string").repartition(5)
    got = {(r.doc_id, r.license): (r.units, r.score) for r in licenses.find_licenses(docs).collect()}
    want = plain(rows)
    assert got == {k: (n, pytest.approx(s)) for k, (n, s) in want.items()}
    assert len(want) > 30


def test_anchors_leave_no_match_without_one():
    for _, text in licenses.TEMPLATES:
        grams = licenses._bigrams(licenses._words(text))
        found = licenses.anchors(grams, 0.8)
        signs = [re.compile(x.replace(licenses.GAP, r"[\W_]+")) for x in found]
        free = [g for g in grams if not any(x.search(g) for x in signs)]
        assert 2 * len(free) / (len(free) + len(grams)) < 0.8, text


def test_empty_and_native(spark):
    assert licenses.find_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = licenses.find_licenses(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Cartesian", "NestedLoop"))


def test_notices_inside_longer_units(spark):
    mit, gpl, mpl = template("Permission is"), template("This program", "GPL-3.0"), template("This Source")

    def comment(mark, text, width=9):
        words = text.split()
        return "\n".join(f"{mark} " + " ".join(words[k : k + width]) for k in range(0, len(words), width))

    code = "\nimport os\n" + "\n".join(f"value_{k} = compute(value_{k - 1}, {k})" for k in range(60))
    docs = [
        (1, "# Copyright 2020 Jane Doe\n#\n" + comment("#", mit) + code, "MIT"),
        (2, "/*\n * Widget\n *\n" + comment(" *", gpl) + "\n */" + code, "GPL-3.0"),
        (3, "This library was written by Jane Doe in 2020. Released under the MIT License.", "MIT"),
        (4, "word " * 255 + mpl + " more" * 700, "MPL-2.0"),
        (5, "word " * 3000 + "Licensed under CC BY-NC 4.0." + " more" * 10, "CC-BY-NC-4.0"),
        (6, "the license of the software was discussed under the terms of the meeting", None),
    ]
    rows = licenses.find_licenses(spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.license) for r in rows) == [(k, name) for k, _, name in docs if name]
    assert all(r.units == 1 and r.score >= 0.8 for r in rows)


def test_sibling_licences_are_told_apart(spark):
    bsd = template("Redistribution and") + "\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. "
    two, three = template("Redistributions in"), template("Neither")
    clause, disclaimer = two.split(" THIS SOFTWARE")[0], "\n\nTHIS SOFTWARE" + two.split(" THIS SOFTWARE")[1]
    docs = {name: text for name, text in licenses.TEMPLATES if not text.startswith("SPDX") and not name.startswith(("BSD-", "CC"))}
    cases = [(f"# {text}\ncode = 1", {name}) for name, text in docs.items()]
    cases += [("Some words before it. " + text.upper() + " And some words after it, too.", {name}) for name, text in docs.items()]
    cases += [(f"// {text}\n", {name}) for name, text in licenses.TEMPLATES if text.startswith("SPDX")]
    cases += [(bsd + clause + disclaimer, {"BSD", "BSD-2-Clause"}), (bsd + clause + "\n\n3. " + three + disclaimer, {"BSD", "BSD-3-Clause"})]
    cases += [("Licensed under the BSD License.", {"BSD"}), ("Released under the ISC License.", {"ISC"}), ("the GNU General Public License, version 2.", set())]
    found = {k: set() for k in range(len(cases))}
    frame = spark.createDataFrame([(k, text) for k, (text, _) in enumerate(cases)], "doc_id long, text string")
    for r in licenses.find_licenses(frame).collect():
        found[r.doc_id].add(r.license)
    assert [(cases[k][0], v) for k, v in found.items() if v != cases[k][1]] == []
