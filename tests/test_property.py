"""Conservation: nothing disappears without a trace.

Randomized headers (duplicates, blanks, unknown names, ragged rows, several
sheets, random choices and cancels). Every data row is merged, or belongs
to a cancelled file or an unmatched sheet; every non-null cell is placed in
a slot (directly or through an equal same-named column), or its column is
in the exception table, or its file/sheet was not merged.
"""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sheetmerge import MergePlan, model
from tests.golden import frames

NAMES = ["A", "B", "T", "U", None, "X"]
TEMPLATE = {"S1": ["表名", "A", "T", "T", "B"], "S2": ["表名", "U", "A"]}


def make_case(seed):
    rnd = random.Random(seed)
    sources, decisions = [], []
    for f in range(rnd.randint(1, 4)):
        file = f"f{f}.xlsx"
        for sheet in rnd.sample(["S1", "S2", "S3"], rnd.randint(1, 2)):
            header = [rnd.choice(NAMES) for _ in range(rnd.randint(1, 6))]
            while header and header[-1] is None:
                header.pop()
            data = []
            for r in range(rnd.randint(0, 7)):
                width = len(header) + rnd.choice([0, 0, 0, -1, 1, 2])
                vals = [rnd.choice(["1", "2", None]) for _ in range(max(width, 1))]
                while vals and vals[-1] is None:
                    vals.pop()
                if vals:
                    data.append(vals)
            sources.append((file, sheet, header, data))
            tcount = header.count("T")
            if tcount > 2 and rnd.random() < 0.7:
                t_cols = [i for i, n in enumerate(header) if n == "T"]
                for occ in (1, 2):
                    decisions.append((file, sheet, model.KIND_UNSELECTED, "T", rnd.choice(t_cols), occ, model.SELECT, None))
            if "X" in header and rnd.random() < 0.3:
                decisions.append((file, sheet, model.KIND_EXTRA, "X", header.index("X"), None, model.CANCEL_FILE, "x"))
    return sources, decisions


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(min_value=0, max_value=10**6))
def test_conservation(spark, seed):
    sources, decisions = make_case(seed)
    th, h, r, d = frames(spark, template=TEMPLATE, sources=sources, decisions=decisions)
    plan = MergePlan(spark, th, h, r, d, materialize=False)
    res = plan.result()

    cancelled = {x["file"] for x in res.cancelled.collect()}
    merged_rows = {(x["file"], x["sheet"], x["row_no"]) for x in res.merged_all.collect()}
    mapping = {(x["file"], x["sheet"]): list(x["m"]) for x in plan.mapping.collect()}
    rules = {(x["file"], x["sheet"], x["name"]): x["rule"] for x in plan.rules.collect()}
    letters = {}
    for x in res.exceptions.collect():
        letters.setdefault((x["file"], x["sheet"]), set()).add(x["col_pos"])

    from sheetmerge.plans.fixture_files import col_letters

    for file, sheet, header, data in sources:
        merged_sheet = sheet in TEMPLATE and file not in cancelled
        for row_no, vals in enumerate(data, start=1):
            assert ((file, sheet, row_no) in merged_rows) == merged_sheet
            if not merged_sheet:
                continue
            m = mapping[(file, sheet)]
            for i, v in enumerate(vals):
                if v is None:
                    continue
                name = header[i] if i < len(header) else None
                placed = i in m
                same_as_first = (
                    name is not None and rules.get((file, sheet, name)) == model.RULE_FILL_ALL
                )
                reported = col_letters(i) in letters.get((file, sheet), set())
                assert placed or same_as_first or reported, (file, sheet, row_no, i, name, header, m)
