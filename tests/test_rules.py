"""The three-step duplicate rule (the reference's four unit tests, plus the short case)."""

import pytest

from pyspark.sql import functions as F

from sheetmerge import MergePlan, merge_tables, model
from tests.golden import frames


def srt(rows):
    return sorted(rows, key=repr)


def run(spark, header, data, template=("表名", "T", "T"), decisions=()):
    th, h, r, d = frames(
        spark,
        template={"S": list(template)},
        sources=[("f.xlsx", "S", header, data)],
        decisions=list(decisions),
    )
    res = merge_tables(spark, th, h, r, d)
    return srt(tuple(x)[1:] for x in res.sheets["S"].collect()), res


def test_step1_equal_values_fill_every_slot(spark):
    got, res = run(spark, ["T", "T", "T"], [["1", "1", "1"], [None, None, None]])
    assert got == srt([("1", "1"), (None, None)])
    assert res.exceptions.count() == 0


def test_step2_equal_counts_in_order(spark):
    got, _ = run(spark, ["T", "T"], [["1", "2"], ["3", "4"]])
    assert got == [("1", "2"), ("3", "4")]


def test_step3_more_sources_take_the_choice(spark):
    dec = [
        ("f.xlsx", "S", model.KIND_UNSELECTED, "T", 2, 1, model.SELECT, None),
        ("f.xlsx", "S", model.KIND_UNSELECTED, "T", 0, 2, model.SELECT, None),
    ]
    got, res = run(spark, ["T", "T", "T"], [["a", "b", "c"]], decisions=dec)
    assert got == [("c", "a")]
    ex = [tuple(x) for x in res.exceptions.select("col_pos", "kind", "sample_values").collect()]
    assert ex == [("B", model.KIND_UNSELECTED, "b")]


def test_step3_without_choice_leaves_slots_empty_and_logs_all(spark):
    got, res = run(spark, ["T", "T", "T"], [["a", "b", "c"]])
    assert got == [(None, None)]
    assert sorted(r["col_pos"] for r in res.exceptions.collect()) == ["A", "B", "C"]


def test_short_case_fills_first_slots(spark):
    got, res = run(spark, ["T", "T"], [["a", "b"]], template=("表名", "T", "T", "T"))
    assert got == [("a", "b", None)]
    assert res.exceptions.count() == 0


def test_single_source_column_fills_all_slots(spark):
    got, _ = run(spark, ["T"], [["a"]])
    assert got == [("a", "a")]


def test_null_equals_null_but_not_a_value(spark):
    got, _ = run(spark, ["T", "T"], [["a", "a"], [None, "x"]])
    assert got == srt([("a", "a"), (None, "x")])  # not equal -> in order


def test_policy_fail_raises_on_unresolved(spark):
    import pytest

    th, h, r, d = frames(spark, template={"S": ["表名", "A"]}, sources=[("f.xlsx", "S", ["A", "Z"], [["1", "2"]])], decisions=[])
    with pytest.raises(ValueError):
        merge_tables(spark, th, h, r, d, policy="fail")
    ok = merge_tables(spark, th, h, r, d, policy={model.KIND_EXTRA: model.DROP})
    assert ok.exceptions.count() == 1


def test_template_without_source_name_column_is_rejected(spark):
    import pytest

    th, h, r, d = frames(spark, template={"S": ["A", "B"]}, sources=[("f.xlsx", "S", ["A"], [["1"]])], decisions=[])
    with pytest.raises(ValueError):
        merge_tables(spark, th, h, r, d)


def _three_kinds(spark, decisions):
    sources = [
        ("a.xlsx", "S", ["A", "Z"], [["1", "z", "over"]]),
        ("b.xlsx", "S", ["A", "Y", "X"], [["2", "y", "x"]]),
        ("c.xlsx", "S", ["A"], [["3"]]),
    ]
    return frames(spark, template={"S": ["表名", "A"]}, sources=sources, decisions=decisions)


def test_a_policy_that_cancels_removes_the_rows_and_lists_the_file(spark):
    th, h, r, d = _three_kinds(spark, [])
    res = merge_tables(spark, th, h, r, d, policy={model.KIND_OVERFLOW: model.CANCEL_FILE})
    assert sorted(x["表名"] for x in res.sheets["S"].collect()) == ["b.xlsx", "c.xlsx"]
    assert [tuple(x) for x in res.cancelled.collect()] == [("a.xlsx", model.KIND_OVERFLOW)]
    ops = {(x["file"], x["kind"]): x["operation"] for x in res.exceptions.collect()}
    assert ops == {
        ("a.xlsx", model.KIND_OVERFLOW): model.CANCEL_FILE,
        ("a.xlsx", model.KIND_EXTRA): model.CANCEL_FILE,
        ("b.xlsx", model.KIND_EXTRA): model.DROP,
    }


def test_a_decision_for_one_column_overrides_a_cancelling_policy(spark):
    th, h, r, d = _three_kinds(spark, [("b.xlsx", "S", model.KIND_EXTRA, None, None, None, model.DROP, None)])
    res = merge_tables(spark, th, h, r, d, policy={model.KIND_EXTRA: model.CANCEL_FILE})
    assert sorted(x["表名"] for x in res.sheets["S"].collect()) == ["b.xlsx", "c.xlsx"]
    assert [x["file"] for x in res.cancelled.collect()] == ["a.xlsx"]


def test_policy_fail_takes_an_answer_for_all_columns_of_a_kind(spark):
    answers = [
        ("a.xlsx", "S", model.KIND_EXTRA, None, None, None, model.DROP, None),
        ("a.xlsx", "S", model.KIND_OVERFLOW, None, None, None, model.TRUNCATE, None),
        ("b.xlsx", "S", model.KIND_EXTRA, None, None, None, model.DROP, None),
    ]
    th, h, r, d = _three_kinds(spark, answers)
    assert merge_tables(spark, th, h, r, d, policy="fail").sheets["S"].count() == 3
    th, h, r, d = _three_kinds(spark, answers[:2])
    with pytest.raises(ValueError):
        merge_tables(spark, th, h, r, d, policy="fail")


def test_policy_fail_accepts_a_full_choice_and_rejects_an_open_slot(spark):
    sources = [("f.xlsx", "S", ["T", "T", "T"], [["1", "2", "3"]])]
    chosen = [("f.xlsx", "S", model.KIND_UNSELECTED, "T", k, k + 1, model.SELECT, None) for k in (0, 1)]
    for decisions, good in ((chosen, True), (chosen[:1], False), ([], False)):
        th, h, r, d = frames(spark, template={"S": ["表名", "T", "T"]}, sources=sources, decisions=decisions)
        if good:
            res = merge_tables(spark, th, h, r, d, policy="fail")
            assert [tuple(x) for x in res.sheets["S"].collect()] == [("f.xlsx", "1", "2")]
            assert [x["operation"] for x in res.exceptions.collect()] == [model.DROP]
        else:
            with pytest.raises(ValueError):
                merge_tables(spark, th, h, r, d, policy="fail")


def test_a_file_that_could_not_be_read_is_listed(spark):
    th, h, r, d = _three_kinds(spark, [])
    failed = spark.createDataFrame([("bad.xlsx", "BadZipFile: not a zip")], model.CANCELLED)
    res = merge_tables(spark, th, h, r, d, failed=failed)
    assert [tuple(x) for x in res.cancelled.collect()] == [("bad.xlsx", "BadZipFile: not a zip")]
    assert res.sheets["S"].count() == 3


def test_the_column_map_equals_the_slots_of_the_grid(spark):
    """The map gathered from filled slots against every slot of every sheet laid out, on the fixtures and the golden example."""
    from sheetmerge.operators import resolve
    from sheetmerge.plans.fixtures import frames as fixture_frames
    from tests.golden import frames as golden_frames

    inputs = [golden_frames(spark)]
    for name in ("customer", "three"):
        f = fixture_frames(spark, "/root/testdata/sf0.001", name)
        inputs.append((f.template_headers, f.headers, f.rows, f.decisions))
    for th, h, r, d in inputs:
        plan = MergePlan(spark, th, h, r, d)
        want = resolve.build_mapping(plan.assignment)
        got = {(x["file"], x["sheet"]): list(x["m"]) for x in plan.mapping_all.collect()}
        assert got == {(x["file"], x["sheet"]): list(x["m"]) for x in want.collect()} and got
        assert any(c is None for m in got.values() for c in m[1:])
    m = resolve.column_map(plan.occurrence, plan.template_headers, F.broadcast(plan.rules), F.broadcast(plan.choices), plan.matched)
    text = m._jdf.queryExecution().sparkPlan().toString()
    assert text.count("SortMergeJoin") == 0 and text.count("Explode") + text.count("Generate") == 0
