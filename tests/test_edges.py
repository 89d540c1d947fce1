
from sheetmerge import MergePlan, merge_tables, model
from tests.golden import frames


def srt(rows):
    return sorted(rows, key=repr)


def merged(res, sheet):
    return srt(tuple(r) for r in res.sheets[sheet].collect())


def test_choice_pointing_at_another_name_is_ignored(spark):
    dec = [("f.xlsx", "S", model.KIND_UNSELECTED, "T", 1, 1, model.SELECT, None)]  # col 1 is 'U'
    th, h, r, d = frames(
        spark, template={"S": ["表名", "T"]}, sources=[("f.xlsx", "S", ["T", "U", "T"], [["a", "u", "b"]])], decisions=dec
    )
    res = merge_tables(spark, th, h, r, d)
    assert merged(res, "S") == [("f.xlsx", None)]
    kinds = srt((x["kind"], x["col_pos"]) for x in res.exceptions.collect())
    assert kinds == srt([(model.KIND_EXTRA, "B"), (model.KIND_UNSELECTED, "A"), (model.KIND_UNSELECTED, "C")])


def test_cancel_decision_for_an_absent_file_cancels_nothing(spark):
    dec = [("ghost.xlsx", "S", model.KIND_EXTRA, "Z", 1, None, model.CANCEL_FILE, "gone")]
    th, h, r, d = frames(spark, template={"S": ["表名", "A"]}, sources=[("f.xlsx", "S", ["A"], [["1"]])], decisions=dec)
    res = merge_tables(spark, th, h, r, d)
    assert res.cancelled.count() == 0
    assert merged(res, "S") == [("f.xlsx", "1")]


def test_blank_and_case_different_template_names(spark):
    th, h, r, d = frames(
        spark,
        template={"S": ["表名", "T", None, "t"]},
        sources=[("f.xlsx", "S", ["t", "T"], [["lower", "upper"]])],
        decisions=[],
    )
    res = merge_tables(spark, th, h, r, d)
    assert res.sheets["S"].columns == ["表名", "T", "_c2", "t__2"]
    assert merged(res, "S") == [("f.xlsx", "upper", None, "lower")]
    assert res.exceptions.count() == 0


def test_source_name_column_in_a_source_is_ignored(spark):
    th, h, r, d = frames(
        spark, template={"S": ["表名", "A"]}, sources=[("f.xlsx", "S", ["表名", "A"], [["other.xlsx", "1"]])], decisions=[]
    )
    res = merge_tables(spark, th, h, r, d)
    assert merged(res, "S") == [("f.xlsx", "1")]
    assert res.exceptions.count() == 0


def test_unmatched_sheet_is_reported_but_not_audited(spark):
    th, h, r, d = frames(
        spark, template={"S": ["表名", "A"]}, sources=[("f.xlsx", "X", ["A", None, "Z"], [["1", "2", "3", "4"]])], decisions=[]
    )
    res = merge_tables(spark, th, h, r, d)
    assert [tuple(x) for x in res.unmatched.collect()] == [("f.xlsx", "X")]
    assert res.exceptions.count() == 0 and res.sheets["S"].count() == 0


def test_header_without_names_makes_every_value_overflow(spark):
    th, h, r, d = frames(
        spark, template={"S": ["表名", "A"]}, sources=[("f.xlsx", "S", [None, None], [["1", "2"], ["3"]])], decisions=[]
    )
    res = merge_tables(spark, th, h, r, d)
    got = srt((x["kind"], x["col_pos"], x["sample_values"]) for x in res.exceptions.collect())
    assert got == [(model.KIND_OVERFLOW, "A", "1,3"), (model.KIND_OVERFLOW, "B", "2")]
    assert merged(res, "S") == [("f.xlsx", None), ("f.xlsx", None)]


def test_samples_take_rows_one_to_five_only(spark):
    data = [[str(i), f"z{i}"] for i in range(1, 9)]
    th, h, r, d = frames(spark, template={"S": ["表名", "A"]}, sources=[("f.xlsx", "S", ["A", "Z"], data)], decisions=[])
    (x,) = merge_tables(spark, th, h, r, d).exceptions.collect()
    assert x["sample_values"] == "z1,z2,z3,z4,z5"


def test_plan_without_materializing_gives_the_same_result(spark):
    th, h, r, d = frames(spark)
    lazy = MergePlan(spark, th, h, r, d, materialize=False).result()
    landed = MergePlan(spark, th, h, r, d).result()
    for name in ("exceptions", "cancelled", "missing", "unmatched"):
        assert srt(map(tuple, getattr(lazy, name).collect())) == srt(map(tuple, getattr(landed, name).collect()))
    assert merged(lazy, "NAME1") == merged(landed, "NAME1")


def test_no_broadcast_path_gives_the_same_result(spark):
    th, h, r, d = frames(spark)
    small = MergePlan(spark, th, h, r, d).result()
    big = MergePlan(spark, th, h, r, d, max_broadcast_bytes=0).result()
    assert merged(small, "NAME1") == merged(big, "NAME1")
    assert srt(map(tuple, small.exceptions.collect())) == srt(map(tuple, big.exceptions.collect()))


def test_wide_templates_are_aligned_alike(spark, monkeypatch):
    from sheetmerge.operators import merge

    th, h, r, d = frames(spark)
    narrow = merge_tables(spark, th, h, r, d)
    monkeypatch.setattr(merge, "WIDE", 1)
    wide = merge_tables(spark, th, h, r, d)
    for sheet, df in narrow.sheets.items():
        assert wide.sheets[sheet].schema == df.schema
        assert [f.metadata for f in wide.sheets[sheet].schema.fields] == [f.metadata for f in df.schema.fields]
        assert merged(wide, sheet) == merged(narrow, sheet) and "slots" in wide.sheets[sheet]._jdf.queryExecution().toString()
    assert srt(map(tuple, wide.merged_all.collect())) == srt(map(tuple, narrow.merged_all.collect()))


def test_a_template_of_3000_columns(spark):
    n = 3000
    names = [None if k % 1000 == 7 else f"n`{k}" for k in range(n)]
    th, h, r, d = frames(
        spark,
        template={"S": ["表名", *names[1:]]},
        sources=[("f.xlsx", "S", names[:0:-1], [[str(k) for k in range(n - 1, 0, -1)], ["x"]])],
        decisions=[],
    )
    sheet = merge_tables(spark, th, h, r, d).sheets["S"]
    assert len(sheet.columns) == n and sheet.columns[1] == "n`1" and sheet.columns[7] == "_c7"
    rows = sorted((tuple(x) for x in sheet.collect()), key=lambda x: str(x[1]))
    assert rows[1] == ("f.xlsx", *([None] * (n - 2)), "x")
    assert rows[0] == ("f.xlsx", *(None if names[k] is None else str(k) for k in range(1, n)))
