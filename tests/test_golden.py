from sheetmerge import merge_tables
from tests.golden import frames


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_golden_merge(spark):
    th, headers, rows, dec = frames(spark)
    res = merge_tables(spark, th, headers, rows, dec)
    assert res.sheets["NAME1"].columns == ["表名", "A", "T", "T__2", "B"]
    assert rows_of(res.sheets["NAME1"]) == sorted(
        [
            ("小表1.xlsx", "a1", "1", "x1", "b1"),
            ("小表1.xlsx", "a2", "2", "x2", "b2"),
            ("小表2.xlsx", None, "5", "5", "b3"),
            ("小表2.xlsx", None, "6", "6", "b4"),
            ("小表3.xlsx", "a5", "1", "2", None),
            ("小表3.xlsx", "a6", "3", "4", None),
            ("小表3.xlsx", "a7", "5", "6", None),
        ]
    )
    assert rows_of(res.sheets["NAME2"]) == [("小表3.xlsx", "a8", "c8")]
    assert rows_of(res.exceptions) == sorted(
        [
            ("小表1.xlsx", "NAME1", "-", "T", "C", "7,8", "同名列未选择", "drop"),
            ("小表2.xlsx", "NAME1", "-", "111", "D", "111,222", "列名不存在于大表", "drop"),
            ("小表3.xlsx", "NAME1", "全部行", "数据异常，无列名", "C", "v1,v2,v3", "无列名", "drop"),
            ("小表3.xlsx", "NAME1", "全部行", "-", "E", "45,67", "超表头列数", "truncate"),
            ("小表5.xlsx", "NAME1", "-", "Z", "B", "z1", "列名不存在于大表", "cancel_file"),
        ]
    )
    assert rows_of(res.missing) == sorted(
        [
            ("小表2.xlsx", "NAME1", "A"),
            ("小表3.xlsx", "NAME1", "B"),
            ("小表5.xlsx", "NAME1", "B"),
            ("小表5.xlsx", "NAME1", "T"),
        ]
    )
    assert rows_of(res.unmatched) == [("小表4.csv", "Sheet1")]
    assert rows_of(res.cancelled) == [("小表5.xlsx", "unexpected column Z")]


def test_golden_csv_sheet_merges_when_template_has_it(spark):
    from tests.golden import TEMPLATE

    template = dict(TEMPLATE, Sheet1=["表名", "A"])
    th, headers, rows, dec = frames(spark, template=template)
    res = merge_tables(spark, th, headers, rows, dec)
    assert rows_of(res.sheets["Sheet1"]) == [("小表4.csv", "a9")]
    assert res.unmatched.count() == 0
