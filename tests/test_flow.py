"""End to end from files: the golden example as real workbooks and a CSV."""

import csv

import os

import pytest

from sheetmerge import model
from sheetmerge.plans import flow
from sheetmerge.plans.fixture_files import XlsxWriter
from sheetmerge.session import checkpoint_dir, local_fs_path
from sheetmerge.sources import sink
from tests.golden import DECISIONS, SOURCES, TEMPLATE


def write_golden(d):
    books = {}
    for file, sheet, header, data in SOURCES:
        books.setdefault(file, []).append((sheet, header, data))
    for file, sheets in books.items():
        if file.endswith(".csv"):
            ((_, header, data),) = sheets
            with open(d / file, "w", encoding="utf-8", newline="") as fh:
                w = csv.writer(fh)
                for row in [header] + data:
                    w.writerow(["" if v is None else v for v in row])
            continue
        w = XlsxWriter(str(d / file))
        for sheet, header, data in sheets:
            w.start_sheet(sheet)
            for r, vals in enumerate([header] + data, start=1):
                w.row(r, vals)
        w.close()
    t = XlsxWriter(str(d / "大表.xlsx"))
    for sheet, names in TEMPLATE.items():
        t.start_sheet(sheet)
        t.row(1, names)
        t.row(2, ["template data rows are ignored"])
    t.close()
    (d / "~$小表1.xlsx").write_bytes(b"lock")
    # the answers live beside the source folder: any .csv inside it is a source
    with open(d.parent / "decisions.csv", "w", encoding="utf-8", newline="") as fh:
        w = csv.writer(fh)
        w.writerow([f.name for f in model.DECISIONS.fields])
        for row in DECISIONS:
            w.writerow(["" if v is None else v for v in row])


def test_merge_from_files_matches_the_golden_example(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    write_golden(src)
    dec_path = str(tmp_path / "decisions.csv")
    out = str(tmp_path / "out")
    res = flow.merge_files(
        spark, str(src / "大表.xlsx"), str(src), out, decisions=flow.read_decisions(spark, dec_path)
    )
    back = sink.read_result(spark, out)
    got = sorted((tuple(r) for r in back["NAME1"].collect()), key=repr)
    assert got == sorted(
        [
            ("小表1.xlsx", "a1", "1", "x1", "b1"),
            ("小表1.xlsx", "a2", "2", "x2", "b2"),
            ("小表2.xlsx", None, "5", "5", "b3"),
            ("小表2.xlsx", None, "6", "6", "b4"),
            ("小表3.xlsx", "a5", "1", "2", None),
            ("小表3.xlsx", "a6", "3", "4", None),
            ("小表3.xlsx", "a7", "5", "6", None),
        ],
        key=repr,
    )
    assert [tuple(r) for r in back["NAME2"].collect()] == [("小表3.xlsx", "a8", "c8")]
    ex = sorted(tuple(r) for r in sink.read_audit(spark, out, "exceptions").collect())
    assert ex == sorted(
        [
            ("小表1.xlsx", "NAME1", "-", "T", "C", "7,8", "同名列未选择", "drop"),
            ("小表2.xlsx", "NAME1", "-", "111", "D", "111,222", "列名不存在于大表", "drop"),
            ("小表3.xlsx", "NAME1", "全部行", "数据异常，无列名", "C", "v1,v2,v3", "无列名", "drop"),
            ("小表3.xlsx", "NAME1", "全部行", "-", "E", "45,67", "超表头列数", "truncate"),
            ("小表5.xlsx", "NAME1", "-", "Z", "B", "z1", "列名不存在于大表", "cancel_file"),
        ]
    )
    assert [tuple(r) for r in sink.read_audit(spark, out, "cancelled").collect()] == [("小表5.xlsx", "unexpected column Z")]
    assert [tuple(r) for r in res.unmatched.collect()] == [("小表4.csv", "Sheet1")]


def test_detect_then_choose_subset_from_the_command_line(spark, tmp_path):
    from sheetmerge.__main__ import main

    src = tmp_path / "src"
    src.mkdir()
    write_golden(src)
    out = tmp_path / "detect"
    assert main(["detect", "--template", str(src / "大表.xlsx"), "--sources", str(src), "--out", str(out)]) == 0
    needed = spark.read.option("header", True).csv(str(out / "choices_needed")).collect()
    assert sorted((r["file"], r["name"], r["t_occ"]) for r in needed) == [("小表1.xlsx", "T", "1"), ("小表1.xlsx", "T", "2")]
    res = flow.merge_files(spark, str(src / "大表.xlsx"), str(src), chosen=["小表3.xlsx"])
    assert {r["表名"] for r in res.sheets["NAME1"].collect()} == {"小表3.xlsx"}


def test_merge_command_writes_the_result_folder(spark, tmp_path):
    from sheetmerge.__main__ import main

    src = tmp_path / "src"
    src.mkdir()
    write_golden(src)
    out = tmp_path / "result"
    argv = ["merge", "--template", str(src / "大表.xlsx"), "--sources", str(src), "--out", str(out),
            "--decisions", str(tmp_path / "decisions.csv"), "--format", "csv"]
    assert main(argv) == 0
    back = sink.read_result(spark, str(out), fmt="csv")
    first_sheet = sorted((out / "sheets" / "00000").glob("*.csv"))
    assert "".join(p.read_text(encoding="utf-8") for p in first_sheet).splitlines()[0] == "表名,A,T,T,B"
    assert back["NAME1"].count() == 7 and back["NAME2"].count() == 1
    cancelled = sink.read_audit(spark, str(out), "cancelled", fmt="csv").collect()
    assert [tuple(r) for r in cancelled] == [("小表5.xlsx", "unexpected column Z")]


def test_a_run_that_fails_leaves_no_result_and_one_that_ends_leaves_no_landings(spark, tmp_path, monkeypatch):
    src = tmp_path / "src"
    src.mkdir()
    write_golden(src)
    out = str(tmp_path / "out")
    shared = local_fs_path(checkpoint_dir(spark))

    def landed():
        return {n for n in os.listdir(shared) if n.startswith("sheetmerge-")} if os.path.isdir(shared) else set()

    before, plain = landed(), sink.run_concurrently

    def killed(actions, *how):
        plain(actions[:2], *how)
        raise RuntimeError("killed")

    monkeypatch.setattr(sink, "run_concurrently", killed)
    with pytest.raises(RuntimeError, match="killed"):
        flow.merge_files(spark, str(src / "大表.xlsx"), str(src), out)
    for read in (lambda: sink.read_result(spark, out), lambda: sink.read_audit(spark, out, "exceptions")):
        with pytest.raises(FileNotFoundError):
            read()
    (left,) = landed() - before
    assert left.startswith("sheetmerge-run-")
    monkeypatch.setattr(sink, "run_concurrently", plain)
    monkeypatch.setattr(sink, "_publish", lambda *_: None)  # killed before it is published
    with pytest.raises(FileNotFoundError):
        flow.merge_files(spark, str(src / "大表.xlsx"), str(src), out)
    monkeypatch.undo()
    between = landed()
    res = flow.merge_files(spark, str(src / "大表.xlsx"), str(src), out)
    assert landed() == between
    assert not [n for n in os.listdir(out) if n.startswith("_staging")]
    assert res.sheets["NAME1"].count() > 0 and res.cancelled.count() == 0 and res.merged_all is None
    with pytest.raises(FileExistsError):
        sink.write_result(res, out)
    report = flow.detect_files(spark, str(src / "大表.xlsx"), str(src), str(tmp_path / "detect"))
    assert landed() == between and report.choices_needed.count() == 2
