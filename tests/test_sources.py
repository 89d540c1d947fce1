"""File themes: CSV quirks, exact file names, lock files, sparse xlsx, batches."""

import zipfile

import pytest
from pyspark.sql import functions as F

from sheetmerge import merge_tables, model
from sheetmerge.plans.fixture_files import XlsxWriter
from sheetmerge.sources import csv as csv_source, listing, sink, xlsx


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))


def template_df(spark, layout):
    return spark.createDataFrame(
        [(s, i, n) for s, names in layout.items() for i, n in enumerate(names)], model.TEMPLATE_HEADERS
    )


def test_csv_ragged_duplicate_blank_header(spark, tmp_path):
    write(tmp_path / "t.csv", "T,U,T,,V\n1,2\n1,2,3,4,5\n1,2,3,4,5,6,7\n")
    headers, rows = csv_source.scan_csv(spark, str(tmp_path))
    assert [r["name"] for r in headers.orderBy("col_idx").collect()] == ["T", "U", "T", None, "V"]
    got = {r["row_no"]: list(r["vals"]) for r in rows.collect()}
    assert got == {1: ["1", "2"], 2: ["1", "2", "3", "4", "5"], 3: ["1", "2", "3", "4", "5", "6", "7"]}

    th = template_df(spark, {"Sheet1": ["表名", "T", "U", "V"]})
    res = merge_tables(spark, th, headers, rows)
    ex = sorted((r["kind"], r["col_pos"], r["sample_values"], r["operation"]) for r in res.exceptions.collect())
    assert ex == sorted(
        [
            (model.KIND_BLANK, "D", "4,4", model.DROP),
            (model.KIND_OVERFLOW, "F", "6", model.TRUNCATE),
            (model.KIND_OVERFLOW, "G", "7", model.TRUNCATE),
            (model.KIND_UNSELECTED, "A", "1,1,1", model.DROP),
            (model.KIND_UNSELECTED, "C", "3,3", model.DROP),
        ]
    )
    merged = sorted((tuple(r) for r in res.sheets["Sheet1"].collect()), key=repr)
    assert merged == sorted([("t.csv", None, "2", None), ("t.csv", None, "2", "5"), ("t.csv", None, "2", "5")], key=repr)


def test_csv_quotes_and_line_breaks(spark, tmp_path):
    write(tmp_path / "q.csv", 'A,B\n"x,""q""","a\nb"\nplain,2\n')
    headers, rows = csv_source.scan_csv(spark, str(tmp_path))
    got = sorted((r["row_no"], tuple(r["vals"])) for r in rows.collect())
    assert got == [(1, ('x,"q"', "a\nb")), (2, ("plain", "2"))]


def test_csv_wider_record_than_any_line_is_not_cut(spark, tmp_path):
    write(tmp_path / "w.csv", 'A\n"1\n",2,"3\n",4,"5\n",6\n')
    _, rows = csv_source.scan_csv(spark, str(tmp_path))
    (r,) = rows.collect()
    assert list(r["vals"]) == ["1\n", "2", "3\n", "4", "5\n", "6"]


def test_csv_bom_and_chinese(spark, tmp_path):
    write(tmp_path / "中文.csv", "﻿名称,数量\n苹果,3\n")
    headers, rows = csv_source.scan_csv(spark, str(tmp_path))
    assert [r["name"] for r in headers.orderBy("col_idx").collect()] == ["名称", "数量"]
    assert [r["file"] for r in rows.collect()] == ["中文.csv"]


def test_exact_file_names_despite_globs_and_encoding(spark, tmp_path):
    names = ["表[1].csv", "表1.csv", "a b{x,y}.csv", "p+q.csv", "100%.csv"]
    for i, n in enumerate(names):
        write(tmp_path / n, f"A\nv{i}\n")
    src = listing.list_sources(spark, str(tmp_path))
    assert sorted(r["file"] for r in src.collect()) == sorted(names)
    headers, rows = csv_source.scan_csv(spark, str(tmp_path), src)
    th = template_df(spark, {"Sheet1": ["表名", "A"]})
    got = sorted(tuple(r) for r in merge_tables(spark, th, headers, rows).sheets["Sheet1"].collect())
    assert got == sorted((n, f"v{i}") for i, n in enumerate(names))
    only = listing.select_sources(src, spark.createDataFrame([("表[1].csv",)], "file string"))
    _, rows1 = csv_source.scan_csv(spark, str(tmp_path), only)
    assert [r["file"] for r in rows1.collect()] == ["表[1].csv"]
    inverted = listing.select_sources(src, spark.createDataFrame([("表[1].csv",)], "file string"), invert=True)
    assert inverted.count() == 4


def test_listing_skips_lock_files_xls_and_other_files(spark, tmp_path):
    for n in ["~$a.xlsx", "b.xls", "c.txt", "_u.csv", "d.csv", "E.XLSX"]:
        write(tmp_path / n, "A\n1\n")
    w = XlsxWriter(str(tmp_path / "a.xlsx"))
    w.start_sheet("S")
    w.row(1, ["A"])
    w.close()
    got = sorted((r["file"], r["format"]) for r in listing.list_sources(spark, str(tmp_path)).collect())
    # '_u.csv' is hidden by Spark's file lister; '.XLSX' is not the lower-case extension
    assert got == [("a.xlsx", "xlsx"), ("d.csv", "csv")]
    assert listing.list_sources(spark, str(tmp_path), skip_lock_files=False).where(
        F.col("file").startswith("~$")
    ).count() == 1


def _shared_strings_book(path):
    ct = (
        '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
        '<Default Extension="xml" ContentType="application/xml"/></Types>'
    )
    wb = (
        '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" '
        'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>'
        '<sheet name="NAME1" sheetId="1" r:id="rId7"/><sheet name="空表" sheetId="2" r:id="rId8"/></sheets></workbook>'
    )
    rels = (
        '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
        '<Relationship Id="rId7" Type="x" Target="worksheets/a.xml"/>'
        '<Relationship Id="rId8" Type="x" Target="/xl/worksheets/b.xml"/></Relationships>'
    )
    sst = (
        '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
        "<si><t>A</t></si><si><r><t>T</t></r><r><t>x</t></r></si><si><t>v</t><rPh><t>ignored</t></rPh></si></sst>"
    )
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    a = (
        f"<worksheet {ns}><sheetData>"
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row>'
        '<row r="2"><c r="A2"><v>45</v></c><c r="B2" t="s"><v>2</v></c><c r="C2" t="b"><v>1</v></c></row>'
        '<row r="4"><c r="D4" t="inlineStr"><is><t>far</t></is></c></row>'
        '<row r="5"><c r="A5" t="str"><v></v></c></row>'
        "</sheetData></worksheet>"
    )
    b = f"<worksheet {ns}><sheetData/></worksheet>"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("[Content_Types].xml", ct)
        z.writestr("xl/workbook.xml", wb)
        z.writestr("xl/_rels/workbook.xml.rels", rels)
        z.writestr("xl/sharedStrings.xml", sst)
        z.writestr("xl/worksheets/a.xml", a)
        z.writestr("xl/worksheets/b.xml", b)


def test_xlsx_sparse_cells_shared_strings_two_sheets(spark, tmp_path):
    _shared_strings_book(str(tmp_path / "book.xlsx"))
    headers, rows = xlsx.scan_workbooks(spark, str(tmp_path))
    assert sorted((r["sheet"], r["col_idx"], r["name"]) for r in headers.collect()) == [
        ("NAME1", 0, "A"), ("NAME1", 1, None), ("NAME1", 2, "Tx"), ("空表", 0, None)
    ]
    got = sorted((r["row_no"], tuple(r["vals"])) for r in rows.collect())
    assert got == [(1, ("45", "v", "TRUE")), (3, (None, None, None, "far"))]


def test_twenty_workbooks_two_sheets_merge(spark, tmp_path):
    for i in range(20):
        w = XlsxWriter(str(tmp_path / f"小表{i}.xlsx"))
        w.start_sheet("NAME1")
        w.row(1, ["B", "A"])
        for k in range(1, 4):
            w.row(k + 1, [f"b{i}.{k}", f"a{i}.{k}"])
        w.start_sheet("NAME2")
        w.row(1, ["C"])
        w.row(2, [f"c{i}"])
        w.close()
    headers, rows = xlsx.scan_workbooks(spark, str(tmp_path), listing.list_sources(spark, str(tmp_path)))
    th = template_df(spark, {"NAME1": ["表名", "A", "B"], "NAME2": ["表名", "C"]})
    res = merge_tables(spark, th, headers, rows)
    n1 = res.sheets["NAME1"]
    assert n1.count() == 60
    assert n1.where(F.col("A") == "a7.2").select("表名", "B").collect()[0] == ("小表7.xlsx", "b7.2")
    assert res.sheets["NAME2"].count() == 20
    out = str(tmp_path / "out")
    sink.write_result(res, out, fmt="csv")
    back = sink.read_result(spark, out, fmt="csv")
    assert back["NAME1"].count() == 60 and back["NAME1"].columns == ["表名", "A", "B"]


def test_csv_sink_keeps_duplicate_template_names(spark, tmp_path):
    from tests.golden import frames

    th, h, r, d = frames(spark)
    res = merge_tables(spark, th, h, r, d)
    out = str(tmp_path / "res")
    sink.write_result(res, out, fmt="csv")
    lines = "".join(p.read_text(encoding="utf-8") for p in sorted((tmp_path / "res" / "sheets" / "00000").glob("*.csv")))
    assert lines.splitlines()[0] == "表名,A,T,T,B"
    sink.write_result(res, str(tmp_path / "pq"))
    back = sink.read_result(spark, str(tmp_path / "pq"))
    assert back["NAME1"].columns == ["表名", "A", "T", "T__2", "B"] and back["NAME1"].count() == 7
    assert sink.read_audit(spark, str(tmp_path / "pq"), "exceptions").count() == 5


def test_csv_record_wider_than_the_sampled_bound_is_read_again_wider(spark, tmp_path):
    record = ",".join(['"v%d\n"' % i for i in range(10)]) + ",end"
    write(tmp_path / "deep.csv", "A\n" + record + "\n")
    _, rows = csv_source.scan_csv(spark, str(tmp_path))
    (r,) = rows.collect()
    assert list(r["vals"]) == [f"v{i}\n" for i in range(10)] + ["end"]


def test_numeric_looking_sheet_names_stay_text(spark, tmp_path):
    w = XlsxWriter(str(tmp_path / "n.xlsx"))
    for name in ("01", "2024"):
        w.start_sheet(name)
        w.row(1, ["A"])
        w.row(2, [f"v{name}"])
    w.close()
    headers, rows = xlsx.scan_workbooks(spark, str(tmp_path))
    assert sorted((r["sheet"], tuple(r["vals"])) for r in rows.collect()) == [("01", ("v01",)), ("2024", ("v2024",))]
    th = template_df(spark, {"01": ["表名", "A"]})
    res = merge_tables(spark, th, headers, rows)
    assert [tuple(r) for r in res.sheets["01"].collect()] == [("n.xlsx", "v01")]


def test_big_csv_files_split_unless_they_hold_quoted_line_breaks(spark, tmp_path):
    clean = "A,B\n" + "".join(f"{i},x{i}\n" for i in range(3000))
    dirty = 'A,B\n"first\nline",1\n' + "".join(f"{i},y{i}\n" for i in range(3000))
    write(tmp_path / "clean.csv", clean)
    write(tmp_path / "dirty.csv", dirty)
    write(tmp_path / "small.csv", 'A,B\n"s\nt",2\n')
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    spark.conf.set(key, "4096")
    try:
        headers, rows = csv_source.scan_csv(spark, str(tmp_path))
        got = {(r["file"], r["row_no"]): list(r["vals"]) for r in rows.collect()}
    finally:
        spark.conf.set(key, old)
    assert len(got) == 3000 + 3001 + 1
    assert got[("clean.csv", 1)] == ["0", "x0"] and got[("clean.csv", 3000)] == ["2999", "x2999"]
    assert got[("dirty.csv", 1)] == ["first\nline", "1"] and got[("dirty.csv", 3001)] == ["2999", "y2999"]
    assert got[("small.csv", 1)] == ["s\nt", "2"]
    assert sorted((r["file"], r["col_idx"], r["name"]) for r in headers.collect()) == [
        ("clean.csv", 0, "A"), ("clean.csv", 1, "B"), ("dirty.csv", 0, "A"), ("dirty.csv", 1, "B"),
        ("small.csv", 0, "A"), ("small.csv", 1, "B"),
    ]


def test_csv_late_wide_record_with_an_empty_cell_where_the_widest_ended(spark, tmp_path):
    write(tmp_path / "late.csv", "A,B\n" + "1,2\n" * 10_050 + "1,2,,,,,LOST,ALSO\n")
    headers, rows = csv_source.scan_csv(spark, str(tmp_path))
    last = rows.where(F.col("row_no") == 10_051).collect()[0]
    assert list(last["vals"]) == ["1", "2", None, None, None, None, "LOST", "ALSO"]
    res = merge_tables(spark, template_df(spark, {"Sheet1": ["表名", "A", "B"]}), headers, rows)
    found = {(r["kind"], r["col_pos"]) for r in res.exceptions.collect()}
    assert found == {(model.KIND_OVERFLOW, "G"), (model.KIND_OVERFLOW, "H")}


HARD = [
    'A,B,C',
    '   ',
    '',
    '5","a',
    'b",6"',
    '"x,""q""","a',
    '',
    'b, c"d"',
    '"lone ""quotes"" here",2',
    '\ufeffBOM,"3"',
    'é漢字,"',
    '",""',
    ',,,',
    'a"b,"c',
    'd"tail,e',
    '"w","x","y","z"',
    'last,"one',
    'and "" two',
    'three",end',
]


def _python_rows(text):
    import csv as pycsv

    out = []
    for row in pycsv.reader([x + "\n" for x in text.split("\n")]):
        if row:
            cells = [c or None for c in row]
            while cells and cells[-1] is None:
                cells.pop()
            out.append(cells)
    return out


def test_csv_gives_equal_rows_at_any_split_size(spark, tmp_path):
    text = "\n".join(HARD * 7 + ["plain,%d" % k for k in range(300)] + HARD)
    write(tmp_path / "hard.csv", text)
    write(tmp_path / "plain.csv", "A,B\n" + "".join(f"{k},x\n" for k in range(400)))
    want = _python_rows(text)
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    for size in ("64b", "2048b", old):
        spark.conf.set(key, size)
        try:
            headers, rows = csv_source.scan_csv(spark, str(tmp_path))
            got = {(r["file"], r["row_no"]): list(r["vals"]) for r in rows.collect()}
            names = [(r["file"], r["name"]) for r in headers.orderBy("file", "col_idx").collect()]
        finally:
            spark.conf.set(key, old)
        assert names == [("hard.csv", "A"), ("hard.csv", "B"), ("hard.csv", "C"), ("plain.csv", "A"), ("plain.csv", "B")]
        assert {k[1]: v for k, v in got.items() if k[0] == "hard.csv"} == {n: v for n, v in enumerate(want) if n and v}
        assert {k[1]: v for k, v in got.items() if k[0] == "plain.csv"} == {n + 1: [str(n), "x"] for n in range(400)}


def test_csv_mark_is_dropped_at_the_start_of_a_file_only(spark, tmp_path):
    write(tmp_path / "m.csv", '\ufeff"A,1",B\n\ufeffx,2\n"a\n\ufeffb",\ufeff\n')
    headers, rows = csv_source.scan_csv(spark, str(tmp_path))
    assert [r["name"] for r in headers.orderBy("col_idx").collect()] == ["A,1", "B"]
    assert {r["row_no"]: list(r["vals"]) for r in rows.collect()} == {1: ["\ufeffx", "2"], 2: ["a\n\ufeffb", "\ufeff"]}


def test_csv_files_that_cannot_be_read_are_cancelled_with_a_reason(spark, tmp_path):
    plain = "A,B\n" + "1,2\n" * 50
    write(tmp_path / "good.csv", plain)
    write(tmp_path / "spans.csv", 'A,B\n"x\ny",2\n')
    write(tmp_path / "empty.csv", "")
    write(tmp_path / "blank.csv", "\n\r\n\n")
    (tmp_path / "latin.csv").write_bytes("A,B\ncaf\u00e9,1\n".encode("latin-1"))
    (tmp_path / "latin_open.csv").write_bytes('A,B\n"caf\u00e9,1\n'.encode("latin-1"))
    write(tmp_path / "open.csv", 'A,B\n1,2\n"never closed,3\n' + "4,5\n" * 5000)
    write(tmp_path / "short.csv", 'A,B\n"never closed,3\n4,5\n')
    write(tmp_path / "line.csv", "A,B\n" + "x" * 5000 + ",1\n")
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    for size in ("1024b", old):
        spark.conf.set(key, size)
        try:
            headers, rows, failed = csv_source.scan_csv_with_failures(spark, str(tmp_path), max_record_bytes=4000)
            reasons = {r["file"]: r["reason"] for r in failed.collect()}
            counts = {r["file"]: r["count"] for r in rows.groupBy("file").count().collect()}
            names = {r["file"] for r in headers.select("file").distinct().collect()}
        finally:
            spark.conf.set(key, old)
        start = "in the part from byte 0 on"
        assert reasons == {
            "empty.csv": "no record", "blank.csv": "no record", "latin.csv": f"not UTF-8, {start}", "latin_open.csv": f"not UTF-8, {start}",
            "open.csv": f"record longer than 4000 bytes, {start}", "line.csv": f"record longer than 4000 bytes, {start}",
        }
        assert counts == {"good.csv": 50, "spans.csv": 1, "short.csv": 1} and names == set(counts)
    only = spark.createDataFrame([("empty.csv",), ("good.csv",)], "file string")
    _, rows, failed = csv_source.scan_csv_with_failures(spark, str(tmp_path), only)
    assert rows.count() == 50 and [tuple(r) for r in failed.collect()] == [("empty.csv", "no record")]


def test_csv_templates_that_cannot_be_read_are_refused(spark, tmp_path):
    write(tmp_path / "t.csv", "")
    with pytest.raises(ValueError, match="no record"):
        xlsx.read_template(spark, str(tmp_path / "t.csv"))


def test_csv_of_sixteen_thousand_columns(spark, tmp_path):
    n = 16_384
    write(tmp_path / "wide.csv", ",".join(f"h{k}" for k in range(n)) + "\n" + ",".join(f'"v,{k}"' for k in range(n)) + "\n" + "x" + "," * (n - 1) + "\n")
    headers, rows = csv_source.scan_csv(spark, str(tmp_path))
    assert headers.count() == n
    got = {r["row_no"]: list(r["vals"]) for r in rows.collect()}
    assert got[1] == [f"v,{k}" for k in range(n)] and got[2] == ["x"]


def test_sheets_without_names_are_not_lost(spark, tmp_path):
    write(tmp_path / "blank.csv", ",,\n1,2\n3\n")
    w = XlsxWriter(str(tmp_path / "late.xlsx"))
    for name in ("Sheet1", "Other"):
        w.start_sheet(name)
        w.row(3, ["a", "b"])
    w.close()
    h1, r1 = csv_source.scan_csv(spark, str(tmp_path))
    h2, r2 = xlsx.scan_workbooks(spark, str(tmp_path))
    th = template_df(spark, {"Sheet1": ["表名", "A"]})
    res = merge_tables(spark, th, h1.unionByName(h2), r1.unionByName(r2))
    assert sorted((r["表名"], r["A"]) for r in res.sheets["Sheet1"].collect()) == [("blank.csv", None), ("blank.csv", None), ("late.xlsx", None)]
    assert sorted((r["file"], r["name"]) for r in res.missing.collect()) == [("blank.csv", "A"), ("late.xlsx", "A")]
    assert [tuple(r) for r in res.unmatched.collect()] == [("late.xlsx", "Other")]
    found = sorted((r["file"], r["kind"], r["col_pos"], r["sample_values"]) for r in res.exceptions.collect())
    assert found == [
        ("blank.csv", model.KIND_OVERFLOW, "A", "1,3"), ("blank.csv", model.KIND_OVERFLOW, "B", "2"),
        ("late.xlsx", model.KIND_OVERFLOW, "A", "a"), ("late.xlsx", model.KIND_OVERFLOW, "B", "b"),
    ]


def _strict(path):
    _shared_strings_book(path)
    with zipfile.ZipFile(path) as z:
        parts = {n: z.read(n).decode() for n in z.namelist()}
    swaps = (
        ("http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://purl.oclc.org/ooxml/spreadsheetml/main"),
        ("http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://purl.oclc.org/ooxml/officeDocument/relationships"),
    )
    with zipfile.ZipFile(path, "w") as z:
        for name, text in parts.items():
            for a, b in swaps:
                text = text.replace(a, b)
            if name.endswith("workbook.xml.rels"):
                text = text.replace("</Relationships>", '<Relationship Id="rId9" Type="http://x/sharedStrings" Target="texts/own.xml"/></Relationships>')
            z.writestr("xl/texts/own.xml" if name == "xl/sharedStrings.xml" else name, text)


def test_strict_workbook_and_unreadable_ones(spark, tmp_path):
    _strict(str(tmp_path / "strict.xlsx"))
    write(tmp_path / "broken.xlsx", "not a zip")
    with zipfile.ZipFile(tmp_path / "hollow.xlsx", "w") as z:
        z.writestr("x", "y")
    headers, rows, failed = xlsx.scan_workbooks_with_failures(spark, str(tmp_path))
    assert sorted((r["row_no"], tuple(r["vals"])) for r in rows.collect()) == [(1, ("45", "v", "TRUE")), (3, (None, None, None, "far"))]
    assert sorted(r["file"] for r in failed.collect()) == ["broken.xlsx", "hollow.xlsx"]
    assert all(r["reason"] for r in failed.collect())


def _book_of_sheets(path, sheets, n, shared=False):
    w = XlsxWriter(str(path))
    for name in sheets:
        w.start_sheet(name)
        w.row(1, ["A", None, "B"])
        for k in range(2, n + 2):
            w.row(k, [f"{name}.{k}", None, None, "<&>" * (k % 3), None])
    w.close()
    if shared:  # the same book with a table of shared strings, stored uncompressed
        with zipfile.ZipFile(path) as z:
            parts = {m: z.read(m) for m in z.namelist()}
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        parts["xl/sharedStrings.xml"] = f"<sst {ns}><si><t>A</t></si><si><r><t>B</t></r><r><t>b</t></r></si></sst>".encode()
        with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
            for m, data in parts.items():
                if m.startswith("xl/worksheets"):
                    data = data.replace(b'<c r="C1" t="inlineStr"><is><t xml:space="preserve">B</t></is></c>', b'<c r="C1" t="s"><v>1</v></c>')
                z.writestr(m, data)


def test_large_sheets_are_parsed_by_tasks_of_their_own(spark, tmp_path):
    names = [f"S{k}" for k in range(6)]
    _book_of_sheets(tmp_path / "big.xlsx", names, 300)
    _book_of_sheets(tmp_path / "stored.xlsx", names[:2], 200, shared=True)
    _book_of_sheets(tmp_path / "small.xlsx", names[:1], 2)
    write(tmp_path / "none.xlsx", "")

    def scan(**how):
        headers, rows, failed = xlsx.scan_workbooks_with_failures(spark, str(tmp_path), **how)
        cells = sorted((r["file"], r["sheet"], r["row_no"], tuple(r["vals"])) for r in rows.collect())
        return sorted(map(str, headers.collect())), cells, [tuple(r) for r in failed.collect()], rows

    whole = scan()
    assert len(whole[1]) == 6 * 300 + 2 * 200 + 2 and whole[2] == [("none.xlsx", "empty file")]
    assert any("Bb" in h for h in whole[0])
    dealt = scan(large_sheet=2000)
    assert dealt[:3] == whole[:3]
    spread = dealt[3].select(F.input_file_name().alias("f")).distinct().count()
    assert spread > 6  # a task a sheet wrote them
    target = tmp_path.parent / f"{tmp_path.name}-landed"
    some = scan(large_sheet=2000, sheets=["S1", "S4"], land_to=str(target))
    assert some[0] == whole[0] and some[1] == [c for c in whole[1] if c[1] in ("S1", "S4")]
    parts = {p.name for p in target.iterdir() if p.name.startswith("part=")}
    assert parts == {"part=h", "part=l", "part=d0", "part=d1"}  # no data rows of other sheets on disk


def test_a_damaged_large_sheet_cancels_its_file(spark, tmp_path):
    _book_of_sheets(tmp_path / "bad.xlsx", ["S"], 300)
    _book_of_sheets(tmp_path / "good.xlsx", ["S"], 300)
    with zipfile.ZipFile(tmp_path / "bad.xlsx") as z:
        parts = {m: z.read(m) for m in z.namelist()}
    with zipfile.ZipFile(tmp_path / "bad.xlsx", "w", zipfile.ZIP_DEFLATED) as z:
        for m, data in parts.items():
            z.writestr(m, data.replace(b"</sheetData>", b"</wrong>"))
    _, rows, failed = xlsx.scan_workbooks_with_failures(spark, str(tmp_path), large_sheet=2000)
    assert rows.where("file = 'good.xlsx'").count() == 300
    ((file, reason),) = [tuple(r) for r in failed.collect()]
    assert file == "bad.xlsx" and reason.startswith("ParseError")


def test_csv_small_splits_share_tasks_and_landed_parts(spark, tmp_path):
    import glob

    text = "k,v\n" + "".join(f'{i},"say ""{i}"", then\n\n{i},"\n' for i in range(20_000))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(text, encoding="utf-8")
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    spark.conf.set(key, "2048")
    try:
        headers, rows, failed = csv_source.scan_csv_with_failures(spark, str(tmp_path / "in"), land_to=str(tmp_path / "cells"))
        assert spark.conf.get(key) == "2048"
    finally:
        spark.conf.set(key, old)
    parts = len(glob.glob(f"{tmp_path}/cells/part-*.parquet"))
    assert len(text) // 2048 > 5 * csv_source.TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    assert 1 < parts <= csv_source.TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    assert {(r["row_no"], *r["vals"]) for r in rows.collect()} == {
        (i + 1, str(i), f'say "{i}", then\n\n{i},') for i in range(20_000)
    }
    assert headers.count() == 2 and failed.count() == 0


def test_csv_sizes_and_open_values():
    import csv
    import random

    assert [csv_source._in_bytes(x) for x in ("2048", "64k", "134217728b", "16MB", "1g")] == [2048, 65536, 1 << 27, 1 << 24, 1 << 30]

    def consumed(parts):
        reader = csv.reader(iter(parts))
        next(reader)
        return reader.line_num

    draw = random.Random(7)
    for _ in range(20_000):
        line = "".join(draw.choice('",ab ') for _ in range(draw.randint(1, 12)))
        assert csv_source._opens(line) == (consumed([line + "\n", ""]) > 1), line
        assert csv_source._opens('"' + line) == (consumed(['"\n', line + "\n", ""]) > 2), line
