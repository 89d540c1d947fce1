"""Write a derived fixture as real files (CSV or minimal xlsx), one per source file.

Used by the file-operator queries and the tests: the fixture rows are
partitioned by file, sorted within the partition, and each task streams
its files out (no file is ever held whole in memory or on the driver).
Files are written with Python I/O, so ``out_dir`` must be a folder every
executor mounts (the shared checkpoint folder on a cluster); each file is
written under a temporary name and renamed, so a retried or speculative
task leaves one complete file.
"""

from __future__ import annotations

import csv
import io
import os
import uuid
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetmerge.session import is_local_path, local_fs_path

_CT = (
    '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
    '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Default Extension="xml" ContentType="application/xml"/>'
    '<Override PartName="/xl/workbook.xml" '
    'ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
    "{sheets}</Types>"
)
_CT_SHEET = (
    '<Override PartName="/xl/worksheets/sheet{n}.xml" '
    'ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
)
_ROOT_RELS = (
    '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" '
    'Target="xl/workbook.xml"/></Relationships>'
)
_WB = (
    '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" '
    'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{sheets}</sheets></workbook>'
)
_WB_RELS = (
    '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>'
)
_SHEET_HEAD = (
    '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
)
_SHEET_TAIL = "</sheetData></worksheet>"


def col_letters(i: int) -> str:
    n, out = i + 1, ""
    while n > 0:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _xml_attr(s: str) -> str:
    return escape(s, {'"': "&quot;"})


class XlsxWriter:
    """Streams sheets into one .xlsx (inline strings, no styles)."""

    def __init__(self, path: str):
        self.path = path
        self.tmp = f"{path}.{uuid.uuid4().hex}.tmp"
        self.zf = zipfile.ZipFile(self.tmp, "w", zipfile.ZIP_DEFLATED)
        self.sheets: list[str] = []
        self.fh = None

    def start_sheet(self, name: str) -> None:
        self._end_sheet()
        self.sheets.append(name)
        raw = self.zf.open(f"xl/worksheets/sheet{len(self.sheets)}.xml", "w")
        self.fh = io.TextIOWrapper(raw, encoding="utf-8")
        self.fh.write(_SHEET_HEAD)

    def row(self, sheet_row: int, vals) -> None:
        cells = []
        for i, v in enumerate(vals):
            if v is None:
                continue
            cells.append(
                f'<c r="{col_letters(i)}{sheet_row}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>'
            )
        self.fh.write(f'<row r="{sheet_row}">{"".join(cells)}</row>')

    def _end_sheet(self) -> None:
        if self.fh is not None:
            self.fh.write(_SHEET_TAIL)
            self.fh.close()
            self.fh = None

    def close(self) -> None:
        self._end_sheet()
        n = len(self.sheets)
        self.zf.writestr("[Content_Types].xml", _CT.format(sheets="".join(_CT_SHEET.format(n=k) for k in range(1, n + 1))))
        self.zf.writestr("_rels/.rels", _ROOT_RELS)
        self.zf.writestr(
            "xl/workbook.xml",
            _WB.format(
                sheets="".join(
                    f'<sheet name="{_xml_attr(s)}" sheetId="{k}" r:id="rId{k}"/>' for k, s in enumerate(self.sheets, 1)
                )
            ),
        )
        self.zf.writestr(
            "xl/_rels/workbook.xml.rels",
            _WB_RELS.format(
                rels="".join(
                    f'<Relationship Id="rId{k}" '
                    'Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" '
                    f'Target="worksheets/sheet{k}.xml"/>'
                    for k in range(1, n + 1)
                )
            ),
        )
        self.zf.close()
        os.replace(self.tmp, self.path)


class CsvWriter:
    """Streams rows of one sheet into a UTF-8 CSV file."""

    def __init__(self, path: str):
        self.path = path
        self.tmp = f"{path}.{uuid.uuid4().hex}.tmp"
        self.fh = open(self.tmp, "w", encoding="utf-8", newline="")
        self.w = csv.writer(self.fh, lineterminator="\n")

    def start_sheet(self, name: str) -> None:
        pass

    def row(self, sheet_row: int, vals) -> None:
        self.w.writerow(["" if v is None else v for v in vals])

    def close(self) -> None:
        self.fh.close()
        os.replace(self.tmp, self.path)


def _stub(out_dir: str, pattern: str, file: str) -> None:
    stem = file.rsplit(".", 1)[0]
    with open(os.path.join(out_dir, pattern.format(file=file, stem=stem)), "wb") as fh:
        fh.write(b"not a workbook")


def _writer_fn(out_dir: str, fmt: str, stubs: tuple[str, ...] = ()):
    make = XlsxWriter if fmt == "xlsx" else CsvWriter

    def finish(writer, file):
        writer.close()
        for pattern in stubs:
            _stub(out_dir, pattern, file)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cur_file = cur_sheet = None
        writer = None
        written: list[tuple[str, int]] = []
        n = 0
        for batch in batches:
            for file, sheet, row_no, vals in zip(batch["file"], batch["sheet"], batch["row_no"], batch["vals"]):
                if file != cur_file:
                    if writer is not None:
                        finish(writer, cur_file)
                        written.append((cur_file, n))
                    writer, cur_file, cur_sheet, n = make(os.path.join(out_dir, file)), file, None, 0
                if sheet != cur_sheet:
                    writer.start_sheet(sheet)
                    cur_sheet = sheet
                writer.row(int(row_no) + 1, list(vals))
                n += 1
        if writer is not None:
            finish(writer, cur_file)
            written.append((cur_file, n))
        yield pd.DataFrame(written, columns=["file", "n_rows"])

    return run


def with_header_rows(headers: DataFrame, rows: DataFrame) -> DataFrame:
    """Headers as row 0 in front of the data rows. -> (file, sheet, row_no, vals)"""
    ordered = F.array_sort(F.collect_list(F.struct("col_idx", "name")))
    head = headers.groupBy("file", "sheet").agg(
        F.lit(0).cast("long").alias("row_no"), F.transform(ordered, lambda s: s["name"]).alias("vals")
    )
    return head.unionByName(rows.select("file", "sheet", "row_no", "vals"))


def write_files(
    headers: DataFrame,
    rows: DataFrame,
    out_dir: str,
    fmt: str,
    partitions: int | None = None,
    stubs: tuple[str, ...] = (),
) -> int:
    """Write one file per ``file`` value into ``out_dir``; returns the file count.

    ``stubs``: extra small non-source files per written file, as patterns of
    ``{file}`` / ``{stem}`` (e.g. ``'~${file}'`` lock files, ``'{stem}.xls'``).
    """
    if not is_local_path(out_dir):
        raise ValueError("fixture files are written with Python I/O; use a mounted folder")
    local = local_fs_path(out_dir)
    os.makedirs(local, exist_ok=True)
    partitions = partitions or int(headers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    data = (
        with_header_rows(headers, rows)
        .repartition(partitions, "file")
        .sortWithinPartitions("file", "sheet", "row_no")
    )
    done = data.mapInPandas(_writer_fn(local, fmt, stubs), "file string, n_rows long")
    return done.count()


def damage_files(damage: DataFrame, out_dir: str) -> int:
    """Damage written files: (file, keep, tail) leaves a file's bytes or none, and then ``tail``; returns their count."""
    local = local_fs_path(out_dir)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, keep, tail in zip(batch["file"], batch["keep"], batch["tail"]):
                path = os.path.join(local, file)
                with open(path, "rb") as fh:
                    data = fh.read() if keep else b""
                tmp = f"{path}.{uuid.uuid4().hex}.tmp"
                with open(tmp, "wb") as fh:
                    fh.write(data if tail and data.endswith(bytes(tail)) else data + bytes(tail))
                os.replace(tmp, path)
            yield batch[["file"]]

    return damage.mapInPandas(run, "file string").count()
