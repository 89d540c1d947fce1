"""Workbook scan (#6) and template scan (#8).

No Spark source reads .xlsx, so this is the one place Python touches the
data: ``binaryFile`` feeds workbook bytes to ``mapInArrow``; each input row
is one workbook, parsed with the standard library (``zipfile`` and
``xml.etree``: the C parser builds rows, finished ones are read and dropped a
chunk at a time) and emitted as Arrow record batches (no pandas in between).

A workbook isn't splittable, but its sheets are parts of their own: a sheet
of more than ``LARGE_SHEET`` bytes of XML is passed on as it lies in the file,
compressed, with the shared strings, and all those are dealt to tasks one by
one. So a workbook of twenty large sheets is parsed by twenty tasks; the task
that opened it held its compressed bytes.

The parsed cells are landed once; headers (sheet row 1) and data rows
(row 2 on, numbered from 1 by their sheet row) are both read from there.
Where the template's sheets are known, data rows of other sheets are neither
parsed nor landed, and each output sheet reads only its own part. Parts are
numbered: sheet names are users' texts, and no folder is named by them.
"""

from __future__ import annotations

import functools
import io
import posixpath
import zipfile
import zlib
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sheetmerge.plans.sizing import broadcast_if_small, small_enough
from sheetmerge.session import scratch_path
from sheetmerge.sources.land import land
from sheetmerge.sources.listing import decoded_file_name, file_filter, file_names

CELLS_SCHEMA = "file string, sheet string, row_no long, vals array<string>, body binary, strings binary"

#: Sheets of more XML than this are parsed by tasks of their own.
LARGE_SHEET = 64 << 20

_BATCH = 4096
_CHUNK = 1 << 18


def letters_to_index(letters: str) -> int:
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _local(tag: str) -> str:
    """Tag without its namespace (Transitional and Strict workbooks differ in it)."""
    return tag.rpartition("}")[2]


def _space(tag: str) -> str:
    """The namespace of a tag, as it stands before others."""
    return tag[: len(tag) - len(_local(tag))]


def _text_of(elem, space: str) -> str:
    """Text of a string item: plain <t> or rich-text runs; phonetic guides skipped."""
    t, r = space + "t", space + "r"
    if len(elem) == 1 and elem[0].tag == t:
        return elem[0].text or ""
    parts = []
    for child in elem:
        if child.tag == t:
            parts.append(child.text or "")
        elif child.tag == r:
            parts.extend(x.text or "" for x in child if x.tag == t)
    return "".join(parts)


def _begun(builder: ET.TreeBuilder, holder: str | None):
    """The element named ``holder`` among the root's children (None: the root) as far as it is built, if it has begun."""
    try:
        root = builder.close()  # the C builder gives the root at any time, and builds on
    except AssertionError:  # another one may do so at the end only
        return None
    if root is None or holder is None:
        return root
    return next((child for child in root if _local(child.tag) == holder), None)


def _items(chunks: Iterator[bytes], holder: str | None) -> Iterator[tuple[str, list]]:
    """(namespace, finished children) of the element named ``holder`` (None: the root), chunk by chunk.

    A child is finished once the next one has begun, or at the end. Children
    are dropped when they have been read, so memory doesn't grow with them.
    """
    builder = ET.TreeBuilder()
    parser, parent = ET.XMLParser(target=builder), None
    for chunk in chunks:
        parser.feed(chunk)
        parent = _begun(builder, holder) if parent is None else parent
        if parent is not None and len(parent) > 1:
            done = parent[:-1]
            del parent[:-1]
            yield _space(parent.tag), done
    parser.close()
    parent = _begun(builder, holder) if parent is None else parent
    if parent is not None and len(parent):
        yield _space(parent.tag), parent[:]


def _read(fh) -> Iterator[bytes]:
    while chunk := fh.read(_CHUNK):
        yield chunk


def _relations(z: zipfile.ZipFile, part: str) -> list[tuple[str, str, str]]:
    """[(id, kind, zip member)] of a part's relationships; kind = last piece of the type."""
    folder, name = posixpath.split(part)
    try:
        fh = z.open(posixpath.join(folder, "_rels", name + ".rels"))
    except KeyError:
        return []
    with fh:
        out = []
        for rel in ET.parse(fh).getroot():
            target = rel.get("Target", "")
            member = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
            out.append((rel.get("Id"), rel.get("Type", "").rpartition("/")[2], member))
        return out


def _strings(chunks: Iterator[bytes]) -> list[str]:
    return [_text_of(si, space) for space, items in _items(chunks, None) for si in items if si.tag == space + "si"]


def _shared_strings(z: zipfile.ZipFile, member: str | None) -> list[str]:
    if member is None or member not in z.namelist():
        return []
    with z.open(member) as fh:
        return _strings(_read(fh))


def _sheet_parts(z: zipfile.ZipFile) -> tuple[list[tuple[str, str]], str | None]:
    """([(sheet name, zip member)] in workbook order, member of the shared strings)."""
    book = next((m for _, kind, m in _relations(z, "") if kind == "officeDocument"), "xl/workbook.xml")
    members, strings = {}, None
    for rid, kind, member in _relations(z, book):
        members[rid] = member
        if kind == "sharedStrings":
            strings = member
    if strings is None:
        strings = posixpath.join(posixpath.dirname(book), "sharedStrings.xml")
    with z.open(book) as fh:
        root = ET.parse(fh).getroot()
    out = []
    for sheet in root.iter():
        if _local(sheet.tag) == "sheet":
            rid = next((v for k, v in sheet.attrib.items() if k.endswith("}id")), None)
            if rid in members:
                out.append((sheet.get("name"), members[rid]))
    return out, strings


def _row_cells(row, r: int, space: str, shared: list[str], columns: dict[str, int]) -> list[str | None]:
    """The values of a row by column, up to the last one."""
    c_tag, v_tag, is_tag, digits = space + "c", space + "v", space + "is", len(str(r))
    out: list[str | None] = []
    pos = -1
    for c in row:
        if c.tag != c_tag:
            continue
        ref = c.get("r")
        if ref:
            letters = ref[:-digits]
            pos = columns.get(letters, -1)
            if pos < 0:
                letters = ref.rstrip("0123456789")
                pos = columns[letters] = letters_to_index(letters)
        else:
            pos += 1
        kind = c.get("t")
        if kind == "inlineStr":
            val = next((_text_of(x, space) for x in c if x.tag == is_tag), None)
        else:
            val = next((x.text for x in c if x.tag == v_tag), None)
            if val is not None and kind == "s":
                val = shared[int(val)]
            elif val is not None and kind == "b":
                val = "TRUE" if val == "1" else "FALSE"
        if not val:
            continue
        if pos == len(out):
            out.append(val)
        elif pos > len(out):
            out.extend([None] * (pos - len(out)))
            out.append(val)
        else:
            out[pos] = val
    return out


def sheet_rows(chunks: Iterator[bytes], shared: list[str], max_row: int | None = None) -> Iterator[tuple[int, list[str | None]]]:
    """(sheet row number, values by column) for every non-empty row, streaming.

    Numbers are given as stored: a date cell is its serial number, since what
    it means depends on the workbook's styles.
    """
    next_r, columns = 1, {}
    for space, rows in _items(chunks, "sheetData"):
        tag = space + "row"
        for row in rows:
            if row.tag != tag:
                continue
            r = int(row.get("r") or next_r)
            next_r = r + 1
            cells = _row_cells(row, r, space, shared, columns)
            if cells:
                yield r, cells
            if max_row is not None and r >= max_row:
                return


def _numbered(rows: Iterator[tuple[int, list[str | None]]], header_only: bool) -> Iterator[tuple[int, list[str | None]]]:
    """(row_no, vals): row_no 0 = sheet row 1 (the header), given for an empty or missing row 1, too."""
    seen = False
    for r, vals in rows:
        if r != 1 and not seen:
            yield 0, []
        seen = True
        if header_only and r != 1:
            return
        yield r - 1, vals
    if not seen:
        yield 0, []


def _compressed(data: bytes, info: zipfile.ZipInfo) -> bytes:
    """A member as it lies in the file, after a byte that tells its compression."""
    at = info.header_offset
    begin = at + 30 + int.from_bytes(data[at + 26 : at + 28], "little") + int.from_bytes(data[at + 28 : at + 30], "little")
    return bytes([info.compress_type]) + data[begin : begin + info.compress_size]


def _unpacked(member: bytes) -> Iterator[bytes]:
    """What :func:`_compressed` gave, chunk by chunk."""
    view = memoryview(member)
    if member[0] == zipfile.ZIP_STORED:
        for lo in range(1, len(view), _CHUNK):
            yield bytes(view[lo : lo + _CHUNK])
        return
    unzip, rest = zlib.decompressobj(-15), view[1:]
    while len(rest) and not unzip.eof:
        yield unzip.decompress(rest, _CHUNK)
        rest = unzip.unconsumed_tail
    yield unzip.flush()


def parse_workbook(
    data: bytes, header_only: bool = False, sheets: frozenset[str] | None = None, large: int | None = None
) -> Iterator[tuple[str, int, list[str | None], tuple[bytes, bytes] | None]]:
    """(sheet, row_no, vals, None) of every row; of sheets beside ``sheets`` the header alone.

    Every sheet gives a row 0, an empty one where its row 1 is empty or
    missing, so no sheet goes unseen. A sheet whose rows are wanted and whose
    XML is longer than ``large`` gives (sheet, LARGE, [], (sheet part, strings part)).
    """
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        found, strings = _sheet_parts(z)
        if not found:
            raise ValueError("no readable sheet")
        shared = None
        for name, member in found:
            head = header_only or (sheets is not None and name not in sheets)
            info = z.getinfo(member)
            known = info.compress_type in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) and not info.flag_bits & 1
            if large is not None and not head and known and info.file_size > large:
                texts = _compressed(data, z.getinfo(strings)) if strings in z.namelist() else b""
                yield name, LARGE, [], (_compressed(data, info), texts)
                continue
            if shared is None:
                shared = _shared_strings(z, strings)
            with z.open(member) as fh:
                for row_no, vals in _numbered(sheet_rows(_read(fh), shared, 1 if head else None), head):
                    yield name, row_no, vals, None


FAILED = -1  # row_no of the row that says why a workbook couldn't be read
LARGE = -2  # row_no of the row that holds a sheet still to be parsed

_ERRORS = (zipfile.BadZipFile, ET.ParseError, KeyError, ValueError, IndexError, NotImplementedError, RuntimeError, zlib.error, EOFError)


def _batch(buf: list[tuple]) -> pa.RecordBatch:
    files, sheets, row_nos, vals, parts = zip(*buf, strict=True)
    bodies, strings = zip(*(p or (None, None) for p in parts), strict=True)
    columns = [(files, pa.string()), (sheets, pa.string()), (row_nos, pa.int64()), (vals, pa.list_(pa.string())), (bodies, pa.binary()), (strings, pa.binary())]
    return pa.RecordBatch.from_arrays(
        [pa.array(values, kind) for values, kind in columns], names=["file", "sheet", "row_no", "vals", "body", "strings"]
    )


def _batched(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    buf: list[tuple] = []
    for row in rows:
        buf.append(row)
        if len(buf) >= _BATCH or row[-1]:
            yield _batch(buf)
            buf = []
    if buf:
        yield _batch(buf)


def _parser(header_only: bool, sheets: frozenset[str] | None, large: int | None):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            contents = batch.column("content")
            for i, file in enumerate(batch.column("file").to_pylist()):
                try:
                    for sheet, row_no, vals, part in parse_workbook(contents[i].as_py(), header_only, sheets, large):
                        yield file, sheet, row_no, vals, part
                except _ERRORS as e:
                    # damaged, encrypted or not a workbook: one row with the reason, the run goes on
                    yield file, None, FAILED, [f"{type(e).__name__}: {e}"], None

    return lambda batches: _batched(rows(batches))


def _large_parser(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parses sheets that were passed on."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for row in batch.to_pylist():
                try:
                    shared = _strings(_unpacked(row["strings"])) if row["strings"] else []
                    for row_no, vals in _numbered(sheet_rows(_unpacked(row["body"]), shared), False):
                        yield row["file"], row["sheet"], row_no, vals, None
                except _ERRORS as e:
                    yield row["file"], None, FAILED, [f"{type(e).__name__}: {e}"], None

    return _batched(rows())


def workbook_cells(
    spark: SparkSession,
    directory: str,
    sources: DataFrame | None = None,
    header_only: bool = False,
    where: Column | None = None,
    sheets: Sequence[str] | None = None,
    large: int | None = None,
) -> DataFrame:
    """Parsed cells of every .xlsx in ``directory`` (lazy). -> CELLS_SCHEMA

    ``where`` is a predicate on ``_metadata`` (``listing.file_filter``):
    files that fail it aren't read. ``sources`` (a table of ``file``) is
    matched by path before contents are taken, too, where it is small enough
    to broadcast; contents never go through a shuffle. ``sheets``, ``large``:
    see :func:`parse_workbook`.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(directory)
    name = decoded_file_name()
    listed = listed.where(~name.startswith("~$") if where is None else where)
    books = listed.select(F.substring_index("path", "/", -1).alias("file"), "content")
    parse = _parser(header_only, None if sheets is None else frozenset(sheets), large)
    if sources is None:
        return books.mapInArrow(parse, CELLS_SCHEMA)
    chosen, small = small_enough(sources.select("file").distinct())
    if small:
        return books.join(F.broadcast(chosen), "file", "left_semi").mapInArrow(parse, CELLS_SCHEMA)
    return books.mapInArrow(parse, CELLS_SCHEMA).join(chosen, "file", "left_semi")


def _headers(cells: DataFrame) -> DataFrame:
    """Header cells of rows 0.

    A sheet without names in its first row has one header cell, without a
    name, at column 0: it exists for every later step, with width 0.
    """
    return cells.select("file", "sheet", F.posexplode_outer("vals").alias("col_idx", "name")).select(
        "file", "sheet", F.coalesce("col_idx", F.lit(0)).cast("int").alias("col_idx"), "name"
    )


def _part(sheets: Sequence[str] | None) -> Column:
    """Where a row is landed: headers, failures, sheets still to be parsed, or the data rows of a sheet."""
    data = F.lit("d")
    for k, name in enumerate(sheets or ()):
        data = F.when(F.col("sheet") == name, F.lit(f"d{k}")).otherwise(data)
    row_no = F.col("row_no")
    return F.when(row_no == 0, F.lit("h")).when(row_no == FAILED, F.lit("f")).when(row_no == LARGE, F.lit("l")).otherwise(data)


def scan_workbooks_with_failures(
    spark: SparkSession,
    directory: str,
    sources: DataFrame | None = None,
    land_to: str | None = None,
    where: Column | None = None,
    sheets: Sequence[str] | None = None,
    large_sheet: int = LARGE_SHEET,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every sheet of every .xlsx in ``directory`` -> (headers, rows, failed).

    ``sheets`` are the template's sheets, where they are known: other sheets
    give their header alone. Landed once, by header, data and sheet of the
    template: each output sheet reads only its part, and the header side
    never reads data rows. failed(file, reason) has the workbooks that
    couldn't be read.
    """
    path = land_to if land_to is not None else scratch_path(spark, "xlsx-cells")
    cells = workbook_cells(spark, directory, sources, where=where, sheets=sheets, large=large_sheet)
    seen = Observation("xlsx_cells")
    cells = cells.observe(seen, F.count(F.when(F.col("row_no") == LARGE, 1)).alias("large"))
    landed = land(spark, cells.withColumn("part", _part(sheets)), "xlsx-cells", path, partition_by=("part",))
    if large := seen.get["large"]:
        rest = landed.where(F.col("part") == "l").drop("part").repartition(int(large)).mapInArrow(_large_parser, CELLS_SCHEMA)
        rest.withColumn("part", _part(sheets)).write.mode("append").partitionBy("part").parquet(path)
        landed = spark.read.schema(landed.schema).parquet(path)
    columns = [F.col(c) for c in ("file", "sheet", "row_no", "vals")]
    rows = landed.where((F.col("part") == "d") & (F.size("vals") > 0)).select(*columns)
    if sheets is not None:
        # every other sheet gave its header alone
        parts = [landed.where((F.col("part") == f"d{k}") & (F.size("vals") > 0)).withColumn("sheet", F.lit(name)) for k, name in enumerate(sheets)]
        rows = functools.reduce(DataFrame.unionByName, [p.select(*columns) for p in parts], rows.limit(0))
    failed = landed.where(F.col("part") == "f").groupBy("file").agg(F.min(F.get("vals", F.lit(0))).alias("reason"))
    names = file_names(spark, directory, "*.xlsx", file_filter() if where is None else where)
    if sources is not None:
        names = names.join(broadcast_if_small(sources.select("file").distinct()), "file", "left_semi")
    known = landed.where(F.col("part").isin("h", "f")).select("file").distinct()
    empty = names.join(known, "file", "left_anti").select("file", F.lit("empty file").alias("reason"))
    return _headers(landed.where(F.col("part") == "h")), rows, land(spark, failed.unionByName(empty), "xlsx-failed")


def scan_workbooks(
    spark: SparkSession,
    directory: str,
    sources: DataFrame | None = None,
    land_to: str | None = None,
    where: Column | None = None,
    sheets: Sequence[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """As :func:`scan_workbooks_with_failures`, without the failures. -> (headers, rows)"""
    return scan_workbooks_with_failures(spark, directory, sources, land_to, where, sheets)[:2]


def read_template(spark: SparkSession, path: str) -> DataFrame:
    """Template workbook (or CSV) -> template_headers (sheet, t_idx, name).

    Only that file is read: its name is a predicate on file metadata.
    """
    directory, name = posixpath.split(path.rstrip("/"))
    only = file_filter([name])
    if name.endswith(".csv"):
        from sheetmerge.sources.csv import scan_csv_with_failures

        headers, _, failed = scan_csv_with_failures(spark, directory or ".", where=only)
        reason = failed.limit(1).collect()
        if reason:
            raise ValueError(f"template {name} can't be read: {reason[0]['reason']}")
    else:
        cells = workbook_cells(spark, directory or ".", header_only=True, where=only)
        reason = cells.where(F.col("row_no") == FAILED).limit(1).collect()
        if reason:
            raise ValueError(f"template {name} can't be read: {reason[0]['vals'][0]}")
        headers = _headers(cells.where(F.col("row_no") == 0))
    return headers.select("sheet", F.col("col_idx").alias("t_idx"), "name")


__all__ = [
    "parse_workbook",
    "read_template",
    "scan_workbooks",
    "scan_workbooks_with_failures",
    "workbook_cells",
]
