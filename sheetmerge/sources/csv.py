"""CSV scan (#4, #5, #7): UTF-8 CSV files -> ``headers`` + ``rows`` + failures.

Spark's CSV reader would rename duplicate or blank header names and needs a
width before it reads; files here are ragged. So files are read as text,
always splittable, and every record is cut into an array of its own width:
there is no schema to outgrow and one path for files of any size.

1. *One read.* Every line is landed as if it were a record: without a quote
   character cut at its commas by Spark, with one as it is. The landed lines
   with quotes, and only those, then go through Python's ``csv`` module,
   which has the quoting rules files like these are written by: a quote
   opens a value only at the start of a field, ``5"`` is text.
2. *Records over several lines.* A line's effect is a function of the state
   it starts in (outside or inside a quoted value). Files with a line that
   opens a value and doesn't close it are read again, and their line effects
   composed within each split by running aggregates, and over the splits of
   a file by prefix, so a big file stays split across tasks; then the lines
   of a record are joined.
3. *Numbers.* Records are numbered per file from the scan order: (records of
   the earlier splits) + (place in the split). Record 0 is the header, data
   rows count from 1, empty lines don't.

A file that can't be read is cancelled as a whole, with its reason, and the
run goes on: one without a record, one that isn't UTF-8, and one with a
record of more than ``MAX_RECORD_BYTES`` (what a quoted value that is never
closed makes of the rest of a long file). A record's size is summed up
before its lines meet, so a damaged quote never gathers a file in one task.

An empty cell is null. Cells after the last value of a record are cut. A
line break inside a value is ``\\n``. A byte order mark at the start of a
file is dropped by the line reader. A quoted value that is never closed runs
to the end of its file.

Every CSV file is the virtual sheet ``Sheet1``.
"""

from __future__ import annotations

import csv
import re
import sys
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetmerge.model import CSV_SHEET
from sheetmerge.operators.numbering import apply_offsets, block_offsets
from sheetmerge.plans.sizing import DEFAULT_MAX_BROADCAST_BYTES, broadcast_if_small
from sheetmerge.session import file_system, scratch_path
from sheetmerge.sources.land import land
from sheetmerge.sources.listing import decoded_file_name, file_filter, file_names

#: The longest record, in bytes; a file with a longer one is cancelled.
MAX_RECORD_BYTES = 16 << 20

#: Up to so many files to read again are named to the reader, so that it opens no others.
NAMED_FILES = 1000

#: A task reads about so many bytes of text, one split after the other where splits are smaller; landed
#: tables are read in parts of at least this size.
TASK_BYTES = 32 << 20

#: Small inputs are read by up to so many tasks a core.
TASKS_PER_CORE = 3

SPLIT_BYTES = "spark.sql.files.maxPartitionBytes"

_QUOTE = '"'


#: Closed fields, each up to its comma (text after a closing quote belongs to the field), then a value that
#: isn't closed; nothing in it is tried twice.
_OPEN = re.compile(r'(?:(?:"[^"]*+(?:""[^"]*+)*+"[^,]*+|[^",][^,]*+)?+,)*+"[^"]*+(?:""[^"]*+)*+\Z')


def _opens(line: str) -> bool:
    """Whether a value is open at the end of a line that began outside one, by the rules of the ``csv`` module."""
    return _OPEN.match(line) is not None


@F.arrow_udf(T.IntegerType())
def _line_effect(lines: pa.Array) -> pa.Array:
    """Whether a line ends inside a quoted value: bit 0 if it starts outside one, bit 1 if inside."""
    return pa.array([None if x is None else _opens(x) + 2 * _opens(_QUOTE + x) for x in lines.to_pylist()], pa.int32())


def _parsed(records: list[str | None]) -> pa.Array:
    """The cells of each record; closed ones go through one reader, which takes them one by one."""
    csv.field_size_limit(sys.maxsize)
    closed = csv.reader(x for x in records if x is not None and not _opens(x))
    cells = [None if x is None else next(csv.reader([x]) if _opens(x) else closed, []) for x in records]
    return pa.array([x and [c or None for c in x] for x in cells], pa.list_(pa.string()))


@F.arrow_udf(T.ArrayType(T.StringType()))
def _quoted_cells(records: pa.Array) -> pa.Array:
    return _parsed(records.to_pylist())


@F.arrow_udf(T.StructType([T.StructField("opens", T.BooleanType()), T.StructField("cells", T.ArrayType(T.StringType()))]))
def _quoted_line(lines: pa.Array) -> pa.Array:
    """(opens, cells) of a line with quotes."""
    texts = lines.to_pylist()
    return pa.StructArray.from_arrays([pa.array([_opens(x) for x in texts], pa.bool_()), _parsed(texts)], names=["opens", "cells"])


def _has_quote(value: str = "value") -> Column:
    return F.col(value).contains(_QUOTE)


def _in_bytes(setting: str) -> int:
    """A size as Spark's settings spell it (``64k``, ``134217728b``)."""
    number, unit = re.fullmatch(r"\s*(\d+)\s*([kmgtp]?)b?\s*", setting.lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


@contextmanager
def _splits_of(spark: SparkSession, size: str) -> Iterator[None]:
    """Scans that start in here read splits of this size."""
    old = spark.conf.get(SPLIT_BYTES)
    spark.conf.set(SPLIT_BYTES, size)
    try:
        yield
    finally:
        spark.conf.set(SPLIT_BYTES, old)


def read_lines(spark: SparkSession, directory: str, where: Column, split_bytes: str | None = None) -> DataFrame:
    """(file, split, value) of every line, in scan order; ``where`` prunes files.

    Splits stay as they are, but small ones don't get a task and a landed part
    each: a task reads ``TASK_BYTES`` of them, one after the other.
    """
    lines = (
        spark.read.option("pathGlobFilter", "*.csv")
        .text(directory)
        .where(where)
        .select(
            decoded_file_name().alias("file"),
            F.col("_metadata.file_block_start").alias("split"),
            "value",
        )
    )
    if _in_bytes(split_bytes or spark.conf.get(SPLIT_BYTES)) >= TASK_BYTES:
        return lines
    fs, path = file_system(spark, directory)
    tasks = -(-fs.getContentSummary(path).getLength() // TASK_BYTES)
    return lines.coalesce(max(tasks, TASKS_PER_CORE * spark.sparkContext.defaultParallelism))


def _composed(by: Window, effect: str) -> tuple[Column, Column]:
    """State after each row if the first starts outside, and if it starts inside.

    An effect (0-3, as :func:`_line_effect`; null changes nothing) sets the
    state (0, 3), keeps it (2) or swaps it (1): the state is what the last
    setting row left, swapped as often as rows since swap it.
    """
    swaps = F.sum(F.when(F.col(effect) == 1, 1).otherwise(0)).over(by)
    sets = F.col(effect).isin(0, 3)
    left = F.last(F.when(sets, (F.col(effect) == 3).cast("int")), ignorenulls=True).over(by)
    return swaps, left


def _states(df: DataFrame, by_cols: list[str], order: str, effect: str) -> DataFrame:
    """Adds ``after0`` / ``after1``: the state after a row that began outside / inside."""
    by = Window.partitionBy(*by_cols).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swaps, left = _composed(by, effect)
    df = df.withColumn("_swaps", swaps).withColumn("_left", left)
    at = F.last(F.when(F.col(effect).isin(0, 3), F.col("_swaps")), ignorenulls=True).over(by)
    df = df.withColumn("_since", F.col("_swaps") - F.coalesce(at, F.lit(0)))
    odd = F.col("_since") % 2

    def state(start: int) -> Column:
        return F.coalesce(F.col("_left"), F.lit(start)).bitwiseXOR(odd.cast("int"))

    return df.withColumn("after0", state(0)).withColumn("after1", state(1)).drop("_swaps", "_left", "_since")


def _keyed_lines(spark: SparkSession, lines: DataFrame, max_broadcast_bytes: int, split_bytes: str) -> DataFrame:
    """Lines of files whose values span lines -> (file, own, rid, split, value); ``own`` tells the records apart.

    The windows are per split (a split has a bounded size) and per file over
    its splits.
    """
    lines = lines.withColumn("rid", F.monotonically_increasing_id())
    with _splits_of(spark, split_bytes):
        lines = land(spark, lines.withColumn("effect", _line_effect(F.when(_has_quote(), F.col("value")))), "csv-lines")
    split = ["file", "split"]
    lines = _states(lines, split, "rid", "effect")
    splits = lines.groupBy(*split).agg(F.max_by(F.struct("after0", "after1"), "rid").alias("end"))
    splits = splits.withColumn("effect", F.col("end.after0") + 2 * F.col("end.after1"))
    earlier = Window.partitionBy("file").orderBy("split")
    splits = _states(splits, ["file"], "split", "effect").select(
        *split, F.coalesce(F.lag("after0").over(earlier), F.lit(0)).alias("start")
    )
    splits = land(spark, splits, "csv-splits")
    in_split = Window.partitionBy(*split).orderBy("rid")
    before = F.when(
        F.col("start") == 0, F.coalesce(F.lag("after0").over(in_split), F.lit(0))
    ).otherwise(F.coalesce(F.lag("after1").over(in_split), F.lit(1)))
    lines = lines.join(broadcast_if_small(splits, max_broadcast_bytes), split).withColumn("before", before)
    begins = (F.col("before") == 0) & (F.col("value") != "")
    running = in_split.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("nth", F.sum(begins.cast("int")).over(running)).where((F.col("before") == 1) | begins)
    lines = land(spark, lines.select(*split, "rid", "value", "nth"), "csv-lines")
    # what continues a record of an earlier split belongs to the last record there
    counts = lines.groupBy(*split).agg(F.max("nth").alias("n"))
    upto = earlier.rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("n") > 0, F.struct("split", "n")), ignorenulls=True).over(upto)
    owners = broadcast_if_small(counts.select(*split, last.alias("last")), max_broadcast_bytes)
    own = F.when(F.col("nth") > 0, F.struct("split", F.col("nth").alias("n"))).otherwise(F.col("last"))
    return lines.join(owners, split).select("file", own.alias("own"), "split", "rid", "value")


def _joined_records(
    spark: SparkSession, lines: DataFrame, max_record_bytes: int, max_broadcast_bytes: int, split_bytes: str
) -> tuple[DataFrame, DataFrame]:
    """((file, split, rid, vals), (file, fault, split)): the records of files whose values span lines, landed, and
    the files that have one too long. The lines of a record meet in one row once their bytes are known to fit."""
    keyed = _keyed_lines(spark, lines, max_broadcast_bytes, split_bytes)
    sizes = keyed.groupBy("file", "own").agg(F.sum(F.octet_length("value") + 1).alias("bytes"))
    long = sizes.where(F.col("bytes") > max_record_bytes + 1).groupBy("file").agg(F.min("own.split").alias("split"))
    long = land(spark, long.select("file", _too_long(max_record_bytes).alias("fault"), "split"), "csv-long")
    keyed = _without(keyed, long, max_broadcast_bytes)
    texts = F.transform(F.sort_array(F.collect_list(F.struct("split", "rid", "value"))), lambda x: x["value"])
    records = keyed.groupBy("file", "own").agg(F.array_join(texts, "\n").alias("value"))
    cells = F.when(_has_quote(), _quoted_cells(F.when(_has_quote(), F.col("value")))).otherwise(_cells("value"))
    records = records.select("file", F.col("own.split").alias("split"), F.col("own.n").cast("long").alias("rid"), cells.alias("cells"))
    return land(spark, records.select("file", "split", "rid", _cut("cells").alias("vals")), "csv-records"), long


def _too_long(max_record_bytes: int) -> Column:
    return F.lit(f"record longer than {max_record_bytes} bytes")


def _without(df: DataFrame, files: DataFrame, max_broadcast_bytes: int) -> DataFrame:
    """``df`` without the rows of some files; as it is if there are none."""
    if files.limit(1).count() == 0:
        return df
    return df.join(broadcast_if_small(files.select("file").distinct(), max_broadcast_bytes), "file", "left_anti")


def _cells(value: str) -> Column:
    """A record without quotes as its cells."""
    return F.transform(F.split(F.col(value), ",", -1), lambda x: F.when(x != "", x))


def _cut(cells: str) -> Column:
    """Cells up to the last value."""
    last = F.array_max(F.transform(F.col(cells), lambda x, i: F.when(x.isNotNull(), i + 1)))
    return F.slice(F.col(cells), F.lit(1), F.coalesce(last, F.lit(0)))


def _read_again(
    spark: SparkSession, directory: str, where: Column, files: DataFrame, max_broadcast_bytes: int, split_bytes: str
) -> DataFrame:
    """The lines of some of the files."""
    named = [r["file"] for r in files.limit(NAMED_FILES + 1).collect()]
    if len(named) <= NAMED_FILES:
        return read_lines(spark, directory, where & decoded_file_name().isin(named), split_bytes)
    return read_lines(spark, directory, where, split_bytes).join(broadcast_if_small(files, max_broadcast_bytes), "file", "left_semi")


def scan_csv_with_failures(
    spark: SparkSession,
    directory: str,
    sources: DataFrame | None = None,
    land_to: str | None = None,
    max_broadcast_bytes: int = DEFAULT_MAX_BROADCAST_BYTES,
    where: Column | None = None,
    max_record_bytes: int = MAX_RECORD_BYTES,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Read every ``*.csv`` in ``directory``.

    ``where`` is a predicate on ``_metadata`` (``listing.file_filter``):
    files that fail it aren't read. ``sources`` (a table of ``file``)
    restricts the files by a join. The cells are landed once (``land_to`` or
    a fresh folder under ``spark.checkpoint.dir``).
    -> (headers(file, sheet, col_idx, name), rows(file, sheet, row_no, vals), failed(file, reason))

    The session's split size, however small, is that of the text; what is
    landed on the way is read in parts of at least ``TASK_BYTES``.
    """
    split_bytes = spark.conf.get(SPLIT_BYTES)
    where = file_filter() if where is None else where
    with _splits_of(spark, str(max(_in_bytes(split_bytes), TASK_BYTES))):
        return _scan(spark, directory, sources, land_to, max_broadcast_bytes, where, max_record_bytes, split_bytes)


def _scan(
    spark: SparkSession,
    directory: str,
    sources: DataFrame | None,
    land_to: str | None,
    max_broadcast_bytes: int,
    where: Column,
    max_record_bytes: int,
    split_bytes: str,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    lines = read_lines(spark, directory, where, split_bytes)
    files = file_names(spark, directory, "*.csv", where)
    if sources is not None:
        chosen = broadcast_if_small(sources.select("file").distinct(), max_broadcast_bytes)
        lines, files = lines.join(chosen, "file", "left_semi"), files.join(chosen, "file", "left_semi")
    lines = lines.where(F.col("value") != "").withColumn("rid", F.monotonically_increasing_id())
    long = F.octet_length("value") > max_record_bytes
    fault = F.when(long, _too_long(max_record_bytes)).when(~F.is_valid_utf8("value"), F.lit("not UTF-8"))
    lines = lines.withColumn("fault", fault)
    sound, columns = F.col("fault").isNull(), ["file", "split", "rid"]
    lines = lines.select(
        *columns,
        "fault",
        F.when(sound & ~_has_quote(), _cells("value")).alias("cells"),
        F.when(sound & _has_quote(), F.col("value")).alias("quoted"),
    ).select(*columns, "fault", _cut("cells").alias("vals"), "quoted")
    seen = Observation("csv_lines")
    lines = lines.observe(seen, F.count("fault").alias("faults"), F.count("quoted").alias("quoted"))
    with _splits_of(spark, split_bytes):
        lines = land(spark, lines, "csv-cells", land_to if land_to is not None else scratch_path(spark, "csv-cells"))
    parts = [lines.where("vals is not null").select(*columns, "vals")]
    faults = spark.createDataFrame([], "file string, fault string, split long")
    if seen.get["faults"]:
        first = lines.where("fault is not null").groupBy("file").agg(F.min(F.struct("split", "rid", "fault")).alias("at"))
        faults = faults.unionByName(first.select("file", "at.fault", "at.split"))
    if seen.get["quoted"]:
        quoted = lines.where("quoted is not null").select(*columns, _quoted_line("quoted").alias("line"))
        quoted = land(spark, quoted.select(*columns, "line.opens", "line.cells"), "csv-quoted")
        open_files = quoted.where("opens").select("file").distinct()
        parts.append(quoted.select(*columns, _cut("cells").alias("vals")))
        if open_files.limit(1).count():
            open_files = land(spark, _without(open_files, faults, max_broadcast_bytes), "csv-open")
            parts = [_without(p, open_files, max_broadcast_bytes) for p in parts]
            again = _read_again(spark, directory, where, open_files, max_broadcast_bytes, split_bytes)
            joined, long_files = _joined_records(spark, again, max_record_bytes, max_broadcast_bytes, split_bytes)
            parts.append(joined)
            faults = faults.unionByName(long_files)
    cells = parts[0]
    for part in parts[1:]:
        cells = cells.unionByName(part)
    faults = land(spark, faults, "csv-faults")
    headers, rows, offsets = _numbered(_without(cells, faults, max_broadcast_bytes), max_broadcast_bytes)
    told = F.concat("fault", F.lit(", in the part from byte "), F.col("split").cast("string"), F.lit(" on"))
    known = offsets.select("file").union(faults.select("file")).distinct()
    empty = files.join(known, "file", "left_anti").select("file", F.lit("no record").alias("reason"))
    failed = land(spark, faults.select("file", told.alias("reason")).unionByName(empty), "csv-failed")
    return headers, rows, failed


def scan_csv(
    spark: SparkSession,
    directory: str,
    sources: DataFrame | None = None,
    land_to: str | None = None,
    max_broadcast_bytes: int = DEFAULT_MAX_BROADCAST_BYTES,
    where: Column | None = None,
    max_record_bytes: int = MAX_RECORD_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """As :func:`scan_csv_with_failures`, without the failures. -> (headers, rows)"""
    return scan_csv_with_failures(spark, directory, sources, land_to, max_broadcast_bytes, where, max_record_bytes)[:2]


def _numbered(cells: DataFrame, max_broadcast_bytes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(file, split, rid, vals) in scan order -> numbered headers and rows, and the offsets of the splits.

    Ids are consecutive within a file split and splits follow file order, so
    the position in the file is a block offset (``operators.numbering``).
    The header is the first record of each file: found by a join with the
    offset 0 (the filter reaches the scan), not by numbering every row. A
    file without names in its first record has one header cell, without a
    name, at column 0: its sheet exists for every later step, with width 0.
    """
    offsets = block_offsets(cells, ["file"], "split", "rid", max_broadcast_bytes)
    numbered = apply_offsets(cells, offsets, ["file"], "split", "rid", base=0)
    numbered = numbered.select("file", F.lit(CSV_SHEET).alias("sheet"), "row_no", "vals")
    first = offsets.where(F.col("_offset") == 0).select("file", "split", F.col("_first_id").alias("rid"))
    header_vals = cells.join(first, ["file", "split", "rid"]).select("file", F.lit(CSV_SHEET).alias("sheet"), "vals")
    headers = header_vals.select("file", "sheet", F.posexplode_outer("vals").alias("col_idx", "name")).select(
        "file", "sheet", F.coalesce("col_idx", F.lit(0)).cast("int").alias("col_idx"), "name"
    )
    rows = numbered.where((F.col("row_no") > 0) & (F.size("vals") > 0))
    return headers, rows, offsets
