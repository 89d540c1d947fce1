"""The whole run from files (#36): template file + source folder -> result folder.

This is the batch equivalent of the interactive program: the template and
the source folder are arguments, the file chooser is ``chosen``/``invert``,
the pop-ups are a decisions table (CSV with the ``model.DECISIONS``
columns) plus a default policy, and the result workbook is a result folder.
"""

from __future__ import annotations

import posixpath
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetmerge import model
from sheetmerge.model import DECISIONS, SOURCE_EXTENSIONS
from sheetmerge.plans.job import DetectReport, MergePlan, MergeResult
from sheetmerge.session import file_system, run_scope
from sheetmerge.sources import csv as csv_source, listing, sink, xlsx


def load_sources(
    spark: SparkSession,
    directory: str,
    chosen: Sequence[str] | None = None,
    invert: bool = False,
    exclude: Sequence[str] = (),
    sheets: Sequence[str] | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Choose and scan the .xlsx and .csv files of a folder (each landed once).

    ``sheets`` are the template's, where they are known: data rows of other
    sheets aren't parsed.

    The choice is a predicate on file metadata, so files left out are never
    opened. Chosen names that match no file raise.
    -> (headers, rows, failed(file, reason)) over both formats.
    """
    sources = listing.skip_locks(listing.file_names(spark, directory, "*.{" + ",".join(e[1:] for e in SOURCE_EXTENSIONS) + "}"))
    if chosen:
        found = {r["file"] for r in sources.where(F.col("file").isin(list(chosen))).collect()}
        if set(chosen) - found:
            raise ValueError(f"chosen files that are not in {directory}: {sorted(set(chosen) - found)}")
    formats = {r["format"] for r in sources.select(F.substring_index("file", ".", -1).alias("format")).distinct().collect()}
    where = listing.file_filter(chosen, invert, exclude)
    headers = spark.createDataFrame([], model.HEADERS)
    rows = spark.createDataFrame([], model.ROWS)
    failed = spark.createDataFrame([], model.CANCELLED)
    if "xlsx" in formats:
        h, r, failed = xlsx.scan_workbooks_with_failures(spark, directory, where=where, sheets=sheets)
        headers, rows = headers.unionByName(h), rows.unionByName(r)
    if "csv" in formats:
        h, r, f = csv_source.scan_csv_with_failures(spark, directory, where=where)
        headers, rows, failed = headers.unionByName(h), rows.unionByName(r), failed.unionByName(f)
    return headers, rows, failed


def _folder(spark: SparkSession, path: str) -> str:
    """Fully qualified, normalised form of a folder path."""
    fs, p = file_system(spark, path)
    return fs.makeQualified(p).toString().rstrip("/")


def read_decisions(spark: SparkSession, path: str | None) -> DataFrame | None:
    if path is None:
        return None
    return spark.read.schema(DECISIONS).option("header", True).option("escape", '"').csv(path)


def plan_from_files(
    spark: SparkSession,
    template_path: str,
    source_dir: str,
    chosen: list[str] | None = None,
    invert: bool = False,
    decisions: DataFrame | None = None,
    policy: dict[str, str] | str | None = None,
    **kwargs,
) -> MergePlan:
    template = xlsx.read_template(spark, template_path)
    t_dir, t_name = posixpath.split(template_path.rstrip("/"))
    same_dir = _folder(spark, t_dir or ".") == _folder(spark, source_dir)
    sheets = sorted(r["sheet"] for r in template.select("sheet").distinct().collect())  # one row a template sheet
    headers, rows, failed = load_sources(spark, source_dir, chosen, invert, [t_name] if same_dir else [], sheets)
    return MergePlan(spark, template, headers, rows, decisions, policy, failed=failed, **kwargs)


def merge_files(spark: SparkSession, template_path: str, source_dir: str, out_dir: str | None = None,
                fmt: str = "parquet", **kwargs) -> MergeResult:
    """Merge, and write the result folder when ``out_dir`` is given.

    With ``out_dir`` the run removes what it landed once the result is
    published, and the tables returned read the published result
    (``merged_all``, which isn't part of it, is None).
    """
    if out_dir is None:
        return plan_from_files(spark, template_path, source_dir, **kwargs).result()
    with run_scope(spark):
        sink.write_result(plan_from_files(spark, template_path, source_dir, **kwargs).result(), out_dir, fmt)
    tables = {name: sink.read_audit(spark, out_dir, name, fmt) for name in sink.AUDIT_TABLES}
    return MergeResult(sheets=sink.read_result(spark, out_dir, fmt), merged_all=None, **tables)


REPORT_TABLES = ("exceptions", "choices_needed", "missing", "unmatched")


def detect_files(spark: SparkSession, template_path: str, source_dir: str, out_dir: str | None = None,
                 fmt: str = "csv", **kwargs) -> DetectReport:
    """Pass 1: what would need a decision; written for a person to answer.

    With ``out_dir`` the run removes what it landed, and the tables returned
    read what was written.
    """
    if out_dir is None:
        return plan_from_files(spark, template_path, source_dir, **kwargs).report()
    out_dir = out_dir.rstrip("/")
    options = {"header": True, "escape": '"'} if fmt == "csv" else {}
    with run_scope(spark):
        report = plan_from_files(spark, template_path, source_dir, **kwargs).report()
        schemas = {name: getattr(report, name).schema for name in REPORT_TABLES}
        for name in REPORT_TABLES:
            getattr(report, name).write.mode("errorifexists").format(fmt).options(**options).save(f"{out_dir}/{name}")
    return DetectReport(*(spark.read.schema(schemas[n]).format(fmt).options(**options).load(f"{out_dir}/{n}") for n in REPORT_TABLES))
