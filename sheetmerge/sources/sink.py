"""Result sink (#35): merged sheets + exception and cancel tables.

One folder per template sheet plus the audit tables, each written by
executors in parallel. Sheet folders are numbered (sheet names may hold
characters a path should not) and ``manifest`` maps number -> sheet name ->
template column names; it also maps the audit folders to the output's fixed
titles. Parquet needs unique column names (``T``, ``T__2``); the CSV sink
writes the template's own header text, duplicates included, and the fixed
field titles of the audit tables.

A result is published as a whole. All tables are written to a staging
folder inside the result folder, which no reader looks at, then moved to
their places by renames, the manifest last. A folder without a manifest
isn't a result: a run that was killed leaves none, and the next one replaces
what it left.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context

from pyspark.sql import DataFrame, SparkSession

from sheetmerge.model import AUDIT_TITLES
from sheetmerge.plans.job import MergeResult
from sheetmerge.session import file_system

MANIFEST = "manifest"
STAGING = "_staging-"
AUDIT_TABLES = ("exceptions", "cancelled", "missing", "unmatched")


def _template_names(df: DataFrame) -> list[str]:
    return [f.metadata.get("template_name", f.name) for f in df.schema.fields]


def run_concurrently(actions: list[Callable[[], None]], max_parallel: int = 8) -> None:
    """Submit independent Spark jobs from driver threads so small outputs
    share the cluster instead of queueing one after another."""
    if len(actions) <= 1 or max_parallel <= 1:
        for act in actions:
            act()
        return
    with ThreadPoolExecutor(max_workers=min(max_parallel, len(actions))) as pool:
        for fut in [pool.submit(copy_context().run, a) for a in actions]:
            fut.result()


def write_result(
    result: MergeResult, out_dir: str, fmt: str = "parquet", mode: str = "errorifexists", max_parallel: int = 8
) -> None:
    """Write and publish a result. ``mode``: what to do where one is published already
    (``errorifexists`` or ``overwrite``; the old one stays readable until the new one is written)."""
    spark = result.exceptions.sparkSession
    out_dir = out_dir.rstrip("/")
    if mode not in ("errorifexists", "overwrite"):
        raise ValueError(f"mode {mode!r}: errorifexists or overwrite")
    if mode == "errorifexists" and _published(spark, out_dir):
        raise FileExistsError(f"{out_dir} holds a result")
    staging = f"{out_dir}/{STAGING}{uuid.uuid4().hex[:12]}"
    manifest, actions = [], []  # (number, folder, sheet or title, column names)
    for i, (sheet, df) in enumerate(result.sheets.items()):
        path = f"{staging}/sheets/{i:05d}"
        names = _template_names(df)
        writer = (df.toDF(*names) if fmt == "csv" else df).write.format(fmt)
        if fmt == "csv":
            writer = writer.option("header", True).option("escape", '"').option("encoding", "UTF-8")
        actions.append(lambda w=writer, p=path: w.save(p))
        manifest.append((i, f"sheets/{i:05d}", sheet, json.dumps(names, ensure_ascii=False)))
    for name in AUDIT_TABLES:
        table = getattr(result, name)
        title, fields = AUDIT_TITLES.get(name, (name, tuple(table.columns)))
        manifest.append((None, name, title, json.dumps(fields, ensure_ascii=False)))
        writer = (table.toDF(*fields) if fmt == "csv" else table).write.format(fmt)
        if fmt == "csv":
            writer = writer.option("header", True).option("escape", '"')
        actions.append(lambda w=writer, p=f"{staging}/{name}": w.save(p))
    run_concurrently(actions, max_parallel)
    spark.createDataFrame(manifest, "idx int, folder string, sheet string, names string").coalesce(1).write.json(
        f"{staging}/{MANIFEST}"
    )
    _publish(spark, staging, out_dir)


def _published(spark: SparkSession, out_dir: str) -> bool:
    fs, path = file_system(spark, f"{out_dir}/{MANIFEST}")
    return fs.exists(path)


def _publish(spark: SparkSession, staging: str, out_dir: str) -> None:
    """Moves the staged folders to their places: the old manifest goes first, the new one comes last."""

    def place(name: str, base: str = out_dir):
        return file_system(spark, f"{base}/{name}" if name else base)[1]

    fs, staged = file_system(spark, staging)
    folders = [s.getPath().getName() for s in fs.listStatus(staged)]
    fs.delete(place(MANIFEST), True)
    for name in sorted(folders, key=lambda n: n == MANIFEST):
        fs.delete(place(name), True)
        if not fs.rename(place(name, staging), place(name)):
            raise OSError(f"{name} of {staging} can't be moved to {out_dir}")
    for left in fs.listStatus(place("")):  # this run's, and those of runs that were killed
        if left.getPath().getName().startswith(STAGING):
            fs.delete(left.getPath(), True)


def _manifest(spark: SparkSession, out_dir: str) -> DataFrame:
    if not _published(spark, out_dir):
        raise FileNotFoundError(f"{out_dir} holds no published result")
    return spark.read.json(f"{out_dir}/{MANIFEST}")


def read_result(spark: SparkSession, out_dir: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """Sheets written by ``write_result``: sheet -> DataFrame."""
    out_dir = out_dir.rstrip("/")
    entries = _manifest(spark, out_dir).where("idx is not null").collect()
    sheets = {}
    for e in sorted(entries, key=lambda r: r["idx"]):
        reader = spark.read.format(fmt)
        if fmt == "csv":
            reader = reader.option("header", True).option("escape", '"')
        sheets[e["sheet"]] = reader.load(f"{out_dir}/sheets/{e['idx']:05d}")
    return sheets


def read_audit(spark: SparkSession, out_dir: str, name: str, fmt: str = "parquet") -> DataFrame:
    out_dir = out_dir.rstrip("/")
    _manifest(spark, out_dir)
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("escape", '"')
    return reader.load(f"{out_dir}/{name}")


__all__ = ["AUDIT_TABLES", "read_audit", "read_result", "run_concurrently", "write_result"]
