"""Listing and choosing source files (#1-#3).

The listing uses the ``binaryFile`` source without selecting ``content``,
so only file metadata is touched. Its ``path`` is not percent-encoded, so
the file name (the value of 表名) is exact for names with spaces, ``+``,
``%``, brackets or CJK characters. Spark's lister hides names starting with
``_`` or ``.``; such files must be renamed before they can be merged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetmerge.model import LOCK_FILE_PREFIX, SOURCE_EXTENSIONS


def _file_name(path: F.Column) -> F.Column:
    return F.substring_index(path, "/", -1)


def decoded_file_name(raw: Column | None = None) -> Column:
    """Exact file name from ``_metadata.file_name`` (which is percent-encoded)."""
    raw = F.col("_metadata.file_name") if raw is None else raw
    return F.url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))


def file_filter(chosen: Sequence[str] | None = None, invert: bool = False, exclude: Sequence[str] = ()) -> Column:
    """The choice of source files as a predicate on ``_metadata``.

    It prunes files before they are read, whatever the scan; the names are
    an argument of the run. ``chosen=[]`` chooses nothing; no list at all
    chooses every file (inverted: none). Lock files never pass.
    """
    name = decoded_file_name()
    cond = ~name.startswith(LOCK_FILE_PREFIX)
    if chosen is None:
        hit = F.lit(True)
    elif len(chosen):
        hit = name.isin(list(chosen))
    else:
        hit = F.lit(False)
    cond &= ~hit if invert else hit
    return cond & ~name.isin(list(exclude)) if exclude else cond


def list_files(spark: SparkSession, directory: str) -> DataFrame:
    """Every file directly inside ``directory``. -> (path, file, length)"""
    listed = spark.read.format("binaryFile").load(directory)
    return listed.select("path", _file_name(F.col("path")).alias("file"), "length")


def file_names(spark: SparkSession, directory: str, pattern: str, where: Column | None = None) -> DataFrame:
    """(file) of every file directly inside ``directory`` that matches, files without a byte included.

    Spark's scans pass over empty files; its file index, which the driver
    holds for any scan of the folder, has them. ``where`` is a predicate on
    ``_metadata`` (:func:`file_filter`).
    """
    paths = spark.read.option("pathGlobFilter", pattern).text(directory).inputFiles()
    named = [((path.rpartition("/")[2],),) for path in paths]
    names = spark.createDataFrame(named, "_metadata struct<file_name: string>")
    return (names if where is None else names.where(where)).select(decoded_file_name().alias("file"))


def list_sources(
    spark: SparkSession,
    directory: str,
    skip_lock_files: bool = True,
    exclude: str | None = None,
) -> DataFrame:
    """Source files (.xlsx / .csv, extension case as written) in a directory.

    ``exclude`` = a file name to leave out (the template, when it sits among
    the sources). -> (path, file, format, length)
    """
    pattern = "[.](" + "|".join(e.lstrip(".") for e in SOURCE_EXTENSIONS) + ")$"
    files = list_files(spark, directory).where(F.col("file").rlike(pattern))
    if skip_lock_files:
        files = skip_locks(files)
    if exclude is not None:
        files = files.where(F.col("file") != F.lit(exclude))
    return files.select(
        "path",
        "file",
        F.substring_index("file", ".", -1).alias("format"),
        "length",
    )


def skip_locks(files: DataFrame) -> DataFrame:
    """Drop editor lock files (``~$name.xlsx``)."""
    return files.where(~F.col("file").startswith(LOCK_FILE_PREFIX))


def select_sources(sources: DataFrame, chosen: DataFrame | None = None, invert: bool = False) -> DataFrame:
    """Keep the chosen files (by ``file``); ``invert`` keeps the others.

    No chooser keeps everything (the select-all button).
    """
    if chosen is None:
        return sources if not invert else sources.limit(0)
    how = "left_anti" if invert else "left_semi"
    return sources.join(chosen.select("file").distinct(), "file", how)
