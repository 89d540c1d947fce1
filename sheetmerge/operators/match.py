"""Matching sheets and columns by exact name (#10-#14).

Everything here works on ``headers`` (one row per header cell), which is
small next to ``rows``; the template side is broadcast (bounded, see
``template.py``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetmerge.functions import is_blank, not_blank
from sheetmerge.operators.template import template_sheets
from sheetmerge.plans.sizing import template_side


def header_width(headers: DataFrame) -> DataFrame:
    """Header width = position of the last named cell + 1 (0 if none).

    Blank cells before it are unnamed columns; values beyond it overflow.
    -> (file, sheet, width)
    """
    last_named = F.max(F.when(not_blank("name"), F.col("col_idx")))
    return headers.groupBy("file", "sheet").agg(
        F.coalesce(last_named + 1, F.lit(0)).cast("int").alias("width")
    )


def file_sheets(headers: DataFrame) -> DataFrame:
    return headers.select("file", "sheet").distinct()


def match_sheets(headers: DataFrame, template_headers: DataFrame) -> DataFrame:
    """Source sheets that have a same-named template sheet. -> (file, sheet)"""
    return file_sheets(headers).join(
        template_side(template_sheets(template_headers)), "sheet", "left_semi"
    ).select("file", "sheet")


def unmatched_sheets(headers: DataFrame, template_headers: DataFrame) -> DataFrame:
    """Source sheets no template sheet is named after (not merged). -> (file, sheet)"""
    return file_sheets(headers).join(
        template_side(template_sheets(template_headers)), "sheet", "left_anti"
    ).select("file", "sheet")


def match_columns(headers: DataFrame, template_headers: DataFrame) -> DataFrame:
    """Every (source column, template slot) pair with exactly equal names.

    Slot 0 (表名) is left out: it always takes the file name.
    -> (file, sheet, col_idx, name, t_idx)
    """
    slots = template_headers.where((F.col("t_idx") >= 1) & not_blank("name")).select(
        "sheet", "name", "t_idx"
    )
    return (
        headers.where(not_blank("name"))
        .join(template_side(slots), ["sheet", "name"])
        .select("file", "sheet", "col_idx", "name", "t_idx")
    )


def extra_columns(headers: DataFrame, template_headers: DataFrame) -> DataFrame:
    """Named source columns of a matched sheet whose name the template sheet lacks.

    -> (file, sheet, col_idx, name)
    """
    names = template_headers.where(not_blank("name")).select("sheet", "name").distinct()
    return (
        headers.where(not_blank("name"))
        .join(template_side(template_sheets(template_headers)), "sheet", "left_semi")
        .join(template_side(names), ["sheet", "name"], "left_anti")
        .select("file", "sheet", "col_idx", "name")
    )


def missing_columns(headers: DataFrame, template_headers: DataFrame) -> DataFrame:
    """Template names (slot 0 excepted) a matched source sheet does not have.

    -> (file, sheet, name), one row per distinct name.
    """
    wanted = (
        template_headers.where((F.col("t_idx") >= 1) & not_blank("name"))
        .select("sheet", "name")
        .distinct()
    )
    present = headers.where(not_blank("name")).select("file", "sheet", "name")
    return (
        match_sheets(headers, template_headers)
        .join(template_side(wanted), "sheet")
        .join(present, ["file", "sheet", "name"], "left_anti")
        .select("file", "sheet", "name")
    )


def blank_headers(headers: DataFrame) -> DataFrame:
    """Unnamed header cells inside the header width. -> (file, sheet, col_idx)"""
    return (
        headers.where(is_blank("name"))
        .join(header_width(headers), ["file", "sheet"])
        .where(F.col("col_idx") < F.col("width"))
        .select("file", "sheet", "col_idx")
    )
