"""Audit outputs (#31, #33): samples and the exception table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetmerge.functions import col_letter, ordered_text, pick
from sheetmerge.model import (
    BLANK_COL_NAME,
    KIND_BLANK,
    KIND_EXTRA,
    KIND_OVERFLOW,
    KIND_UNSELECTED,
    SAMPLE_ROWS,
    SCOPE_ALL_ROWS,
    SCOPE_NONE,
)


def first_values(rows: DataFrame, columns: DataFrame, n: int = SAMPLE_ROWS) -> DataFrame:
    """Standalone sample: first ``n`` rows' values of each listed column.

    ``columns`` = (file, sheet, col_idx). The ``row_no <= n`` filter comes
    first so a landed, row_no-sorted table skips almost every row group.
    -> (file, sheet, col_idx, sample); '' when the first rows hold nothing.
    """
    head = rows.where(F.col("row_no") <= n).select("file", "sheet", "row_no", "vals")
    values = head.join(columns.select("file", "sheet", "col_idx"), ["file", "sheet"]).select(
        "file", "sheet", "col_idx", "row_no", pick("vals", "col_idx").alias("v")
    )
    found = values.groupBy("file", "sheet", "col_idx").agg(ordered_text("v", "row_no").alias("sample"))
    return (
        columns.select("file", "sheet", "col_idx")
        .join(found, ["file", "sheet", "col_idx"], "left")
        .select("file", "sheet", "col_idx", F.coalesce("sample", F.lit("")).alias("sample"))
    )


def anomaly_table(
    blank: DataFrame, overflow: DataFrame, extra: DataFrame, unselected: DataFrame
) -> DataFrame:
    """The four kinds in one frame. -> (file, sheet, kind, col_idx, name)"""
    null_name = F.lit(None).cast("string").alias("name")
    return (
        blank.select("file", "sheet", F.lit(KIND_BLANK).alias("kind"), "col_idx", null_name)
        .unionByName(overflow.select("file", "sheet", F.lit(KIND_OVERFLOW).alias("kind"), "col_idx", null_name))
        .unionByName(extra.select("file", "sheet", F.lit(KIND_EXTRA).alias("kind"), "col_idx", "name"))
        .unionByName(unselected.select("file", "sheet", F.lit(KIND_UNSELECTED).alias("kind"), "col_idx", "name"))
    )


def exception_records(with_ops: DataFrame, samples: DataFrame) -> DataFrame:
    """Render anomalies (with ``operation``) as the 8-field exception table.

    ``samples`` = (file, sheet, col_idx, sample) for every anomalous column.
    """
    kind = F.col("kind")
    row_scope = F.when(kind.isin(KIND_BLANK, KIND_OVERFLOW), F.lit(SCOPE_ALL_ROWS)).otherwise(F.lit(SCOPE_NONE))
    col_name = (
        F.when(kind == KIND_BLANK, F.lit(BLANK_COL_NAME))
        .when(kind == KIND_OVERFLOW, F.lit(SCOPE_NONE))
        .otherwise(F.col("name"))
    )
    return with_ops.join(samples, ["file", "sheet", "col_idx"], "left").select(
        "file",
        "sheet",
        row_scope.alias("row_scope"),
        col_name.alias("col_name"),
        col_letter("col_idx").alias("col_pos"),
        F.coalesce("sample", F.lit("")).alias("sample_values"),
        "kind",
        "operation",
    )
