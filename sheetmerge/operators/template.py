"""Template operators (#9 and the slot table every later step joins on).

The template is one workbook's header rows: at most 16,384 cells per sheet
(the xlsx column limit), so it is the one input that is always safe to
broadcast and to collect for building output schemas.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetmerge.functions import not_blank
from sheetmerge.model import SOURCE_NAME_COLUMN


def template_slots(template_headers: DataFrame) -> DataFrame:
    """Named data slots (t_idx >= 1) with their occurrence number.

    -> (sheet, t_idx, name, t_occ, n_t); t_occ is the k-th slot of that name,
    n_t how many slots carry it.
    """
    by_name = Window.partitionBy("sheet", "name")
    return template_headers.where((F.col("t_idx") >= 1) & not_blank("name")).select(
        "sheet",
        "t_idx",
        "name",
        F.row_number().over(by_name.orderBy("t_idx")).cast("int").alias("t_occ"),
        F.count(F.lit(1)).over(by_name).cast("int").alias("n_t"),
    )


def template_sheets(template_headers: DataFrame) -> DataFrame:
    return template_headers.select("sheet").distinct()


def check_template(template_headers: DataFrame) -> DataFrame:
    """Per template sheet: its first column name and whether it is 表名.

    -> (sheet, first_name, ok). A sheet without a cell at t_idx 0 fails.
    """
    first = F.max(F.when(F.col("t_idx") == 0, F.col("name")))
    return (
        template_headers.groupBy("sheet")
        .agg(first.alias("first_name"))
        .select(
            "sheet",
            "first_name",
            F.coalesce(F.col("first_name") == F.lit(SOURCE_NAME_COLUMN), F.lit(False)).alias("ok"),
        )
    )


def template_violations(template_headers: DataFrame) -> DataFrame:
    return check_template(template_headers).where(~F.col("ok"))


def assert_template(template_headers: DataFrame) -> None:
    """Fail fast unless column 1 of every template sheet is 表名."""
    bad = template_violations(template_headers).limit(5).collect()
    if bad:
        detail = ", ".join(f"{r['sheet']!r}: {r['first_name']!r}" for r in bad)
        raise ValueError(f"template column 1 must be {SOURCE_NAME_COLUMN!r}; got {detail}")


def template_layout(template_headers: DataFrame) -> dict[str, list[str | None]]:
    """sheet -> template names by position (driver side; bounded, see module doc)."""
    layout: dict[str, dict[int, str | None]] = {}
    for r in template_headers.select("sheet", "t_idx", "name").collect():
        layout.setdefault(r["sheet"], {})[r["t_idx"]] = r["name"]
    return {
        s: [cells.get(i) for i in range(max(cells) + 1)] for s, cells in layout.items()
    }


def check_layout(layout: dict[str, list[str | None]]) -> None:
    """Same rule as :func:`assert_template`, on the collected layout."""
    bad = {s: names[0] if names else None for s, names in layout.items() if not names or names[0] != SOURCE_NAME_COLUMN}
    if bad:
        raise ValueError(f"template column 1 must be {SOURCE_NAME_COLUMN!r}; got {bad}")
