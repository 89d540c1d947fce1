"""Projection and append (#27-#30).

Alignment is one narrow stage over ``rows``: each row meets its sheet's
index array (a broadcast join when the map is small enough, a shuffle join
with AQE skew splitting otherwise) and every template slot becomes
``get(vals, m[k])``. No explode, no pivot, no per-file plan. A wide template
(more than ``WIDE`` slots) is aligned as one array, by one ``transform`` over the
index array, and its entries get their names after that, so the work per
row is one expression however wide the template is.

Projections are written as SQL texts: a template may have 16,384 columns,
and as many column objects take minutes to build.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetmerge.model import SOURCE_NAME_COLUMN

SLOT_PREFIX = "c"

#: Templates of more slots than this are aligned as one array.
WIDE = 200


def slot_column(k: int) -> str:
    return f"{SLOT_PREFIX}{k}"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def align(rows: DataFrame, mapping: DataFrame, width: int) -> DataFrame:
    """Put every value under its template slot.

    ``mapping`` (file, sheet, m) must already carry its join strategy.
    ``width`` = widest template sheet. Rows of sheets/files absent from the
    mapping (unmatched sheets, cancelled files) fall away in the inner join.
    -> (sheet, file, row_no, 表名, c1 .. c{width-1})
    """
    met, value = rows.join(mapping, ["file", "sheet"]), "get(vals, get(m, {}))"
    if width > WIDE:
        slots = F.transform("m", lambda i: F.get("vals", i)).alias("slots")
        met, value = met.select("sheet", "file", "row_no", slots), "get(slots, {})"
    slots = [f"{value.format(k)} AS {slot_column(k)}" for k in range(1, width)]
    return met.selectExpr("sheet", "file", "row_no", f"file AS {quoted(SOURCE_NAME_COLUMN)}", *slots)


def truncate_rows(rows: DataFrame, widths: DataFrame) -> DataFrame:
    """Cut values at or beyond the header width. ``widths`` = (file, sheet, width),
    broadcast after a size check (it grows with the number of sheets)."""
    from sheetmerge.plans.sizing import broadcast_if_small

    return rows.join(broadcast_if_small(widths), ["file", "sheet"]).select(
        "file",
        "sheet",
        "row_no",
        F.when(F.size("vals") > F.col("width"), F.slice("vals", 1, F.col("width")))
        .otherwise(F.col("vals"))
        .alias("vals"),
    )


def physical_names(names: list[str | None]) -> list[str]:
    """Unique (case-insensitively) output names for a template sheet.

    Position 0 is 表名. A repeated name gets '__2', '__3' ...; an unnamed
    slot is '_c<k>'. The template text itself is kept by ``sheet_frame``'s
    column metadata.
    """
    out: list[str] = []
    taken: set[str] = set()
    for k, raw in enumerate(names):
        base = SOURCE_NAME_COLUMN if k == 0 else (raw if raw else f"_c{k}")
        cand, n = base, 1
        while cand.lower() in taken:
            n += 1
            cand = f"{base}__{n}"
        taken.add(cand.lower())
        out.append(cand)
    return out


def sheet_frame(aligned: DataFrame, sheet: str, names: list[str | None]) -> DataFrame:
    """One template sheet with its own column names, in template order."""
    phys = physical_names(names)
    slots = [SOURCE_NAME_COLUMN, *(slot_column(k) for k in range(1, len(names)))]
    named = aligned.where(F.col("sheet") == F.lit(sheet)).selectExpr(
        *(f"{quoted(slot)} AS {quoted(name)}" for slot, name in zip(slots, phys, strict=True))
    )
    texts = [SOURCE_NAME_COLUMN, *(name or "" for name in names[1:])]
    fields = [T.StructField(f.name, f.dataType, f.nullable, {"template_name": t}) for f, t in zip(named.schema.fields, texts, strict=True)]
    return named.to(T.StructType(fields))
