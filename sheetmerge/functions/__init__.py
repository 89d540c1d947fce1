"""Column expressions (JVM-side, no UDFs)."""

from sheetmerge.functions.columns import (
    col_letter,
    is_blank,
    not_blank,
    ordered_text,
    pick,
)

__all__ = ["col_letter", "is_blank", "not_blank", "ordered_text", "pick"]
