"""Scalar and aggregate expressions used across the operators.

All of them are built from ``pyspark.sql.functions`` so they stay inside the
JVM (and, except for the ordered aggregate, inside whole-stage codegen).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MAX_LETTERS = 7  # the largest int (2,147,483,646) is FXSHRXW


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def col_letter(idx: Column | str, max_letters: int = _MAX_LETTERS) -> Column:
    """0-based column index -> spreadsheet letters (0 -> A, 25 -> Z, 26 -> AA).

    Bijective base-26, unrolled to ``max_letters`` digits so it is a plain
    arithmetic expression (codegen, no Python).
    """
    idx = _c(idx)
    n = idx.cast("long") + 1
    digits = []
    for _ in range(max_letters):
        digit = F.char(F.lit(65) + F.pmod(n - 1, F.lit(26)))
        digits.append(F.when(n >= 1, digit).otherwise(F.lit("")))
        n = F.floor((n - 1) / 26)
    return F.when(idx >= 0, F.concat(*reversed(digits)))


def is_blank(name: Column | str) -> Column:
    """Header cell without a name: null or empty (no trimming, names are exact)."""
    name = _c(name)
    return name.isNull() | (name == F.lit(""))


def not_blank(name: Column | str) -> Column:
    name = _c(name)
    return name.isNotNull() & (name != F.lit(""))


def pick(vals: Column | str, idx: Column | str | int) -> Column:
    """0-based value of a ragged row; null when the row is shorter or idx is null.

    ``get`` instead of ``vals[i]``: under ANSI mode the subscript raises on an
    out-of-range index, ``get`` returns null.
    """
    idx = F.lit(idx) if isinstance(idx, int) else _c(idx)
    return F.get(_c(vals), idx)


def ordered_text(value: Column | str, order: Column | str, sep: str = ",") -> Column:
    """Aggregate: non-null values joined by ``sep`` in ``order``; '' when none.

    Nulls never enter the buffer (``collect_list`` skips the null struct), so
    it holds only the values that end up in the text; callers feed it at most
    five per group.
    """
    value, order = _c(value), _c(order)
    entry = F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v")))
    ordered = F.array_sort(F.collect_list(entry))
    return F.array_join(F.transform(ordered, lambda e: e["v"]), sep)
