"""Size-checked broadcast.

Every join between ``rows`` (the data) and a per-sheet table (profile,
column map) is keyed by (file, sheet). Those tables grow with the number of
source sheets, not with the data, but a landing directory of millions of
files makes them large too. So the broadcast is decided from a measured
size, and above the limit the join is left to a shuffle join, where AQE's
skew handling splits a file that holds a large share of all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_MAX_BROADCAST_BYTES = 256 << 20
_ROW_OVERHEAD = 64  # UnsafeRow header, null bits, offsets
_INT_BYTES = 4


@dataclass(frozen=True)
class SheetStats:
    """Measured once per job from the (header-sized) sheet profile."""

    n_sheets: int
    key_bytes: int  # sum of the bytes of file and sheet
    profile_ints: int  # sum of probe + duplicate index entries

    def profile_bytes(self) -> int:
        return self.n_sheets * (_ROW_OVERHEAD + 48) + self.key_bytes + _INT_BYTES * self.profile_ints

    def mapping_bytes(self, template_width: int) -> int:
        return self.n_sheets * (_ROW_OVERHEAD + 16 + _INT_BYTES * template_width) + self.key_bytes


def profile_metrics() -> list[F.Column]:
    """Aggregates giving :class:`SheetStats`; usable in ``agg`` or ``observe``."""
    dup_ints = F.aggregate("dups", F.lit(0), lambda acc, d: acc + F.size(d["idxs"]) + 1)
    return [
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.octet_length("file") + F.octet_length("sheet")), F.lit(0)).alias("k"),
        F.coalesce(F.sum(F.size("probe") + dup_ints), F.lit(0)).alias("i"),
    ]


def stats_from_metrics(row) -> SheetStats:
    return SheetStats(int(row["n"]), int(row["k"] or 0), int(row["i"] or 0))


def measure_profile(profile: DataFrame) -> SheetStats:
    """Separate job; the merge plan instead observes these while landing the profile."""
    return stats_from_metrics(profile.agg(*profile_metrics()).collect()[0])


def maybe_broadcast(df: DataFrame, est_bytes: int, limit: int) -> DataFrame:
    return F.broadcast(df) if est_bytes <= limit else df


XLSX_MAX_COLUMNS = 16_384


def template_side(df: DataFrame) -> DataFrame:
    """Broadcast a table derived from the template header alone.

    Bound: a template sheet has at most 16,384 columns (the xlsx limit), so
    such a table holds at most 16,384 rows per template sheet, whatever the
    size of the sources.
    """
    return F.broadcast(df)


def small_enough(df: DataFrame, limit: int = DEFAULT_MAX_BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """A key table, written once, and whether its measured size (rows and
    string bytes) allows a broadcast."""
    from sheetmerge.sources.land import land

    strings = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    key_bytes = F.lit(0)
    for c in strings:
        key_bytes = key_bytes + F.coalesce(F.octet_length(c), F.lit(0))
    landed = land(df.sparkSession, df, "keys")
    got = landed.agg(F.count(F.lit(1)).alias("n"), F.sum(key_bytes).alias("b")).collect()[0]
    return landed, int(got["n"]) * _ROW_OVERHEAD + int(got["b"] or 0) <= limit


def broadcast_if_small(df: DataFrame, limit: int = DEFAULT_MAX_BROADCAST_BYTES) -> DataFrame:
    """Broadcast a key table only under ``limit``; otherwise leave the join to Spark."""
    landed, small = small_enough(df, limit)
    return F.broadcast(landed) if small else landed
