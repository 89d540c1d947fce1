"""Dense row numbers within groups, without a per-group window.

``row_number() OVER (PARTITION BY g ORDER BY o)`` sends a whole group to one
task; a group holding a third of all rows would make that task the job.
Here rows are ranged-sorted by (g, o) instead, so a big group spans many
partitions, and each row's number is

    rows of its group in earlier blocks + its offset inside its block

where a block is a stretch of consecutive ids (one sorted partition, or one
file split for the CSV scan). The per-(group, block) counts are a small
table; their prefix sums are the only window, over that small table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from sheetmerge.plans.sizing import DEFAULT_MAX_BROADCAST_BYTES, maybe_broadcast


def block_offsets(
    df: DataFrame,
    group_cols: list[str],
    block_col: str,
    id_col: str,
    max_broadcast_bytes: int = DEFAULT_MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Per (group, block): first id and rows of the group in earlier blocks.

    -> (*group_cols, block_col, _first_id, _offset), landed once; its size is
    observed during that write and decides the broadcast.
    """
    from sheetmerge.sources.land import land

    blocks = df.groupBy(*group_cols, block_col).agg(
        F.min(id_col).alias("_first_id"), F.count(F.lit(1)).alias("_n")
    )
    earlier = Window.partitionBy(*group_cols).orderBy(block_col).rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        *group_cols, block_col, "_first_id", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset")
    )
    obs = Observation("block_offsets")
    key_bytes = F.lit(0)
    for c in group_cols:
        key_bytes = key_bytes + F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0))
    offsets = land(
        df.sparkSession,
        offsets.observe(obs, F.count(F.lit(1)).alias("n"), F.sum(key_bytes).alias("b")),
        "block-offsets",
    )
    got = obs.get
    est = int(got["n"]) * 96 + int(got["b"] or 0)
    return maybe_broadcast(offsets, est, max_broadcast_bytes)


def apply_offsets(df: DataFrame, offsets: DataFrame, group_cols: list[str], block_col: str, id_col: str,
                  base: int = 1) -> DataFrame:
    return (
        df.join(offsets, [*group_cols, block_col])
        .withColumn("row_no", F.col("_offset") + F.col(id_col) - F.col("_first_id") + F.lit(base))
        .drop("_first_id", "_offset")
    )


def block_row_numbers(
    df: DataFrame,
    group_cols: list[str],
    block_col: str,
    id_col: str,
    base: int = 1,
    max_broadcast_bytes: int = DEFAULT_MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Add ``row_no`` (from ``base``) to rows whose ``id_col`` is consecutive
    within each (group, block) and whose blocks are ordered by ``block_col``.

    ``df`` must be stable across evaluations (landed), since it is read twice.
    """
    offsets = block_offsets(df, group_cols, block_col, id_col, max_broadcast_bytes)
    return apply_offsets(df, offsets, group_cols, block_col, id_col, base)


def number_in_order(
    spark: SparkSession,
    df: DataFrame,
    group_cols: list[str],
    order_cols: list[Column | str],
    label: str = "numbered",
) -> DataFrame:
    """Dense 1-based ``row_no`` within ``group_cols`` following ``order_cols``.

    One range shuffle + sort, one landing write (so ids are frozen), then a
    join with the small block-offset table.
    """
    from sheetmerge.sources.land import land

    try:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    except ValueError:  # a non-numeric setting: let the default decide
        n = 200
    keys = [F.col(c) for c in group_cols] + [F.col(c) if isinstance(c, str) else c for c in order_cols]
    keyed = (
        df.repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_blk", F.spark_partition_id())
        .withColumn("_rid", F.monotonically_increasing_id())
    )
    landed = land(spark, keyed, label)
    return block_row_numbers(landed, group_cols, "_blk", "_rid").drop("_blk", "_rid")
