"""Landing: write a scanned table once to the shared folder and read it back.

Parsing files is the expensive part of a scan and ``monotonically_
increasing_id`` is only stable within one execution, so each scan is
written to Parquet under ``spark.checkpoint.dir`` exactly once; every later
stage reads the landed copy (pruned columns, pushed filters) and a lost
executor never forces a re-parse.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sheetmerge.session import scratch_path


def land(spark: SparkSession, df: DataFrame, label: str, path: str | None = None,
         partition_by: tuple[str, ...] = ()) -> DataFrame:
    target = path or scratch_path(spark, label)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(target)
    # read back with the written schema: partition values stay strings (a
    # sheet named '01' or '2024' must not come back as a number)
    return spark.read.schema(df.schema).parquet(target)
