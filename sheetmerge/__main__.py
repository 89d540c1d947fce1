"""Command line: ``python -m sheetmerge {merge,detect} ...`` (or via spark-submit)."""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="sheetmerge", description="Merge similar tables into a template.")
    ap.add_argument("command", choices=["merge", "detect"])
    ap.add_argument("--template", required=True, help="template workbook (.xlsx); column 1 must be 表名")
    ap.add_argument("--sources", required=True, help="folder holding the .xlsx / .csv files")
    ap.add_argument("--out", required=True, help="result folder (must not exist)")
    ap.add_argument("--choose", nargs="*", help="file names to merge (default: all)")
    ap.add_argument("--invert", action="store_true", help="merge every file except the chosen ones")
    ap.add_argument("--decisions", help="CSV with columns file,sheet,kind,name,col_idx,t_occ,action,reason")
    ap.add_argument("--policy", choices=["default", "fail"], default="default")
    ap.add_argument("--format", choices=["parquet", "csv"], default=None)
    ap.add_argument("--local", action="store_true", help="run on a local session instead of the submitted one")
    args = ap.parse_args(argv)

    from pyspark.sql import SparkSession

    from sheetmerge.plans import flow
    from sheetmerge.session import local_session

    spark = local_session() if args.local else SparkSession.builder.getOrCreate()
    kwargs = dict(
        chosen=args.choose,
        invert=args.invert,
        decisions=flow.read_decisions(spark, args.decisions),
        policy="fail" if args.policy == "fail" else None,
    )
    if args.command == "merge":
        res = flow.merge_files(spark, args.template, args.sources, args.out, fmt=args.format or "parquet", **kwargs)
        print(f"merged sheets: {', '.join(res.sheets)}; result in {args.out}")
    else:
        flow.detect_files(spark, args.template, args.sources, args.out, fmt=args.format or "csv", **kwargs)
        print(f"anomalies and open choices in {args.out}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
