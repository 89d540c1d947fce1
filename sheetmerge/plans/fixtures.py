"""Multi-file merge inputs derived from the driver's tables (FIXTURES.md 2).

A fixture says how rows of a Parquet table become (file, sheet, row) of a
pretend workbook: which header each file has ("variant") and which values
go under it. Expressions are written once, in the SQL subset Spark and
DuckDB share, so the Spark frames here and the oracle SQL in
``plans.oracle`` are built from the same description.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetmerge import model
from sheetmerge.operators.numbering import number_in_order


@dataclass(frozen=True)
class Variant:
    header: tuple[str | None, ...]
    vals: tuple[str, ...]  # one SQL expression per header cell
    extra_when: str | None = None  # rows wider than the header when true
    extra_vals: tuple[str, ...] = ()


@dataclass(frozen=True)
class Part:
    table: str
    file: str  # SQL expression
    sheet: str  # SQL expression
    variant: str  # SQL expression giving a key of ``variants``
    variants: dict[int, Variant]
    row_no: str | None = None  # SQL expression; else row_number() below
    row_partition: tuple[str, ...] = ()
    row_order: tuple[str, ...] = ()


@dataclass(frozen=True)
class TemplateSpec:
    names: tuple[str, ...]
    sheets: tuple[str, ...] = ()  # literal sheet names, or:
    sheet_table: str | None = None  # derive sheets from a table column
    sheet_expr: str | None = None
    sheet_filter: str | None = None


@dataclass(frozen=True)
class Fixture:
    name: str
    parts: tuple[Part, ...]
    template: TemplateSpec
    decisions: tuple[tuple, ...] = field(default_factory=tuple)


def _dec(file, sheet, kind, name, col_idx, t_occ, action, reason=None):
    return (file, sheet, kind, name, col_idx, t_occ, action, reason)


# ---------------------------------------------------------------------------
# 2.2 customer as 25 files x 5 sheets
# ---------------------------------------------------------------------------
_CK = "cast(c_custkey as string)"
_CN = "c_name"
_CA = "cast(cast(c_acctbal as decimal(12,2)) as string)"
_T1 = "'g' || cast(c_custkey % 3 as string)"
_T1N = "nullif('g' || cast(c_custkey % 3 as string), 'g0')"
_T2 = "'g' || cast(c_custkey % 5 as string)"
_T3 = "'g' || cast(c_custkey % 7 as string)"
_NOTE = "'note' || cast(c_custkey % 4 as string)"
_BLANKV = "'v' || cast(c_custkey % 9 as string)"
_W1 = "nullif('w' || cast(c_custkey % 11 as string), 'w0')"
_W2 = "cast(c_custkey * 3 as string)"

_STEP3 = Variant(("custkey", "tag", "tag", "tag", "name"), (_CK, _T1, _T2, _T3, _CN))
_EXTRA = Variant(("custkey", "name", "note"), (_CK, _CN, _NOTE))

CUSTOMER_VARIANTS = {
    0: Variant(("custkey", "name", "tag", "acctbal"), (_CK, _CN, _T1, _CA)),
    1: Variant(("acctbal", "custkey", "name"), (_CA, _CK, _CN)),
    2: Variant(("custkey", "name", "tag", "tag", "acctbal"), (_CK, _CN, _T1N, _T1N, _CA)),
    3: Variant(("custkey", "name", "tag", "tag", "acctbal"), (_CK, _CN, _T1, _T2, _CA)),
    4: _STEP3,
    5: _STEP3,
    6: _EXTRA,
    7: _EXTRA,
    8: Variant(("custkey", None, "name"), (_CK, _BLANKV, _CN)),
    9: Variant(("custkey", "name"), (_CK, _CN), "c_custkey % 7 = 0", (_W1, _W2)),
}

CUSTOMER_SHEETS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD")  # MACHINERY left out


def _nation_file(k: int) -> str:
    return f"nation_{k:02d}.xlsx"


CUSTOMER_DECISIONS = tuple(
    _dec(_nation_file(k), s, model.KIND_UNSELECTED, "tag", col, occ, model.SELECT)
    for k in (4, 14, 24)
    for s in CUSTOMER_SHEETS
    for col, occ in ((1, 1), (3, 2))
) + tuple(
    _dec(_nation_file(k), "BUILDING", model.KIND_EXTRA, "note", 2, None, model.CANCEL_FILE, "note is not a template column")
    for k in (7, 17)
)

CUSTOMER = Fixture(
    "customer",
    (
        Part(
            table="customer",
            file="'nation_' || lpad(cast(c_nationkey as string), 2, '0') || '.xlsx'",
            sheet="c_mktsegment",
            variant="c_nationkey % 10",
            variants=CUSTOMER_VARIANTS,
            row_partition=("c_nationkey", "c_mktsegment"),
            row_order=("c_custkey",),
        ),
    ),
    TemplateSpec(
        names=(model.SOURCE_NAME_COLUMN, "custkey", "name", "tag", "tag", "acctbal"),
        sheet_table="customer",
        sheet_expr="c_mktsegment",
        sheet_filter="c_mktsegment <> 'MACHINERY'",
    ),
    CUSTOMER_DECISIONS,
)

# The same customer data as CSV files: every (nation, segment) is one file,
# read as the virtual sheet Sheet1 (file operators and the CSV merge).
def _csv_file(k: int, segment: str) -> str:
    return f"nation_{k:02d}_{segment.lower()}.csv"


CUSTOMER_SEGMENTS = CUSTOMER_SHEETS + ("MACHINERY",)

CUSTOMER_CSV = Fixture(
    "customer_csv",
    (
        Part(
            table="customer",
            file="'nation_' || lpad(cast(c_nationkey as string), 2, '0') || '_' || lower(c_mktsegment) || '.csv'",
            sheet=f"'{model.CSV_SHEET}'",
            variant="c_nationkey % 10",
            variants=CUSTOMER_VARIANTS,
            row_partition=("c_nationkey", "c_mktsegment"),
            row_order=("c_custkey",),
        ),
    ),
    TemplateSpec(
        names=(model.SOURCE_NAME_COLUMN, "custkey", "name", "tag", "tag", "acctbal"),
        sheets=(model.CSV_SHEET,),
    ),
    tuple(
        _dec(_csv_file(k, s), model.CSV_SHEET, model.KIND_UNSELECTED, "tag", col, occ, model.SELECT)
        for k in (4, 14, 24)
        for s in CUSTOMER_SEGMENTS
        for col, occ in ((1, 1), (3, 2))
    )
    + tuple(
        _dec(_csv_file(k, "BUILDING"), model.CSV_SHEET, model.KIND_EXTRA, "note", 2, None, model.CANCEL_FILE,
             "note is not a template column")
        for k in (7, 17)
    ),
)

# ---------------------------------------------------------------------------
# 2.3 customer, supplier, nation as three CSV files (the flagship merge)
# ---------------------------------------------------------------------------
THREE = Fixture(
    "three",
    (
        Part(
            table="customer",
            file="'customer.csv'",
            sheet=f"'{model.CSV_SHEET}'",
            variant="0",
            variants={
                0: Variant(
                    ("custkey", "name", "nationkey", "acctbal", "mktsegment"),
                    (_CK, _CN, "cast(c_nationkey as string)", _CA, "c_mktsegment"),
                )
            },
            row_no="c_custkey + 1",
        ),
        Part(
            table="supplier",
            file="'supplier.csv'",
            sheet=f"'{model.CSV_SHEET}'",
            variant="0",
            variants={
                0: Variant(
                    ("suppkey", "name", "nationkey", "acctbal"),
                    (
                        "cast(s_suppkey as string)",
                        "s_name",
                        "cast(s_nationkey as string)",
                        "cast(cast(s_acctbal as decimal(12,2)) as string)",
                    ),
                )
            },
            row_no="s_suppkey + 1",
        ),
        Part(
            table="nation",
            file="'nation.csv'",
            sheet=f"'{model.CSV_SHEET}'",
            variant="0",
            variants={
                0: Variant(
                    ("nationkey", "name", "regionkey"),
                    ("cast(n_nationkey as string)", "n_name", "cast(n_regionkey as string)"),
                )
            },
            row_no="n_nationkey + 1",
        ),
    ),
    TemplateSpec(
        names=(model.SOURCE_NAME_COLUMN, "name", "nationkey", "acctbal", "mktsegment"),
        sheets=(model.CSV_SHEET,),
    ),
)

# ---------------------------------------------------------------------------
# 2.4 lineitem as 200 files x 3 sheets (bench)
# ---------------------------------------------------------------------------
_L = {
    "orderkey": "cast(l_orderkey as string)",
    "partkey": "cast(l_partkey as string)",
    "suppkey": "cast(l_suppkey as string)",
    "linenumber": "cast(l_linenumber as string)",
    "quantity": "cast(cast(l_quantity as decimal(12,2)) as string)",
    "extendedprice": "cast(cast(l_extendedprice as decimal(12,2)) as string)",
    "discount": "cast(cast(l_discount as decimal(12,2)) as string)",
    "tax": "cast(cast(l_tax as decimal(12,2)) as string)",
    "returnflag": "l_returnflag",
    "linestatus": "l_linestatus",
    "shipdate": "cast(cast(l_shipdate as date) as string)",
}
_LN = tuple(_L)  # natural order


def _lv(names, extra_when=None, extra_vals=(), overrides=None):
    overrides = overrides or {}
    vals = tuple(overrides[i] if i in overrides else _L[n] for i, n in enumerate(names))
    return Variant(tuple(names), vals, extra_when, extra_vals)


LINEITEM_VARIANTS = {
    0: _lv(_LN),
    1: _lv(("returnflag", "linestatus", "orderkey", "partkey", "suppkey", "linenumber", "quantity", "extendedprice", "shipdate")),
    2: _lv(_LN + ("quantity",)),
    3: _lv(_LN + ("tax",), overrides={11: _L["discount"]}),
    4: _lv(_LN + ("comment",), overrides={11: "'c' || cast(l_linenumber as string)"}),
    5: _lv(_LN[:4] + (None,) + _LN[4:], overrides={4: "cast(l_linenumber * 2 as string)"}),
    6: _lv(_LN, "l_linenumber = 1", ("'x' || cast(l_partkey % 13 as string)", "cast(l_suppkey as string)")),
    7: _lv(tuple(reversed(_LN))),
    8: _lv(_LN + ("comment",), overrides={11: "'c' || cast(l_linenumber as string)"}),
    9: _lv(_LN[5:] + _LN[:5]),
}

LINEITEM_TEMPLATE_NAMES = (model.SOURCE_NAME_COLUMN,) + (
    "returnflag",
    "linestatus",
    "shipdate",
    "orderkey",
    "linenumber",
    "partkey",
    "suppkey",
    "quantity",
    "extendedprice",
    "discount",
    "tax",
)

LINEITEM = Fixture(
    "lineitem",
    (
        Part(
            table="lineitem",
            file="'supp_' || lpad(cast(l_suppkey % 200 as string), 3, '0') || '.xlsx'",
            sheet="l_returnflag",
            variant="l_suppkey % 10",
            variants=LINEITEM_VARIANTS,
            row_partition=("l_suppkey % 200", "l_returnflag"),
            row_order=("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"),
        ),
    ),
    TemplateSpec(names=LINEITEM_TEMPLATE_NAMES, sheets=("A", "N", "R")),
    tuple(
        _dec(f"supp_{k:03d}.xlsx", "N", model.KIND_EXTRA, "comment", 11, None, model.CANCEL_FILE, "comment column")
        for k in range(8, 200, 10)
    ),
)

# lineitem as CSV files: one file per (supplier group, return flag), sheet Sheet1
LINEITEM_CSV = Fixture(
    "lineitem_csv",
    (
        Part(
            table="lineitem",
            file="'supp_' || lpad(cast(l_suppkey % 200 as string), 3, '0') || '_' || lower(l_returnflag) || '.csv'",
            sheet=f"'{model.CSV_SHEET}'",
            variant="l_suppkey % 10",
            variants=LINEITEM_VARIANTS,
            row_partition=("l_suppkey % 200", "l_returnflag"),
            row_order=("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"),
        ),
    ),
    TemplateSpec(names=LINEITEM_TEMPLATE_NAMES, sheets=(model.CSV_SHEET,)),
    tuple(
        _dec(f"supp_{k:03d}_n.csv", model.CSV_SHEET, model.KIND_EXTRA, "comment", 11, None, model.CANCEL_FILE,
             "comment column")
        for k in range(8, 200, 10)
    ),
)

FIXTURES = {f.name: f for f in (CUSTOMER, CUSTOMER_CSV, THREE, LINEITEM, LINEITEM_CSV)}


# ---------------------------------------------------------------------------
# Spark side
# ---------------------------------------------------------------------------
def _case_array(part: Part, pick) -> str:
    """CASE <variant> WHEN k THEN array(...) ... END in Spark SQL."""
    whens = " ".join(f"WHEN {k} THEN {pick(v)}" for k, v in sorted(part.variants.items()))
    return f"CASE {part.variant} {whens} END"


def _spark_array(items) -> str:
    return "array(" + ", ".join(items) + ")"


def _spark_vals(v: Variant) -> str:
    base = _spark_array(v.vals)
    if v.extra_when is None:
        return base
    wide = _spark_array(v.vals + v.extra_vals)
    return f"CASE WHEN {v.extra_when} THEN {wide} ELSE {base} END"


def _spark_header(v: Variant) -> str:
    return _spark_array("NULL" if n is None else _sql_str(n) for n in v.header)


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def part_rows(spark: SparkSession, sf_dir: str, part: Part) -> DataFrame:
    base = _table(spark, sf_dir, part.table)
    cols = [
        F.expr(part.file).alias("file"),
        F.expr(part.sheet).alias("sheet"),
        F.expr(_case_array(part, _spark_vals)).alias("vals"),
    ]
    if part.row_no is not None:
        return base.select(cols[0], cols[1], F.expr(part.row_no).cast("long").alias("row_no"), cols[2])
    # dense numbers per (file, sheet) in the fixture's order; no per-group window. The
    # table's own columns are sorted and landed, not the texts made of them
    texts = " ".join((_case_array(part, _spark_vals), *part.row_order))
    used = [c for c in base.columns if re.search(rf"\b{re.escape(c)}\b", texts)]
    order = [F.expr(e) for e in part.row_order]
    numbered = number_in_order(spark, base.select(*cols[:2], *used), ["file", "sheet"], order, "fixture-rows")
    return numbered.select("file", "sheet", F.col("row_no").cast("long"), cols[2])


def part_headers(spark: SparkSession, sf_dir: str, part: Part) -> DataFrame:
    base = _table(spark, sf_dir, part.table)
    keys = [F.expr(part.file).alias("file"), F.expr(part.sheet).alias("sheet"), F.expr(part.variant).alias("variant")]
    header = _case_array(replace(part, variant="variant"), _spark_header)
    # the rows are told apart by their variant; two variants may have one header
    sheets = base.select(*keys).distinct().select("file", "sheet", F.expr(header).alias("h")).distinct()
    return sheets.select("file", "sheet", F.posexplode("h").alias("col_idx", "name")).select(
        "file", "sheet", F.col("col_idx").cast("int"), "name"
    )


def template_frame(spark: SparkSession, sf_dir: str, spec: TemplateSpec) -> DataFrame:
    names = F.array(*[F.lit(n) for n in spec.names])
    if spec.sheet_table:
        base = _table(spark, sf_dir, spec.sheet_table)
        if spec.sheet_filter:
            base = base.where(F.expr(spec.sheet_filter))
        sheets = base.select(F.expr(spec.sheet_expr).alias("sheet")).distinct()
    else:
        sheets = spark.createDataFrame([(s,) for s in spec.sheets], "sheet string")
    return sheets.select("sheet", F.posexplode(names).alias("t_idx", "name")).select(
        "sheet", F.col("t_idx").cast("int"), "name"
    )


@dataclass
class FixtureFrames:
    template_headers: DataFrame
    headers: DataFrame
    rows: DataFrame
    decisions: DataFrame


def frames(spark: SparkSession, sf_dir: str, fixture: Fixture | str) -> FixtureFrames:
    fx = FIXTURES[fixture] if isinstance(fixture, str) else fixture
    headers = rows = None
    for part in fx.parts:
        h, r = part_headers(spark, sf_dir, part), part_rows(spark, sf_dir, part)
        headers = h if headers is None else headers.unionByName(h)
        rows = r if rows is None else rows.unionByName(r)
    return FixtureFrames(
        template_frame(spark, sf_dir, fx.template),
        headers,
        rows,
        spark.createDataFrame(list(fx.decisions), model.DECISIONS),
    )
