"""

Each query builds its inputs from the driver's Parquet tables (a derived
fixture, ``plans.fixtures``), runs the operator on Spark and returns the
DataFrame; ``ORACLE`` holds the DuckDB SQL computing the same result from
the same tables. Column names and types agree between the two.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetmerge import model
from sheetmerge.functions import col_letter
from sheetmerge.operators import audit, decisions as dec, detect, match, merge, resolve, template
from sheetmerge.plans import oracle
from sheetmerge.plans.fixtures import CUSTOMER, FIXTURES, LINEITEM, THREE, frames
from sheetmerge.plans.job import MergePlan, merge_tables

QueryFn = Callable[[SparkSession, str], DataFrame]

MAIN_SHEET = "BUILDING"  # template sheet shown by merge_sheet
LINEITEM_SHEET = "R"


def _plan(spark: SparkSession, sf_dir: str, fixture: str = "customer") -> MergePlan:
    f = frames(spark, sf_dir, fixture)
    return MergePlan(spark, f.template_headers, f.headers, f.rows, f.decisions)


def _fx(spark, sf_dir, fixture="customer"):
    return frames(spark, sf_dir, fixture)


QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None, fixture: str = "customer"):
    def wrap(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = oracle.with_fixture(fixture, sql)
        return fn

    return wrap


# --- 2.1 template check -------------------------------------------------------
@register(
    "check_template",
    "SELECT sheet, max(CASE WHEN t_idx = 0 THEN name END) AS first_name, "
    f"coalesce(max(CASE WHEN t_idx = 0 THEN name END) = {oracle.q(model.SOURCE_NAME_COLUMN)}, false) AS ok "
    "FROM fx_template GROUP BY sheet",
)
def q_check_template(spark, sf_dir):
    return template.check_template(_fx(spark, sf_dir).template_headers)


# --- 2.2 matching ---------------------------------------------------------------
@register("match_sheets", "SELECT file, sheet FROM matched")
def q_match_sheets(spark, sf_dir):
    f = _fx(spark, sf_dir)
    return match.match_sheets(f.headers, f.template_headers)


@register("unmatched_sheets", "SELECT file, sheet FROM unmatched")
def q_unmatched_sheets(spark, sf_dir):
    f = _fx(spark, sf_dir)
    return match.unmatched_sheets(f.headers, f.template_headers)


@register(
    "match_columns",
    "SELECT h.file, h.sheet, h.col_idx, h.name, t.t_idx FROM fx_headers h "
    "JOIN fx_template t ON t.sheet = h.sheet AND t.name = h.name "
    "WHERE t.t_idx >= 1 AND h.name IS NOT NULL AND h.name <> ''",
)
def q_match_columns(spark, sf_dir):
    f = _fx(spark, sf_dir)
    return match.match_columns(f.headers, f.template_headers)


@register("extra_columns", "SELECT file, sheet, col_idx, name FROM extra")
def q_extra_columns(spark, sf_dir):
    f = _fx(spark, sf_dir)
    return match.extra_columns(f.headers, f.template_headers)


@register("missing_columns", "SELECT file, sheet, name FROM missing")
def q_missing_columns(spark, sf_dir):
    f = _fx(spark, sf_dir)
    return match.missing_columns(f.headers, f.template_headers)


# --- 2.3 detection -----------------------------------------------------------------
@register(
    "duplicate_columns",
    "SELECT file, sheet, name, CAST(count(*) AS INTEGER) AS n_s, "
    "string_agg(CAST(col_idx AS VARCHAR), ',' ORDER BY col_idx) AS col_idxs "
    "FROM fx_headers WHERE name IS NOT NULL AND name <> '' "
    "GROUP BY file, sheet, name HAVING count(*) > 1",
)
def q_duplicate_columns(spark, sf_dir):
    return detect.duplicate_columns(_fx(spark, sf_dir).headers)


@register("column_occurrence", "SELECT file, sheet, col_idx, name, occ, n_s FROM occ")
def q_column_occurrence(spark, sf_dir):
    return detect.column_occurrence(_fx(spark, sf_dir).headers)


@register("blank_headers", "SELECT file, sheet, col_idx FROM blank")
def q_blank_headers(spark, sf_dir):
    return match.blank_headers(_fx(spark, sf_dir).headers)


@register(
    "overflow_columns",
    "SELECT o.file, o.sheet, o.col_idx, coalesce(s.sample, '') AS sample FROM overflow o "
    "LEFT JOIN samples s ON s.file = o.file AND s.sheet = o.sheet AND s.col_idx = o.col_idx",
)
def q_overflow_columns(spark, sf_dir):
    return _plan(spark, sf_dir).overflow


# --- 2.4 duplicate rule --------------------------------------------------------------
@register(
    "dup_value_consistency",
    "SELECT k.file, k.sheet, k.name, k.n_s, coalesce(e.eq, true) AS eq FROM counts k "
    "LEFT JOIN eqs e ON e.file = k.file AND e.sheet = k.sheet AND e.name = k.name WHERE k.n_s >= 2",
)
def q_dup_value_consistency(spark, sf_dir):
    p = _plan(spark, sf_dir)
    return resolve.dup_consistency(p.counts, p.facts)


@register(
    "dup_in_order",
    "SELECT file, sheet, name, t_idx, t_occ, col_idx FROM assign WHERE rule = 'in_order'",
)
def q_dup_in_order(spark, sf_dir):
    return resolve.dup_in_order(_plan(spark, sf_dir).assignment)


@register(
    "dup_by_choice",
    "SELECT file, sheet, name, t_idx, t_occ, col_idx FROM assign WHERE rule = 'choose'",
)
def q_dup_by_choice(spark, sf_dir):
    return resolve.dup_by_choice(_plan(spark, sf_dir).assignment)


@register("dup_rule", "SELECT file, sheet, name, n_s, n_t, eq, rule FROM rules")
def q_dup_rule(spark, sf_dir):
    return _plan(spark, sf_dir).rules


@register("unselected_columns", "SELECT file, sheet, col_idx, name FROM unselected")
def q_unselected_columns(spark, sf_dir):
    return _plan(spark, sf_dir).unselected


# --- 2.5 decisions -------------------------------------------------------------------
@register("apply_decisions", "SELECT file, sheet, kind, col_idx, name, action, operation FROM ops")
def q_apply_decisions(spark, sf_dir):
    return _plan(spark, sf_dir).with_operations.select(
        "file", "sheet", "kind", "col_idx", "name", "action", "operation"
    )


@register(
    "cancel_files",
    "SELECT file, sheet, row_no, CAST(len(vals) AS INTEGER) AS n_vals FROM fx_rows "
    "WHERE file NOT IN (SELECT file FROM cancelled)",
)
def q_cancel_files(spark, sf_dir):
    f = _fx(spark, sf_dir)
    cancelled = dec.cancelled_files(f.decisions, f.headers)
    return dec.cancel_files(f.rows, cancelled).select(
        "file", "sheet", "row_no", F.size("vals").alias("n_vals")
    )


# --- 2.6 projection and append -----------------------------------------------------------
@register(
    "build_mapping",
    "SELECT file, sheet, t_idx, col_idx FROM assign WHERE file NOT IN (SELECT file FROM cancelled)",
)
def q_build_mapping(spark, sf_dir):
    return _plan(spark, sf_dir).mapping.select(
        "file", "sheet", F.posexplode("m").alias("t_idx", "col_idx")
    )


_W = len(CUSTOMER.template.names)


@register(
    "align_columns",
    f"SELECT sheet, file, row_no, {oracle.ident(model.SOURCE_NAME_COLUMN)}, "
    + ", ".join(f"c{k}" for k in range(1, _W))
    + " FROM merged",
)
def q_align_columns(spark, sf_dir):
    return _plan(spark, sf_dir).aligned


@register(
    "truncate_rows",
    "SELECT r.file, r.sheet, r.row_no, CAST(len(list_slice(r.vals, 1, w.width)) AS INTEGER) AS n_vals, "
    "array_to_string(list_transform(list_slice(r.vals, 1, w.width), lambda x: coalesce(x, '∅')), '|') AS vals_text "
    "FROM fx_rows r JOIN width w ON w.file = r.file AND w.sheet = r.sheet",
)
def q_truncate_rows(spark, sf_dir):
    f = _fx(spark, sf_dir)
    cut = merge.truncate_rows(f.rows, match.header_width(f.headers))
    return cut.select(
        "file",
        "sheet",
        "row_no",
        F.size("vals").alias("n_vals"),
        F.array_join("vals", "|", "∅").alias("vals_text"),
    )


@register(
    "fill_source_name",
    f"SELECT sheet, {oracle.ident(model.SOURCE_NAME_COLUMN)}, count(*) AS n_rows FROM merged "
    f"GROUP BY sheet, {oracle.ident(model.SOURCE_NAME_COLUMN)}",
)
def q_fill_source_name(spark, sf_dir):
    return (
        _plan(spark, sf_dir)
        .aligned.groupBy("sheet", model.SOURCE_NAME_COLUMN)
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


@register("merge_sheet", oracle.sheet_select(CUSTOMER, MAIN_SHEET))
def q_merge_sheet(spark, sf_dir):
    return _plan(spark, sf_dir).sheet(MAIN_SHEET)


@register("merge_all", oracle.sheet_select(CUSTOMER, None))
def q_merge_all(spark, sf_dir):
    p = _plan(spark, sf_dir)
    out = None
    for s in sorted(p.layout):
        df = p.sheet(s).select(F.lit(s).alias("sheet"), "*")
        out = df if out is None else out.unionByName(df)
    return out


def whole_result(sheets: dict[str, DataFrame], tables: dict[str, DataFrame]) -> DataFrame:
    """Every merged sheet and every audit table of a merge, one text line a row."""

    def lines(df: DataFrame, part: str, sheet: F.Column, cols: list[str]) -> DataFrame:
        cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("-")) for c in cols]
        return df.select(F.lit(part).alias("part"), sheet.alias("sheet"), F.concat_ws("|", *cells).alias("line"))

    parts = [lines(df, "sheet", F.lit(name), df.columns) for name, df in sheets.items()]
    for name, df in tables.items():
        sheet = F.col("sheet") if "sheet" in df.columns else F.lit("")
        parts.append(lines(df, name, sheet, [c for c in df.columns if c != "sheet"]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _whole(res) -> DataFrame:
    names = ("exceptions", "cancelled", "missing", "unmatched")
    return whole_result(res.sheets, {n: getattr(res, n) for n in names})


@register("merge_lineitem_whole", oracle.whole_result(LINEITEM), fixture="lineitem")
def q_merge_lineitem_whole(spark, sf_dir):
    return _whole(_plan(spark, sf_dir, "lineitem").result())


@register("merge_customer_whole", oracle.whole_result(CUSTOMER))
def q_merge_customer_whole(spark, sf_dir):
    return _whole(_plan(spark, sf_dir).result())


@register("merge_sheet_lineitem", oracle.sheet_select(LINEITEM, LINEITEM_SHEET), fixture="lineitem")
def q_merge_sheet_lineitem(spark, sf_dir):
    return _plan(spark, sf_dir, "lineitem").sheet(LINEITEM_SHEET)


# --- 2.7 audit ------------------------------------------------------------------------
@register(
    "first_five_values",
    "SELECT h.file, h.sheet, h.col_idx, coalesce(string_agg(r.vals[h.col_idx + 1], ',' ORDER BY r.row_no), '') "
    "AS sample FROM fx_headers h LEFT JOIN fx_rows r ON r.file = h.file AND r.sheet = h.sheet AND r.row_no <= 5 "
    "GROUP BY h.file, h.sheet, h.col_idx",
)
def q_first_five_values(spark, sf_dir):
    f = _fx(spark, sf_dir)
    return audit.first_values(f.rows, f.headers)


# indexes around the first of two to seven letters, moved by each customer's key
_LETTER_STEPS = (0, 702, 18_278, 475_254, 12_356_630, 321_272_406)


@register(
    "column_letters",
    f"SELECT CAST(i AS INTEGER) AS col_idx, {oracle.letters_sql('i')} AS col_pos "
    f"FROM (SELECT unnest([{', '.join(f'{x} + c_custkey - 2' for x in _LETTER_STEPS)}]) AS i FROM customer)",
)
def q_column_letters(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir.rstrip('/')}/customer.parquet")
    near = F.explode(F.array(*[(F.lit(x) + F.col("c_custkey") - 2).cast("int") for x in _LETTER_STEPS]))
    return c.select(near.alias("col_idx")).select("col_idx", col_letter("col_idx").alias("col_pos"))


@register(
    "exception_records",
    "SELECT file, sheet, row_scope, col_name, col_pos, sample_values, kind, operation FROM exceptions",
)
def q_exception_records(spark, sf_dir):
    return _plan(spark, sf_dir).exceptions


@register("cancelled_files", "SELECT file, reason FROM cancelled")
def q_cancelled_files(spark, sf_dir):
    return _plan(spark, sf_dir).cancelled


# --- 2.9 end to end -----------------------------------------------------------------------
@register("merge_job_whole", oracle.whole_result(THREE), fixture="three")
def q_merge_job_whole(spark, sf_dir):
    f = _fx(spark, sf_dir, "three")
    return _whole(merge_tables(spark, f.template_headers, f.headers, f.rows, f.decisions))


@register("merge_job", oracle.sheet_select(THREE, model.CSV_SHEET), fixture="three")
def q_merge_job(spark, sf_dir):
    f = _fx(spark, sf_dir, "three")
    res = merge_tables(spark, f.template_headers, f.headers, f.rows, f.decisions)
    return res.sheets[model.CSV_SHEET]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q_merge_job(spark, sf_dir)


__all__ = ["FIXTURES", "ORACLE", "QUERIES", "flagship"]


# --- 2.1 / 2.8 file operators ----------------------------------------------------------------
# Each writes the derived fixture as real files into a fresh folder under the
# shared checkpoint folder (kept: the result is lazy), then reads it back.
from sheetmerge.plans.fixture_files import damage_files, write_files  # noqa: E402
from sheetmerge.session import scratch_path  # noqa: E402
from sheetmerge.sources import csv as csv_source, listing, sink, xlsx  # noqa: E402
from sheetmerge.sources.land import land  # noqa: E402

LOCK_STUB = "~${file}"
XLS_STUB = "{stem}.xls"


def source_dir(spark: SparkSession, sf_dir: str, xlsx_files: bool = True, csv_files: bool = True) -> str:
    out = scratch_path(spark, "sources")
    if xlsx_files:
        f = _fx(spark, sf_dir, "customer")
        write_files(f.headers, f.rows, out, "xlsx", stubs=(LOCK_STUB, XLS_STUB))
    if csv_files:
        f = _fx(spark, sf_dir, "customer_csv")
        write_files(f.headers, f.rows, out, "csv")
    return out


_XLSX_FILE = "'nation_' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || '.xlsx'"
_CSV_FILE = "'nation_' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || '_' || lower(c_mktsegment) || '.csv'"
_LISTED = (
    f"SELECT DISTINCT {_XLSX_FILE} AS file, 'xlsx' AS format FROM customer "
    f"UNION ALL SELECT DISTINCT {_CSV_FILE}, 'csv' FROM customer"
)


def _register_raw(name: str, sql: str | None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


@_register_raw(
    "list_sources",
    _LISTED + f" UNION ALL SELECT DISTINCT '~$' || {_XLSX_FILE}, 'xlsx' FROM customer",
)
def q_list_sources(spark, sf_dir):
    d = source_dir(spark, sf_dir)
    return listing.list_sources(spark, d, skip_lock_files=False).select("file", "format")


@_register_raw("skip_lock_files", _LISTED)
def q_skip_lock_files(spark, sf_dir):
    d = source_dir(spark, sf_dir)
    return listing.list_sources(spark, d).select("file", "format")


@_register_raw(
    "select_sources",
    f"SELECT DISTINCT {_XLSX_FILE} AS file, 'xlsx' AS format FROM customer "
    "JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 0",
)
def q_select_sources(spark, sf_dir):
    d = source_dir(spark, sf_dir, csv_files=False)
    nation = spark.read.parquet(f"{sf_dir.rstrip('/')}/nation.parquet")
    chosen = nation.where(F.col("n_regionkey") == 0).select(
        F.format_string("nation_%02d.xlsx", F.col("n_nationkey")).alias("file")
    )
    return listing.select_sources(listing.list_sources(spark, d), chosen).select("file", "format")


_ROWS_TEXT = (
    "SELECT file, sheet, row_no, array_to_string(list_transform(vals, lambda x: coalesce(x, '∅')), '|') AS vals_text "
    "FROM fx_rows"
)


def _rows_text(rows: DataFrame) -> DataFrame:
    return rows.select("file", "sheet", "row_no", F.array_join("vals", "|", "∅").alias("vals_text"))


@register("scan_csv", _ROWS_TEXT, fixture="customer_csv")
def q_scan_csv(spark, sf_dir):
    d = source_dir(spark, sf_dir, xlsx_files=False)
    _, rows = csv_source.scan_csv(spark, d, listing.list_sources(spark, d))
    return _rows_text(rows)


@register("csv_virtual_sheet", "SELECT file, sheet, col_idx, name FROM fx_headers", fixture="customer_csv")
def q_csv_virtual_sheet(spark, sf_dir):
    d = source_dir(spark, sf_dir, xlsx_files=False)
    headers, _ = csv_source.scan_csv(spark, d)
    return headers


@register("row_numbers", _ROWS_TEXT, fixture="customer_csv")
def q_row_numbers(spark, sf_dir):
    """CSV read with tiny splits: files above one split are checked for quoted
    line breaks and read by several tasks; numbering runs across splits."""
    d = source_dir(spark, sf_dir, xlsx_files=False)
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    spark.conf.set(key, "2048")
    try:
        _, rows = csv_source.scan_csv(spark, d)
    finally:
        spark.conf.set(key, old)
    return _rows_text(rows)


@register("scan_workbooks", _ROWS_TEXT, fixture="customer")
def q_scan_workbooks(spark, sf_dir):
    d = source_dir(spark, sf_dir, csv_files=False)
    _, rows = xlsx.scan_workbooks(spark, d, listing.list_sources(spark, d))
    return _rows_text(rows)


@register("read_template", "SELECT sheet, t_idx, name FROM fx_template", fixture="customer")
def q_read_template(spark, sf_dir):
    out = scratch_path(spark, "template")
    th = _fx(spark, sf_dir, "customer").template_headers
    as_headers = th.select(F.lit("template.xlsx").alias("file"), "sheet", F.col("t_idx").alias("col_idx"), "name")
    write_files(as_headers, as_headers.sparkSession.createDataFrame([], model.ROWS), out, "xlsx")
    return xlsx.read_template(spark, f"{out}/template.xlsx")


@register("write_result", oracle.whole_result("customer_csv"), fixture="customer_csv")
def q_write_result(spark, sf_dir):
    d = source_dir(spark, sf_dir, xlsx_files=False)
    headers, rows = csv_source.scan_csv(spark, d, listing.list_sources(spark, d))
    f = _fx(spark, sf_dir, "customer_csv")
    res = merge_tables(spark, f.template_headers, headers, rows, f.decisions)
    out = scratch_path(spark, "result")
    sink.write_result(res, out)
    return whole_result(sink.read_result(spark, out), {n: sink.read_audit(spark, out, n) for n in sink.AUDIT_TABLES})


@register("merge_files", oracle.whole_result(CUSTOMER), fixture="customer")
def q_merge_files(spark, sf_dir):
    """The whole run from files: 25 workbooks + a template workbook in one folder."""
    from sheetmerge.plans import flow

    d = source_dir(spark, sf_dir, csv_files=False)
    f = _fx(spark, sf_dir, "customer")
    as_headers = f.template_headers.select(
        F.lit("template.xlsx").alias("file"), "sheet", F.col("t_idx").alias("col_idx"), "name"
    )
    write_files(as_headers, spark.createDataFrame([], model.ROWS), d, "xlsx")
    res = flow.merge_files(spark, f"{d}/template.xlsx", d, decisions=f.decisions)
    return _whole(res)


@register(
    "choices_needed",
    "SELECT file, sheet, name, t_idx, t_occ, col_idx FROM assign WHERE rule = 'choose' AND col_idx IS NULL",
)
def q_choices_needed(spark, sf_dir):
    """Pass 1 of the two-pass run: duplicate slots still waiting for a choice."""
    f = _fx(spark, sf_dir)
    from sheetmerge.plans.job import detect_anomalies

    return detect_anomalies(spark, f.template_headers, f.headers, f.rows, f.decisions).choices_needed


# --- CSV quirks over whole tables: files written by Spark, read back by the scan ---------------


def _scan_with_splits(spark: SparkSession, path: str, split_bytes: str) -> DataFrame:
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    spark.conf.set(key, split_bytes)
    try:
        return csv_source.scan_csv(spark, path)[1]
    finally:
        spark.conf.set(key, old)


@_register_raw(
    "scan_csv_wide_late",
    "SELECT CAST(l_orderkey AS VARCHAR) AS k, CASE WHEN l_linenumber = 6 THEN 9 ELSE 2 END AS cells, "
    "CASE WHEN l_linenumber = 6 THEN 'LOST' END AS far FROM lineitem",
)
def q_scan_csv_wide_late(spark, sf_dir):
    """Two columns, and now and then a record with values far to the right
    and nothing where the usual record ends."""
    li = spark.read.parquet(f"{sf_dir.rstrip('/')}/lineitem.parquet")
    wide = F.when(F.col("l_linenumber") == 6, F.lit(",,,,,LOST,,x")).otherwise("")
    line = F.concat(F.col("l_orderkey").cast("string"), F.lit(","), F.col("l_linenumber").cast("string"), wide)
    out = scratch_path(spark, "wide-late")
    raw = li.select(line.alias("A,B")).write.option("header", True)
    raw.option("sep", "\u0001").option("quote", "\u0000").csv(out)
    rows = _scan_with_splits(spark, out, "64k")
    return rows.select(
        F.get("vals", F.lit(0)).alias("k"), F.size("vals").alias("cells"), F.get("vals", F.lit(6)).alias("far")
    )


@_register_raw(
    "scan_csv_split_parity",
    "SELECT CAST(o_orderkey AS VARCHAR) AS k, "
    "'say \"' || o_orderstatus || '\", then' || chr(10) || chr(10) || o_orderkey || ',' AS v, '5\"' AS w FROM orders",
)
def q_scan_csv_split_parity(spark, sf_dir):
    """Values with quotes, commas and line breaks, in splits smaller than the files."""
    o = spark.read.parquet(f"{sf_dir.rstrip('/')}/orders.parquet")
    key = F.col("o_orderkey").cast("string")
    value = F.concat(F.lit('say "'), F.col("o_orderstatus"), F.lit('", then\n\n'), key, F.lit(","))
    out = scratch_path(spark, "parity")
    o.select(key.alias("K"), value.alias("V"), F.lit('5"').alias("W")).write.option("header", True).option("escape", '"').csv(out)
    rows = _scan_with_splits(spark, out, "64k")
    return rows.select(*[F.get("vals", F.lit(i)).alias(c) for i, c in enumerate("kvw")])


_WIDE = 2000  # slots of the template, the source name included
_WIDE_TASKS = 4  # tasks a core that make the wide rows


@_register_raw(
    "merge_wide_template",
    "SELECT 'w_' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') || '.xlsx' AS file, CAST(s_suppkey AS VARCHAR) || '.1' AS first_slot, "
    f"md5(array_to_string(list_transform(range(1, {_WIDE}), lambda k: s_suppkey || '.' || k), '|')) AS slots_md5 FROM supplier",
)
def q_merge_wide_template(spark, sf_dir):
    """A template of 2,000 columns; each source has them in an order of its own."""
    s = spark.read.parquet(f"{sf_dir.rstrip('/')}/supplier.parquet")
    n = _WIDE - 1  # a prime: every step visits all names
    s = s.select("s_suppkey", F.format_string("w_%02d.xlsx", "s_nationkey").alias("file"), (F.col("s_nationkey") + 2).alias("step"))
    # a small file is one task's, and each of its rows becomes 2,000 cells
    s = s.repartition(_WIDE_TASKS * spark.sparkContext.defaultParallelism)
    places = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda c: (c * F.col("step") % n + 1).cast("int"))
    names = F.posexplode(F.transform(places, lambda p: F.concat(F.lit("n"), p.cast("string")))).alias("col_idx", "name")
    headers = s.select("file", "step").distinct().select("file", F.lit("W").alias("sheet"), names)
    vals = F.transform(places, lambda p: F.concat(F.col("s_suppkey").cast("string"), F.lit("."), p.cast("string")))
    rows = s.select("file", F.lit("W").alias("sheet"), F.col("s_suppkey").cast("long").alias("row_no"), vals.alias("vals"))
    slots = [("W", k, f"n{k}" if k else model.SOURCE_NAME_COLUMN) for k in range(_WIDE)]
    merged = merge_tables(spark, spark.createDataFrame(slots, model.TEMPLATE_HEADERS), headers, rows).sheets["W"]
    texts = ", ".join(merge.quoted(c) for c in merged.columns[1:])
    return merged.selectExpr(f"{merge.quoted(model.SOURCE_NAME_COLUMN)} AS file", "n1 AS first_slot", f"md5(concat_ws('|', array({texts}))) AS slots_md5")


_LIMIT = 1 << 16


@register(
    "csv_unreadable_files",
    "SELECT f.file, CASE f.k WHEN 0 THEN 'no record' WHEN 1 THEN 'not UTF-8, in the part from byte 0 on' "
    f"WHEN 2 THEN 'record longer than {_LIMIT} bytes, in the part from byte 0 on' END AS reason, "
    "CASE WHEN f.k > 2 THEN coalesce(r.n, 0) ELSE 0 END AS n_rows "
    "FROM (SELECT file, CAST(substr(file, 8, 2) AS INTEGER) % 5 AS k FROM fx_headers GROUP BY file) f "
    "LEFT JOIN (SELECT file, count(*) AS n FROM fx_rows GROUP BY file) r ON r.file = f.file",
    fixture="customer_csv",
)
def q_csv_unreadable_files(spark, sf_dir):
    """CSV files of three nations in five are damaged: emptied, given bytes that
    aren't UTF-8, or a quote that is never closed; each is cancelled, the rest are read."""
    d = source_dir(spark, sf_dir, xlsx_files=False)
    files = listing.list_sources(spark, d).select("file", (F.substring("file", 8, 2).cast("int") % 5).alias("k"))
    files = land(spark, files, "damaged")  # as they are before
    tail = F.when(F.col("k") == 1, F.unhex(F.lit("636166E92C310A"))).when(
        F.col("k") == 2, F.concat(F.lit(b'"never closed,1\n'), F.repeat(F.lit("a,b\n"), _LIMIT // 4).cast("binary"))
    ).otherwise(F.lit(b""))
    damage_files(files.where("k < 3").select("file", (F.col("k") > 0).alias("keep"), tail.alias("tail")), d)
    _, rows, failed = csv_source.scan_csv_with_failures(spark, d, max_record_bytes=_LIMIT)
    counts = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n_rows"))
    read = files.select("file").join(failed, "file", "left").join(counts, "file", "left")
    return read.select("file", "reason", F.coalesce("n_rows", F.lit(0).cast("long")).alias("n_rows"))


def _merge_chosen(spark: SparkSession, sf_dir: str, invert: bool) -> DataFrame:
    from sheetmerge.plans import flow

    d = source_dir(spark, sf_dir, csv_files=False)
    f = _fx(spark, sf_dir, "customer")
    t = f.template_headers.select(F.lit("template.xlsx").alias("file"), "sheet", F.col("t_idx").alias("col_idx"), "name")
    write_files(t, spark.createDataFrame([], model.ROWS), d, "xlsx")
    low = listing.list_sources(spark, d).where(F.col("file").startswith("nation_0")).select("file")
    chosen = [r["file"] for r in low.collect()]  # at most ten files
    # the template lies in the source folder, spelt another way
    template_path = f"{d}/../{d.rsplit('/', 1)[1]}/template.xlsx"
    return _whole(flow.merge_files(spark, template_path, d, chosen=chosen, invert=invert, decisions=f.decisions))


@register("merge_chosen_files", f"SELECT * FROM ({oracle.whole_result(CUSTOMER)}) WHERE line LIKE 'nation_0%'")
def q_merge_chosen_files(spark, sf_dir):
    return _merge_chosen(spark, sf_dir, invert=False)


@register("merge_other_files", f"SELECT * FROM ({oracle.whole_result(CUSTOMER)}) WHERE line NOT LIKE 'nation_0%'")
def q_merge_other_files(spark, sf_dir):
    return _merge_chosen(spark, sf_dir, invert=True)


@register(
    "cancel_by_policy",
    "SELECT file, reason FROM cancelled UNION ALL "
    f"SELECT DISTINCT a.file, {oracle.q(model.KIND_EXTRA)} FROM anomalies a LEFT JOIN adec d ON d.file = a.file "
    "AND d.sheet = a.sheet AND d.kind = a.kind AND d.col_idx = a.col_idx "
    f"WHERE a.kind = {oracle.q(model.KIND_EXTRA)} AND coalesce(d.action, 'cancel_file') = 'cancel_file' "
    "AND a.file NOT IN (SELECT file FROM cancelled)",
)
def q_cancel_by_policy(spark, sf_dir):
    f = _fx(spark, sf_dir)
    policy = {model.KIND_EXTRA: model.CANCEL_FILE}
    return merge_tables(spark, f.template_headers, f.headers, f.rows, f.decisions, policy=policy).cancelled
