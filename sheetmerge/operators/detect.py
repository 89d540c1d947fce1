"""Anomaly detection (#15-#19) and the one fused pass over ``rows``.

Header-side checks (duplicates, occurrence numbers, blanks) run on
``headers``. The checks that need cell values (does a row overflow its
header, are same-named columns equal on every row, what are the first five
values of a flagged column) are in :func:`scan_rows`: each row is joined to
its sheet's profile and gives a boolean per flagged column, combined
map-side, so the shuffle is proportional to the number of flagged columns,
not to the data; texts come from the first five rows alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetmerge.functions import is_blank, not_blank, ordered_text, pick
from sheetmerge.model import SAMPLE_ROWS
from sheetmerge.operators.template import template_sheets
from sheetmerge.plans.sizing import template_side

FACT_OVERFLOW = "overflow"
FACT_DUP = "dup"
FACT_SAMPLE = "sample"

def column_occurrence(headers: DataFrame) -> DataFrame:
    """k-th column of each name within its header, and the name's count.

    -> (file, sheet, col_idx, name, occ, n_s); blank names are left out.
    A window partition is one name inside one header (<= header width).
    """
    by_name = Window.partitionBy("file", "sheet", "name")
    return headers.where(not_blank("name")).select(
        "file",
        "sheet",
        "col_idx",
        "name",
        F.row_number().over(by_name.orderBy("col_idx")).cast("int").alias("occ"),
        F.count(F.lit(1)).over(by_name).cast("int").alias("n_s"),
    )


def duplicate_columns(headers: DataFrame) -> DataFrame:
    """Names occurring more than once in one source header.

    -> (file, sheet, name, n_s, col_idxs) with col_idxs like '1,2,3'.
    """
    idxs = F.array_join(F.array_sort(F.collect_list("col_idx")).cast("array<string>"), ",")
    return (
        headers.where(not_blank("name"))
        .groupBy("file", "sheet", "name")
        .agg(F.count(F.lit(1)).cast("int").alias("n_s"), idxs.alias("col_idxs"))
        .where(F.col("n_s") > 1)
    )


def annotate_headers(headers: DataFrame, template_headers: DataFrame) -> DataFrame:
    """Every header cell with what the header-side checks need, in one pass.

    -> (file, sheet, col_idx, name, width, n_s, occ, matched, in_template, n_t)

    * width: header width of its sheet; n_s / occ: count and rank of its name
      in the header (null for blank names)
    * matched: a template sheet has this name; in_template: the template
      sheet has this column name (表名 included); n_t: template data slots
      (t_idx >= 1) with this name

    Both windows share one shuffle: the (file, sheet) hash partitioning also
    clusters (file, sheet, name).
    """
    tnames = (
        template_headers.where(not_blank("name"))
        .groupBy("sheet", "name")
        .agg(F.count(F.when(F.col("t_idx") >= 1, F.lit(1))).cast("int").alias("n_t"))
        .withColumn("in_template", F.lit(True))
    )
    tsheets = template_sheets(template_headers).withColumn("matched", F.lit(True))
    by_sheet = Window.partitionBy("file", "sheet")
    by_name = Window.partitionBy("file", "sheet", "name")
    named = not_blank("name")
    return (
        headers.join(template_side(tsheets), "sheet", "left")
        .join(template_side(tnames), ["sheet", "name"], "left")
        .select(
            "file",
            "sheet",
            "col_idx",
            "name",
            F.coalesce(F.max(F.when(named, F.col("col_idx"))).over(by_sheet) + 1, F.lit(0)).cast("int").alias("width"),
            F.when(named, F.count(F.lit(1)).over(by_name)).cast("int").alias("n_s"),
            F.when(named, F.row_number().over(by_name.orderBy("col_idx"))).cast("int").alias("occ"),
            F.coalesce("matched", F.lit(False)).alias("matched"),
            F.coalesce("in_template", F.lit(False)).alias("in_template"),
            F.coalesce("n_t", F.lit(0)).alias("n_t"),
        )
    )


def profile_from_cells(cells: DataFrame) -> DataFrame:
    """Sheet profile (see :func:`sheet_profile`) from annotated header cells, one aggregate."""
    named = not_blank("name")
    is_dup = named & (F.col("n_t") >= 1) & (F.col("n_s") > 1)
    probe = (is_blank("name") & (F.col("col_idx") < F.col("width"))) | (named & ~F.col("in_template")) | is_dup
    agg = (
        cells.where(F.col("matched"))
        .groupBy("file", "sheet")
        .agg(
            F.max("width").alias("width"),
            F.array_sort(F.collect_list(F.when(probe, F.col("col_idx")))).alias("probe"),
            F.array_sort(F.collect_list(F.when(is_dup, F.struct("name", "col_idx")))).alias("pairs"),
        )
    )
    dups = F.transform(
        F.array_distinct(F.transform("pairs", lambda p: p["name"])),
        lambda n: F.struct(
            n.alias("name"),
            F.transform(F.filter("pairs", lambda p: p["name"] == n), lambda p: p["col_idx"]).alias("idxs"),
        ),
    )
    return agg.select("file", "sheet", "width", dups.alias("dups"), "probe")


def sheet_profile(headers: DataFrame, template_headers: DataFrame) -> DataFrame:
    """One row per matched source sheet: what the row scan must look at.

    -> (file, sheet, width, dups array<struct<name, idxs>>, probe array<int>)

    * ``width``: header width (values at or beyond it overflow)
    * ``dups``: same-named columns whose name is a template name, whose
      equality on every row decides step 1 of the duplicate rule
    * ``probe``: positions that may end in the exception table (blank,
      unknown or duplicated names) and so need their first five values
    """
    return profile_from_cells(annotate_headers(headers, template_headers))


def scan_rows(rows: DataFrame, profile: DataFrame) -> DataFrame:
    """The detection pass over the data rows.

    ``profile`` must already carry its join strategy (see ``plans.sizing``).
    -> (file, sheet, fact, name, col_idx, eq, sample)

    * fact 'overflow': a position >= width holding a value in some row;
      sample = its first-five-rows text
    * fact 'dup': name of a same-named group; eq = equal on every row
    * fact 'sample': first-five-rows text of a probed position

    Two branches: what every row decides (is there a value, are the columns
    equal) is a boolean per flagged column, combined map-side in a hash
    aggregate; texts are gathered from the first five rows alone, a filter
    that reaches the scan.
    """
    # each branch is used once: a filter by kind would reach the rows and have them read once a kind
    met = _row_checks(rows, profile).join(_first_texts(rows, profile), ["file", "sheet", "col_idx"], "full_outer")
    checked = F.col("fact").isNotNull()
    return met.where(checked | F.col("probed")).select(
        "file",
        "sheet",
        F.coalesce("fact", F.lit(FACT_SAMPLE)).alias("fact"),
        "name",
        "col_idx",
        F.when(checked, F.col("eq")).otherwise(True).alias("eq"),
        F.when(checked, F.coalesce("sample", F.lit(""))).otherwise(F.col("sample")).alias("sample"),
    )


def _beyond(width: F.Column, n: F.Column) -> F.Column:
    """Positions at or beyond the header that hold a value in this row."""
    none = F.array().cast("array<int>")
    held = F.filter(F.sequence(width, n - 1), lambda p: pick("vals", p).isNotNull())
    return F.when(n > width, held).otherwise(none)


def _row_checks(rows: DataFrame, profile: DataFrame) -> DataFrame:
    """(file, sheet, fact, name, col_idx, eq) over all rows."""
    n, width = F.size("vals"), F.col("width")
    overflow = F.transform(
        _beyond(width, n),
        lambda p: F.struct(
            F.lit(FACT_OVERFLOW).alias("fact"), F.lit(None).cast("string").alias("name"), p.alias("col_idx"), F.lit(True).alias("eq")
        ),
    )
    dups = F.transform(
        "dups",
        lambda d: F.struct(
            F.lit(FACT_DUP).alias("fact"),
            d["name"].alias("name"),
            F.lit(-1).alias("col_idx"),
            (F.size(F.array_distinct(F.transform(d["idxs"], lambda i: pick("vals", i)))) <= 1).alias("eq"),
        ),
    )
    return (
        rows.join(profile, ["file", "sheet"])
        .where((n > width) | (F.size("dups") > 0))
        .select("file", "sheet", F.explode(F.concat(overflow, dups)).alias("e"))
        .groupBy("file", "sheet", F.col("e.fact").alias("fact"), F.col("e.name").alias("name"), F.col("e.col_idx").alias("col_idx"))
        .agg(F.bool_and("e.eq").alias("eq"))
    )


def _first_texts(rows: DataFrame, profile: DataFrame) -> DataFrame:
    """(file, sheet, col_idx, probed, sample) from the first rows of each sheet."""
    n, width = F.size("vals"), F.col("width")
    first = rows.where(F.col("row_no") <= SAMPLE_ROWS).join(profile, ["file", "sheet"])
    at = F.explode(F.concat("probe", _beyond(width, n))).alias("col_idx")
    values = first.select("file", "sheet", "row_no", "vals", "width", at)
    return values.groupBy("file", "sheet", "col_idx").agg(
        F.bool_or(F.col("col_idx") < width).alias("probed"),
        ordered_text(pick("vals", "col_idx"), "row_no").alias("sample"),
    )


def overflow_columns(facts: DataFrame) -> DataFrame:
    """Positions beyond the header that hold data. -> (file, sheet, col_idx, sample)"""
    return facts.where(F.col("fact") == FACT_OVERFLOW).select("file", "sheet", "col_idx", "sample")


def probe_samples(facts: DataFrame) -> DataFrame:
    """First-five text of every probed position. -> (file, sheet, col_idx, sample)"""
    return facts.where(F.col("fact") == FACT_SAMPLE).select("file", "sheet", "col_idx", "sample")


def dup_equality(facts: DataFrame) -> DataFrame:
    """-> (file, sheet, name, eq) for every profiled duplicate group with rows."""
    return facts.where(F.col("fact") == FACT_DUP).select("file", "sheet", "name", "eq")
