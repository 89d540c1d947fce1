"""Schemas and fixed literals shared by every stage.

Source headers are *data* (rows of ``headers``), never Spark column names:
Spark's own name handling renames duplicates and blanks and folds case, which
would destroy exactly what the audit has to report.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: output literals of the merge (they must appear verbatim) ---
SOURCE_NAME_COLUMN = "表名"  # mandatory first template column, filled with the file name
CSV_SHEET = "Sheet1"  # virtual sheet every CSV file is mapped to
KIND_BLANK = "无列名"  # header cell has no name
KIND_OVERFLOW = "超表头列数"  # data row wider than its header
KIND_EXTRA = "列名不存在于大表"  # source column name not in the template
KIND_UNSELECTED = "同名列未选择"  # duplicate-named column not chosen
BLANK_COL_NAME = "数据异常，无列名"  # col_name written for blank headers
SCOPE_ALL_ROWS = "全部行"  # row_scope for blank / overflow records
SCOPE_NONE = "-"  # row_scope for extra / unselected; col_name for overflow
LOCK_FILE_PREFIX = "~$"
SOURCE_EXTENSIONS = (".xlsx", ".csv")
EXCEPTIONS_TITLE = "异常记录"  # name of the exception output
CANCELLED_TITLE = "取消合并的表名"  # name of the output that lists cancelled files
EXCEPTION_FIELDS = ("文件名", "Sheet", "行号", "列名", "列1位置", "列1值", "异常类型")
SAMPLE_ROWS = 5  # "first five rows" of an anomalous column
# --- end of fixed values ---

KINDS = (KIND_BLANK, KIND_OVERFLOW, KIND_EXTRA, KIND_UNSELECTED)

# Actions a decision (or the default policy) may take.
DROP = "drop"
TRUNCATE = "truncate"
SELECT = "select"
CANCEL_FILE = "cancel_file"
ACTIONS = (DROP, TRUNCATE, SELECT, CANCEL_FILE)

# Outputs beside the sheets: title, and titles of the fields (the operation
# and the reason have no title given; these are ours).
AUDIT_TITLES = {
    "exceptions": (EXCEPTIONS_TITLE, (*EXCEPTION_FIELDS, "操作")),
    "cancelled": (CANCELLED_TITLE, (EXCEPTION_FIELDS[0], "原因")),
}

DEFAULT_POLICY = {
    KIND_BLANK: DROP,
    KIND_OVERFLOW: TRUNCATE,
    KIND_EXTRA: DROP,
    KIND_UNSELECTED: DROP,
}

# Duplicate-name rules (the three steps plus the short case, SURVEY 7.5).
RULE_FILL_ALL = "fill_all"
RULE_IN_ORDER = "in_order"
RULE_CHOOSE = "choose"
RULE_IN_ORDER_SHORT = "in_order_short"

TEMPLATE_HEADERS = T.StructType(
    [
        T.StructField("sheet", T.StringType()),
        T.StructField("t_idx", T.IntegerType()),
        T.StructField("name", T.StringType()),
    ]
)

HEADERS = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("sheet", T.StringType()),
        T.StructField("col_idx", T.IntegerType()),
        T.StructField("name", T.StringType()),
    ]
)

ROWS = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("sheet", T.StringType()),
        T.StructField("row_no", T.LongType()),
        T.StructField("vals", T.ArrayType(T.StringType())),
    ]
)

DECISIONS = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("sheet", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("col_idx", T.IntegerType()),
        T.StructField("t_occ", T.IntegerType()),
        T.StructField("action", T.StringType()),
        T.StructField("reason", T.StringType()),
    ]
)

EXCEPTIONS = T.StructType(
    [
        T.StructField(n, T.StringType())
        for n in (
            "file",
            "sheet",
            "row_scope",
            "col_name",
            "col_pos",
            "sample_values",
            "kind",
            "operation",
        )
    ]
)

CANCELLED = T.StructType(
    [T.StructField("file", T.StringType()), T.StructField("reason", T.StringType())]
)

SOURCES = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("format", T.StringType()),
        T.StructField("length", T.LongType()),
    ]
)
