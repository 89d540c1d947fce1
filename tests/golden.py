"""The golden example of FIXTURES.md section 1 as DataFrames."""

from sheetmerge import model

TEMPLATE = {
    "NAME1": ["表名", "A", "T", "T", "B"],
    "NAME2": ["表名", "A", "C"],
}

SOURCES = [
    ("小表1.xlsx", "NAME1", ["A", "T", "T", "T", "B"], [["a1", "1", "7", "x1", "b1"], ["a2", "2", "8", "x2", "b2"]]),
    ("小表2.xlsx", "NAME1", ["B", "T", "T", "111"], [["b3", "5", "5", "111"], ["b4", "6", "6", "222"]]),
    (
        "小表3.xlsx",
        "NAME1",
        ["A", "T", None, "T"],
        [["a5", "1", "v1", "2"], ["a6", "3", "v2", "4", "45"], ["a7", "5", "v3", "6", "67"]],
    ),
    ("小表3.xlsx", "NAME2", ["A", "C"], [["a8", "c8"]]),
    ("小表4.csv", "Sheet1", ["A"], [["a9"]]),
    ("小表5.xlsx", "NAME1", ["A", "Z"], [["a10", "z1"]]),
]

DECISIONS = [
    ("小表1.xlsx", "NAME1", model.KIND_UNSELECTED, "T", 1, 1, model.SELECT, None),
    ("小表1.xlsx", "NAME1", model.KIND_UNSELECTED, "T", 3, 2, model.SELECT, None),
    ("小表5.xlsx", "NAME1", model.KIND_EXTRA, "Z", 1, None, model.CANCEL_FILE, "unexpected column Z"),
]


def frames(spark, template=TEMPLATE, sources=SOURCES, decisions=DECISIONS):
    th = spark.createDataFrame(
        [(s, i, n) for s, names in template.items() for i, n in enumerate(names)], model.TEMPLATE_HEADERS
    )
    headers = spark.createDataFrame(
        [(f, s, i, n) for f, s, names, _ in sources for i, n in enumerate(names or [None])], model.HEADERS
    )
    rows = spark.createDataFrame(
        [(f, s, r + 1, vals) for f, s, _, data in sources for r, vals in enumerate(data)], model.ROWS
    )
    dec = spark.createDataFrame(decisions, model.DECISIONS)
    return th, headers, rows, dec
