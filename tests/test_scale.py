"""How often rows are read, what is landed of them, and how many tasks make them."""

import pytest
from pyspark.sql import functions as F

from sheetmerge.operators import detect
from sheetmerge.plans import catalog, fixtures
from tests.golden import frames


def test_detection_reads_the_rows_once_a_branch(spark, tmp_path, capsys):
    sources = [
        ("f.xlsx", "S", ["T", "U", "T", "X"], [["a", "u", "a", "x"], ["b", "u", "c", None, "far"]]),
        ("g.xlsx", "S", ["T", "T"], [["a", "a"]]),
    ]
    th, h, r, _ = frames(spark, template={"S": ["表名", "T", "T", "U"]}, sources=sources, decisions=[])
    r.write.parquet(f"{tmp_path}/rows")
    rows = spark.read.schema(r.schema).parquet(f"{tmp_path}/rows")
    facts = detect.scan_rows(rows, F.broadcast(detect.sheet_profile(h, th)))
    facts.explain()
    assert capsys.readouterr().out.count("FileScan parquet") == 2
    got = {(x["file"], x["fact"], x["name"], x["col_idx"], x["eq"], x["sample"]) for x in facts.collect()}
    assert got == {
        ("f.xlsx", detect.FACT_DUP, "T", -1, False, ""),
        ("g.xlsx", detect.FACT_DUP, "T", -1, True, ""),
        ("f.xlsx", detect.FACT_OVERFLOW, None, 4, True, "far"),
        ("f.xlsx", detect.FACT_SAMPLE, None, 0, True, "a,b"),
        ("f.xlsx", detect.FACT_SAMPLE, None, 2, True, "a,c"),
        ("f.xlsx", detect.FACT_SAMPLE, None, 3, True, "x"),
        ("g.xlsx", detect.FACT_SAMPLE, None, 0, True, "a"),
        ("g.xlsx", detect.FACT_SAMPLE, None, 1, True, "a"),
    }


def test_fixture_rows_are_numbered_before_their_texts_are_made(spark, tmp_path, monkeypatch):
    table = spark.createDataFrame(
        [(k, f"n{k}", k % 3, 1.5, "BUILDING") for k in (5, 2, 8, 11)],
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    )
    table.write.parquet(f"{tmp_path}/customer.parquet")
    seen = []
    number = fixtures.number_in_order
    monkeypatch.setattr(fixtures, "number_in_order", lambda s, df, *a: seen.append(df.schema) or number(s, df, *a))
    rows = fixtures.part_rows(spark, str(tmp_path), fixtures.CUSTOMER.parts[0])
    assert not [f.name for f in seen[0] if f.dataType.typeName() == "array"]
    assert [f.name for f in rows.schema] == ["file", "sheet", "row_no", "vals"]
    assert {(x["file"], x["row_no"], *x["vals"]) for x in rows.collect()} == {
        ("nation_02.xlsx", n, str(k), f"n{k}", "g2", "g2", "1.50") for n, k in enumerate((2, 5, 8, 11), 1)
    }


def test_wide_rows_of_a_small_table_are_made_by_many_tasks(spark, tmp_path, monkeypatch):
    table = spark.createDataFrame([(k, k % 25) for k in range(400)], "s_suppkey bigint, s_nationkey int")
    table.coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")

    class Seen(Exception):
        pass

    def seen(spark, template_headers, headers, rows):
        raise Seen(rows)

    monkeypatch.setattr(catalog, "merge_tables", seen)
    with pytest.raises(Seen) as caught:
        catalog.q_merge_wide_template(spark, str(tmp_path))
    rows = caught.value.args[0]
    sizes = [r["n"] for r in rows.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 400 and max(sizes) <= 400 // spark.sparkContext.defaultParallelism
