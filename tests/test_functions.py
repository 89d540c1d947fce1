from pyspark.sql import functions as F

from sheetmerge.functions import col_letter
from sheetmerge.plans.fixture_files import col_letters


def test_col_letter_known_points(spark):
    cases = {0: "A", 25: "Z", 26: "AA", 51: "AZ", 52: "BA", 701: "ZZ", 702: "AAA", 16383: "XFD", 18277: "ZZZ", 18278: "AAAA"}
    df = spark.createDataFrame([(k,) for k in cases], "i int").select("i", col_letter("i").alias("l"))
    assert {r["i"]: r["l"] for r in df.collect()} == cases


def test_col_letter_agrees_with_python_everywhere(spark):
    df = spark.range(0, 20000).select(F.col("id").cast("int").alias("i"), col_letter("id").alias("l"))
    bad = [r for r in df.collect() if col_letters(r["i"]) != r["l"]]
    assert not bad


def test_col_letter_null_and_negative(spark):
    df = spark.createDataFrame([(None,), (-1,)], "i int").select(col_letter("i").alias("l"))
    assert [r["l"] for r in df.collect()] == [None, None]


def test_col_letter_over_the_whole_int_range(spark):
    cases = {475_253: "ZZZZ", 475_254: "AAAAA", 12_356_629: "ZZZZZ", 321_272_405: "ZZZZZZ", 2_147_483_646: "FXSHRXW"}
    df = spark.createDataFrame([(k,) for k in cases], "i int").select("i", col_letter("i").alias("l"))
    assert {r["i"]: r["l"] for r in df.collect()} == cases == {k: col_letters(k) for k in cases}
