"""The registered queries: contract columns, whole tables, and agreement with SQL."""

import os

import duckdb
import pytest

from sheetmerge.llm import queries
from tools.compare import TABLES, digest

SF = "/root/testdata/sf0.001"

COLUMNS = {
    "op1_simhash": ["doc_id", "fingerprint", "component_id"],
    "op2_topk": ["query_id", "rank", "vec_id", "score"],
    "op3_url_rules": ["page_id", "host", "path", "rule", "verdict"],
    "op4_language": ["doc_id", "held_out", "lang_pred", "score"],
    "op5_licenses": ["doc_id", "license", "units", "score"],
    "op6_secrets": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op7_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op8_chat": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op9_decontaminate": ["doc_id", "item_id", "score"],
    "op10_mix": ["doc_id", "size", "source_size", "target", "taken"],
    "op11_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op12_hard_negatives": ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
    "op13_runs": ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
}
EVERY_ROW = {"op1_simhash": "documents", "op3_url_rules": "pages", "op4_language": "documents", "op6_secrets": "documents", "op7_toxicity": "documents", "op10_mix": "documents", "op11_warc": "pages", "op13_runs": "documents"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_one_query_an_operator():
    assert list(queries.QUERIES) == list(COLUMNS)
    assert set(queries.ORACLE) <= set(COLUMNS)


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_rows_and_sql(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    assert df.columns[: len(COLUMNS[name])] == COLUMNS[name] or set(COLUMNS[name]) <= set(df.columns)
    rows = [tuple(r) for r in df.collect()]
    if name in EVERY_ROW:
        assert len(rows) == con.execute(f"SELECT count(*) FROM {EVERY_ROW[name]}").fetchone()[0]
    if name in queries.ORACLE:
        res = con.execute(queries.ORACLE[name])
        names, want = [d[0] for d in res.description], res.fetchall()
        assert sorted(names) == sorted(df.columns)
        assert digest(names, want) == digest(df.columns, rows)
