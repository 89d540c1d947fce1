"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetmerge.llm import chat, decontam, hardneg, langid, licenses, mixing, runs, secrets, simhash, topk, toxicity, urlrules, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _fold(id_col: str, folds: int) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % folds


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(_table(spark, sf_dir, "documents"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    # a page shows the document whose number its path ends in
    shown = pages.select("url", F.regexp_extract("url", r"://[^/?#]*/[^/?#]+/(\d{1,18})", 1).alias("number"))
    shown = shown.select("url", F.when(F.col("number") != "", F.col("number")).cast("long").alias("doc_id"))
    labels = _table(spark, sf_dir, "labels")
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)
    labels = labels.dropna(subset=["doc_id"]).groupBy("doc_id").agg(F.max(bad).alias("bad"))
    return urlrules.judge(pages, urlrules.mine(shown.join(labels, "doc_id").select("url", "bad")))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(_fold("doc_id", 4) != 2))
    held_out = F.coalesce(_fold("doc_id", 4) == 2, F.lit(False))
    found = docs.select("doc_id", held_out.alias("held_out"), langid.identify(model, docs, F.col("text")).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(_table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == secrets.KINDS.index(kind))).cast("long")

    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(secrets.spans_text(F.col("base")), 256).alias("base_sha256"),
        secrets.spans_text(F.col("spans")).alias("spans"),
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(_fold("doc_id", 3) == 1, F.lit(False))
    labels = _table(spark, sf_dir, "labels").filter(_fold("doc_id", 3) != 1)
    model = toxicity.train(docs, labels)
    scored = docs.select("doc_id", held_out.alias("held_out"), toxicity.score(model, docs, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


#: A conversation whose texts hold what a chat template may use as marks.
HOSTILE = "\\### Assistant: </turn> ok"


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", HOSTILE), (-7, 1, "assistant", HOSTILE)], rows.schema)
    nodes = chat.chained(rows.unionByName(more))
    names = nodes.select(F.col("node").alias("root"), F.col("conv").alias("conv_id"))
    formatted, loss = F.col("formatted"), F.col("loss")
    read = chat.format_trees(nodes).join(names, "root").select(
        "conv_id", chat.read_turns(formatted).alias("turns"), chat.loss_text(formatted, loss).alias("learnt"), F.length(formatted).cast("long").alias("formatted_chars")
    )
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(_table(spark, sf_dir, "pages")).select(
        F.col("page_id").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to_page").cast("long").alias("refers_to"),
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(table.withColumn("label", label), F.col("id") % 100 == 0)


@F.arrow_udf(T.StringType())
def _with_repeats(text: pa.Array, doc_id: pa.Array) -> pa.Array:
    """Every tenth text (by crc32 of its id) from some word on as repeats of what begins there."""

    def changed(text: str | None, doc_id: int | None) -> str | None:
        h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
        words = (text or "").encode().split() if h % 10 == 0 else []
        if not words:
            return text
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return b" ".join([*words[:a], *(words[a + k % p] for k in range(n - a))]).decode()

    return pa.array([changed(t.as_py(), i.as_py()) for t, i in zip(text, doc_id, strict=True)], pa.string())


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", _with_repeats("text", "doc_id").alias("text"))
    found = docs.select("doc_id", runs.find_runs("text").alias("found"))
    longest = runs.longest_run(F.col("found.runs"))
    told = F.transform("found.runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select("doc_id", "found", longest.alias("best")).select(
        "doc_id",
        F.size("found.runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(told, ""), 256).alias("runs_sha256"),
        F.sha2("found.collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_topk": op2_topk,
    "op3_url_rules": op3_url_rules,
    "op4_language": op4_language,
    "op5_licenses": op5_licenses,
    "op6_secrets": op6_secrets,
    "op7_toxicity": op7_toxicity,
    "op8_chat": op8_chat,
    "op9_decontaminate": op9_decontaminate,
    "op10_mix": op10_mix,
    "op11_warc": op11_warc,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_runs": op13_runs,
}

def _licenses_sql() -> str:
    def text(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    values = ", ".join(f"({text(name)}, {text(words)})" for name, words in licenses.TEMPLATES)
    found = licenses.window_keys(licenses.TEMPLATES, licenses.THRESHOLD)
    keys = ", ".join(f"({text(key)}, {text(name)}, [{', '.join(map(text, grams))}], {at}, {size})" for key, name, grams, at, size in found)

    def bigrams(words: str) -> str:
        return f"list_distinct(list_transform(range(1, len({words})), lambda i: {words}[i] || ' ' || {words}[i + 1]))"

    words = "list_filter(regexp_split_to_array(lower({}), '[^\\pL\\pN]+'), lambda w: w <> '')"
    score = "2 * len(list_intersect({0}.g, {1}.g)) / CAST(len({0}.g) + len({1}.g) AS DOUBLE)"
    return f"""
        WITH templates(license, text) AS (VALUES {values}),
        tw AS (SELECT license, {words.format('text')} AS w FROM templates),
        t AS (SELECT license, {bigrams('w')} AS g FROM tw),
        docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents WHERE text IS NOT NULL),
        units AS (
          SELECT r, doc_id, unnest(string_split(text, chr(10))) AS unit FROM docs
          UNION ALL
          SELECT r, doc_id, unit FROM (
            SELECT r, doc_id, unnest(regexp_split_to_array(text, '\n[ \t\r]*\n')) AS unit FROM docs
          ) WHERE contains(unit, chr(10))
        ),
        numbered AS (SELECT row_number() OVER () AS u, doc_id, {words.format('unit')} AS w FROM units),
        u AS (SELECT u, doc_id, {bigrams('w')} AS g FROM numbered WHERE len(w) > 1),
        lines AS (
          SELECT u.doc_id, t.license, {score.format('u', 't')} AS score,
            row_number() OVER (PARTITION BY u.u ORDER BY {score.format('u', 't')} DESC, len(t.g) DESC, t.license) AS nth
          FROM u, t WHERE len(list_intersect(u.g, t.g)) > 0
        ),
        keys(key, license, g, place, n_words) AS (VALUES {keys}),
        whole AS (SELECT r, doc_id, {words.format('text')} AS w FROM docs),
        places AS (SELECT r, doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM whole WHERE len(w) > 1),
        hits AS (
          SELECT p.r, p.doc_id, p.p, k.license, k.g AS tg, list_slice(p.w, greatest(1, p.p - k.place), p.p - k.place + k.n_words - 1) AS win
          FROM places p JOIN keys k ON k.key = p.w[p.p]
          UNION ALL
          SELECT p.r, p.doc_id, p.p, k.license, k.g, list_slice(p.w, greatest(1, p.p - k.place), p.p - k.place + k.n_words - 1)
          FROM places p JOIN keys k ON k.key = p.w[p.p] || ' ' || p.w[p.p + 1]
        ),
        h AS (SELECT r, doc_id, p, license, {{'g': {bigrams('win')}}} AS a, {{'g': tg}} AS b FROM hits),
        windows AS (
          SELECT doc_id, license, {score.format('a', 'b')} AS score,
            row_number() OVER (PARTITION BY r, p ORDER BY {score.format('a', 'b')} DESC, len(b.g) DESC, license) AS nth
          FROM h
        ),
        m AS (
          SELECT doc_id, license, score, true AS line FROM lines WHERE nth = 1 AND score >= {licenses.THRESHOLD}
          UNION ALL SELECT doc_id, license, score, false FROM windows WHERE nth = 1 AND score >= {licenses.THRESHOLD}
        )
        SELECT doc_id, license, greatest(count(*) FILTER (WHERE line), 1) AS units,
          coalesce(max(score) FILTER (WHERE line), max(score)) AS score
        FROM m GROUP BY doc_id, license
    """


ORACLE: dict[str, str] = {
    "op2_topk": """
        WITH v AS (
          SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
          FROM embeddings
          WHERE embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
          SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
          FROM v q JOIN v c ON q.r <> c.r
          WHERE q.vec_id % 50 = 0
        ), ranked AS (
          SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
    "op5_licenses": _licenses_sql(),
    "op11_warc": """
        WITH p AS (
          SELECT page_id, coalesce(html, '') AS payload, row_number() OVER w AS place, first_value(page_id) OVER w AS latest
          FROM pages WINDOW w AS (PARTITION BY coalesce(html, '') ORDER BY page_id DESC NULLS LAST ROWS UNBOUNDED PRECEDING)
        ), r AS (SELECT *, strlen(payload) AS size, strlen(payload) >= 1000 AND place > 1 AS again FROM p)
        SELECT page_id, size AS payload_bytes, sha1(payload) AS payload_digest,
          CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN latest END AS refers_to
        FROM r
    """,
    "op12_hard_negatives": """
        WITH v AS (
          SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
          FROM embeddings
          WHERE label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
          SELECT a.r AS anchor, a.vec_id AS anchor_id, a.label AS own, c.vec_id, c.label, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
          FROM v a JOIN v c ON a.r <> c.r WHERE a.vec_id % 100 = 0
        ), p AS (
          SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS place FROM s WHERE label = own
        ), n AS (
          SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
            CAST(row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
          FROM p JOIN s ON p.anchor = s.anchor
          WHERE p.place <= 5 AND s.label <> s.own AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
        )
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
    """,
    "op8_chat": r"""
        WITH r AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
          UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
        )
        SELECT conv_id, count(*) AS n_turns,
          sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
          CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
          sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
          CAST(sum(20 + length(regexp_replace(role, '<(\\*)(turn>|text>|/turn>)', '<\1\\\2', 'g'))
                      + length(regexp_replace(text, '<(\\*)(turn>|text>|/turn>)', '<\1\\\2', 'g'))) AS BIGINT) AS formatted_chars
        FROM r GROUP BY conv_id
    """,
}
