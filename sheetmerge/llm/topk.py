"""Exact top-k inner products over vectors sorted by length.

Vectors are range-sorted by descending length (Euclidean norm) and written
once. An SVD of all vectors (from their Gram matrix, summed by Spark)
rotates space so that the first coordinates hold most of every vector. For
a query and its k-th best score so far, a candidate is dropped

* by length, where |q| |c| is below that score (Cauchy-Schwarz): the scan
  itself starts from the length that any query of the block still needs,
  which prunes files and row groups of the sorted table;
* by its partial sum over the first rotated coordinates plus the product of
  the lengths of what remains of both (Cauchy-Schwarz on the residuals).

What remains is scored exactly, in integers. A first bound for every query
comes from some of the longest vectors. Queries are a stated set; they are
read in blocks of about ``QUERY_BLOCK`` (fewer if vectors are long), the
most that is collected and broadcast at a time; each block is held against
all candidates and its findings are written before the next one. A task
returns at most k rows per query, which are merged per query.

Defined results: components become floor(256 x). A vector that is null or
holds a null, NaN or infinite component takes no part. Every row is a
candidate of its own, whatever its id: rows that repeat an id, and rows
without one, count like any other, and a query leaves out its own row only.
Of rows that repeat a query's id each asks. A shorter vector counts as
filled up with zeros. Ties go to the smaller id, those without an id last.
Scores beyond the range of a long are cut to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetmerge.llm.vectors import EXACT, large_products, matrix, nullable, whole_vectors
from sheetmerge.session import scratch_path
from sheetmerge.sources.land import land

K = 5
QUERY_BLOCK = 8192
SEEDS = 1024

_CHUNK = 2048
_CELLS = 1 << 21
_NONE = -(1 << 63)


def _rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of all vectors, by descending singular value."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            m = matrix(batch.column(0), dim)
            m /= np.maximum(1.0, np.abs(m).max(initial=0.0))  # any scale serves; no overflow
            total += m.T @ m
        at = np.arange(dim * dim)
        yield pa.record_batch({"at": at, "value": total.ravel()})

    cells = vectors.select("v").mapInArrow(gram, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    total = np.zeros(dim * dim)
    for cell in cells:
        total[cell["at"]] = cell["value"]
    values, basis = np.linalg.eigh(total.reshape(dim, dim))
    return basis[:, np.argsort(-values)]


class _Block:
    """Rows of (row, id, v) as arrays."""

    def __init__(self, batch: pa.Table | pa.RecordBatch, dim: int):
        self.rows = batch.column(0).to_numpy()
        self.ids, self.unnamed = nullable(batch.column(1))
        self.vectors = matrix(batch.column(2), dim)


class _Best:
    """The k best (score, id) of every query of a block so far."""

    def __init__(self, asked: _Block, basis: np.ndarray, k: int):
        self.rows, self.ids, self.queries, self.basis, self.k = asked.rows, asked.ids, asked.vectors, basis, k
        n = len(self.rows)
        self.head = max(1, self.queries.shape[1] // 4)
        rotated = self.queries @ basis
        self.lead, self.rest = rotated[:, : self.head], np.linalg.norm(rotated[:, self.head :], axis=1)
        self.norm = np.linalg.norm(self.queries, axis=1)
        self.scores = np.full((n, k), _NONE, dtype=np.int64)
        self.found, self.unnamed = np.zeros((n, k), dtype=np.int64), np.ones((n, k), dtype=bool)
        self.least = np.full(n, -np.inf)

    def exact(self, q: np.ndarray, c: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        top = np.abs(self.queries).max(initial=0.0) * np.abs(vectors).max(initial=0.0) * max(1, vectors.shape[1])
        if top < EXACT:
            if 8 * len(q) > len(self.queries) * len(vectors):
                return (self.queries @ vectors.T)[q, c].astype(np.int64)
            return np.einsum("ij,ij->i", self.queries[q], vectors[c]).astype(np.int64)
        found = np.empty(len(q), dtype=np.int64)
        for i in np.unique(q):
            found[q == i] = large_products(self.queries[i], vectors[c[q == i]])
        return found

    def add(self, block: _Block) -> None:
        rotated = block.vectors @ self.basis
        lead, rest = rotated[:, : self.head], np.linalg.norm(rotated[:, self.head :], axis=1)
        norm = np.linalg.norm(block.vectors, axis=1)
        step = max(1, _CELLS // max(1, len(block.rows)))
        for lo in range(0, len(self.rows), step):
            hi = min(len(self.rows), lo + step)
            slack = 1e-9 * np.outer(self.norm[lo:hi], norm) + 1e-6
            bound = self.lead[lo:hi] @ lead.T + np.outer(self.rest[lo:hi], rest) + slack
            q, c = np.nonzero((bound >= self.least[lo:hi, None]) & (self.rows[lo:hi, None] != block.rows[None, :]))
            if len(q):
                self.merge(q + lo, block.ids[c], block.unnamed[c], self.exact(q + lo, c, block.vectors))

    def merge(self, q: np.ndarray, ids: np.ndarray, unnamed: np.ndarray, scores: np.ndarray) -> None:
        able = scores >= self.least[q]
        q, ids, unnamed, scores = q[able], ids[able], unnamed[able], scores[able]
        rows = np.unique(q)
        q = np.concatenate([q, np.repeat(rows, self.k)])
        ids = np.concatenate([ids, self.found[rows].ravel()])
        unnamed = np.concatenate([unnamed, self.unnamed[rows].ravel()])
        scores = np.concatenate([scores, self.scores[rows].ravel()])
        order = np.lexsort((ids, unnamed, ~scores, q))  # ~ descends without overflow
        q, ids, unnamed, scores = q[order], ids[order], unnamed[order], scores[order]
        take = np.searchsorted(q, rows)[:, None] + np.arange(self.k)[None, :]
        self.found[rows], self.unnamed[rows], self.scores[rows] = ids[take], unnamed[take], scores[take]
        last = self.scores[rows, -1]
        self.least[rows] = np.where(last == _NONE, -np.inf, last.astype(np.float64) * (1 - 1e-15 * np.sign(last)))

    def found_rows(self) -> pa.RecordBatch:
        have = self.scores != _NONE
        of = np.nonzero(have)[0]
        ids = pa.array(self.found[have], mask=self.unnamed[have])
        return pa.record_batch({"query": self.rows[of], "query_id": self.ids[of], "vec_id": ids, "score": self.scores[have]})


def _searcher(shared):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, basis, k, least = shared.value
        best = _Best(asked, basis, k)
        best.least = least.copy()
        for batch in batches:
            for lo in range(0, batch.num_rows, _CHUNK):
                best.add(_Block(batch.slice(lo, _CHUNK), asked.vectors.shape[1]))
        yield best.found_rows()

    return search


def top_k(table: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every query.

    ``is_query`` is a condition on ``id``; every other row than the query's
    own is a candidate.
    """
    spark = table.sparkSession
    vectors = whole_vectors(table, vec_col, F.col(id_col).cast("long").alias("id"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    vectors = land(spark, vectors.select("row", "id", "v", length.alias("norm")), "vectors")
    count, dim, queries = vectors.agg(
        F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0)), F.count(F.when(is_query, 1))
    ).collect()[0]
    schema = "query long, query_id long, vec_id long, score long"
    path = scratch_path(spark, "top-k")
    if queries and count > 1:
        dim = max(1, dim)
        basis = _rotation(vectors, dim)
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        by_length = [F.col("norm").desc(), F.col("row")]
        vectors = land(spark, vectors.repartitionByRange(parts, *by_length).sortWithinPartitions(*by_length), "by-length")
        cut = vectors.agg(F.percentile_approx("norm", max(0.0, 1 - SEEDS / count), 10_000)).collect()[0][0]
        longest = _Block(vectors.filter(F.col("norm") >= cut).limit(SEEDS).select("row", "id", "v").toArrow(), dim)
        blocks = -(-queries // max(1, min(QUERY_BLOCK, 2 * _CELLS // dim)))
        for b in range(blocks):
            asked = vectors.filter(is_query & (F.pmod(F.xxhash64("row"), F.lit(blocks)) == b)).select("row", "id", "v").toArrow()
            if not asked.num_rows:
                continue
            best = _Best(_Block(asked, dim), basis, k)
            best.add(longest)
            # from here on only what reaches the k-th best of the longest vectors
            needed = np.where(best.norm > 0, best.least / np.maximum(best.norm, 1e-300), np.where(best.least > 0, np.inf, -np.inf))
            shortest = float(needed.min()) * (1 - 1e-9) if needed.min() > 0 else -1.0
            shared = spark.sparkContext.broadcast((_Block(asked, dim), basis, k, best.least))
            pool = vectors.filter(F.col("norm") >= shortest)
            if 2 * pool.count() < count:  # the longest stand in few files: deal them to all tasks
                pool = pool.repartition(parts)
            pool.select("row", "id", "v").mapInArrow(_searcher(shared), schema).write.mode("append").parquet(path)
            shared.destroy()
    found = spark.read.schema(schema).parquet(path) if queries and count > 1 else spark.createDataFrame([], schema)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last()))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
