"""Hard-negative mining by a BOND vertical scan.

Vectors are written once, column by column: a stored block holds some
thousand rows as one list per dimension, with the least and the greatest
value of each. An anchor reads a block's dimensions by the descending size
of its own components. What the dimensions still unread can add to a score
at most and at least follows from their extremes; a candidate leaves the
block's bitmap as soon as its bounds miss every window that the anchor looks
at, or can't beat the k-th best that certainly lies in it. Those that stay
have been read whole, so their scores are exact, and the exact windows decide.

1. *Positives*: one window over all scores, rows of the anchor's label.
2. *Negatives*: one window for each positive, from ``min_percent`` to
   ``max_percent`` of its score, rows of other labels.

Blocks are range-sorted by label, so an anchor passes over blocks without a
row it looks for; a label with many rows spans many blocks. Anchors are a
stated set, read in blocks of about ``ANCHOR_BLOCK`` (fewer if vectors are
long): that many, and their positives, are collected and broadcast at a
time. A task returns at most k rows a window, merged by window.

Defined results: components become floor(256 x). Rows with a null label, a
null vector, or a null, NaN or infinite component take no part. Every row
is a candidate of its own, whatever its id; an anchor leaves out its own row
only, and rows that repeat an anchor's id are anchors too. Ties go to the
smaller id, rows without an id last. An anchor without a positive, and a
positive without a negative in its window, give no row. A shorter vector
counts as filled up with zeros; scores beyond the range of a long are cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheetmerge.llm.vectors import EXACT, LEAST, MOST, large_products, matrix, nullable, whole_vectors
from sheetmerge.session import scratch_path
from sheetmerge.sources.land import land

K = 5
MIN_PERCENT, MAX_PERCENT = 80, 100
ANCHOR_BLOCK = 8192

_CELLS = 1 << 20
_FIRST = 8

_STORED = (
    "rows array<long>, ids array<long>, labels array<long>, dimensions array<array<double>>, low array<double>, high array<double>"
)
_FOUND = "anchor long, place int, anchor_id long, positive_id long, positive_score long, vec_id long, score long"


def _stored_blocks(vectors: DataFrame, dim: int) -> DataFrame:
    """The vectors in columns, some thousand rows in one block, sorted by label."""
    size = max(64, _CELLS // dim)

    def lists(values: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(np.arange(0, values.size + 1, max(1, values.shape[-1]), dtype=np.int32), values.ravel())

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, size):
                part = batch.slice(lo, size)
                columns = np.ascontiguousarray(matrix(part.column(3), dim).T)
                whole = pa.array([0, dim], pa.int32())
                values = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(k)) for k in range(3)]
                values.append(pa.ListArray.from_arrays(whole, lists(columns)))
                values += [pa.ListArray.from_arrays(whole, pa.array(x)) for x in (columns.min(axis=1), columns.max(axis=1))]
                yield pa.RecordBatch.from_arrays(values, names=["rows", "ids", "labels", "dimensions", "low", "high"])

    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_label = [F.col("label"), F.xxhash64("row")]
    sorted_rows = vectors.repartitionByRange(parts, *by_label).sortWithinPartitions(*by_label)
    return sorted_rows.select("row", "id", "label", "v").mapInArrow(store, _STORED)


class _Stored:
    """A stored block as arrays."""

    def __init__(self, batch: pa.RecordBatch, k: int):
        def cells(name: str) -> pa.Array:
            return batch.column(name).slice(k, 1).flatten()

        self.rows = cells("rows").to_numpy()
        self.ids, self.unnamed = nullable(cells("ids"))
        self.labels = cells("labels").to_numpy()
        self.columns = cells("dimensions").flatten().to_numpy().reshape(-1, len(self.rows))
        self.low, self.high = cells("low").to_numpy(), cells("high").to_numpy()
        self.size = max(np.abs(self.low).max(initial=0.0), np.abs(self.high).max(initial=0.0))


class _Anchors:
    """Anchors and, for each, windows (lo, hi, id and score of the positive)."""

    def __init__(self, table: pa.Table, dim: int):
        self.rows = table.column("row").to_numpy()
        self.ids = table.column("id").to_numpy()
        self.labels = table.column("label").to_numpy()
        self.vectors = matrix(table.column("v"), dim)
        self.windows: list[list[tuple[int, int, int | None, int]]] = [[(LEAST, MOST, None, 0)] for _ in self.rows]


class _Kept:
    """The k best (score, id) of one window so far, and the least score that can still enter."""

    def __init__(self, lo: int, hi: int, k: int):
        self.lo, self.hi, self.k, self.need = lo, hi, k, lo
        self.scores, self.ids, self.unnamed = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, unnamed: np.ndarray) -> None:
        fits = (scores >= self.need) & (scores <= self.hi)
        if fits.any():
            scores, ids, unnamed = (
                np.concatenate((old, new[fits])) for old, new in ((self.scores, scores), (self.ids, ids), (self.unnamed, unnamed))
            )
            best = np.lexsort((ids, unnamed, ~scores))[: self.k]
            self.scores, self.ids, self.unnamed = scores[best], ids[best], unnamed[best]
            if len(best) == self.k:
                self.need = int(self.scores[-1])


def _scan(block: _Stored, q: np.ndarray, order: np.ndarray, candidates: np.ndarray, windows: list[_Kept]) -> None:
    """Takes the candidates of a block that fit an anchor's windows."""
    if np.abs(q).max(initial=0.0) * block.size * len(q) >= EXACT:  # too large for doubles: no bounds, whole numbers
        scores = large_products(q, block.columns[:, candidates].T)
    else:
        a, b = q * block.low, q * block.high
        most = np.append(np.cumsum(np.maximum(a, b)[order][::-1])[::-1], 0.0)
        least = np.append(np.cumsum(np.minimum(a, b)[order][::-1])[::-1], 0.0)
        scores, at, step, whole = np.zeros(len(candidates)), 0, _FIRST, len(candidates) == len(block.rows)
        while True:
            upper, lower = scores + most[at], scores + least[at]
            alive = np.zeros(len(scores), dtype=bool)
            for w in windows:
                need = float(w.need)
                if 0 < at < len(q):
                    sure = lower[(lower >= need) & (upper <= w.hi)]
                    if len(sure) >= w.k:  # so many candidates are certainly in this window, and at least as good
                        need = max(need, np.partition(sure, -w.k)[-w.k])
                alive |= (upper >= need) & (lower <= w.hi)
            if not alive.all():
                candidates, scores, whole = candidates[alive], scores[alive], False
            if at == len(q) or not len(candidates):
                break
            read = order[at : at + step]
            values = block.columns[read] if whole else block.columns[read[:, None], candidates[None, :]]
            scores = scores + q[read] @ values
            at, step = min(len(q), at + step), 2 * step if at else step
        scores = scores.astype(np.int64)
    for w in windows:
        w.add(scores, block.ids[candidates], block.unnamed[candidates])


def _scanner(shared, k: int, same_label: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors: _Anchors = shared.value
        orders = np.argsort(-np.abs(anchors.vectors), axis=1, kind="stable")
        kept = [[_Kept(lo, hi, k) for lo, hi, _, _ in windows] for windows in anchors.windows]
        for batch in batches:
            for r in range(batch.num_rows):
                block = _Stored(batch, r)
                own = {int(row): i for i, row in enumerate(block.rows)}
                of_label = {int(x): np.flatnonzero(block.labels == x) for x in np.unique(block.labels)}
                not_label = {x: np.flatnonzero(block.labels != x) for x in of_label}
                every, none = np.arange(len(block.rows)), np.zeros(0, np.int64)
                for a, windows in enumerate(kept):
                    label = int(anchors.labels[a])
                    if same_label:
                        candidates = of_label.get(label, none)
                        if int(anchors.rows[a]) in own:
                            candidates = candidates[candidates != own[int(anchors.rows[a])]]
                    else:
                        candidates = not_label.get(label, every)
                    if windows and len(candidates):
                        _scan(block, anchors.vectors[a], orders[a], candidates, windows)
        for a, windows in enumerate(kept):
            for place, w in enumerate(windows):
                if not len(w.scores):
                    continue
                _, _, positive_id, positive_score = anchors.windows[a][place]
                n = len(w.scores)
                yield pa.record_batch(
                    {
                        "anchor": np.full(n, anchors.rows[a]),
                        "place": np.full(n, place, np.int32),
                        "anchor_id": np.full(n, anchors.ids[a]),
                        "positive_id": pa.array([positive_id] * n, pa.int64()),
                        "positive_score": np.full(n, positive_score, np.int64),
                        "vec_id": pa.array(w.ids, mask=w.unnamed),
                        "score": w.scores,
                    }
                )

    return scan


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The k best of every window."""
    by = Window.partitionBy("anchor", "place").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def _read_windows(anchors: _Anchors, positives: pa.Table, min_percent: int, max_percent: int) -> None:
    """The windows that the positives of each anchor stand for; one that can't hold a score is empty."""
    place = {int(row): a for a, row in enumerate(anchors.rows)}
    anchors.windows = [[] for _ in anchors.rows]
    for row, vec_id, score in sorted(zip(*(positives.column(c).to_pylist() for c in ("anchor", "vec_id", "score")), strict=True), key=str):
        lo, hi = -(-min_percent * score // 100), max_percent * score // 100
        if lo <= min(hi, MOST) and hi >= LEAST:
            anchors.windows[place[row]].append((max(lo, LEAST), min(hi, MOST), vec_id, score))


def mine(
    table: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    positives: int = K,
    negatives: int = K,
    min_percent: int = MIN_PERCENT,
    max_percent: int = MAX_PERCENT,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is a condition on ``id``; labels are whole numbers. The
    positives of an anchor are its best other rows of the same label; for
    each, the best rows of other labels whose score is from ``min_percent``
    to ``max_percent`` of the positive's.
    """
    spark: SparkSession = table.sparkSession
    named = [F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label")]
    vectors = land(spark, whole_vectors(table.filter(F.col(label_col).isNotNull()), vec_col, *named), "vectors")
    count, dim, asked = vectors.agg(
        F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0)), F.count(F.when(is_anchor, 1))
    ).collect()[0]
    path = scratch_path(spark, "hard-negatives")
    if asked and count > 1:
        dim = max(1, dim)
        stored = land(spark, _stored_blocks(vectors, dim), "columns")
        blocks = -(-asked // max(1, min(ANCHOR_BLOCK, 4 * _CELLS // dim)))
        for b in range(blocks):
            picked = vectors.filter(is_anchor & (F.pmod(F.xxhash64("row"), F.lit(blocks)) == b)).select("row", "id", "label", "v").toArrow()
            if not picked.num_rows:
                continue
            anchors = _Anchors(picked, dim)
            shared = spark.sparkContext.broadcast(anchors)
            best = _merged(stored.mapInArrow(_scanner(shared, positives, True), _FOUND), positives)
            best = best.select("anchor", "vec_id", "score").toArrow()
            shared.destroy()
            _read_windows(anchors, best, min_percent, max_percent)
            shared = spark.sparkContext.broadcast(anchors)
            stored.mapInArrow(_scanner(shared, negatives, False), _FOUND).write.mode("append").parquet(path)
            shared.destroy()
        found = spark.read.schema(_FOUND).parquet(path)
    else:
        found = spark.createDataFrame([], _FOUND)
    return _merged(found, negatives).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
