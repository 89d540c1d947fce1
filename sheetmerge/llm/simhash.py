"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two 64-bit fingerprints within ``d`` bits of each other share a variant
that lies within floor(d/2) bits of one and ceil(d/2) bits of the other.
So every distinct fingerprint emits all variants of itself within those
radii, the variants are shuffled, and those that meet on a variant link up.

A bucket (one variant) holds at most as many distinct fingerprints as the
ball has points, 65 for d = 2, however many documents there are: copies
share a fingerprint, and only distinct fingerprints emit. Within a bucket
every fingerprint is linked to the smallest "home" one (within floor(d/2))
instead of to all others; members of a bucket are within d of it, so each
star has the components of all pairs. The links are deduplicated and their
distance verified, then components are formed by large-star / small-star.

Defined results: a null or blank text has the fingerprint 0 and links like
any other; repeated rows are documents of their own with one fingerprint;
rows with a null id keep their place in a group but can't name it (a group
of null ids only has a null component_id). An empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetmerge.llm.components import connected_components
from sheetmerge.sources.land import land

SEED = 42
SHINGLE_WORDS = 3
MAX_DISTANCE = 2

_PIECE = 1 << 20
_LANES = np.uint64(0x0101010101010101)


def _pieces(text: bytes):
    """The words of a text in stretches of about a megabyte."""
    if len(text) <= _PIECE:
        yield text.lower().split()
        return
    lo = 0
    while lo < len(text):
        hi = min(len(text), lo + _PIECE)
        while hi < len(text) and text[hi] not in b" \t\n\r\x0b\x0c":
            hi += 1
        yield text[lo:hi].lower().split()
        lo = hi


def _shingle_hashes(text: bytes, n: int):
    """Arrays of the XXH64 of each word shingle, for bounded stretches of text."""
    digest, tail, seen = xxhash.xxh64_intdigest, [], 0
    for words in _pieces(text):
        words = tail + words
        if len(words) >= n:
            grams = words if n == 1 else map(b" ".join, zip(*(words[k:] for k in range(n)), strict=False))
            yield np.fromiter((digest(g, SEED) for g in grams), dtype=np.uint64)
            seen += 1
        tail = words[len(words) - n + 1 :] if len(words) >= n else words
    if not seen and tail:
        yield np.array([digest(b" ".join(tail), SEED)], dtype=np.uint64)


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each of the 64 bits set.

    Bit k of all eight bytes is summed in eight byte lanes at once; a lane
    holds at most 255.
    """
    starts = np.arange(0, len(hashes), 255)
    counts = np.empty((8, 8), dtype=np.int64)
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & _LANES, starts)
        counts[:, k] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return counts.reshape(64)


def simhash(text: bytes, n: int = SHINGLE_WORDS) -> int:
    """A bit is 1 where over half the shingle hashes have it set."""
    counts, total = np.zeros(64, dtype=np.int64), 0
    for hashes in _shingle_hashes(text, n):
        counts += _bit_counts(hashes)
        total += len(hashes)
    bits = (2 * counts > total) if total else np.zeros(64, dtype=bool)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprint(text: Column | str, shingle_words: int = SHINGLE_WORDS) -> Column:
    """The 64-bit fingerprint of a text column, as a signed long."""

    @F.arrow_udf("long")
    def of(column: pa.Array) -> pa.Array:
        column = column.cast(pa.large_string()).cast(pa.large_binary())
        found = np.fromiter((simhash(x.as_py() or b"", shingle_words) for x in column), dtype=np.uint64, count=len(column))
        return pa.array(found.view(np.int64))

    return of(text)


def _masks(radius: int) -> list[int]:
    """All 64-bit masks of up to ``radius`` bits, as signed longs."""
    masks = [sum(1 << k for k in bits) for r in range(radius + 1) for bits in combinations(range(64), r)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def near_links(fingerprints: DataFrame, col: str = "fingerprint", max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(a, b): links between distinct fingerprints within ``max_distance`` bits.

    The links have the connected components of all pairs within that
    distance; a pair that meets in no bucket with a smaller one is linked
    directly, others through the smallest fingerprint of their buckets.
    """
    inner, outer = max_distance // 2, (max_distance + 1) // 2
    masks = _masks(outer)
    homes = sum(comb(64, r) for r in range(inner + 1))  # masks come by their number of bits
    # dealt to all tasks before they grow: tasks are sized by what they read, which here is little
    parts = int(fingerprints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    variants = fingerprints.select(F.col(col).alias("a")).distinct().repartition(parts).select(
        "a", F.posexplode(F.array(*map(F.lit, masks))).alias("k", "mask")
    )
    bucket = Window.partitionBy("variant")
    met = variants.select(
        "a", F.col("a").bitwiseXOR(F.col("mask")).alias("variant"), (F.col("k") < homes).alias("home")
    ).select("a", F.min(F.when(F.col("home"), F.col("a"))).over(bucket).alias("b"))
    links = met.filter("b is not null and a <> b").distinct()
    return links.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance)


def _classes(prints: DataFrame, rep: Column, max_distance: int) -> DataFrame:
    """(fingerprint, rep): the smallest ``rep`` over each component of documents."""
    by_print = prints.groupBy("fingerprint").agg(F.min(rep).alias("rep"))
    linked = connected_components(near_links(prints, "fingerprint", max_distance))
    linked = land(prints.sparkSession, linked, "components")
    rooted = by_print.join(linked.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    root = F.coalesce("component", "fingerprint").alias("root")
    tops = rooted.groupBy(root).agg(F.min("rep").alias("rep"))
    return rooted.select("fingerprint", root).join(tops, "root").select("fingerprint", "rep")


def near_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    max_distance: int = MAX_DISTANCE,
) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id."""
    prints = docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), shingle_words).alias("fingerprint"))
    prints = land(docs.sparkSession, prints, "fingerprints")
    classes = _classes(prints, F.col("id"), max_distance)
    return prints.join(classes, "fingerprint").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        F.col("rep").alias("component_id"),
    )


def keep_one(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    max_distance: int = MAX_DISTANCE,
) -> DataFrame:
    """The rows of ``docs`` that stay: of each group the one with the smallest id.

    Null ids come last. Rows that agree in id and text are one document and
    one of them stays. All columns are returned as they are.
    """
    spark = docs.sparkSession
    text_hash = F.xxhash64(F.col(text_col))
    prints = land(
        spark,
        docs.select(
            F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), text_hash.alias("hash")).alias("row"),
            fingerprint(F.col(text_col), shingle_words).alias("fingerprint"),
        ),
        "fingerprints",
    )
    reps = _classes(prints, F.col("row"), max_distance).select("rep").distinct()
    copies = prints.groupBy("row").count()
    kept = land(
        spark, reps.join(copies, reps.rep.eqNullSafe(copies.row)).select("rep.id", "rep.hash", "count"), "kept"
    )
    d, k = docs.alias("d"), kept.alias("k")
    same = F.col(f"d.`{id_col}`").eqNullSafe(F.col("k.id")) & (F.xxhash64(F.col(f"d.`{text_col}`")) == F.col("k.hash"))
    once = d.join(k.filter("count = 1"), same, "left_semi")
    if kept.filter("count > 1").limit(1).count() == 0:
        return once
    again = d.join(k.filter("count > 1"), same, "left_semi").dropDuplicates([id_col, text_col])
    return once.unionByName(again)
