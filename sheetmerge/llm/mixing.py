"""Mixing sources to target weights.

Every document gets a hash-random 64-bit key. Within a source the documents
are ordered by that key; the words before a document are a prefix sum, and
the source is cut where its budget is spent. A budget above the size of the
source takes the whole source again (epochs) and cuts in the last one.

The key is uniform, so its top bits are range partitions of equal size
without sampling. Words are summed per (source, key range) with map-side
combine and prefix sums run over those few sums, at most 2^``LEVEL_BITS`` a
source; the range in which a source's budget ends is cut into ranges in the
same way, level by level, until single keys are reached. That is the order
of a full sort where the cut needs it and nowhere else: no source is ever
sorted or added up in one task, and texts are read once and never shuffled.

Defined results: a null text has size 0; a null source is a source of its
own, after all others; documents with equal id and text have equal keys
and, where the cut falls on them, share the words left in proportion to
their sizes (whole words each), so reruns agree whatever the order of rows.
Sources of size 0 have target 0. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetmerge.sources.land import land

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
LEVEL_BITS = 7
LEVELS = 3


def word_count(text: Column) -> Column:
    """Number of stretches without the bytes 0x20 and 0x09-0x0D."""
    # a word ends where a non-space is followed by a space or the end
    spaced = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    words = F.filter(F.split(spaced, " ", -1), lambda w: w != "")
    return F.coalesce(F.size(words), F.lit(0)).cast("long")


def _key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.lit("mix"), F.col(id_col), F.col(text_col))


def _range(key: Column, bits: int) -> Column:
    """The top bits of a key; all of them in unsigned order."""
    if bits == 0:
        return F.lit(0).cast("long")
    return _unsigned(key) if bits >= 64 else F.shiftrightunsigned(key, 64 - bits)


def _source_order(sizes: DataFrame) -> Window:
    return Window.orderBy(F.col("source").isNull(), F.col("source"))


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS
) -> DataFrame:
    """(source, source_size) -> with target: one row per source.

    Sources by code point, null last, take ``weights`` in turn and share
    ``share`` of all words. A target stops at ``max_epochs`` times its
    source; what is above is shared again by weight. Whether a source is
    stopped depends only on size over weight, so the sources are ordered by
    that ratio and the stopped ones are a prefix, found by prefix sums.
    """
    every = Window.partitionBy()
    place = F.row_number().over(_source_order(sizes)) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    w = sizes.withColumn("weight", weight).withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("all_words", F.sum("source_size").over(every)).withColumn("all_weight", F.sum("weight").over(every))
    level = (F.lit(float(share)) * F.col("all_words") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    w = w.withColumn("level", level).withColumn("open", F.col("weight") * F.col("level") <= F.col("cap"))
    # the first source that isn't stopped has the level of all that follow
    rate = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(
        by_ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    w = w.withColumn("rate", rate)
    target = F.when(F.col("rate").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("rate")))
    return w.select("source", "source_size", target.alias("target"))


def plan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    max_epochs: float = MAX_EPOCHS,
) -> tuple[DataFrame, DataFrame]:
    """(sizes, cuts): a landed row per document, and a row per source.

    sizes: id, source, size, key. cuts: source, source_size, target, epochs
    (whole passes), cut_key (documents before it are taken once more), left
    (words of the cut key's documents that are taken) and cut_size.
    """
    spark = docs.sparkSession
    sizes = land(
        spark,
        docs.select(
            F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
            _key(id_col, text_col).alias("key"),
        ),
        "mix-sizes",
    )
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(land(spark, totals, "mix-sources"), weights, share, max_epochs)
    budget = F.floor(F.col("target")).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("epochs", epochs).withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    targets = land(spark, targets, "mix-targets")
    # where the rest of the budget ends: a range of keys, then a range of that, down to a key
    cut = targets.select("source", F.lit(0).cast("long").alias("range"), F.lit(0).cast("long").alias("before"), "rest")
    done = 0
    for bits in (*(LEVEL_BITS * n for n in range(1, LEVELS + 1)), 64):
        s, c = sizes.alias("s"), cut.alias("c")
        inside = F.col("s.source").eqNullSafe(F.col("c.source")) & (_range(F.col("s.key"), done) == F.col("c.range"))
        sums = s.join(c, inside).groupBy(F.col("c.source").alias("source"), _range(F.col("s.key"), bits).alias("range"), "before", "rest")
        earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        at = F.col("before") + F.coalesce(F.sum("words").over(earlier), F.lit(0))
        found = sums.agg(F.sum("size").alias("words")).withColumn("at", at).filter("at <= rest and rest < at + words")
        cut = land(spark, found.select("source", "range", F.col("at").alias("before"), "rest", "words"), "mix-cut")
        done = bits
    cut = cut.select("source", _unsigned(F.col("range")).alias("cut_key"), (F.col("rest") - F.col("before")).alias("left"), F.col("words").alias("cut_size"))
    t, k = targets.alias("t"), cut.alias("k")
    cuts = t.join(k, F.col("t.source").eqNullSafe(F.col("k.source")), "left").select(
        "t.source", "source_size", "target", "epochs", "cut_key", "left", "cut_size"
    )
    return sizes, land(spark, cuts, "mix-cuts")


def _unsigned(key: Column) -> Column:
    """Orders signed longs like unsigned ones; its own inverse."""
    return key.bitwiseXOR(F.lit(-(1 << 63)))


def _taken(size: Column, key: Column, cut: Column) -> Column:
    """Words taken of a document, given its source's row of ``cuts``."""
    part = F.when(cut["cut_size"] == size, cut["left"]).otherwise(F.floor(size * cut["left"] / cut["cut_size"]))
    more = (
        F.when(cut["cut_key"].isNull(), F.lit(0))
        .when(_unsigned(key) < _unsigned(cut["cut_key"]), size)
        .when(key == cut["cut_key"], part)
        .otherwise(F.lit(0))
    )
    return (cut["epochs"] * size + more).cast("long")


def _as_struct(cuts: DataFrame, name: str = "_mix_cut") -> DataFrame:
    return cuts.select(F.struct("*").alias(name))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """One row per document: id, source, size, source_size, target, taken."""
    sizes, cuts = plan(docs, id_col, text_col, source_col, **how)
    cut = F.col("_mix_cut")
    return sizes.join(_as_struct(cuts), F.col("source").eqNullSafe(cut["source"])).select(
        F.col("id").alias(id_col),
        "source",
        "size",
        cut["source_size"].alias("source_size"),
        cut["target"].alias("target"),
        _taken(F.col("size"), F.col("key"), cut).alias("taken"),
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The documents the mix takes, with all their columns and ``taken``.

    A document taken twice is one row with twice its words in ``taken``. A
    column of ``docs`` that is itself named ``taken`` is replaced.
    """
    _, cuts = plan(docs, id_col, text_col, source_col, **how)
    doc_name, cut_name = "_mix_doc", "_mix_cut"
    while {doc_name, cut_name} & {c.lower() for c in docs.columns}:
        doc_name, cut_name = doc_name + "_", cut_name + "_"
    cut, own = F.col(cut_name), F.col(doc_name)
    doc = F.struct(word_count(F.col(f"`{text_col}`")).alias("size"), _key(f"`{id_col}`", f"`{text_col}`").alias("key"))
    met = docs.withColumn(doc_name, doc).join(_as_struct(cuts, cut_name), F.col(f"`{source_col}`").eqNullSafe(cut["source"]))
    taken = _taken(own["size"], own["key"], cut)
    return met.withColumn("taken", taken).drop(cut_name, doc_name).filter("taken > 0")
