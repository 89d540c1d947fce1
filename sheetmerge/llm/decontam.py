"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Texts and test items become sequences of words (lower case; letters, digits
and their marks by Unicode, anything else is a gap). In scripts written
without spaces every character is a word. Seeds are n-grams of ``SEED_WORDS`` words of the items. A first
pass over all documents counts in how many of them each n-gram occurs. Those
that no document holds can't match and are left out. Of any ``SEED_WINDOW``
n-grams in a row of an item the rarest of the others becomes a seed. So every
run of SEED_WORDS + SEED_WINDOW - 1 = 5 words that a document shares with an
item holds a seed of that item, however frequent the passage is in the
corpus, while stop-word n-grams rarely are seeds. All n-grams of at most
``RARE_DOCS`` documents are seeds, too: where a corpus holds an item and
edited copies of it, the n-grams the edits broke are rarer than those left.

The second pass looks up the seeds in every document, cuts a window around
the place where the item would lie, and aligns item and window word by word
(match +1, other word -1, gap -1). The score is the best local alignment
over the length of the item: 1 for a verbatim copy. A document holds an
item if the score is ``THRESHOLD`` or more, or if ``LONG_MATCH`` words align,
so that a long excerpt of a much longer item counts, too. At least
``SHORT_MATCH`` words must align, or all of a shorter item, since a phrase of
three or four words is no copy of a short question. Windows that can't
reach this, by the number of words they share with the item, aren't aligned.

Test items are the small, stated side: they are read in blocks of about
``BLOCK_WORDS`` words, the most that is collected and broadcast at a time;
every block is held against all documents. Both passes are narrow, apart
from the sums of the n-gram counts, and texts are never shuffled.

Items under ``MIN_ITEM_WORDS`` words are too short to align: a document holds
one if all its words stand in it in a row, however common they are.

Defined results: null texts hold no words, items without a word are in no
document. Every row of
``docs`` is judged by itself, whatever its id; an item given in several rows
is found once for each. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetmerge.llm.textblocks import blocks, marked, scramble, words

SEED_WORDS = 3
SEED_WINDOW = 3
RARE_DOCS = 64
THRESHOLD = 0.5
LONG_MATCH = 50
SHORT_MATCH = 7
MIN_ITEM_WORDS = 5
BLOCK_WORDS = 1 << 20

_FILTER_BITS = 22
_SPACED_BYTES = 4 << 20
_MAX_CELLS = 1 << 22
#: Scripts without spaces between words, as RE2 and as Java write them.
_SCRIPTS = ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar")
_SINGLES = "[" + "".join(rf"\p{{{x}}}" for x in _SCRIPTS) + "]"
_SINGLES_JAVA = "[" + "".join(rf"\p{{Is{x}}}" for x in _SCRIPTS) + "]"
_NO_WORD = r"[^\x00-\x7F\p{L}\p{N}\p{M}]+"
_ABSENT = np.iinfo(np.int64).max


def _spaced(column: pa.Array) -> pa.Array:
    """Spaces for what is above ASCII and in no word, and around characters that are words."""
    column = column.cast(pa.large_string())
    ascii_ = pc.fill_null(pc.string_is_ascii(column), True)
    other = pc.invert(ascii_)
    if not pc.any(other).as_py():
        return column
    some = pc.replace_substring_regex(column.filter(other), _NO_WORD, " ")
    some = pc.replace_substring_regex(some, f"({_SINGLES})", r" \1 ")
    return pc.replace_with_mask(column, other, some)


def _rows_words(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hash of every word, first word of every row and the end), block by block."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    step = pc.sum(pc.binary_length(column)).as_py() or 0
    step = max(1, len(column) * _SPACED_BYTES // max(1, step))
    for first in range(0, len(column), step):
        for lo, _, data, offsets in blocks(_spaced(column.slice(first, step))):
            x, offsets = marked(data, offsets)
            start, _, codes = words(x)
            yield first + lo, codes, np.searchsorted(start, offsets)


def _grams(codes: np.ndarray, size: int = SEED_WORDS) -> np.ndarray:
    out = np.zeros(max(0, len(codes) - size + 1), dtype=np.uint64)
    for k in range(size):
        out = out * np.uint64(0xD6E8FEB86659FD93) + codes[k : k + len(out)]
    return scramble(out)


@dataclass(frozen=True)
class _Lookup:
    """A sorted set of n-grams behind a bitmap that most other n-grams fail."""

    grams: np.ndarray
    bitmap: np.ndarray

    @staticmethod
    def of(grams: np.ndarray) -> _Lookup:
        bitmap = np.zeros(1 << _FILTER_BITS, dtype=bool)
        bitmap[(grams >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        return _Lookup(grams, bitmap)

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among ``grams``, number in the set) of those that are in it."""
        at = np.flatnonzero(self.bitmap[(grams >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        number = np.minimum(np.searchsorted(self.grams, grams[at]), len(self.grams) - 1)
        same = self.grams[number] == grams[at]
        return at[same], number[same]


def _hits(lookup: _Lookup, codes: np.ndarray, firsts: np.ndarray, size: int = SEED_WORDS):
    """(row, place, number) of the n-grams of the set that lie within one row."""
    place, number = lookup.find(_grams(codes, size)) if len(lookup.grams) else (np.zeros(0, np.int64),) * 2
    row = np.searchsorted(firsts, place, side="right") - 1
    inside = place + size <= firsts[row + 1]
    return row[inside], place[inside], number[inside]


@dataclass(frozen=True)
class Items:
    """A block of test items; ids is a one-column Arrow table."""

    ids: pa.Table
    codes: list[np.ndarray]
    lookup: _Lookup
    item: np.ndarray  # by n-gram: items and places that have it, as stretches
    place: np.ndarray
    first: np.ndarray
    short: list[tuple[int, _Lookup, list[list[int]]]]  # length, n-grams, items of each: those looked up whole

    @staticmethod
    def of(ids: pa.Table, codes: list[np.ndarray], chosen: np.ndarray | None = None, docs: np.ndarray | None = None) -> Items:
        """With the n-grams ``chosen`` (sorted) and their document counts: only the rare seeds."""
        grams = [_grams(c if len(c) >= MIN_ITEM_WORDS else c[:0]) for c in codes]
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(g)) for g in grams)])
        flat = np.concatenate([np.zeros(0, np.uint64), *grams])
        if chosen is not None:
            keep = np.zeros(len(flat), dtype=bool)
            lo = 0
            for g in grams:
                if len(g):
                    at = np.minimum(np.searchsorted(chosen, g), max(0, len(chosen) - 1))
                    count = np.where(chosen[at] == g, docs[at], 0) if len(chosen) else np.zeros(len(g), np.int64)
                    keep[lo : lo + len(g)] = (count > 0) & (count <= RARE_DOCS)
                    wide = min(SEED_WINDOW, len(g))
                    runs = np.lib.stride_tricks.sliding_window_view(np.where(count > 0, count, _ABSENT), wide)
                    rarest = np.arange(len(runs)) + runs.argmin(axis=1)
                    keep[lo + rarest[count[rarest] > 0]] = True
                lo += len(g)
            item, place, flat = item[keep], place[keep], flat[keep]
        order = np.argsort(flat, kind="stable")
        unique, first = np.unique(flat[order], return_index=True)
        return Items(ids, codes, _Lookup.of(unique), item[order], place[order], np.append(first, len(flat)), _short(codes))

    def windows(self, codes: np.ndarray, firsts: np.ndarray):
        """(row, item, from, to): where items may lie, as stretches of words of one row."""
        row, place, number = _hits(self.lookup, codes, firsts)
        many = self.first[number + 1] - self.first[number]
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        entry = np.repeat(self.first[number], many) + nth
        row, item = np.repeat(row, many), self.item[entry]
        origin = np.repeat(place, many) - self.place[entry]  # where the item would begin
        if not len(row):
            return row, item, origin, origin
        order = np.lexsort((origin, item, row))
        row, item, origin = row[order], item[order], origin[order]
        length = np.array([len(c) for c in self.codes])
        slack = length // 4 + 2
        new = np.ones(len(row), dtype=bool)
        new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (origin[1:] - origin[:-1] > slack[item[1:]])
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(row)) - 1
        row, item = row[begin], item[begin]
        lo = np.maximum(origin[begin] - slack[item], firsts[row])
        hi = np.minimum(origin[end] + length[item] + slack[item], firsts[row + 1])
        return row, item, lo, hi

    def matches(self, codes: np.ndarray, firsts: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item, matched, first word, last word) of the best place of every item a row holds."""
        row, item, lo, hi = self.windows(codes, firsts)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for i in np.unique(item):
            seq = self.codes[i]
            need = least_match(len(seq))
            mine = np.flatnonzero(item == i)
            mine = mine[np.argsort(hi[mine] - lo[mine], kind="stable")]
            while len(mine):
                take = max(1, min(len(mine), _MAX_CELLS // int(hi[mine[-1]] - lo[mine[-1]])))
                part, mine = mine[:take], mine[take:]
                view = _views(codes, lo[part], hi[part])
                able = np.isin(view, seq).sum(axis=1) >= need
                part, view = part[able], view[able]
                score, last = align(view, seq)
                good = score >= need
                part, view, score, last = part[good], view[good], score[good], last[good]
                view[np.arange(view.shape[1])[None, :] > last[:, None]] = 0
                _, back = align(view[:, ::-1], seq[::-1])
                begin = np.minimum(view.shape[1] - 1 - back, last)
                for k, p in enumerate(part):
                    at = lo[p] - firsts[row[p]]
                    found = (int(score[k]), -int(at + begin[k]), -int(at + last[k]))
                    key = (int(row[p]), int(i))
                    best[key] = max(best.get(key, found), found)
        for (r, i), (matched, begin, end) in sorted(best.items()):
            yield r, i, matched, -begin, -end
        for size, lookup, items in self.short:
            row, place, number = _hits(lookup, codes, firsts, size)
            _, once = np.unique(row * len(items) + number, return_index=True)
            for r, at, n in zip(row[once].tolist(), place[once].tolist(), number[once].tolist(), strict=True):
                at -= int(firsts[r])
                yield from ((r, i, size, at, at + size - 1) for i in items[n])


def _short(codes: list[np.ndarray]) -> list[tuple[int, _Lookup, list[list[int]]]]:
    out = []
    for size in range(1, MIN_ITEM_WORDS):
        whole: dict[int, list[int]] = {}
        for i, seq in enumerate(codes):
            if len(seq) == size:
                whole.setdefault(int(_grams(seq, size)[0]), []).append(i)
        if whole:
            out.append((size, _Lookup.of(np.array(sorted(whole), dtype=np.uint64)), [whole[g] for g in sorted(whole)]))
    return out


def least_match(words: int) -> int:
    """The net number of aligned words that makes a document hold an item of so many words."""
    return max(int(min(np.ceil(THRESHOLD * words), LONG_MATCH)), min(words, SHORT_MATCH))


def _views(codes: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The stretches as rows of equal length, filled up with 0."""
    at = lo[:, None] + np.arange(int((hi - lo).max(initial=0)))[None, :]
    return np.where(at < hi[:, None], codes[np.minimum(at, len(codes) - 1)], np.uint64(0))


def align(view: np.ndarray, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment of every row of ``view`` with ``seq``: (score, last column).

    One step per word of ``seq`` and all rows at once. A gap along the row
    is a running maximum: max over k <= j of H[k] - (j - k).
    """
    rows, width = view.shape
    score, last = np.zeros(rows, dtype=np.int32), np.zeros(rows, dtype=np.int64)
    if not rows or not width:
        return score, last
    place = np.arange(width, dtype=np.int32)
    above = np.zeros((rows, width + 1), dtype=np.int32)
    for word in seq:
        here = np.where(view == word, 1, -1).astype(np.int32) + above[:, :-1]
        np.maximum(here, above[:, 1:] - 1, out=here)
        np.maximum(here, 0, out=here)
        here = np.maximum.accumulate(here + place, axis=1) - place
        above[:, 1:] = here
        top = here.max(axis=1)
        better = top > score
        if better.any():
            score[better] = top[better]
            last[better] = here[better].argmax(axis=1)
    return score, last


def _read_items(items: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[pa.Table, list[np.ndarray]]]:
    """Blocks of test items with their word hashes."""
    rows = items.select(F.col(id_col).alias("item_id"), F.lower(F.col(text_col)).alias("text")).filter("text is not null")
    singles = F.length("text") - F.length(F.regexp_replace("text", _SINGLES_JAVA, ""))
    size = rows.agg(F.sum(F.size(F.split("text", r"\s+")) + singles)).collect()[0][0] or 0
    count = -(-int(size) // BLOCK_WORDS)
    for k in range(count):
        part = rows.filter(F.pmod(F.xxhash64("text"), F.lit(count)) == k).toArrow() if count > 1 else rows.toArrow()
        codes, keep = [], []
        for lo, hashes, firsts in _rows_words(part.column("text").combine_chunks()):
            for r in range(len(firsts) - 1):
                seq = hashes[firsts[r] : firsts[r + 1]]
                if len(seq):
                    codes.append(seq)
                    keep.append(lo + r)
        if codes:
            yield part.select(["item_id"]).take(keep).combine_chunks(), codes


def _with_rare_seeds(texts: DataFrame, ids: pa.Table, codes: list[np.ndarray]) -> Items:
    """Counts the documents that hold each n-gram of the items, over all documents."""
    every = Items.of(ids, codes)
    shared = texts.sparkSession.sparkContext.broadcast(every.lookup)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = shared.value
        for batch in batches:
            total = np.zeros(len(lookup.grams), dtype=np.int64)
            for _, hashes, firsts in _rows_words(batch.column(0)):
                row, _, number = _hits(lookup, hashes, firsts)
                once = np.unique(row * len(lookup.grams) + number) % max(1, len(lookup.grams))
                total += np.bincount(once, minlength=len(total))
            some = np.flatnonzero(total)
            yield pa.record_batch({"gram": lookup.grams[some].view(np.int64), "docs": total[some]})

    counted = texts.mapInArrow(count, "gram long, docs long").groupBy("gram").agg(F.sum("docs").alias("docs")).toArrow()
    gram = counted.column("gram").to_numpy().view(np.uint64)
    order = np.argsort(gram)
    return Items.of(ids, codes, gram[order], counted.column("docs").to_numpy()[order])


def _prepared(docs: DataFrame, items: DataFrame, text_col: str, item_id: str, item_text: str) -> Iterator[Items]:
    texts = docs.select(F.lower(F.col(f"`{text_col}`")).alias("text"))
    for ids, codes in _read_items(items, item_id, item_text):
        yield _with_rare_seeds(texts, ids, codes)


def find_items(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row per document and item it holds.

    (doc_id, item_id, score, matched, first_word, last_word): score from
    ``THRESHOLD`` (less for a long excerpt) to 1, the net number of aligned
    words, and the words of the document they span, from 0.
    """
    id_type, item_type = docs.schema[id_col].dataType, items.schema[item_id].dataType
    schema = T.StructType(
        [
            T.StructField(id_col, id_type),
            T.StructField("item_id", item_type),
            T.StructField("score", T.DoubleType()),
            T.StructField("matched", T.LongType()),
            T.StructField("first_word", T.LongType()),
            T.StructField("last_word", T.LongType()),
        ]
    )
    texts = docs.select(F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("text"))
    found = docs.sparkSession.createDataFrame([], schema)
    for block in _prepared(docs, items, text_col, item_id, item_text):
        found = found.union(texts.mapInArrow(_finder(docs.sparkSession.sparkContext.broadcast(block), id_col), schema))
    return found


def _finder(shared, id_col: str):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        length = np.array([len(c) for c in block.codes])
        for batch in batches:
            found = [
                (lo + row, *rest)
                for lo, hashes, firsts in _rows_words(batch.column(1))
                for row, *rest in block.matches(hashes, firsts)
            ]
            row, item, matched, begin, end = np.array(found, dtype=np.int64).reshape(-1, 5).T
            item_ids = block.ids.column(0).combine_chunks()
            yield pa.record_batch(
                {
                    id_col: batch.column(0).take(pa.array(row)),
                    "item_id": item_ids.take(pa.array(item)),
                    "score": matched / length[item],
                    "matched": matched,
                    "first_word": begin,
                    "last_word": end,
                }
            )

    return find


def _holds_item(docs: DataFrame, block: Items, text: Column) -> Column:
    shared = docs.sparkSession.sparkContext.broadcast(block)

    @F.arrow_udf("boolean")
    def holds(column: pa.Array) -> pa.Array:
        out = np.zeros(len(column), dtype=bool)
        for lo, hashes, firsts in _rows_words(column):
            out[[lo + row for row, *_ in shared.value.matches(hashes, firsts)]] = True
        return pa.array(out)

    return holds(F.lower(text))


def keep_uncontaminated(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that hold no test item, with all their columns."""
    kept = docs
    for block in _prepared(docs, items, text_col, item_id, item_text):
        kept = kept.filter(~_holds_item(docs, block, F.col(f"`{text_col}`")))
    return kept
