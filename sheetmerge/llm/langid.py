"""Language identification by cross-parsing entropy.

For every language a suffix automaton of labelled text is built. A text is
parsed against it greedily: each phrase is the longest piece, from where
the last one ended, that occurs in the language's text (Ziv and Merhav
1993). Phrases times log2 of the size of the labelled text, over the length
of the text, estimate the cross entropy in bits a byte; the language with
the least wins.

Texts are lower-cased and everything but letters is one space. The bytes of
whole texts are parsed in stretches of ``STRETCH``, thousands of them side by
side in numpy: one step follows one transition of every stretch.

Labelled text is a bounded sample: for each label, about ``SAMPLE_DOCS``
documents (a hash of id and text decides), of which ``SAMPLE_PIECES`` pieces
of ``PIECE`` characters are used: one of each document in hash order, then a
second one of each, and so on. Automata of that size are built on the driver,
label after label, and broadcast as transition lists, all labels'. A worker
holds tables of ``TABLE_BYTES`` at a time; with more labels it goes through
a batch of texts block of languages by block of languages.

Defined results: a text that is null or has no letter is ``und`` with score
0, and so is every text if nothing is labelled. Of equal languages the one
first by code point wins. The score is the winner's share of exp(-entropy)
over all languages. Labelled rows without a text or an id still count as
rows; repeated rows score alike.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetmerge.llm.textblocks import WORD_CODE, blocks
from sheetmerge.plans.sizing import broadcast_if_small
from sheetmerge.sources.land import land

TABLE_BYTES = 128 << 20
SAMPLE_DOCS = 100
SAMPLE_PIECES = 64
PIECE = 750
STRETCH = 256
UNKNOWN = "und"

_NO_DIGIT = WORD_CODE.copy()
_NO_DIGIT[48:58] = 0x20


def _plain(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters and single spaces; a space at either end of a row is dropped."""
    x = _NO_DIGIT[data]
    letter = x != 0x20
    after = np.zeros(len(x), dtype=bool)
    after[1:] = letter[:-1]
    starts = offsets[:-1][offsets[:-1] < len(x)]
    after[starts] = False
    keep = letter | after
    kept = np.concatenate(([0], np.cumsum(keep)))
    return x[keep], kept[offsets]


def _transitions(text: bytes) -> np.ndarray:
    """Suffix automaton of ``text`` as rows (from, byte, to); 0 is the root."""
    nexts: list[dict[int, int]] = [{}]
    length, link, last = [0], [-1], 0
    for c in text:
        new = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return np.array([(s, c, t) for s, out in enumerate(nexts) for c, t in out.items()], dtype=np.int32).reshape(-1, 3)


@dataclass(frozen=True)
class Model:
    names: list[str]
    sizes: list[int]
    edges: list[np.ndarray]
    key: str = ""

    def blocks(self) -> list[Model]:
        """The model in parts whose tables take ``TABLE_BYTES`` at most (or hold one language)."""
        cuts, used = [0], 0
        for k, edges in enumerate(self.edges):
            size = 4 * (int(edges[:, 2].max(initial=0)) + 1) * (len(np.unique(edges[:, 1])) + 2)
            if used and used + size > TABLE_BYTES:
                cuts.append(k)
                used = 0
            used += size
        bounds = zip(cuts, [*cuts[1:], len(self.names)], strict=True)
        return [Model(self.names[a:b], self.sizes[a:b], self.edges[a:b], f"{self.key}-{a}") for a, b in bounds if a < b]

    def tables(self) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """Per language (symbol of each byte, transitions, symbols).

        A transition that doesn't exist holds ~t, t being where the next
        phrase gets with that symbol from the root. The last symbol is the
        filling at the end of a stretch, which stays where it is; the last
        but one stands for bytes the language doesn't have.
        """
        out = []
        for edges in self.edges:
            known = np.unique(edges[:, 1])
            count = len(known) + 2
            symbol = np.full(256, count - 2, dtype=np.int64)
            symbol[known] = np.arange(len(known))
            states = int(edges[:, 2].max(initial=0)) + 1
            table = np.full((states, count), -1, dtype=np.int32)
            root = edges[edges[:, 0] == 0]
            table[:, symbol[root[:, 1]]] = ~root[:, 2]
            table[edges[:, 0], symbol[edges[:, 1]]] = edges[:, 2]
            table[:, count - 1] = np.arange(states)
            out.append((symbol, table.ravel(), count))
        return out


def _phrases(x: np.ndarray, offsets: np.ndarray, symbol: np.ndarray, table: np.ndarray, count: int) -> np.ndarray:
    """Number of phrases of every row."""
    size = np.diff(offsets)
    lanes = -(-size // STRETCH)
    row = np.repeat(np.arange(len(size)), lanes)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    start = offsets[row] + nth * STRETCH
    end = offsets[row + 1]
    code = symbol[x] if len(x) else np.zeros(1, dtype=np.int64)
    state, phrases = np.zeros(len(row), dtype=np.int64), np.zeros(len(row), dtype=np.int64)
    steps = int(min(STRETCH, size.max(initial=0)))
    for k in range(steps):
        at = start + k
        inside = at < end
        c = np.where(inside, code[np.minimum(at, len(code) - 1)], count - 1)
        to = table[state * count + c]
        # a phrase begins after a byte the language doesn't have, and where the last one can't go on
        phrases += inside & ((state == 0) | (to < 0))
        state = np.where(to < 0, ~to, to).astype(np.int64)
    return np.bincount(row, weights=phrases, minlength=len(size))


def _entropies(model: Model, tables, column: pa.Array) -> np.ndarray:
    """Bits a byte: (rows, languages); infinite for a text without a letter."""
    out = np.full((len(column), len(model.names)), np.inf)
    for lo, hi, data, offsets in blocks(column):
        x, offsets = _plain(data, offsets)
        size = np.diff(offsets)
        for k, (symbol, table, count) in enumerate(tables):
            bits = _phrases(x, offsets, symbol, table, count) * np.log2(max(2, model.sizes[k]))
            out[lo:hi, k] = np.where(size > 0, bits / np.maximum(size, 1), np.inf)
    return out


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    spark = labelled.sparkSession
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("lang is not null")
    counts = land(spark, rows.groupBy("lang").count(), "language-rows")
    at = F.xxhash64("id", "text")
    every = F.greatest(F.lit(1), F.floor(F.col("count") / SAMPLE_DOCS))
    sample = rows.join(broadcast_if_small(counts), "lang").filter(F.pmod(at, every) == 0)
    last = F.floor((F.length("text") - 1) / PIECE).cast("int")
    order = F.array_sort(F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(F.xxhash64("at", k).alias("h"), k.alias("nth"))))
    texts = sample.filter(F.length("text") > 0).select("lang", F.lower("text").alias("text"), at.alias("at"))
    pieces = texts.select("lang", "text", F.posexplode(F.slice(order, 1, SAMPLE_PIECES)).alias("turn", "of"))
    piece = F.substring("text", F.col("of.nth") * PIECE + 1, F.lit(PIECE)).alias("piece")
    pieces = land(spark, pieces.select("lang", "turn", F.col("of.h").alias("at"), piece), "language-sample")
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("turn", "at", "piece"))
    chosen = pieces.select("lang", "piece", turn.alias("n")).filter(F.col("n") <= SAMPLE_PIECES).orderBy("lang", "n")
    names, sizes, edges = [], [], []
    for name, parts in groupby(chosen.toLocalIterator(), key=lambda r: r["lang"]):
        data = np.frombuffer(" ".join(r["piece"] for r in parts).encode(), dtype=np.uint8)
        text, _ = _plain(data, np.array([0, len(data)]))
        if len(text):
            names.append(name)
            sizes.append(len(text))
            edges.append(_transitions(text.tobytes()))
    return Model(names, sizes, edges, uuid.uuid4().hex)


#: In a Python worker: the tables of the block of languages it works with, by the model's key.
_TABLES: dict[str, list] = {}


def _tables(model: Model) -> list[tuple[np.ndarray, np.ndarray, int]]:
    if model.key not in _TABLES:
        _TABLES.clear()
        _TABLES[model.key] = model.tables()
    return _TABLES[model.key]


def identify(model: Model, docs: DataFrame, text: Column) -> Column:
    """struct(lang, score) of a text column of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double>")
    def of(column: pa.Array) -> pa.Array:
        model = shared.value
        bits = np.concatenate([np.zeros((len(column), 0)), *(_entropies(part, _tables(part), column) for part in model.blocks())], axis=1)
        best = bits.argmin(axis=1) if model.names else np.zeros(len(column), dtype=int)
        least = bits[np.arange(len(column)), best] if model.names else np.full(len(column), np.inf)
        some = np.isfinite(least)
        share = np.zeros(len(column))
        share[some] = 1 / np.exp(least[some, None] - bits[some]).sum(axis=1)
        names = [model.names[b] if ok else UNKNOWN for b, ok in zip(best, some, strict=True)]
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(share)], ["lang", "score"])

    letters = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    return of(F.when(letters, F.lower(text)))
