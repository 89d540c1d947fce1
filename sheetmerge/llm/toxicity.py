"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A text is lower-cased and each word of it, with a boundary mark on either
side, gives all its byte n-grams of three to six bytes. N-grams are hashed
into buckets; every bucket has an embedding, the text is the mean of its
n-grams' embeddings, and a linear softmax of that mean gives the class. As
misspelt words share most n-grams with the right spelling, they share its
embeddings. A word that follows itself counts once, and the mean is taken
over ``PRIOR`` more n-grams than there are, so that a very short text needs
stronger evidence.

Embeddings and softmax are trained jointly (numpy, AdaGrad) on the driver
from a bounded sample: of each class, documents in hash order up to
``SAMPLE_DOCS`` and up to ``SAMPLE_BYTES`` bytes of bag. Labels without a
document don't count. Of a long text the first ``SAMPLE_CHARS`` characters
train, and a text that doesn't fit into the bytes left is passed over. Single words and
short stretches of the sample's clean documents train as clean, too. The
trained model is folded into one weight per bucket, since mean and softmax
are linear up to the final sigmoid: 2^``BUCKET_BITS`` floats are what
scoring needs, whatever the size of the corpus.

Defined results: a text without words, or null, has an empty bag and scores
the model's bias; a null label doesn't train, of several labels of one
document the mean decides (0.5: toxic). Where the sample lacks a class,
every text scores as the class it has (0.0 without labels).
Ids may be null or repeat; repeated rows score alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetmerge.llm.textblocks import BLOCK_BYTES, WORD_CODE, blocks, marked, row_sums, words

NGRAMS = (3, 4, 5, 6)
BUCKET_BITS = 17
DIM = 8
PRIOR = 100
EPOCHS = 6
RATE = 0.5
BATCH = 64
SAMPLE_DOCS = {0: 2400, 1: 1000}
SAMPLE_BYTES = 24 << 20
SAMPLE_CHARS = SAMPLE_BYTES // 8
THRESHOLD = 0.7

_NGRAM_BASE = np.uint64(0x100000001B3)
_NGRAM_MIX = np.uint64(0x9E3779B97F4A7C15)


def _buckets(data: np.ndarray, offsets: np.ndarray):
    """The rows' new offsets, and per n: (valid, bucket) of the n-gram at each byte."""
    x, offsets = marked(data, offsets)
    start, end, code = words(x)
    again = np.flatnonzero(code[1:] == code[:-1]) + 1
    # not across rows: between two rows there is a row's end
    again = again[np.searchsorted(offsets, start[again], side="right") == np.searchsorted(offsets, start[again - 1], side="right")]
    cover = np.zeros(len(x) + 1, dtype=np.int8)
    cover[start[again]] += 1
    cover[end[again]] -= 1
    x[np.cumsum(cover[:-1], dtype=np.int8) > 0] = 0x20
    return offsets, _ngrams(x)


def _ngrams(x: np.ndarray):
    size = len(x)
    at = np.arange(size)
    after = np.full(size, size)
    after[:-1] = np.minimum.accumulate(np.where(x == 0x20, at, size)[::-1])[::-1][1:]  # next boundary
    code = x.astype(np.uint64)
    for n in range(2, max(NGRAMS) + 1):
        code = code[: max(0, size - n + 1)] * _NGRAM_BASE + x[n - 1 :]
        if n in NGRAMS:
            upto = after[: len(code)]
            valid = (upto >= at[: len(code)] + n - 1) & (upto < size)
            yield valid, ((code * _NGRAM_MIX) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _bag(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, weights) of one text; the weights sum to n / (n + PRIOR)."""
    _, found = _buckets(np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)]))
    buckets, counts = np.unique(np.concatenate([b[v] for v, b in found]), return_counts=True)
    return buckets.astype(np.int32), (counts / (PRIOR + counts.sum())).astype(np.float32)


def _stretches(data: np.ndarray):
    """A text in stretches of about ``BLOCK_BYTES``, cut between words.

    Each but the first begins with the last word of the one before, so that
    a word that follows itself is seen to; that word is given, too, since it
    counted already.
    """
    lo, again = 0, data[:0]
    while lo < len(data):
        hi = min(len(data), lo + BLOCK_BYTES)
        while hi < len(data) and WORD_CODE[data[hi]] != 0x20:
            part = WORD_CODE[data[hi : hi + BLOCK_BYTES]] == 0x20
            hi = hi + int(part.argmax()) if part.any() else min(len(data), hi + BLOCK_BYTES)
        yield np.concatenate((again, [np.uint8(0x20)], data[lo:hi])) if len(again) else data[lo:hi], again
        letters = WORD_CODE[data[lo:hi]] != 0x20
        if letters.any():
            end = len(letters) - int(letters[::-1].argmax())
            gaps = np.flatnonzero(~letters[:end])
            again = data[lo + (int(gaps[-1]) + 1 if len(gaps) else 0) : lo + end]
        lo = hi


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # log odds per bucket
    bias: float

    def _sums(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The weights and the number of the n-grams of each row."""
        offsets, found = _buckets(data, offsets)
        total, count = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
        for valid, bucket in found:
            last = np.minimum(offsets, len(valid))
            total += row_sums(np.where(valid, self.weights[bucket], 0.0), last)
            count += row_sums(valid, last)
        return total, count

    def _long_sums(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`_sums` of one long text, a stretch at a time."""
        total, count = np.zeros(1), np.zeros(1)
        for stretch, again in _stretches(data):
            for part, sign in ((stretch, 1), (again, -1)):
                if len(part):
                    t, c = self._sums(part, np.array([0, len(part)]))
                    total, count = total + sign * t, count + sign * c
        return total, count

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.empty(len(column))
        for lo, hi, data, offsets in blocks(column):
            total, count = self._long_sums(data) if hi - lo == 1 and len(data) > 2 * BLOCK_BYTES else self._sums(data, offsets)
            out[lo:hi] = 1 / (1 + np.exp(-np.clip(self.bias + total / (PRIOR + count), -500, 500)))
        return out


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 1) -> Model:
    """Embeddings and softmax by minibatch AdaGrad on the cross entropy."""
    rng = np.random.default_rng(seed)
    emb = np.zeros((1 << BUCKET_BITS, DIM), dtype=np.float32)
    emb_sq = np.full_like(emb, 1e-8)
    soft = rng.normal(0, 1, (DIM, 2)).astype(np.float32)
    soft_sq = np.full_like(soft, 1e-8)
    bias, bias_sq = np.zeros(2, dtype=np.float32), np.full(2, 1e-8, dtype=np.float32)
    order = np.arange(len(bags))
    for _ in range(EPOCHS):
        rng.shuffle(order)
        for lo in range(0, len(order), BATCH):
            rows = order[lo : lo + BATCH]
            used, place = np.unique(np.concatenate([bags[r][0] for r in rows]), return_inverse=True)
            mean = np.zeros((len(rows), len(used)), dtype=np.float32)
            mean[np.repeat(np.arange(len(rows)), [len(bags[r][0]) for r in rows]), place] = np.concatenate([bags[r][1] for r in rows])
            hidden = mean @ emb[used]
            logits = hidden @ soft + bias
            error = np.exp(logits - logits.max(axis=1, keepdims=True))
            error /= error.sum(axis=1, keepdims=True)
            error[np.arange(len(rows)), labels[rows]] -= 1
            d_soft, d_bias, d_emb = hidden.T @ error, error.sum(axis=0), mean.T @ (error @ soft.T)
            emb_sq[used] += d_emb**2
            emb[used] -= RATE * d_emb / np.sqrt(emb_sq[used])
            soft_sq += d_soft**2
            soft -= RATE * d_soft / np.sqrt(soft_sq)
            bias_sq += d_bias**2
            bias -= RATE * d_bias / np.sqrt(bias_sq)
    return Model((emb @ (soft[:, 1] - soft[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


def _clean_pieces(text: bytes, rng: np.random.Generator) -> list[bytes]:
    """A single word and four words in a row, from a clean text."""
    found, out = text.split(), []
    for n in (1, 4):
        if len(found) > n:
            at = int(rng.integers(0, len(found) - n + 1))
            out.append(b" ".join(found[at : at + n]))
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from the labelled rows of ``docs``; ``labels`` has the id and 0 or 1.

    Both may hold anything beside these columns. The sample is taken from
    (id, length) rows, so only the sampled texts are read out.
    """
    marks = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
        .dropna()
        .groupBy("id")
        .agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    )
    texts = docs.select(F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("text"))
    marks = marks.join(texts.select("id"), "id", "left_semi")
    bags, ys, rng = [], [], np.random.default_rng(7)
    for label, most in SAMPLE_DOCS.items():
        ids = [r.id for r in marks.filter(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(most).collect()]
        # ids in hash order until the bytes are spent: a sample that doesn't depend on row order
        begin = F.substring("text", 1, SAMPLE_CHARS)
        chosen = texts.filter(F.col("id").isin(ids)).groupBy("id").agg(F.min(begin).alias("text")) if ids else None
        left = SAMPLE_BYTES
        for row in chosen.orderBy(F.xxhash64("id"), "id").toLocalIterator() if ids else ():
            text = (row.text or "").encode()
            if len(text) > left:
                continue
            left -= len(text)
            bags.append(_bag(text))
            ys.append(label)
            for piece in _clean_pieces(text, rng) if label == 0 else ():
                bags.append(_bag(piece))
                ys.append(0)
    if len(set(ys)) < 2:
        return Model(np.zeros(1 << BUCKET_BITS), 500.0 if 1 in ys else -500.0)
    return fit(bags, np.array(ys))


def score(model: Model, docs: DataFrame, text: Column) -> Column:
    """The probability of the toxic class as a column of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    @F.arrow_udf("double")
    def of(column: pa.Array) -> pa.Array:
        return pa.array(Model(*shared.value).scores(column))

    return of(F.lower(text))


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""
    return docs.filter(score(model, docs, F.col(f"`{text_col}`")) < threshold)
