"""Periodic runs in texts, found by multi-scale minimizers.

A run is a maximal stretch of words with smallest period p that is at least
two periods (and ``MIN_WORDS`` words) long. Runs are found scale by scale, a
scale P standing for the periods P to 2P - 1:

* Periods under ``DIRECT`` are found by direct lag scans: words compared
  with those d places on, for every such d.
* At scale P every window of P/2 + 1 grams of P/2 words elects its least
  gram, the leftmost on a tie. The first window of a run and the window one
  period on lie in the run and read the same, so they elect grams one period
  apart: equal elected grams P to 2P - 1 places apart are seeds, and each
  seed is extended to the whole stretch that repeats at its distance.
* A gram inside a run of period P/4 or less would recur all over it. There
  the ends of that small run stand for its grams: a larger run repeats them
  at its own period. The one larger run that does not is a stretch of one
  small run followed by the next one with the same period; such neighbours
  are joined at every distance that brings their phases together.

Equal grams of P/2 words are over P/4 places apart outside small runs, so a
gram meets a bounded number of partners at each scale. Texts are numbered by
word exactly; hashes only choose seeds, and extension compares words.

Defined results: a null, empty or blank text has no run, and collapses to an
empty text. Repeated rows are documents of their own. Words are maximal
sequences of other bytes than 0x20 and 0x09-0x0D.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetmerge.llm.textblocks import blocks, scramble

MIN_WORDS = 12
DIRECT = 32

_PIECE = 1 << 20
_SPACES = b" \t\n\r\x0b\x0c"
_STEP = np.uint64(0x9E3779B97F4A7C15)

RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])
FOUND = T.StructType([T.StructField("runs", T.ArrayType(RUN, False)), T.StructField("collapsed", T.StringType())])


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, about a megabyte at a time."""
    lo = 0
    while lo < len(text):
        hi = min(len(text), lo + _PIECE)
        while hi < len(text) and text[hi] not in _SPACES:
            hi += 1
        yield text[lo:hi].split()
        lo = hi


def _numbered(text: bytes, ids: dict[bytes, int]) -> np.ndarray:
    """A text as the numbers of its words; ``ids`` gets the new ones."""
    parts = [np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int32, len(words)) for words in _pieces(text)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def _stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the stretches of true values."""
    edge = np.flatnonzero(same[1:] != same[:-1]) + 1
    if same[:1].any():
        edge = np.concatenate(([0], edge))
    if len(edge) % 2:
        edge = np.append(edge, len(same))
    return edge[::2], edge[1::2]


def _equal_length(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading entries agree."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        differ = a[at : min(n, at + step)] != b[at : min(n, at + step)]
        k = int(differ.argmax())
        if differ[k]:
            return at + k
        at, step = at + step, 2 * step
    return n


class _Runs:
    """The runs found so far: (start, end) -> smallest period."""

    def __init__(self, x: np.ndarray):
        self.x, self.found = x, {}

    def add(self, start: int, end: int, period: int) -> None:
        if end - start >= max(MIN_WORDS, 2 * period):
            self.found[start, end] = min(period, self.found.get((start, end), period))

    def extend(self, seeds: np.ndarray, lags: np.ndarray) -> None:
        """Adds the stretch that repeats at a lag around each seed; seeds in one stretch count once."""
        x, order = self.x, np.lexsort((seeds, lags))
        lag_before, end_before = -1, -1
        for i, p in zip(seeds[order].tolist(), lags[order].tolist(), strict=True):
            if (p == lag_before and i < end_before) or x[i] != x[i + p]:
                continue
            end = i + _equal_length(x[i : len(x) - p], x[i + p :])
            start = i - _equal_length(x[:i][::-1], x[p : i + p][::-1])
            self.add(start, end + p, p)
            lag_before, end_before = p, end

    def small(self, period: int, length: int) -> np.ndarray:
        """(start, end, period) of runs up to a period, from a length on."""
        rows = [(p, s, e) for (s, e), p in self.found.items() if p <= period and e - s >= length]
        return np.array(sorted(rows), dtype=np.int64).reshape(-1, 3)[:, [1, 2, 0]]


def _phase(x: np.ndarray, one: tuple, two: tuple) -> int | None:
    """The distance, modulo the period, at which words of one run recur in the next; None if never."""
    s, _, p = one
    root = x[s : s + p].tobytes()
    want, at, width = x[two[0] : two[0] + p].tobytes(), -1, x.itemsize
    while (at := (root + root).find(want, at + 1)) >= 0:
        if at % width == 0:
            return int(two[0] - s - at // width) % int(p)
    return None


def _neighbours(x: np.ndarray, small: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Seeds between each run and the next one of the same period, if that begins at its end."""
    seeds, lags = [], []
    for one, two in zip(small[:-1].tolist(), small[1:].tolist(), strict=True):
        (s, e, p), (s2, e2, p2) = one, two
        most = min(e - s, e2 - s2, 2 * scale - 1)
        if p != p2 or not e - p < s2 <= e or most < scale:
            continue
        phase = _phase(x, one, two)
        if phase is not None:
            lag = np.arange(scale + (phase - scale) % p, most + 1, p)
            seeds.append(np.maximum(s, s2 - lag))
            lags.append(lag)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *seeds]), np.concatenate([none, *lags])


def _elected(grams: np.ndarray, scale: int) -> np.ndarray:
    """Marks the least gram of every window of scale/2 + 1 grams."""
    places = np.uint64((1 << len(grams).bit_length()) - 1)
    least = (grams & ~places) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while width < scale // 2:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:-1], least[1:])
    chosen = np.zeros(len(grams), dtype=bool)
    chosen[(least & places).astype(np.int64)] = True
    return chosen


def _pairs(places: np.ndarray, grams: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of equal grams scale to 2 * scale - 1 places apart."""
    order = np.lexsort((places, grams))
    places, grams = places[order], grams[order]
    seeds, lags, k = [], [], 0
    at = np.arange(len(places))
    while len(at):
        k += 1
        at = at[at + k < len(places)]
        away = places[at + k] - places[at]
        near = (grams[at + k] == grams[at]) & (away < 2 * scale)
        at, away = at[near], away[near]
        seeds.append(places[at[away >= scale]])
        lags.append(away[away >= scale])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *seeds]), np.concatenate([none, *lags])


def _runs(x: np.ndarray, sizes: list[int]) -> dict[tuple[int, int], int]:
    """All runs of texts that follow each other in ``x``, the longest first, each ended by a number of its own."""
    runs = _Runs(x)
    for lag in range(1, DIRECT):
        starts, ends = _stretches(x[lag:] == x[:-lag])
        long = ends - starts >= max(MIN_WORDS - lag, lag)
        for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            runs.add(s, e + lag, lag)
    scale, gram, hashes = DIRECT, 1, None
    while sizes and sizes[0] >= 2 * scale:
        # texts of two periods or more; they stand first
        count = sum(n >= 2 * scale for n in sizes)
        end = sum(sizes[:count]) + count
        hashes = scramble(x[:end].astype(np.uint64)) if hashes is None else hashes[: end - gram + 1]
        while gram < scale // 2:
            hashes = scramble(hashes[:-gram] * _STEP + hashes[gram:])
            gram *= 2
        chosen = _elected(hashes, scale)
        small = runs.small(gram // 2, gram)  # all are known: grams have MIN_WORDS words or more
        small = small[small[:, 0] < len(hashes)]
        if len(small):
            inside = np.zeros(len(hashes) + 1, np.int32)
            np.add.at(inside, small[:, 0], 1)
            np.add.at(inside, small[:, 1] - gram + 1, -1)
            chosen &= np.cumsum(inside[:-1]) == 0
            chosen[small[:, 0]] = True
            chosen[small[:, 1] - gram] = True
            runs.extend(*_neighbours(x, small, scale))
        places = np.flatnonzero(chosen)
        runs.extend(*_pairs(places, hashes[places], scale))
        scale *= 2
    return runs.found


def _block(texts: list[bytes]) -> Iterator[tuple[list[tuple[int, int, int]], str]]:
    """For each text its runs (start, length, period) and the text without their repeats."""
    ids: dict[bytes, int] = {}
    numbered = [_numbered(t, ids) for t in texts]
    order = sorted(range(len(texts)), key=lambda k: -len(numbered[k]))
    sizes = [len(numbered[k]) for k in order]
    x = np.concatenate([part for r, k in enumerate(order) for part in (numbered[k], np.array([-1 - r], np.int32))])
    first = np.concatenate(([0], np.cumsum(np.array(sizes) + 1)))
    mine: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (s, e), p in _runs(x, sizes).items():
        r = int(np.searchsorted(first, s, side="right")) - 1
        mine[order[r]].append((s - int(first[r]), e - s, p))
    names = list(ids)
    for text, found in zip(numbered, mine, strict=True):
        found.sort(key=lambda run: (run[0], run[2]))
        if found:
            change = np.zeros(len(text) + 1, np.int32)
            for s, n, p in found:
                change[s + p] += 1
                change[s + n] -= 1
            text = text[np.cumsum(change[:-1]) == 0]
        parts = (b" ".join([names[i] for i in text[lo : lo + _PIECE].tolist()]) for lo in range(0, len(text), _PIECE))
        yield found, b" ".join(parts).decode("utf-8", "replace")


@F.arrow_udf(FOUND)
def _find(column: pa.Array) -> pa.Array:
    counts, cells, collapsed = [0], [], []
    for lo, hi, data, offsets in blocks(column):
        texts = [data[offsets[k] : offsets[k + 1]].tobytes() for k in range(hi - lo)]
        for found, kept in _block(texts):
            cells += found
            counts.append(len(cells))
            collapsed.append(kept)
    table = np.array(cells, dtype=np.int64).reshape(-1, 3)
    runs = pa.StructArray.from_arrays([pa.array(table[:, k]) for k in range(3)], names=["start", "length", "period"])
    return pa.StructArray.from_arrays(
        [pa.ListArray.from_arrays(pa.array(counts, pa.int32()), runs), pa.array(collapsed, pa.string())], names=["runs", "collapsed"]
    )


def find_runs(text: Column | str) -> Column:
    """struct(runs array<struct(start, length, period)> by start, then period; collapsed): the runs of a text and
    its words, joined by single spaces, without what any run holds after its first period."""
    return _find(F.col(text) if isinstance(text, str) else text)


def longest_run(runs: Column) -> Column:
    """The longest run; of equal ones the first to start, then the one of least period. Null without a run."""
    keyed = F.transform(runs, lambda r: F.struct((-r["length"]).alias("length"), r["start"].alias("start"), r["period"].alias("period")))
    best = F.array_min(keyed)
    return F.when(best.isNotNull(), F.struct(best["start"].alias("start"), (-best["length"]).alias("length"), best["period"].alias("period")))
