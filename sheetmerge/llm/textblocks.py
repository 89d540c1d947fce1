"""Arrow text columns as flat byte buffers, a bounded number of bytes at a time.

The Python operators of this package are numpy loops over the UTF-8 bytes
of many documents at once. A batch that Spark sends may hold tens of
megabytes; numpy temporaries are several times their input, so the batch is
cut into blocks of whole documents of about ``budget`` bytes (one longer
document is a block of its own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20

#: 1 for the whitespace bytes 0x20 and 0x09-0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def blocks(column: pa.Array, budget: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, last row + 1, bytes, offsets); a null text is empty.

    ``offsets`` has one entry more than the block has rows and starts at 0.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    filled = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(filled)
    if n == 0:
        return
    buffers = filled.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[filled.offset : filled.offset + n + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + budget, side="right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi, data[offsets[lo] : offsets[hi]], (offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each row's stretch; 0 for an empty stretch."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[offsets[1:]] - total[offsets[:-1]]


#: ASCII letters in lower case, digits and every byte above ASCII; the rest is a space.
WORD_CODE = np.full(256, 0x20, dtype=np.uint8)
for _b in (*range(48, 58), *range(97, 123), *range(128, 256)):
    WORD_CODE[_b] = _b
for _b in range(65, 91):
    WORD_CODE[_b] = _b + 32

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_STEP = 1 << 16


def _powers(base: int) -> np.ndarray:
    out, x = np.empty(_STEP, dtype=np.uint64), 1
    for i in range(_STEP):
        out[i] = x
        x = x * base & (2**64 - 1)
    return out


_UP = _powers(int(_BASE))
_DOWN = _powers(pow(int(_BASE), -1, 2**64))


def scramble(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit codes over all their bits (the SplitMix64 finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def marked(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word codes with a space before every row and after the last, and the rows' new offsets."""
    n = len(offsets) - 1
    out = np.full(len(data) + n + 1, 0x20, dtype=np.uint8)
    row = np.repeat(np.arange(1, n + 1), np.diff(offsets))
    out[np.arange(len(data)) + row] = WORD_CODE[data]
    return out, offsets + np.arange(n + 1)


def words(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of each word of a marked buffer; equal words have equal hashes.

    hash = sum of byte * base^(place in the word) mod 2^64, from one running
    sum of byte * base^(place in the buffer) that is scaled back by the
    place of the word; the running sum is redone every ``_STEP`` bytes.
    """
    inside = x != 0x20
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    at = np.arange(len(x)) & (_STEP - 1)
    run = np.zeros(len(x) + 1, dtype=np.uint64)
    np.cumsum(x * _UP[at], out=run[1:])
    # a word across a step is summed in the two (or more) parts it has
    h = np.zeros(len(start), dtype=np.uint64)
    same = (start >> 16) == ((end - 1) >> 16)
    s, e = start[same], end[same]
    h[same] = (run[e] - run[s]) * _DOWN[at[s]]
    for k in np.flatnonzero(~same):
        w = x[start[k] : end[k]].astype(np.uint64)
        code, scale = 0, 1
        for lo in range(0, len(w), _STEP):
            part = w[lo : lo + _STEP]
            code += scale * int((part * _UP[: len(part)]).sum())
            scale = scale * pow(int(_BASE), _STEP, 2**64) & (2**64 - 1)
        h[k] = np.uint64(code & (2**64 - 1))
    return start, end, scramble(h)
