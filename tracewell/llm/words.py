"""Words and word hashes of whole Arrow string batches, without a loop over words.

A word is a maximal run of bytes other than the six ASCII white-space characters
(space, tab, line feed, vertical tab, form feed, carriage return). Hashes are 64 bits wide; two different words share one with a chance of
about 2**-64, which the operators accept where they say so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.PCG64(20240607))
BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, to spread the bits of a sum or product."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(column: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, offsets)`` of runs of rows of about ``most`` bytes.

    Nulls count as empty. A single longer row makes a longer chunk.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, raw, data = column.buffers()
    offsets = np.frombuffer(raw, np.int64, n + 1, column.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j, whole[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each row the index of its first word.

    The last array has one more entry than there are rows.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~SPACE[data]
    starts = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    starts[cuts] = inside[1:-1][cuts]
    ends[cuts - 1] = inside[1:-1][cuts - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, offsets)


def span_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span ``data[s:e]``, from running sums."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))


_STEPS = [np.uint64(int(x) | 1) for x in _RNG.integers(1, 2**63, 64, dtype=np.uint64)]


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words inside a row, and each row's first shingle.

    A row with fewer than ``k`` words, but at least one, has its whole sequence as its
    only shingle.
    """
    counts = np.diff(first)
    n = len(words)
    if n >= k:
        h = words[: n - k + 1] * _STEPS[0]
        for i in range(1, k):
            h = h + words[i : n - k + 1 + i] * _STEPS[i]
        h = mix(h)
    else:
        h = np.zeros(0, np.uint64)
    have = np.maximum(counts - k + 1, 0)
    short = (counts > 0) & (counts < k)
    total = np.where(short, 1, have)
    out_first = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(total, out=out_first[1:])
    out = np.empty(int(out_first[-1]), np.uint64)
    full = np.flatnonzero(have)
    if len(full):
        take = np.repeat(first[full] - out_first[full], have[full])
        at = np.repeat(out_first[full], have[full]) + _ramp(have[full])
        out[at] = h[take + at]
    for r in np.flatnonzero(short):
        run = words[first[r] : first[r + 1]]
        x = (run * np.array(_STEPS[: len(run)], np.uint64)).sum(keepdims=True)
        out[out_first[r]] = mix(x + _STEPS[k])[0]
    return out, out_first


def _ramp(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts)
