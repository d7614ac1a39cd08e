"""Word hashing over the raw UTF-8 bytes of Arrow batches, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at once; a longer document is a chunk of its own.
CHUNK = 1 << 19

_U = np.uint64
_MUL = _U(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_ODD = _rng.integers(1, 1 << 63, 16, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
#: The separators of words: space and the ASCII controls tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: All ASCII but letters: what stands between runs of letters.
NOT_LETTER = np.zeros(256, bool)
NOT_LETTER[:128] = True
NOT_LETTER[[*range(65, 91), *range(97, 123)]] = False

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n + 1:
        size = max(n + 1, CHUNK + 1)
        for i, base in enumerate((_BASE, _INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[i] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def texts(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    col = batch.column(column)
    if col.type != pa.large_string():
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off


def trim() -> None:
    """Give freed memory back: workers live on between tasks and stages, beside others of their executor."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


def chunks(off: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of about `most` bytes each, one row at least."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def word_hashes(raw: np.ndarray, off: np.ndarray, fold: bool = True, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of bytes outside `gap`) of the rows that `off` bounds, and the rows' bounds within them."""
    lo, hi = int(off[0]), int(off[-1])
    rows = off - lo
    b = raw[lo:hi]
    n = len(b)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    word = ~gap[b]
    start = word.copy()
    start[1:] &= ~word[:-1]
    begin = rows[:-1][rows[:-1] < rows[1:]]
    start[begin] = word[begin]
    end = word.copy()
    end[:-1] &= ~word[1:]
    last = rows[1:][rows[:-1] < rows[1:]] - 1
    end[last] = word[last]
    p, q = _power(n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum((_FOLDED if fold else _BYTE)[b] * p, out=total[1:])
    s, e = np.flatnonzero(start), np.flatnonzero(end)
    return mix((total[e + 1] - total[s]) * q[s]), np.searchsorted(s, rows)


def grams(h: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word sequences within rows, and the rows' bounds within them."""
    m = len(h) - k + 1
    size = np.maximum(np.diff(bounds) - k + 1, 0)
    out = np.concatenate(([0], np.cumsum(size)))
    if m <= 0 or not out[-1]:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    g = h[:m] * _ODD[0]
    for j in range(1, k):
        g += h[j : j + m] * _ODD[j]
    keep = np.zeros(m + 1, np.int32)
    has = size > 0
    np.add.at(keep, bounds[:-1][has], 1)
    np.add.at(keep, bounds[:-1][has] + size[has], -1)
    return mix(g[np.cumsum(keep[:-1]) > 0]), out


def shingle_sets(raw: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its k-word shingles; a shorter row with words has one, the row itself."""
    h, bounds = word_hashes(raw, off)
    g, at = grams(h, bounds, k)
    out = []
    for i in range(len(off) - 1):
        words = int(bounds[i + 1] - bounds[i])
        if words >= k:
            out.append(np.unique(g[at[i] : at[i + 1]]))
        elif words:
            w = h[bounds[i] : bounds[i + 1]]
            out.append(mix((w * _ODD[:words]).sum(dtype=np.uint64, keepdims=True) + _ODD[15:] * _U(words)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(s: np.ndarray) -> int:
    """A signed 64-bit key of a set of hashes, the same for equal sets."""
    k = mix(mix(s ^ _ODD[14]).sum(dtype=np.uint64, keepdims=True) + _ODD[13:14] * _U(len(s)))
    return int(k.view(np.int64)[0])
