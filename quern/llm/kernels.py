"""Vectorised byte kernels shared by the corpus operators.

Every kernel works on the UTF-8 buffer of an Arrow string column, so a batch of
documents costs a handful of numpy passes and no per-document Python loop.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x9E3779B97F4A7C55)  # odd, so it has an inverse modulo 2**64

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[:33] = True
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = IS_WORD[128:] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit keys (wraps modulo 2**64)."""
    x = np.asarray(x, dtype=np.uint64)
    with np.errstate(over="ignore"):  # scalars would warn
        x = (x ^ (x >> np.uint64(30))) * _MIX1
        x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def utf8_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; NULL counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    if not wide and not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each; a longer row stands alone."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi
        lo = hi


def ngram_keys(data: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """Key of the n bytes that end at each position; bytes before a row's start are 0.

    The latest byte is the lowest eight bits, so ``key >> 8`` is the context and
    ``key & (2**(8(n-1)) - 1)`` the next shorter n-gram.  n <= 8.
    """
    keys = data.astype(np.uint64)
    wide = keys.copy()
    for j in range(1, n):
        keys[j:] |= wide[:-j] << np.uint64(8 * j) if len(wide) > j else np.uint64(0)
    starts, ends = offsets[:-1], offsets[1:]
    for r in range(n - 1):
        at = starts[starts + r < ends] + r
        keys[at] &= np.uint64((1 << (8 * (r + 1))) - 1)
    return keys


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each maximal run of ``member`` bytes inside a row."""
    inside = member[data]
    if not len(inside):
        z = np.zeros(0, np.int64)
        return z, z, z
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    cut = offsets[:-1][offsets[:-1] < len(data)]
    begin[cut] = inside[cut]
    stop = np.zeros(len(data) + 1, dtype=bool)
    stop[1:-1] = inside[:-1] & ~inside[1:]
    stop[-1] = inside[-1]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    stop[inner] |= inside[inner - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop)
    row = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, row


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + 1)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit content hash of data[start:end] for every span, from one prefix sum."""
    up, down = _powers(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64, out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts])


def shingles(word_hash: np.ndarray, row: np.ndarray, rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each run of ``width`` words of a row; a shorter row gives one shingle of all its words.

    A row without words has no shingle.
    """
    n = len(word_hash)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    count = np.bincount(row, minlength=rows)
    first = np.concatenate(([0], np.cumsum(count)))[:-1]
    at = np.arange(n) - first[row]
    keep = at <= np.maximum(count[row] - width, 0)
    here = np.flatnonzero(keep)
    out = np.zeros(len(here), np.uint64)
    for j in range(width):
        ok = at[here] + j < count[row[here]]
        part = word_hash[np.minimum(here + j, n - 1)] * ok.astype(np.uint64)
        out = mix64(out * _GOLD + part + np.uint64(j + 1))
    return out, row[here]


def distinct_per_row(values: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row, ordered by row and then value."""
    if not len(values):
        return values, row
    order = np.lexsort((values, row))
    v, r = values[order], row[order]
    new = np.ones(len(v), dtype=bool)
    new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    return v[new], r[new]


def minhash(values: np.ndarray, row: np.ndarray, rows: int, size: int, seed: int) -> np.ndarray:
    """rows x size minima of seeded 32-bit hashes; rows without values keep 2**32 - 1.

    ``row`` must not decrease.
    """
    out = np.full((rows, size), 0xFFFFFFFF, dtype=np.uint32)
    if not len(values):
        return out
    new = np.ones(len(row), dtype=bool)
    new[1:] = row[1:] != row[:-1]
    first = np.flatnonzero(new)
    rng = np.random.default_rng(seed)
    low = (mix64(values) >> np.uint64(32)).astype(np.uint32)
    a = rng.integers(0, 1 << 31, size=size, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 1 << 32, size=size, dtype=np.uint32)
    here = row[first]
    for j in range(size):
        h = low * a[j] + b[j]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        out[here, j] = np.minimum.reduceat(h, first)
    return out
