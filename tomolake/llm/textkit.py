"""Whole-batch text kernels on numpy: the bytes of many texts at once."""

from __future__ import annotations

import ctypes
import functools
import gc

import numpy as np
import pyarrow as pa

U = np.uint64
_R = U(0x9E3779B97F4A7C15 | 1)
_POW: dict[str, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    if "up" not in _POW or len(_POW["up"]) < n:
        size = max(1 << 20, 1 << int(n).bit_length())
        inverse = U(pow(int(_R), -1, 1 << 64))
        with np.errstate(over="ignore"):
            for k, base in (("up", _R), ("down", inverse)):
                a = np.full(size, base, U)
                a[0] = 1
                _POW[k] = np.cumprod(a, dtype=U)
    return _POW["up"], _POW["down"]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty. No copy for ``large_string`` without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary()) if pa.types.is_binary(column.type) else column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    n = len(column)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(offsets: np.ndarray, most: int = (1 << 20) - 64):
    """Ranges of texts with at most ``most`` bytes together; a longer text stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of each text's first word and the end). Words are runs without white space, A-Z lower-cased."""
    n = len(data)
    if not n:
        return np.zeros(0, U), np.zeros(len(off), np.int64)
    low, space = LOWER[data], SPACE[data]
    before = np.empty(n, bool)
    before[0], before[1:] = True, space[:-1]
    firsts = off[:-1][off[:-1] < n]
    before[firsts] = True
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, space[1:]
    after[firsts[firsts > 0] - 1] = True
    start = np.flatnonzero(~space & before)
    end = np.flatnonzero(~space & after) + 1
    up, down = _powers(n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, U)
        np.cumsum((low.astype(U) + U(1)) * up[:n], out=total[1:])
        h = mix((total[end] - total[start]) * down[start])
    return h, np.searchsorted(start, off)


def shingle_sets(data: np.ndarray, off: np.ndarray, size: int = 5, found: tuple[np.ndarray, np.ndarray] | None = None) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its word shingles; ``found``: what ``words`` gave for it, if that is known.

    A text with fewer words has its whole sequence as one shingle; without words the set is empty.
    """
    h, first = words(data, off) if found is None else found
    return [x for x, _ in _shingled(h, first, size, None)]


def weighed_sets(data: np.ndarray, off: np.ndarray, size: int, weight) -> list[tuple[np.ndarray, np.ndarray]]:
    """The sets of ``shingle_sets``, each with the sum over every member's words of ``weight`` (a function of word hashes); 0 for a whole sequence."""
    h, first = words(data, off)
    return _shingled(h, first, size, weight(h))


def _shingled(h: np.ndarray, first: np.ndarray, size: int, worth: np.ndarray | None) -> list[tuple[np.ndarray, np.ndarray | None]]:
    n = len(h)
    out: list[tuple[np.ndarray, np.ndarray | None]] = []
    none = None if worth is None else np.zeros(1, np.int64)
    with np.errstate(over="ignore"):
        s = np.zeros(max(0, n - size + 1), U)
        for t in range(size):
            s = s * _R + h[t : t + len(s)]
        s = mix(s)
        total = None if worth is None else sum((worth[t : t + len(s)].astype(np.int64) for t in range(size)), np.zeros(len(s), np.int64))
        for i in range(len(first) - 1):
            a, b = first[i], first[i + 1]
            if b - a >= size and total is None:
                out.append((np.unique(s[a : b - size + 1]), None))
            elif b - a >= size:
                x, at = np.unique(s[a : b - size + 1], return_index=True)
                out.append((x, total[a : b - size + 1][at]))
            elif b > a:
                x = U(b - a)
                for w in h[a:b]:
                    x = x * _R + w
                out.append((mix(np.array([x ^ U(0xA5A5A5A5)], U)), none))
            else:
                out.append((np.zeros(0, U), None if none is None else none[:0]))
    return out


def set_hash(s: np.ndarray) -> tuple[int, int]:
    """128 bits that depend on the members alone, as two signed longs."""
    with np.errstate(over="ignore"):
        a = mix(np.array([s.sum(dtype=U) + U(len(s))], U))
        b = mix(np.array([mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U) + U(len(s))], U))
    return int(a.view(np.int64)[0]), int(b.view(np.int64)[0])


def lean(run):
    """A map over batches that gives its memory back at the end: Python workers live on, and share an executor's memory with its JVM."""

    @functools.wraps(run)
    def wrapped(*frames):
        try:
            yield from run(*frames)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped
