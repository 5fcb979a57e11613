"""Benchmark decontamination by the q-gram lemma.

Texts are lower-cased; runs of anything but letters and digits become one space.
An item's windows of ``window`` characters (the whole item, when shorter) are
searched in every document: if a window occurs with at most e edits, it shares at
least ``window - q + 1 - q * e`` of its q-grams with one band of diagonals (place
in the document less place in the item). Shared q-grams are counted in bands of
2 (e + 1) diagonals that overlap by half; where the bound is reached, every window
of the item that holds the grams counted is verified by alignment around the band. Lengths are in characters.

The index of the benchmark goes to every task. It is built in slices of at most
``slice_chars`` characters; each slice is one pass over the documents, whose result
is written before the next slice is broadcast, so that a task holds one of them
whatever the size of the benchmark. Grams that many items share are worked off by
halves of the texts and of the items, so that ``most_hits`` bounds what is held at once.

Defined cases: null or empty texts match nothing; items shorter than ``shortest``
after normalising are no evidence and match nothing; repeated items report under
each of their ids, repeated documents once per row; of several
windows in the budget the first to be verified is reported; very long texts are searched whole; an empty
table, or an empty benchmark, matches nothing; extra columns are kept by ``clean``
and ignored by ``find``.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomolake.llm import scratch
from tomolake.llm.textkit import U, chunks, lean, mix, utf8

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[[c for c in range(128) if not (48 <= c < 58 or 97 <= c < 123)]] = 32
_M = U(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Bounds:
    q: int = 10
    window: int = 80
    edit_rate: float = 0.08
    shortest: int = 24
    slice_chars: int = 8_000_000
    most_hits: int = 4_000_000  # shared grams that are held at once

    def edits(self, length: int) -> int:
        return min(int(self.edit_rate * length), (length - self.q) // self.q)


@lru_cache(maxsize=1)
def _is_word() -> np.ndarray:
    """Which code points are letters or digits."""
    return np.array([chr(c).isalnum() for c in range(0x110000)])


def characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code point, first byte) of each character of UTF-8."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    first = data[at]
    size = 1 + (first >= 0xC0) + (first >= 0xE0).astype(np.int64) + (first >= 0xF0)
    code = (first & np.array([0, 0x7F, 0x1F, 0x0F, 0x07], np.uint8)[size]).astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        code[more] = code[more] << 6 | (data[np.minimum(at[more] + k, len(data) - 1)] & 0x3F)
    return code, at


def _parted(x: np.ndarray) -> np.ndarray:
    """UTF-8 in which characters beyond ASCII that are no letters or digits are spaces, byte for byte."""
    if not len(x) or x.max() < 128:
        return x
    code, at = characters(x)
    other = (code >= 128) & ~_is_word()[np.minimum(code, 0x10FFFF)]
    if not other.any():
        return x
    return np.where(np.repeat(other, np.diff(np.append(at, len(x)))), np.uint8(32), x)


def normal(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the normalised texts; each text begins and ends without a space."""
    data, off = utf8(pc.utf8_lower(column.cast(pa.large_string())))
    x = _parted(_FOLD[data])
    if not len(x):
        return x, off
    space = x == 32
    drop = space.copy()
    drop[1:] &= space[:-1]
    inner = off[:-1][(off[:-1] < off[1:])]
    drop[inner] = space[inner]  # a text's first space goes
    keep = ~drop
    total = np.zeros(len(x) + 1, np.int64)
    np.cumsum(keep, out=total[1:])
    y, new = x[keep], total[off]
    last = new[1:][new[1:] > new[:-1]] - 1
    tail = last[y[last] == 32]
    if len(tail):  # and so does its last one
        stay = np.ones(len(y), bool)
        stay[tail] = False
        total = np.zeros(len(y) + 1, np.int64)
        np.cumsum(stay, out=total[1:])
        y, new = y[stay], total[new]
    return y, new


def grams(x: np.ndarray, q: int) -> np.ndarray:
    """The hash of the q symbols from each place, by doubling."""
    n = len(x) - q + 1
    if n <= 0:
        return np.zeros(0, U)
    with np.errstate(over="ignore"):
        power, width = x.astype(U) + U(1), 1
        done, out, factor = 0, None, _M
        while True:
            if q & width:
                if out is None:
                    out = power[: len(x) - width + 1]
                else:
                    out = out[: len(x) - done - width + 1] * factor + power[done : done + len(x) - done - width + 1]
                done += width
            if done == q:
                return mix(out[:n])
            power = power[:-width] * factor + power[width:]
            factor, width = factor * factor, 2 * width


class Index:
    """The q-grams of some benchmark items, sorted by hash, with a bit table in front."""

    def __init__(self, ids: list[int], texts: list[str], bounds: Bounds):
        self.b = bounds
        data, off = normal(pa.array(texts, pa.large_string()))
        self.items = [data[off[k] : off[k + 1]].tobytes() for k in range(len(ids))]
        self.symbols = [characters(np.frombuffer(t, np.uint8))[0] for t in self.items]
        self.ids = ids
        h, item, at = [], [], []
        for k, t in enumerate(self.symbols):
            if len(t) >= max(bounds.shortest, bounds.q):
                g = grams(t, bounds.q)
                h.append(g)
                item.append(np.full(len(g), k))
                at.append(np.arange(len(g)))
        h, item, at = (np.concatenate(x) if x else np.zeros(0, d) for x, d in ((h, U), (item, np.int64), (at, np.int64)))
        order = np.argsort(h, kind="stable")
        self.h, self.item, self.at = h[order], item[order], at[order]
        self.bits = max(16, int(8 * len(h)).bit_length())
        self.table = np.zeros(1 << self.bits, bool)
        self.table[h >> U(64 - self.bits)] = True
        n = np.array([len(t) for t in self.symbols], np.int64)
        self.w = np.minimum(n, bounds.window)
        self.e = np.array([bounds.edits(int(w)) if w >= bounds.q else 0 for w in self.w], np.int64)
        self.t = np.maximum(1, self.w - bounds.q + 1 - bounds.q * self.e)

    def matches(self, data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, from, to, edits) of the first verified window of each text and item, in characters; ``data`` is UTF-8."""
        if len(data) and data.max() >= 128:
            data, at = characters(data)
            off = np.searchsorted(at, off)
        yield from self._matches(data, off, 0, len(self.items))

    def _matches(self, data: np.ndarray, off: np.ndarray, first_item: int, end_item: int):
        q = self.b.q
        g = grams(data, q)
        if not len(g) or not len(self.h):
            return
        place = np.flatnonzero(self.table[g >> U(64 - self.bits)])
        lo = np.searchsorted(self.h, g[place])
        hi = np.searchsorted(self.h, g[place], side="right")
        hit = hi > lo
        place, lo, hi = place[hit], lo[hit], hi[hit]
        doc = np.searchsorted(off, place, side="right") - 1
        inside = place + q <= off[doc + 1]
        place, lo, hi, doc = place[inside], lo[inside], hi[inside], doc[inside]
        many = hi - lo
        total = int(many.sum())
        if not total:
            return
        if total > self.b.most_hits:  # texts and items do not depend on one another
            if (half := (len(off) - 1) // 2) > 0:
                yield from self._matches(data[: off[half]], off[: half + 1], first_item, end_item)
                for d, *rest in self._matches(data[off[half] :], off[half:] - off[half], first_item, end_item):
                    yield (d + half, *rest)
                return
            if end_item - first_item > 1:
                mid = (first_item + end_item) // 2
                yield from self.part(first_item, mid)._matches(data, off, first_item, mid)
                yield from self.part(mid, end_item)._matches(data, off, mid, end_item)
                return
            w, e = int(self.w[first_item]), int(self.e[first_item])
            if len(data) > 8 * (w + e):  # one text, one item: pieces that overlap by a window
                half = len(data) // 2 + (w + e)
                left = list(self._matches(data[:half], np.array([0, half]), first_item, end_item))
                yield from left
                if not left:
                    start = half - 2 * (w + e)
                    for d, k, x, y, n in self._matches(data[start:], np.array([0, len(data) - start]), first_item, end_item):
                        yield d, k, x + start, y + start, n
                return
        row = np.repeat(np.arange(len(place)), many)
        entry = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + lo[row]
        doc, place, item, at = doc[row], place[row], self.item[entry], self.at[entry]
        shift = place - off[doc] - at  # the diagonal
        half = self.e[item] + 1
        doc, item, at, shift, half = (np.concatenate([x, x]) for x in (doc, item, at, shift, half))
        n = len(doc) // 2
        band = np.concatenate([2 * np.floor_divide(shift[:n], 2 * half[:n]), 2 * np.floor_divide(shift[n:] + half[n:], 2 * half[n:]) + 1])
        order = np.lexsort((at, band, item, doc))
        doc, item, band, at, shift = (x[order] for x in (doc, item, band, at, shift))
        same = (doc[1:] == doc[:-1]) & (item[1:] == item[:-1]) & (band[1:] == band[:-1])
        once = np.concatenate([[True], ~(same & (at[1:] == at[:-1]))])
        doc, item, band, at, shift = (x[once] for x in (doc, item, band, at, shift))
        group = np.cumsum(np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1])]))
        need = self.t[item]
        last = np.arange(len(doc)) + need - 1
        ok = last < len(doc)
        ok[ok] = group[last[ok]] == group[ok]
        ok[ok] = at[last[ok]] - at[ok] <= self.w[item[ok]] - q
        found: set[tuple[int, int]] = set()
        tried: dict[int, set[int]] = {}
        for i in np.flatnonzero(ok):
            d, k = int(doc[i]), int(item[i])
            if (d, k) in found:
                continue
            w, e, t = int(self.w[k]), int(self.e[k]), self.symbols[k]
            half, b = e + 1, int(band[i])
            low = b // 2 * 2 * half - b % 2 * half  # the diagonals of the band
            high = low + 2 * half - 1
            text = data[off[d] : off[d + 1]]
            # a window that holds the gram at i and the last one of the bound begins in here
            first, final = max(0, int(at[last[i]]) + q - w), min(int(at[i]), len(t) - w)
            seen = tried.setdefault(int(group[i]), set())
            for some in ([s for s in dict.fromkeys((final, first)) if s not in seen], range(first + 1, final)):
                starts = np.array([s for s in some if s not in seen], np.int64)
                if not len(starts):
                    continue
                seen.update(starts.tolist())
                a, z = max(0, int(starts.min()) + low - e), int(starts.max()) + w + high + e
                edits = distances(t[starts[:, None] + np.arange(w)], text[a : max(a, z)], e)
                s = int(starts[edits.argmin()])
                if edits.min() <= e:
                    n, x, y = aligned(t[s : s + w], text[a:z], e)
                    found.add((d, k))
                    yield d, k, a + x, a + y, n
                    break


    def part(self, first_item: int, end_item: int) -> Index:
        """The same index with the grams of some of its items alone."""
        out = copy.copy(self)
        keep = (self.item >= first_item) & (self.item < end_item)
        out.h, out.item, out.at = self.h[keep], self.item[keep], self.at[keep]
        return out


def distances(patterns: np.ndarray, text: np.ndarray, most: int) -> np.ndarray:
    """The edits of the best occurrence of each pattern (a row each) anywhere in the text; most + 1 when there are more."""
    out = np.full(len(patterns), most + 1)
    live, j = np.arange(len(patterns)), np.arange(len(text) + 1, dtype=np.int32)
    row = np.zeros((len(patterns), len(text) + 1), np.int32)
    for c in patterns.T:
        new = row + 1
        np.minimum(new[:, 1:], row[:, :-1] + (text != c[live, None]), out=new[:, 1:])
        row = np.minimum.accumulate(new - j, axis=1) + j  # moving along the text costs one a step
        near = row.min(1) <= most
        if not near.all():
            live, row = live[near], row[near]
            if not len(live):
                return out
    out[live] = row.min(1)
    return out


def aligned(pattern: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int, int]:
    """(edits, from, to) of the best occurrence of the pattern in the band's stretch of text; edits is most + 1 when there is none."""
    n = len(text)
    j = np.arange(n + 1)
    row, start = np.zeros(n + 1, np.int64), j.copy()
    for i, c in enumerate(pattern):
        over, down = row[:-1] + (text != c), row + 1
        new, begin = down.copy(), start.copy()
        better = over < new[1:]
        new[1:][better], begin[1:][better] = over[better], start[:-1][better]
        level = new - j  # moving along the text costs one a step
        best = np.minimum.accumulate(level)
        of = np.maximum.accumulate(np.where(level == best, j, 0))
        row, start = best + j, begin[of]
        if row.min() > most:
            return most + 1, 0, 0
    y = int(row.argmin())
    return int(row[y]), int(start[y]), y


def slices(benchmark: DataFrame, bounds: Bounds) -> Iterator[Index]:
    """Indexes over the whole benchmark, each within ``slice_chars`` (a longer item stands alone)."""
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    ids, texts, total = [], [], 0
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        if ids and total + len(r.text) > bounds.slice_chars:
            yield Index(ids, texts, bounds)
            ids, texts, total = [], [], 0
        ids.append(r.item_id)
        texts.append(r.text)
        total += len(r.text)
    if ids:
        yield Index(ids, texts, bounds)


def _of_batch(index: Index, column: pa.Array):
    for lo in range(0, len(column), 1024):
        data, off = normal(column.slice(lo, 1024))
        for i, j in chunks(off):
            for d, *rest in index.matches(data[off[i] : off[j]], off[i : j + 1] - off[i]):
                yield (lo + i + d, *rest)


def find(docs: DataFrame, benchmark: DataFrame, bounds: Bounds = Bounds()) -> DataFrame:
    """(doc_id, item_id, start, end, edits): documents that hold an item's window; places are in the normalised text."""
    spark = docs.sparkSession
    shape = "doc_id long, item_id long, start long, end long, edits int"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out, last = None, None
    for index in slices(benchmark, bounds):
        out, last = _settled(out, last), spark.sparkContext.broadcast(index)

        @lean
        def run(batches, shared=last):
            x = shared.value
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                hits = [(ids[d], x.ids[i], a, b, e) for d, i, a, b, e in _of_batch(x, batch.column("text"))]
                cols = list(zip(*hits, strict=True)) if hits else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.int32()], strict=True)], names=["doc_id", "item_id", "start", "end", "edits"])

        found = rows.mapInArrow(run, shape)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], shape) if out is None else out


def _settled(df: DataFrame | None, shared):
    """``df``, which a broadcast index has made, as a written table; the index leaves the executors."""
    if df is None or shared is None:
        return df
    df = scratch.written(df, "slice")
    shared.unpersist()
    return df


def clean(docs: DataFrame, benchmark: DataFrame, bounds: Bounds = Bounds()) -> DataFrame:
    """The rows of ``docs`` that hold no item's window, with all their columns."""
    last = None
    for index in slices(benchmark, bounds):
        docs, last = _settled(docs, last), docs.sparkSession.sparkContext.broadcast(index)

        @lean
        def run(batches, shared=last):
            for batch in batches:
                bad = {h[0] for h in _of_batch(shared.value, batch.column("text").cast(pa.large_string()))}
                yield batch.filter(pa.array([k not in bad for k in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
