"""Toxicity of whole texts: noisy-channel restoration, then a lexical score.

A character trigram model is counted over every text of the corpus. Suspect
spans (runs with letters and leetspeak signs, letters or signs apart from one another,
letters repeated) become lattices: each sign is itself or a letter it stands for,
separators and repeats may be dropped, each at a cost. Viterbi decoding under the
trigram model picks the path; other text has one path, itself. Words of the
restored text and their prefixes are the features of a logistic regression,
fitted on a bounded sample of labelled training rows.

Defined cases: null text is the empty text, which scores the fitted base rate; a
null ``doc_id`` is not held out and never labelled; a document whose labels
contradict counts once for each; of rows that repeat a labelled ``doc_id`` one (by
the least hash of its text) is learned from, while all are scored, equal texts
alike; features that tie go by name, paths of a lattice that tie by the order of
choices; very long texts are decoded and scored whole; without labels of both
classes every text scores the smoothed base rate; an empty table gives an empty
table; extra columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomolake.llm import scratch
from tomolake.llm.textkit import chunks, lean, utf8

#: What signs stand for (fixed values of common leetspeak).
STANDS_FOR = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c"}
APART = " .-_*"
PUNCTUATION = "!|+("
K = 28  # a-z, space, any other sign
WIDE = 3  # times the cost of a dropped gap: what it costs to keep a wide one
CACHED = 64  # longer spans seldom come twice

_SIGNS = "0-9@$!|+€("
_UNIT, _GAPS, _RUN = rf"(?:[^\W\d_]|[{_SIGNS}])", r"[ .\-_*]++", r"[\w@$!|+€(]"
#: Four or more letters or signs apart from one another; a run with a letter and a sign, or with a letter three times in a row.
SUSPECT = re.compile(
    rf"(?<!\w)(?:{_UNIT}{_GAPS}){{3,}}{_UNIT}(?!\w)"
    rf"|(?<!{_RUN})(?={_RUN}*?[^\W\d_])(?:(?={_RUN}*?[{_SIGNS}])|(?={_RUN}*?([^\W\d_])\1\1)){_RUN}++"
)
GAPS = re.compile(_GAPS)
LETTER = re.compile(r"[^\W\d_]")
WORD = re.compile(r"[^\W\d_]+")

_SYMBOL = np.full(256, 27, np.int64)
_SYMBOL[97:123] = np.arange(26)
_SYMBOL[65:91] = np.arange(26)
_SYMBOL[[32, 9, 10, 11, 12, 13]] = 26


# -- the language model -----------------------------------------------------------------------


@lean
def _trigrams(batches):
    counts = np.zeros(K**3, np.int64)
    for batch in batches:
        data, off = utf8(batch.column(0))
        for i, j in chunks(off):
            raw = data[off[i] : off[j]]
            first = (raw & 0xC0) != 0x80  # a character is one symbol, as in decoding
            x = _SYMBOL[raw[first]]
            gap = np.append(np.cumsum(first) - first, len(x))[off[i + 1 : j] - off[i]]
            x[gap[gap < len(x)]] = 26  # a text's first character parts it from the text before
            if len(x) > 2:
                counts += np.bincount(x[:-2] * (K * K) + x[1:-1] * K + x[2:], minlength=K**3)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], names=["code", "n"])


def language_model(texts: DataFrame) -> np.ndarray:
    """log P(c | a, b) as K x K x K, interpolated with lower orders; counted over all rows, at most K**3 of them reach the driver."""
    rows = texts.mapInArrow(_trigrams, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    n = np.zeros(K**3)
    for r in rows.toLocalIterator():
        n[r.code] = r.n
    n = n.reshape(K, K, K)
    one = (n.sum((0, 1)) + 1) / (n.sum() + K)
    two = (n.sum(0) + 8 * one) / (n.sum((0, 2))[:, None] + 8)
    three = (n + 8 * two[None]) / (n.sum(2)[:, :, None] + 8)
    return np.log(three)


def _symbol(c: str) -> int:
    o = ord(c)
    return o - 97 if 97 <= o <= 122 else 26 if c == " " else 27


# -- decoding ---------------------------------------------------------------------------------


class Decoder:
    """Restores suspect spans under a trigram model; decoded spans are remembered (a bounded cache)."""

    def __init__(self, model: np.ndarray, sign: float = 1.0, keep_sign: float = 6.0, drop: float = 0.5, keep_gap: float = 4.0, repeat: float = 1.0, key: float = 20.0):
        self.m = model.tolist()
        self.cost = (sign, keep_sign, drop, keep_gap, repeat)
        self.key = key
        self.span = lru_cache(maxsize=200_000)(self._span)

    def _lattice(self, s: str):
        """For each place of ``s`` the choices (text, symbol, cost); symbol -1 stands for nothing."""
        sign, keep_sign, drop, keep_gap, repeat = self.cost
        spaced = len(s) > 3 and s[1] in APART
        gaps = GAPS.findall(s) if spaced else []
        unit = min(map(len, gaps), default=0)
        ends = len(s.rstrip(PUNCTUATION))
        i = 0
        while i < len(s):
            c = s[i]
            k = _symbol(c)
            if spaced and c in APART:
                c = GAPS.match(s, i)[0]  # a gap wider than the others is likely one between words
                yield [("", -1, -drop), (c, k, -keep_gap if len(c) == unit else -WIDE * drop)]
            elif c in STANDS_FOR:  # at the end of a word some signs are punctuation as well
                yield [(x, _symbol(x), -sign) for x in STANDS_FOR[c]] + [(c, k, -keep_sign if i < ends else 0.0)]
            elif i and c == s[i - 1] and c.isalpha():
                yield [(c, k, -repeat if i > 1 and s[i - 2] == c else 0.0), ("", -1, -repeat)]
            else:
                yield [(c, k, 0.0)]
            i += len(c)

    def _span(self, s: str) -> str:
        """The best path through the lattice of ``s`` (lower case, any length); ``s`` itself where a key, drawn evenly from all symbols, explains it better."""
        m = self.m
        states = {(26, 26): (0.0, None)}
        for options in self._lattice(s):
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, path) in states.items():
                for x, k, cost in options:
                    if k >= 0:
                        key, v = (b, k), score + cost + m[a][b][k]
                    else:
                        key, v = (a, b), score + cost
                    if key not in new or v > new[key][0]:
                        new[key] = (v, (path, x) if x else path)
            states = new
        score, path = max(((v + m[a][b][26], t) for (a, b), (v, t) in states.items()), key=lambda x: x[0])
        if score < -self.key - len(s) * np.log(K):
            return s
        out = []
        while path is not None:  # paths share their beginnings, so work and memory are linear in the span
            path, x = path
            out.append(x)
        return "".join(reversed(out))

    def __call__(self, text: str) -> str:
        """The whole text, lower-cased, with its suspect spans restored."""
        return SUSPECT.sub(self._restored, text.lower())

    def _restored(self, found: re.Match) -> str:
        s = found[0]
        if not LETTER.search(s):  # digits and drawings
            return s
        return self.span(s) if len(s) <= CACHED else self._span(s)


_CLASS = np.zeros(0x250, np.uint8)  # 1 letter, 2 gap, 4 sign; later letters of Unicode are taken for letters
_CLASS[[c for c in range(0x250) if LETTER.match(chr(c))]] = 1
_CLASS[[ord(c) for c in APART]] = 2
_CLASS[[ord(c) for c in "".join(STANDS_FOR) if ord(c) < 0x250]] = 4


def suspects(texts: list[str]) -> np.ndarray:
    """Which texts may hold a suspect span: a cheap test on all their characters at once, never false where ``SUSPECT`` finds one."""
    whole = "\n".join(texts)
    x = np.frombuffer(whole.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t.lower()) + 1 for t in texts]) if len(whole.lower()) != len(whole) else np.cumsum([len(t) + 1 for t in texts])
    if len(x) < 2:
        return np.zeros(len(texts), bool)
    c = np.where(x < 0x250, _CLASS[np.minimum(x, 0x24F)], 1).astype(np.uint8)
    c[x == ord("€")] = 4
    letter, gap = c == 1, c == 2
    hit = np.zeros(len(x), bool)
    sign, joined = c == 4, letter | (x == ord("_"))  # a run with a letter and a sign has a sign beside one of these
    hit[:-1] = sign[:-1] & joined[1:] | joined[:-1] & sign[1:]
    if len(x) > 2:
        hit[:-2] |= letter[:-2] & (x[:-2] == x[1:-1]) & (x[:-2] == x[2:])
    once = np.flatnonzero(~(gap & np.concatenate([[False], gap[:-1]])))  # runs of gaps count as one
    if len(once) > 6:
        unit, gap = (letter | sign)[once], gap[once]
        pair = unit[:-1] & gap[1:]
        hit[once[:-6]] |= pair[:-5] & pair[2:-3] & pair[4:-1] & unit[6:]
    out = np.zeros(len(texts), bool)
    out[np.searchsorted(ends, np.flatnonzero(hit), side="right")] = True
    return out


def restored(texts: list[str], decode: Decoder) -> list[str]:
    """Each text lower-cased and restored."""
    return [decode(t) if s else t.lower() for t, s in zip(texts, suspects(texts).tolist(), strict=True)]


# -- features and fit -------------------------------------------------------------------------


def features(restored: str, known: dict[str, int] | None = None, gate: set[str] | None = None):
    """Of the text's words: ``=word`` and ``prefix`` of 3 to 8 letters; only known ones (their numbers), or all."""
    words = set(WORD.findall(restored))
    out = set()
    if known is None:
        for w in words:
            out.add("=" + w)
            out.update(w[:k] for k in range(3, min(8, len(w)) + 1))
        return out
    for w in words:
        if w[:3] in gate:
            if (k := known.get("=" + w)) is not None:
                out.add(k)
            for n in range(3, min(8, len(w)) + 1):
                if (k := known.get(w[:n])) is not None:
                    out.add(k)
    return out


def _feature_counts(model):
    @lean
    def run(pdfs):
        decode = Decoder(model)
        counts: dict[str, list[int]] = {}
        for pdf in pdfs:
            for text, y in zip(restored([t or "" for t in pdf["text"]], decode), pdf["toxic"], strict=True):
                for f in features(text):
                    counts.setdefault(f, [0, 0])[int(y)] += 1
            if len(counts) > 150_000:
                yield pd.DataFrame([(f, *n) for f, n in counts.items()], columns=["f", "neg", "pos"])
                counts = {}
        yield pd.DataFrame([(f, *n) for f, n in counts.items()], columns=["f", "neg", "pos"])

    return run


def _rows_of(model, known):
    gate = {f.lstrip("=")[:3] for f in known}

    @lean
    def run(pdfs):
        decode = Decoder(model)
        for pdf in pdfs:
            yield pd.DataFrame({"toxic": pdf["toxic"].astype(int), "f": [sorted(features(t, known, gate)) for t in restored([t or "" for t in pdf["text"]], decode)]})

    return run


def logistic(rows: list[list[int]], y: np.ndarray, n: int, ridge: float = 0.3, steps: int = 300) -> np.ndarray:
    """Weights, bias last, by Newton's method on sparse 0/1 rows (conjugate gradients inside)."""
    at = np.concatenate([np.full(len(r), k) for k, r in enumerate(rows)] + [np.zeros(0)]).astype(np.int64)
    col = np.concatenate([np.asarray(r, np.int64) for r in rows] + [np.zeros(0, np.int64)])
    w = np.zeros(n + 1)
    reg = np.full(n + 1, ridge)
    reg[-1] = 1e-6

    def times(v):
        return np.bincount(at, v[col], len(rows)) + v[-1]

    def back(r):
        return np.append(np.bincount(col, r[at], n), r.sum())

    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(times(w), -30, 30)))
        g = back(y - p) - reg * w
        d, r = np.zeros(n + 1), g.copy()
        q, rr = r.copy(), r @ r
        for _ in range(steps):
            if rr < 1e-12:
                break
            hq = back(p * (1 - p) * times(q)) + reg * q
            a = rr / (q @ hq)
            d, r = d + a * q, r - a * hq
            rr, old = r @ r, rr
            q = r + rr / old * q
        w = w + d
        if np.abs(d).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, model: np.ndarray, most_rows: int = 12_000, support: int = 4):
    """({feature: number}, weights) from at most ``most_rows`` labelled training rows (least hashes first).

    Features are all that occur in ``support`` toxic rows at least and favour them; the rows bound their number.
    """
    spark = docs.sparkSession
    train = labels.where("doc_id is not null and toxic in (0, 1)").where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2)
    picked = train.select("doc_id", "toxic").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(most_rows)
    # one row a document, chosen before anything is shuffled, so that an id that many rows repeat stays one row
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    sample = scratch.written(texts.select("text", "toxic"), "labelled").repartition(scratch.partitions(spark))
    total = {int(r.toxic): r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n0, n1 = total.get(0, 0), total.get(1, 0)
    base = np.array([np.log((n1 + 0.5) / (n0 + 0.5 + 5 * (n0 + n1 == 0)))])
    if not n0 or not n1:
        return {}, base
    counted = sample.mapInPandas(_feature_counts(model), "f string, neg long, pos long").groupBy("f").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    ratio = F.log((F.col("pos") + 0.5) / (n1 + 1)) - F.log((F.col("neg") + 0.5) / (n0 + 1))
    best = counted.where(F.col("pos") >= support).where(ratio > 1.0).select("f")
    known = {f: k for k, f in enumerate(sorted(r.f for r in best.collect()))}
    rows = sample.mapInPandas(_rows_of(model, known), "toxic int, f array<int>").collect()
    return known, logistic([r.f for r in rows], np.array([r.toxic for r in rows], float), len(known))


def _scored(model, known, weights):
    gate = {f.lstrip("=")[:3] for f in known}
    w = weights.tolist()

    @lean
    def run(batches):
        decode = Decoder(model)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = restored([t or "" for t in part.column("text").to_pylist()], decode)
                x = np.array([w[-1] + sum(w[k] for k in features(t, known, gate)) for t in texts])
                score = 1 / (1 + np.exp(-np.clip(x, -30, 30)))
                names = [*part.schema.names, "score"]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score, pa.float64())], names=names)

    return run


def score(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, **bounds: int) -> DataFrame:
    """``docs`` (columns ``keep``, doc_id and text at least) with ``score``: the probability that a text is toxic."""
    docs = docs.withColumn("text", F.col("text").cast("string"))
    model = language_model(docs.select("text"))
    known, weights = fit(docs, labels, model, **bounds)
    rows = docs.select(*(keep or ["doc_id", "text"]))
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(_scored(model, known, weights), f"{shape}, score double")
