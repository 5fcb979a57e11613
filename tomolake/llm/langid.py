"""Language identification: a bidirectional gated recurrent network over bytes, in numpy.

Two GRUs read a text's UTF-8 bytes forwards and backwards; every byte position gets
label probabilities from both states, and a document's are the mean over its letter
positions. Whole texts are read, in windows of ``core`` positions that see
``context`` bytes more on both sides, so a long text is many rows of a batch. The
weights are learned by backpropagation through time on windows of a bounded sample
of labelled documents.

Defined cases: null texts and texts without a letter are ``und`` with score 0; rows
with a null ``lang`` or ``doc_id`` are not learned from; of rows that repeat an id and
a label one (by the least hash of its text) is learned from, and all are predicted,
equal texts alike; labels that tie go by their frequency in the sample, then by name;
without any labelled row everything is ``und``; with one label every text with a
letter has it; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tomolake.llm.textkit import lean, utf8

LETTER = re.compile(r"[^\W\d_]")
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass(frozen=True)
class Shape:
    hidden: int = 12
    core: int = 256
    context: int = 24
    length: int = 96  # of a training window
    batch: int = 192
    steps: int = 320
    rate: float = 0.02
    most_docs: int = 4_000
    least_docs: int = 8  # of a label, where it has as many
    seed: int = 5


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Network:
    """Weights: for both directions an embedding per byte (3h x 256), a recurrence (3h x h); an output layer."""

    def __init__(self, hidden: int, labels: int, seed: int):
        rng = np.random.default_rng(seed)
        h = hidden
        self.h = h
        self.p = {f"x{d}": rng.normal(0, 0.3, (3 * h, 256)).astype(np.float32) for d in "fb"}
        self.p |= {f"u{d}": rng.normal(0, 1 / np.sqrt(h), (3 * h, h)).astype(np.float32) for d in "fb"}
        self.p |= {f"o{d}": rng.normal(0, 1 / np.sqrt(h), (labels, h)).astype(np.float32) for d in "fb"}
        self.p["c"] = np.zeros((labels, 1), np.float32)

    def states(self, x: np.ndarray, d: str, keep: bool = False):
        """Yields (t, state) in reading order; x is time x batch. With ``keep`` also what backpropagation needs."""
        h, table, u = self.h, self.p[f"x{d}"], self.p[f"u{d}"]
        s = np.zeros((h, x.shape[1]), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            a = np.take(table, x[t], axis=1)
            b = u @ s
            g = _sigmoid(a[: 2 * h] + b[: 2 * h])
            z, r = g[:h], g[h:]
            n = np.tanh(a[2 * h :] + r * b[2 * h :])
            new = n + z * (s - n)
            text = x[t] != 0
            if not text.all():
                new *= text  # byte 0 pads: a text begins with an empty state wherever it lies
            yield (t, new, (s, z, r, n, b[2 * h :])) if keep else (t, new)
            s = new

    def logits(self, x: np.ndarray) -> np.ndarray:
        """time x labels x batch."""
        out = np.empty((len(x), len(self.p["c"]), x.shape[1]), np.float32)
        for t, s in self.states(x, "f"):
            np.matmul(self.p["of"], s, out=out[t])
        for t, s in self.states(x, "b"):
            out[t] += self.p["ob"] @ s + self.p["c"]
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and its gradients by backpropagation through time; weight: time x batch, sums to 1."""
        h, p = self.h, self.p
        kept = {d: list(self.states(x, d, True)) for d in "fb"}
        at = {d: {t: s for t, s, _ in kept[d]} for d in "fb"}
        g = {k: np.zeros_like(v) for k, v in p.items()}
        back: dict[int, np.ndarray] = {}
        loss = 0.0
        for t in range(len(x)):
            q = p["of"] @ at["f"][t] + p["ob"] @ at["b"][t] + p["c"]
            q = np.exp(q - q.max(0))
            q /= q.sum(0)
            loss -= float((weight[t] * np.log(np.maximum(q[y, np.arange(len(y))], 1e-9))).sum())
            q[y, np.arange(len(y))] -= 1
            e = q * weight[t]
            back[t] = e
            g["c"] += e.sum(1, keepdims=True)
            for d in "fb":
                g[f"o{d}"] += e @ at[d][t].T
        for d in "fb":
            u, gx, gu = p[f"u{d}"], g[f"x{d}"], g[f"u{d}"]
            ds = np.zeros((h, x.shape[1]), np.float32)
            seen = np.empty((3 * h, *x.shape), ds.dtype)
            for t, _, (s, z, r, n, bn) in reversed(kept[d]):
                ds = (ds + p[f"o{d}"].T @ back[t]) * (x[t] != 0)
                dn = ds * (1 - z) * (1 - n * n)
                dz = ds * (s - n) * z * (1 - z)
                dr = dn * bn * r * (1 - r)
                seen[:h, t], seen[h : 2 * h, t], seen[2 * h :, t] = dz, dr, dn
                db = np.concatenate([dz, dr, dn * r])
                gu += db @ s.T
                ds = ds * z + u.T @ db
            for k in range(3 * h):
                gx[k] += np.bincount(x.ravel(), seen[k].ravel(), 256)
        return loss, g


def train(texts: list[bytes], labels: list[int], n_labels: int, shape: Shape) -> Network:
    """Adam on random windows; the sample's labels are drawn evenly."""
    net = Network(shape.hidden, n_labels, shape.seed)
    rng = np.random.default_rng(shape.seed)
    by: list[list[int]] = [[] for _ in range(n_labels)]
    for k, y in enumerate(labels):
        by[y].append(k)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v2 = {k: np.zeros_like(v) for k, v in net.p.items()}
    if n_labels < 2:
        return net
    for step in range(1, shape.steps + 1):
        y = rng.integers(0, n_labels, shape.batch)
        x = np.zeros((shape.length, shape.batch), np.int64)
        for j, c in enumerate(y):
            t = texts[by[c][rng.integers(len(by[c]))]]
            a = rng.integers(max(1, len(t) - shape.length + 1))
            piece = np.frombuffer(t[a : a + shape.length], np.uint8)
            x[: len(piece), j] = piece
        weight = _IS_LETTER[x].astype(np.float32)
        weight /= max(1.0, float(weight.sum()))
        _, g = net.gradients(x, y, weight)
        rate = shape.rate * min(1.0, 2 * (1 - step / (shape.steps + 1)))
        for k in net.p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v2[k] = 0.99 * v2[k] + 0.01 * g[k] ** 2
            net.p[k] = (net.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def _windows(docs: DataFrame, shape: Shape) -> DataFrame:
    """(lang, piece, full): two seeded windows of each sampled document, or one around its first letter that is not full, for training only."""
    size, seed = 2 * shape.length, shape.seed

    def run(pdfs):
        for pdf in pdfs:
            rows = []
            for doc, lang, text in zip(pdf["doc_id"], pdf["lang"], pdf["text"], strict=True):
                raw = (text or "").encode()
                rng = np.random.default_rng([seed, int(doc) & 0xFFFFFFFF])
                letters = _IS_LETTER[np.frombuffer(raw, np.uint8)]
                kept = len(rows)
                for _ in range(2):
                    a = int(rng.integers(max(1, len(raw) - size + 1)))
                    if letters[a : a + size].sum() >= 8:
                        rows.append((lang, raw[a : a + size], True))
                if len(rows) == kept and letters.any():
                    a = max(0, int(letters.argmax()) - size // 2)
                    rows.append((lang, raw[a : a + size], False))
            yield pd.DataFrame(rows, columns=["lang", "piece", "full"])

    return docs.mapInPandas(run, "lang string, piece binary, full boolean")


def fit(docs: DataFrame, shape: Shape) -> tuple[list[str], Network | None]:
    """(labels, network): every label of a training row with a letter, learned from about ``most_docs`` documents, dealt evenly to the labels (least hashes of their ids)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    train_rows = rows.where("doc_id is not null and lang is not null").where(F.col("text").rlike(r"\p{L}")).where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 1)
    keys = train_rows.select("doc_id", "lang")
    sizes = keys.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).collect()
    if not sizes:
        return [], None
    each = max(shape.least_docs, shape.most_docs // len(sizes))
    rates = docs.sparkSession.createDataFrame([(r.lang, min(1.0, 4 * each / r.n)) for r in sizes], "lang string, rate double")
    few = keys.join(F.broadcast(rates), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) <= F.col("rate") * F.lit(1 << 30)).select("doc_id", "lang").distinct()  # bounds what one label's task ranks
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    picked = few.withColumn("rank", rank).where(F.col("rank") <= each).select("doc_id", "lang")
    # one row a document, chosen before anything is shuffled, so that an id that many rows repeat stays one row
    once = train_rows.join(F.broadcast(picked), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    sample = _windows(once, shape).orderBy("lang", "piece").collect()
    rich = {r.lang for r in sample if r.full}
    sample = [r for r in sample if r.full or r.lang not in rich]  # windows of few letters only where a label has no others
    count = Counter(r.lang for r in sample)
    names = sorted(count, key=lambda x: (-count[x], x))
    if not names:
        return [], None
    number = {x: k for k, x in enumerate(names)}
    return names, train([bytes(r.piece) for r in sample], [number[r.lang] for r in sample], len(names), shape)


def probabilities(net: Network, data: np.ndarray, off: np.ndarray, shape: Shape, batch: int = 4096) -> np.ndarray:
    """texts x labels: the mean over letter positions of each position's probabilities; zeros without any."""
    n, core, ctx = len(off) - 1, shape.core, shape.context
    batch = max(1, min(batch, 32_768 // len(net.p["c"])))  # many labels take smaller batches
    lens = np.diff(off)
    many = -(-lens // core)
    doc = np.repeat(np.arange(n), many)
    start = off[doc] + core * (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many))
    total = np.zeros((n, len(net.p["c"])))
    count = np.zeros(n)
    for lo in range(0, len(doc), batch):
        d, s = doc[lo : lo + batch], start[lo : lo + batch]
        longest = int(min(core, (off[d + 1] - s).max()))
        place = s[None, :] + np.arange(-ctx, longest + ctx)[:, None]
        inside = (place >= off[d]) & (place < off[d + 1])
        x = np.where(inside, data[np.clip(place, 0, len(data) - 1)], 0).astype(np.int64)
        q = net.logits(x)[ctx : ctx + longest]
        letter = (_IS_LETTER[x] & inside)[ctx : ctx + longest]
        q = np.exp(q - q.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        pooled = np.einsum("tlb,tb->bl", q, letter.astype(np.float32))
        for k in range(pooled.shape[1]):
            total[:, k] += np.bincount(d, pooled[:, k], n)
        count += np.bincount(d, letter.sum(0), n)
    return total / np.maximum(count, 1)[:, None]


def _predicted(names: list[str], net: Network | None, shape: Shape):
    @lean
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                texts = part.column("text")
                known = np.array([bool(t and LETTER.search(t)) for t in texts.to_pylist()])
                lang, score = np.full(len(known), "und", object), np.zeros(len(known))
                if net is not None and known.any():
                    data, off = utf8(texts)
                    p = probabilities(net, data, off, shape)
                    best = p.argmax(1)
                    lang[known] = np.array(names, object)[best[known]]
                    score[known] = np.clip(p[np.arange(len(p)), best][known], 0, 1)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``docs`` (doc_id, text, lang)."""
    names, net = fit(docs, shape)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_predicted(names, net, shape), "doc_id long, lang_pred string, score double")
