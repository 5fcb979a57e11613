"""Scores against independent plain-Python versions: the character model, decoding by all paths, the regression, the recurrent network."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tomolake.llm import langid, toxicity

RING = ["the", "other", "thing", "and", "ring", "stone", "later", "in", "on", "inner", "rather"]
BAD = ["idiot", "moron"]


def symbol(c):
    c = c.lower() if c.isascii() else c
    return ord(c) - 97 if "a" <= c <= "z" else 26 if c in " \t\n\x0b\x0c\r" else 27


def character_model(texts):
    """log P(c | a, b) by dictionaries: trigrams of all texts, whose first characters count as gaps but for the first text of all."""
    count = Counter()
    x = []
    for k, t in enumerate(texts):
        y = [symbol(c) for c in t]
        if k and y:
            y[0] = 26
        x += y
    for a, b, c in zip(x, x[1:], x[2:], strict=False):
        count[a, b, c] += 1
    one, two, pair, single, total = Counter(), Counter(), Counter(), Counter(), sum(count.values())
    for (a, b, c), n in count.items():
        one[c] += n
        two[b, c] += n
        pair[a, b] += n
        single[b] += n

    def p(a, b, c):
        p1 = (one[c] + 1) / (total + 28)
        p2 = (two[b, c] + 8 * p1) / (single[b] + 8)
        return math.log((count[a, b, c] + 8 * p2) / (pair[a, b] + 8))

    return p


SIGNS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}


def best_path(span, p):
    """The best restoration of a span by trying every path of its lattice."""
    spaced = len(span) > 3 and span[1] in " .-"
    choices = []
    for i, c in enumerate(span):
        if spaced and c in " .-":
            choices.append([("", -0.5), (c, -4.0)])
        elif c in SIGNS:
            choices.append([(x, -1.0) for x in SIGNS[c]] + [(c, -6.0)])
        elif i and c == span[i - 1] and c.isalpha():
            choices.append([(c, -1.0 if i > 1 and span[i - 2] == c else 0.0), ("", -1.0)])
        else:
            choices.append([(c, 0.0)])
    best = None
    for path in itertools.product(*choices):
        a, b, score = 26, 26, 0.0
        for x, cost in path:
            score += cost
            if x:
                k = symbol(x)
                score += p(a, b, k)
                a, b = b, k
        score += p(a, b, 26)
        if best is None or score > best[0]:
            best = (score, "".join(x for x, _ in path))
    return span if best[0] < -20 - len(span) * math.log(28) else best[1]


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(8)
    prose = lambda n: " ".join(r.choice(RING) for _ in range(n))
    docs, labels = [], []
    for i in range(160):
        bad = i % 4 == 0
        docs.append((i, prose(10) + (f" you {r.choice(BAD)} {prose(2)} {r.choice(BAD)}" if bad else "")))
        labels.append((i, 1, int(bad)))
    docs += [(900 + k, t) for k, t in enumerate(["an 1d10t in the ring", "m o r o n", "moooron stone", "the 15 stones", "i-d-i-o-t", "m0r0n 1n the r1ng", "éther ring", ""])]
    return docs, labels


def test_the_model_by_dictionaries(spark, corpus):
    docs, _ = corpus
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    got, want = toxicity.language_model(df.select("text")), character_model([t for _, t in docs])
    for a, b, c in itertools.product((0, 4, 19, 26, 27), (0, 7, 13, 26), range(28)):
        assert got[a, b, c] == pytest.approx(want(a, b, c), abs=1e-9)


@pytest.mark.parametrize("span", ["1d10t", "m0r0n", "m o r o n", "i d 1 0 t", "moooron", "moorrronn", "i-d-i-o-t", "r1ng", "5t0ne", "xq7z", "th3", "i.d.i.o.t", "1nn3r"])
def test_decoding_by_all_paths(spark, corpus, span):
    docs, _ = corpus
    p = character_model([t for _, t in docs])
    n = np.array([[[p(a, b, c) for c in range(28)] for b in range(28)] for a in range(28)])
    assert toxicity.Decoder(n)(span) == best_path(span, p)


def test_scores_by_plain_descent(spark, corpus):
    """Every document's score, from the dictionaries' model, paths tried one by one and a regression by gradient descent."""
    docs, labels = corpus
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    got = {x.doc_id: x.score for x in toxicity.score(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    p = character_model([t for _, t in docs])
    span = re.compile(r"\b\w(?:[ .-]\w){3,}\b|\b(?=\w*[a-zé])(?=\w*[0-9])\w+|\b\w*(\w)\1\1\w*")
    restore = lambda t: span.sub(lambda m: best_path(m[0], p) if re.search("[a-z]", m[0]) else m[0], t.lower())
    clean = {d: restore(t) for d, t in docs}

    def features(t):
        words = set(re.findall(r"[^\W\d_]+", t))
        return {"=" + w for w in words} | {w[:k] for w in words for k in range(3, min(8, len(w)) + 1)}

    train = [(features(clean[d]), y) for d, _, y in labels if zlib.crc32(str(d).encode()) % 4 != 2]
    n = [sum(1 for _, y in train if y == k) for k in (0, 1)]
    seen = defaultdict(lambda: [0, 0])
    for f, y in train:
        for x in f:
            seen[x][y] += 1
    known = {x for x, (neg, pos) in seen.items() if pos >= 4 and math.log((pos + 0.5) / (n[1] + 1)) - math.log((neg + 0.5) / (n[0] + 1)) > 1}
    weight, bias = dict.fromkeys(known, 0.0), 0.0
    for _ in range(6000):
        slope, up = {x: -0.3 * v for x, v in weight.items()}, -1e-6 * bias
        for f, y in train:
            e = y - 1 / (1 + math.exp(-(bias + sum(weight[x] for x in f & known))))
            up += e
            for x in f & known:
                slope[x] += e
        for x in known:
            weight[x] += 0.02 * slope[x]
        bias += 0.02 * up
    for d, _ in docs:
        z = bias + sum(weight[x] for x in features(clean[d]) & known)
        assert got[d] == pytest.approx(1 / (1 + math.exp(-z)), abs=5e-3), (d, clean[d])
    assert min(got[900 + k] for k in (0, 1, 2, 4, 5)) > 10 * max(got[900 + k] for k in (3, 6, 7))


def test_the_network_by_scalars():
    """Document probabilities from one gated unit at a time, in windows with their context."""
    shape = langid.Shape(hidden=3, core=7, context=2)
    net = langid.Network(3, 3, 1)
    texts = ["abc déf", "x1y", "the ring and the stone", "é"]
    raw = [t.encode() for t in texts]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    got = langid.probabilities(net, data, off, shape)
    sig = lambda v: 1 / (1 + math.exp(-v))
    h, P = 3, {k: v.astype(float) for k, v in net.p.items()}  # noqa: N806

    def states(window, d):
        s, out = [0.0] * h, [None] * len(window)
        for t in range(len(window)) if d == "f" else range(len(window) - 1, -1, -1):
            x = window[t]
            if x is None:
                s = [0.0] * h
            else:
                r = [sum(P[f"u{d}"][i][j] * s[j] for j in range(h)) for i in range(3 * h)]
                a = [P[f"x{d}"][i][x] for i in range(3 * h)]
                z = [sig(a[i] + r[i]) for i in range(h)]
                g = [sig(a[h + i] + r[h + i]) for i in range(h)]
                n = [math.tanh(a[2 * h + i] + g[i] * r[2 * h + i]) for i in range(h)]
                s = [n[i] + z[i] * (s[i] - n[i]) for i in range(h)]
            out[t] = s
        return out

    for k, b in enumerate(raw):
        total, letters = [0.0] * 3, 0
        for start in range(0, len(b), shape.core):
            end = min(start + shape.core, len(b))
            window = [b[i] if 0 <= i < len(b) else None for i in range(start - shape.context, start + shape.core + shape.context)]
            f, w = states(window, "f"), states(window, "b")
            for i in range(start, end):
                c = b[i]
                if not (65 <= c <= 90 or 97 <= c <= 122 or c >= 128):
                    continue
                t = i - start + shape.context
                q = [math.exp(sum(P["of"][y][j] * f[t][j] + P["ob"][y][j] * w[t][j] for j in range(h)) + P["c"][y][0]) for y in range(3)]
                total = [a + v / sum(q) for a, v in zip(total, q, strict=True)]
                letters += 1
        assert got[k] == pytest.approx([v / letters for v in total], abs=1e-4), texts[k]
