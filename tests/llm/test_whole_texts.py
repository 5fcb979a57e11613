"""Whole texts, repeated rows and ties in the scored operators."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tomolake.llm import langid, scratch, toxicity, urlfilter

RING = ["the", "other", "thing", "and", "ring", "stone", "later", "in", "on", "inner", "rather"]


def prose(r, n):
    return " ".join(r.choice(RING) for _ in range(n))


def test_a_character_is_one_symbol():
    """Letters beyond ASCII are one symbol of the model, and texts do not run into one another."""
    rows = [pa.RecordBatch.from_arrays([pa.array(["aéb", "ж", "zz"])], names=["text"])]
    got = next(iter(toxicity._trigrams(rows)))
    count = dict(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True))
    K, other, gap = toxicity.K, 27, 26  # noqa: N806
    want: dict[int, int] = {}
    x = [0, other, 1, gap, gap, 25]  # the first character of a later text parts it from the one before
    for a, b, c in zip(x, x[1:], x[2:], strict=False):
        want[a * K * K + b * K + c] = want.get(a * K * K + b * K + c, 0) + 1
    assert count == want


def test_toxicity_of_long_and_repeated_texts(spark):
    r = random.Random(4)
    docs, labels = [], []
    for i in range(240):
        docs.append((i, prose(r, 30) + (" you idiot you moron " + prose(r, 4) if i % 3 == 0 else "")))
        labels.append((i, 1, int(i % 3 == 0)))
    long = prose(r, 60_000)
    docs += [(900, long), (901, long + " what an 1 d 1 0 t and m0r0n")]
    docs += [(1, docs[1][1])] * 400 + [(3, docs[3][1])] * 5  # repeated rows of labelled documents
    df = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = toxicity.score(df, lab).collect()
    assert len(rows) == len(docs)
    by: dict[int, set] = {}
    for x in rows:
        by.setdefault(x.doc_id, set()).add(x.score)
    assert all(len(v) == 1 for v in by.values())
    assert min(by[901]) >= 0.3 > max(by[900])
    once = {x.doc_id: x.score for x in toxicity.score(df.distinct(), lab).collect()}
    learned = toxicity.fit(df, lab, toxicity.language_model(df.select("text")))
    assert learned[0] == toxicity.fit(df.distinct(), lab, toxicity.language_model(df.select("text")))[0] and len(once) == 242


def test_every_supported_feature_counts(spark):
    """No feature that favours toxic rows is cut for there being many."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("bcdfgklmnprstv") + r.choice("aeiou") for _ in range(4))
    names = sorted({word() for _ in range(1500)})
    docs, labels = [], []
    for i in range(600):
        bad = i % 2
        docs.append((i, " ".join(r.sample(names, 30)) if bad else prose(r, 30)))
        labels.append((i, 1, bad))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    known, w = toxicity.fit(df, lab, np.zeros((toxicity.K,) * 3))
    count = Counter(f for i, t in docs if i % 2 and zlib.crc32(str(i).encode()) % 4 != 2 for f in toxicity.features(t))
    want = {f for f, n in count.items() if n >= 4} - toxicity.features(" ".join(RING))
    assert set(known) == want and len(want) > 4000 and len(w) == len(want) + 1


def test_language_of_repeated_and_long_texts(spark):
    r = random.Random(6)
    draw = lambda letters, n: " ".join("".join(r.choice(letters) for _ in range(4)) for _ in range(n))
    docs = [(i, draw("abcdefgh" if i % 2 else "stuvwxyz", 30), "ab"[i % 2]) for i in range(300)]
    docs += [(2, docs[2][1], "a")] * 500 + [(7000, draw("abcdefgh", 40_000), None), (7001, "абв", "a")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    rows = langid.predict(df, langid.Shape(steps=60)).collect()
    assert len(rows) == len(docs) and len({(x.lang_pred, round(x.score, 5)) for x in rows if x.doc_id == 2}) == 1
    got = {x.doc_id: x.lang_pred for x in rows}
    assert got[7000] == "b" and got[2] == "a"


def test_equal_trust_and_distrust_is_allowed(spark):
    """A host between one allowed and one blocked host: a tie, which is no reason to block."""
    page = lambda k, h, *links: (k, f"http://{h}/", "".join(f"<a href='http://{x}/'>x</a>" for x in links))
    pages = [page(1, "good.com", "mid.net"), page(2, "mid.net", "bad.com"), page(3, "bad.com"), (4, "http://long.net/" + "p/" * 200_000, "<a href='http://bad.com/" + "q" * 300_000 + "'>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {x.page_id: x for x in urlfilter.judge(df, [("allow", "good.com/"), ("block", "bad.com/")]).collect()}
    assert got[2].trust == pytest.approx(0.85 * 0.15) and got[2].distrust == pytest.approx(0.85 * 0.15 / 2)
    assert got[2].verdict == "allow" and got[4].verdict == "block" and len(got[4].path) == 400_001


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()  # noqa: N815

        class conf:  # noqa: N801
            get = staticmethod(lambda k, d: d)

    with pytest.raises(RuntimeError, match="checkpoint"):
        scratch.shared_dir(Session())
    Context.master = "local[4]"
    assert scratch.shared_dir(Session())
