"""Toxicity, language, main text, URL filters."""

import random

import numpy as np
import pytest

from tomolake.llm import langid, maintext, toxicity, urlfilter

BAD = ["idiot", "moron", "trash", "stupid"]


def prose(r, n):
    return " ".join(r.choice(["the", "other", "thing", "and", "ring", "stone", "later", "in", "on", "inner", "rather", "tin", "to", "toad", "sure"]) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(0)
    docs, labels = [], []
    for i in range(600):
        t = prose(r, r.choice([8, 30, 80]))
        y = int(i % 4 == 0)
        if y:
            for _ in range(2):
                t += " " + r.choice(BAD) + " " + prose(r, 5)
        docs.append((i, t))
        labels.append((i, 1, y))
    docs += [(9001, "you are an 1d10t"), (9002, "so s t u p i d here"), (9003, "mooooron in the ring"), (9004, "the ring in 1999, 15 stones"), (9005, None), (9006, ""), (None, "tr@sh and m0r0n")]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark, labelled):
    docs, labels = labelled
    got = {(r.doc_id, r.text): r.score for r in toxicity.score(docs, labels).collect()}
    by = {d: s for (d, _), s in got.items() if d is not None}
    held = [i for i in range(600) if __import__("zlib").crc32(str(i).encode()) % 4 == 2]
    right = sum((by[i] >= 0.3) == (i % 4 == 0) for i in held)
    assert right / len(held) > 0.98
    for i in (9001, 9002, 9003):
        assert by[i] >= 0.3, i
    for i in (9004, 9005, 9006):
        assert 0 <= by[i] < 0.3
    assert got[(None, "tr@sh and m0r0n")] >= 0.3


def test_toxicity_defined_cases(spark, labelled):
    docs, labels = labelled
    few = docs.limit(5)
    assert {round(r.score, 6) for r in toxicity.score(few, labels.limit(0)).collect()} == {round(0.5 / 6, 4) and round(1 / (1 + np.exp(-np.log(0.5 / 5.5))), 6)}
    one = toxicity.score(few, labels.where("toxic = 0"))
    assert len({round(r.score, 9) for r in one.collect()}) == 1
    assert toxicity.score(docs.limit(0), labels).count() == 0
    extra = docs.selectExpr("doc_id", "text", "1 as toxic", "2.0 as score", "'q' as quality").limit(3)
    assert toxicity.score(extra, labels).columns == ["doc_id", "text", "score"]


def test_decoder():
    import pyarrow as pa

    counts = [b for b in toxicity._trigrams([pa.RecordBatch.from_arrays([pa.array(["the idiot and the moron ring stupid trash to in " * 50])], names=["text"])])][0]
    n = np.zeros(toxicity.K**3)
    n[counts.column(0).to_numpy()] = counts.column(1).to_numpy()
    n = n.reshape((toxicity.K,) * 3)
    model = np.log((n + 0.01) / (n.sum(2, keepdims=True) + 0.28))
    d = toxicity.Decoder(model)
    for raw, want in [("1d10t", "idiot"), ("i d i o t", "idiot"), ("m.o.r.o.n", "moron"), ("moooron", "moron"), ("$tup1d", "stupid"), ("tr@sh", "trash"), ("The ring", "the ring"), ("", "")]:
        assert d(raw) == want, raw
    long = "a1" * 40
    assert d(long) == long


def test_suspects_miss_nothing():
    r = random.Random(4)
    alphabet = "aabcXéß 019@$!|+€(.-_*\n İ"
    texts = ["".join(r.choice(alphabet) for _ in range(r.choice([0, 1, 3, 9, 30]))) for _ in range(3000)]
    flags = np.concatenate([toxicity.suspects(texts[k : k + 50]) for k in range(0, 3000, 50)])
    for t, f in zip(texts, flags, strict=True):
        assert f or not toxicity.SUSPECT.search(t.lower()), repr(t)


def test_gradients():
    net = langid.Network(4, 3, 1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    x, y, w = rng.integers(0, 256, (7, 5)), rng.integers(0, 3, 5), rng.random((7, 5))
    x[2, 1] = x[5, 3] = x[6, 4] = 0
    w[x == 0] = 0
    w /= w.sum()
    _, g = net.gradients(x, y, w)
    for k, v in net.p.items():
        i = np.unravel_index(rng.integers(v.size), v.shape)
        i = (i[0], x[3, 2]) if k[0] == "x" else i
        old, e = v[i], 1e-5
        v[i] = old + e
        up = net.gradients(x, y, w)[0]
        v[i] = old - e
        down = net.gradients(x, y, w)[0]
        v[i] = old
        assert g[k][i] == pytest.approx((up - down) / 2 / e, rel=1e-4, abs=1e-8)


def test_language(spark):
    r = random.Random(0)
    parts = {"aa": ["ka", "ta", "rak", "tok"], "bb": ["über", "schön", "ein", "ß"], "cc": ["lo", "sol", "mil", "lil"]}
    docs = []
    for i in range(450):
        lang = r.choice(list(parts))
        docs.append((i, " ".join("".join(r.choice(parts[lang]) for _ in range(3)) for _ in range(r.choice([4, 30, 200]))), lang))
    docs += [(9001, None, "aa"), (9002, "", "bb"), (9003, "123 !? — 45", "cc"), (9004, "katarak toktok", None), (None, "sol mil lo", "cc"), (9005, "ka " * 20_000, "aa")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "'x' as lang_pred")
    shape = langid.Shape(steps=240, batch=128, length=64)
    rows = langid.predict(df, shape).collect()
    assert len(rows) == len(docs) and all(0 <= x.score <= 1 for x in rows)
    got = {x.doc_id: x.lang_pred for x in rows}
    held = [d for d in docs[:450] if __import__("zlib").crc32(str(d[0]).encode()) % 3 == 1]
    assert sum(got[i] == lang for i, _, lang in held) / len(held) > 0.97
    assert [got[i] for i in (9001, 9002, 9003)] == ["und"] * 3 and got[9004] == "aa" and got[None] == "cc" and got[9005] == "aa"
    assert {x.lang_pred for x in langid.predict(df.selectExpr("doc_id", "text", "cast(null as string) as lang"), shape).collect()} == {"und"}
    assert langid.predict(df.limit(0), shape).count() == 0
    assert {x.lang_pred for x in langid.predict(df.where("lang = 'aa'"), shape).collect()} == {"aa", "und"}


def test_windows_do_not_depend_on_batching():
    net = langid.Network(6, 3, 2)
    rng = np.random.default_rng(1)
    texts = [rng.integers(97, 123, n).astype(np.uint8) for n in (5, 300, 1, 0, 900)]
    data, off = np.concatenate(texts), np.cumsum([0, *map(len, texts)])
    a = langid.probabilities(net, data, off, langid.Shape(core=64, context=8))
    b = langid.probabilities(net, data, off, langid.Shape(core=64, context=8), batch=3)
    np.testing.assert_allclose(a, b, atol=1e-5)
    for k, t in enumerate(texts):
        np.testing.assert_allclose(langid.probabilities(net, t, np.array([0, len(t)]), langid.Shape(core=64, context=8))[0], a[k], atol=1e-5)
    # a window as long as the text is the plain network
    x = texts[1].astype(np.int64)[:, None]
    q = np.exp(net.logits(x))
    whole = (q / q.sum(1, keepdims=True)).mean(0)[:, 0]
    np.testing.assert_allclose(langid.probabilities(net, texts[1], np.array([0, 300]), langid.Shape(core=512, context=0))[0], whole, atol=1e-5)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href=/a>One</a></li></ul></nav><!-- <p>gone</p> -->
<div class="ad">Buy now, many words of an advert that is rather long and has no links in it at all.</div>
<div id="cookie-notice">We use cookies.</div>
<article><header><h1>Head &amp; line</h1></header><p><b>First <i>para</i>&nbsp;graph.<br>goes on<p>Sec&ouml;nd &lt;b&gt;   one.<ul><li>item<li>last</ul>
<aside>Pull quote</aside><form><p>Sign up</p><button>Go</button></form><blockquote>Quoted.</blockquote></article>
<section class="comments"><p>Great article, I read all of it twice and then some more.</p></section>
<div class="sidebar"><p>Other</p></div><footer>&copy; us</footer></body></html>"""


def test_main_text(spark):
    want = "Head & line\nFirst para graph. goes on\nSecönd <b> one.\nitem\nlast\nQuoted."
    assert maintext.main_text(PAGE) == want
    pages = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>" + "word " * 60_000 + "</p>"), (1, "u", PAGE), (None, "u", "<b>unclosed <!-- comment"), (5, "u", "<script>x"), (6, "u", "just words, no tags")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'x' as text", "3 as n_chars")
    rows = maintext.extract(df).collect()
    assert len(rows) == len(pages) and all(r.n_chars == len(r.text) for r in rows)
    got = {r.page_id: r.text for r in rows}
    assert got[1] == want and got[2] == got[3] == got[5] == "" and got[4] == ("word " * 60_000).strip() and got[6] == "just words, no tags" and got[None] == "unclosed"
    assert maintext.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("page", ["<p" * 5000, "<a href='" * 3000, "<" * 20000, "<div class=\"x" + "y" * 50000, "<!--" * 5000, "</p>" * 9000])
def test_broken_pages_take_no_time(page):
    import time

    t = time.time()
    maintext.main_text(page)
    assert time.time() - t < 2


def test_page_without_article():
    long = "A paragraph with a good number of words in it, more than fifteen of them in fact, as prose has."
    page = f"<body><div><a href=x>Home</a> <a href=y>News</a></div><h2>Heading here</h2><p>{long}</p><p>Short line.</p><p>{long}</p><div><a href=z>Next</a></div></body>"
    assert maintext.main_text(page) == f"Heading here\n{long}\nShort line.\n{long}"


def brute_walk(edges, seeds, w):
    hosts = sorted({h for e in edges for h in e[:2]} | set(seeds))
    total = sum(seeds.values())
    start = {h: seeds.get(h, 0) / total if total else 0 for h in hosts}
    out = {h: sum(n for a, _, n in edges if a == h) for h in hosts}
    score = dict(start)
    for _ in range(w.rounds):
        new = {h: (1 - w.damping) * start[h] for h in hosts}
        for a, b, n in edges:
            new[b] += w.damping * score[a] * n / out[a]
        score = new
    return score


def test_urls(spark):
    pages = [
        (1, "http://A.org/en/", '<a href="http://b.net/x"> <A HREF=\'https://C.net\'>'), (2, "http://b.net/q?u=http://z", "<a href=http://c.net><a href=/own>"), (3, "http://c.net", "x"), (4, None, None), (5, "nourl", ""),
        (6, "http://s.net/", '<a href="http://bad.com/de/1"><a href="http://b.net">'), (7, "http://bad.com/de/2", '<a href="http://bad.com/">'), (8, "HTTP://X.Example.ORG/en/1?x", ""), (9, "http://x.example.org/es/", ""),
        (10, "http://x.example.org/en/2", ""), (11, "https://notorg/x", ""), (12, "https://u@h.com:80/fr/x#y://z", ""), (13, "a://org", ""), (3, "http://c.net", "x"), (None, "http://late.net/a", '<a href="http://s.net/">'),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'h' as host", "1 as trust", "2 as rule")
    rows = urlfilter.judge(df).collect()
    got = {r.page_id: r for r in rows}
    assert len(rows) == len(pages)
    assert [(got[i].host, got[i].path) for i in (1, 2, 4, 5, 12, 13)] == [("a.org", "/en/"), ("b.net", "/q"), ("", ""), ("", ""), ("u@h.com:80", "/fr/x"), ("org", "")]
    assert {i: (got[i].rule, got[i].verdict) for i in (1, 7, 8, 9, 10, 11, 13)} == {
        1: ("org/", "allow"), 7: ("com/de/", "block"), 8: ("example.org/en/1", "block"), 9: ("example.org/es/", "block"), 10: ("org/", "allow"), 11: (None, "allow"), 13: (None, "allow"),
    }
    edges = [("a.org", "b.net", 1), ("a.org", "c.net", 1), ("b.net", "c.net", 1), ("s.net", "bad.com", 1), ("s.net", "b.net", 1), ("late.net", "s.net", 1)]
    w = urlfilter.Walk()
    trust = brute_walk(edges, {"a.org": 1, "x.example.org": 1}, w)
    distrust = brute_walk([(b, a, n) for a, b, n in edges], {"bad.com": 1, "x.example.org": 2}, w)
    for r in rows:
        assert r.trust == pytest.approx(trust.get(r.host, 0)) and r.distrust == pytest.approx(distrust.get(r.host, 0))
        if r.rule is None:
            assert r.verdict == ("block" if distrust.get(r.host, 0) > max(trust.get(r.host, 0), 1e-9) else "allow")
    assert got[6].verdict == "block" and got[None].verdict == "block" and got[3].verdict == "allow"
    assert urlfilter.judge(df.limit(0)).count() == 0
    plan = urlfilter.judge(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
