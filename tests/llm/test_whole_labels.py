"""Many and rare languages."""

import random

from tomolake.llm import langid


def draw(r, letters, n=40):
    return " ".join("".join(r.choice(letters) for _ in range(r.randrange(2, 8))) for _ in range(n))


def test_every_label_is_learned(spark):
    r = random.Random(0)
    docs = [(100 * k + i, draw(r, "abcdefgh", 10), f"l{k:02d}") for k in range(70) for i in range(8)]
    docs += [(90_000 + i, "7 x 7", "short") for i in range(8)]
    names, net = langid.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string"), langid.Shape(steps=2))
    assert set(names) == {d[2] for d in docs} and len(net.p["c"]) == 71


def test_a_rare_language_is_predicted(spark):
    r = random.Random(1)
    docs = [(i, draw(r, "abcdefgh" if i % 2 else "stuvwxyz"), "ab"[i % 2]) for i in range(1500)]
    docs += [(5000 + i, draw(r, "абвгдежз"), "rare") for i in range(6)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = {x.doc_id: x.lang_pred for x in langid.predict(df, langid.Shape(most_docs=40, steps=80)).collect()}
    assert all(got[5000 + i] == "rare" for i in range(6))
    assert sum(got[d] == y for d, _, y in docs) / len(docs) > 0.98
