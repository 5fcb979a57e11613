"""Budgets against an independent way of filling; clashing names; conversations without ids."""

import random

import pytest
from pyspark.sql import functions as F

from tomolake.llm import chatpack, mixing


def filled(held, weights, epochs, tokens):
    """The same budgets by bisection: each node's children take min(capacity, level * weight) at the level that spends its budget."""
    w = lambda c: max(0.0, weights.get(c, 1.0))

    def kids(node):
        return sorted({p[: len(node) + 1] for p in held if p[: len(node)] == node})

    def capacity(node):
        return held[node] * epochs if node in held else sum(capacity(c) for c in kids(node) if w(c) > 0)

    out = dict.fromkeys(held, 0.0)

    def pour(node, budget):
        if node in held:
            out[node] = budget
            return
        live = [c for c in kids(node) if w(c) > 0 and capacity(c) > 0]
        budget = min(budget, sum(capacity(c) for c in live))
        lo, hi = 0.0, max([capacity(c) / w(c) for c in live], default=0.0)
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(min(capacity(c), mid * w(c)) for c in live) < budget else (lo, mid)
        for c in live:
            pour(c, min(capacity(c), hi * w(c)))

    pour((), tokens)
    return out


@pytest.mark.parametrize("seed", range(40))
def test_budgets_against_bisection(seed):
    r = random.Random(seed)
    held = {(d, g, s): r.choice([1, 10, 100, 1000]) for d in "abc" for g in "xy" for s in "pqr" if r.random() < 0.7}
    weights = {p: r.choice([0.0, 0.5, 1.0, 3.0, -1.0]) for leaf in held for p in (leaf[:1], leaf[:2], leaf) if r.random() < 0.6}
    tokens = r.choice([0, 7, 300, 2500, 10**7])
    got = mixing.budgets(held, mixing.Plan(tokens, weights, epochs=2))
    want = filled(held, weights, 2, tokens)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-4) for k in held)


def test_a_shortage_beside_weight_0_reaches_the_ancestor_s_siblings():
    held = {("a", "en", "s"): 1000, ("a", "de", "s"): 10, ("b", "en", "s"): 1000}
    got = mixing.budgets(held, mixing.Plan(400, {("a", "en"): 0.0}, epochs=1))
    assert got == {("a", "en", "s"): 0, ("a", "de", "s"): 10, ("b", "en", "s"): 390}


def test_any_names_and_long_texts(spark):
    """Columns named like the operator's own, in any case, stay as they are or give way; a long text is taken whole."""
    r = random.Random(2)
    docs = [(i, "w " * r.choice([1, 5, 40]), r.choice(["en", None, ""]), "src0", i) for i in range(200)] + [(900, "w " * 300_000, "de", "src1", 1), (7, "w w", "en", "src0", 7), (7, "w w", "en", "src0", 7)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n long")
    clash = {"_lang": "n", "_source": "n", "_key": "n", "_bucket": "n", "_epochs": "n", "_before": "n", "key": "n", "bucket": "n", "start": "n", "before": "n", "epochs": "n", "cut_epoch": "n", "doc": "n", "u0": "n", "Domain": "n", "EPOCH": "n"}
    more = df.select("*", *(F.col(c).alias(k) for k, c in clash.items()))
    plan = mixing.Plan(2_000, epochs=2, seed=3, buckets=8)
    want = sorted((x.doc_id, x.epoch, x.n_tokens) for x in mixing.mix(df, plan).collect())
    out = mixing.mix(more, plan)
    assert len({c.lower() for c in out.columns}) == len(out.columns) and {"_lang", "bucket", "u0"} <= set(out.columns)
    rows = out.collect()
    assert sorted((x.doc_id, x.epoch, x.n_tokens) for x in rows) == want and all(x["_key"] == x["u0"] == x.n for x in rows)
    assert any(x[0] == 900 and x[2] == 300_000 for x in want)
    # null and "" are one leaf
    assert len({x.leaf_budget for x in rows if x.lang in (None, "")}) == 1


def test_rows_without_a_conversation(spark):
    """Each is a conversation of its own; equal ones are one path; a hot one is one row of the plan."""
    rows = [(None, 0, "user", "hi"), (None, 1, "assistant", "ho"), (None, 2, "user", "hi")] + [(None, 5, "user", "same")] * 300 + [(3, 0, "user", "hi"), (3, 1, "assistant", "w" * 200_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    packs, members = chatpack.pack(df)
    got = chatpack.digests(packs, members).collect()
    assert len(got) == 304 and sorted(x.n_turns for x in got) == [1] * 303 + [2]
    assert sum(len(x.leaf_digest) for x in packs.collect()) == 4  # hi, ho, same, and conversation 3


def test_ties_across_partitions(spark):
    """Conversations that share turns give the same digests however many partitions cut the sorted rows."""
    rows = [(c, k, ("user", "assistant")[k % 2], f"t{k}" if k < 3 else f"t{k}-{c % 5}") for c in range(80) for k in range(5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    seen = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            seen.append(sorted(map(tuple, chatpack.digests(*chatpack.pack(df)).collect())))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[1] and len(seen[0]) == 80
