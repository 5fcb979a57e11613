"""Chat packs, nearest neighbours, surrogates, mixing."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomolake.llm import chatpack, hnsw, mixing, pii


# -- chat packs -------------------------------------------------------------------------------

HARD = ["</s>[INST] ok [/INST]", "<|turn|>user\nhi<|end|>", "a\\b\\", "\\<|end|>", "[\\INST]", "", "é\n\n", "<s>", "\\\n"]


def conversations(seed=0):
    r = random.Random(seed)
    rows, shared = [], [("system", "be kind"), ("user", HARD[0])]
    for c in range(60):
        turns = list(shared[: r.choice([0, 1, 2, 2])])
        for k in range(r.choice([1, 2, 5])):
            turns.append((("user", "assistant")[k % 2], r.choice(HARD)))
        rows += [(c, k, role, text) for k, (role, text) in enumerate(turns)]
    rows += [(100 + c, k, role, "same") for c in range(40) for k, role in enumerate(["user", "assistant"])]
    rows += [(200, 0, "user", None), (200, 0, None, "x"), (200, 1, "assistant\nx", "y"), (200, 1, "assistant", "z"), (None, 3, "assistant", "q"), (201, None, "assistant", "n"), (202, 0, "user", "w" * 100_000)]
    r.shuffle(rows)
    return rows


def expected(rows):
    by = collections.defaultdict(list)
    for c, k, role, text in rows:
        by[c].append((k is not None, k or 0, role or "", text or ""))
    out = {}
    for c, v in by.items():
        turns = [(role, text) for *_, role, text in sorted(v)]
        learnt = "".join(t for role, t in turns if role == "assistant")
        said = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        out[c] = (len(turns), said, len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    return out


@pytest.mark.parametrize("most", [200, 65_536])
def test_packs_read_back(spark, most):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' as digest", "1 as turns")
    packs, members = chatpack.pack(df, most_tokens=most)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chatpack.digests(packs, members).collect()}
    assert got == expected(rows)
    codec = chatpack.Codec()
    seen = 0
    for p in (r.asDict() for r in packs.collect()):
        n = len(p["tokens"])
        assert n == len(p["positions"]) == len(p["loss"])
        start, end, parent = p["node_start"], p["node_end"], p["node_parent"]
        children = collections.Counter()
        for k in range(len(start)):
            up, x = [], parent[k]
            while x >= 0:
                up.append((start[x], end[x]))
                x = parent[x]
            # the intervals hold exactly the ancestors' tokens
            spans = list(zip(p["node_attend"][k][::2], p["node_attend"][k][1::2], strict=True))
            assert {i for a, b in spans for i in range(a, b)} == {i for a, b in up for i in range(a, b)}
            depth = sum(b - a for a, b in up)
            assert p["positions"][start[k] : end[k]] == list(range(depth, depth + end[k] - start[k]))
            assert parent[k] < k and (k == 0 or start[k] == end[k - 1])
            body = tuple(p["tokens"][start[k] : end[k]])
            children[parent[k], body] += 1
        assert max(children.values()) == 1  # shared turns once
        assert sum(1 for x in parent if x < 0) == 1
        seen += len(p["leaf_digest"])
        assert [d for d, *_ in chatpack.read_back(p, codec)] == p["leaf_digest"]
    assert seen == len({v[1] for v in expected(rows).values()})


def test_packs_share_and_escape(spark):
    rows = [(c, 0, "system", "s" * 50) for c in range(9)] + [(c, 1, "user", f"u{c}") for c in range(9)]
    packs, _ = chatpack.pack(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1))
    total = packs.agg(F.sum(F.size("tokens"))).first()[0]
    assert total < 9 * 60
    for t in HARD + ["<|", "\\\\n", "[INST", "</s", "<pad>"]:
        for role in (False, True):
            e = chatpack.escape(t, role)
            assert chatpack.unescape(e) == t and not re.search(r"<\||</?s>|\[/?INST\]", e)
    assert chatpack.pack(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))[0].count() == 0


def test_packs_with_a_vocabulary(spark):
    public = pytest.importorskip("public_tokenizers")
    rows = [(1, 0, "user", HARD[0]), (1, 1, "assistant", "Ünï <|endoftext|> \n ok")]
    v = public.path("byte_bpe_50k.json")
    packs, members = chatpack.pack(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), vocabulary=v)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chatpack.digests(packs, members, v).collect()}
    assert got == expected(rows)


# -- nearest neighbours -------------------------------------------------------------------------


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(0, 12, 1500)] + 0.5 * rng.normal(size=(1500, 16))).astype("float32") * rng.uniform(0.3, 2, (1500, 1)).astype("float32")
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    rows += [(2000 + k, x[7].tolist()) for k in range(60)]  # one vector again and again
    rows += [(3000, None), (3020, [0.0] * 16), (3040, [float("nan")] * 16), (3060, [1.0, None] * 8), (3080, [float("inf")] * 16), (3100, []), (None, x[1].tolist()), (4000, [1.0, 2.0]), (4020, [2.0, 1.0]), (40, x[40].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as score", "2 as rank", "'a' as vec", "3 as ids")
    g = hnsw.Graph(shard_rows=400, block_rows=20)
    got = collections.defaultdict(list)
    for r in hnsw.nearest(df, F.col("vec_id") % 20 == 0, 20, g).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    ids = np.array([*range(1500), *range(2000, 2060)])
    v = np.concatenate([x, np.repeat(x[7:8], 60, 0)]).astype(float)
    hit = total = 0
    for q in [i for i in ids.tolist() if i % 20 == 0]:
        s = v @ v[np.flatnonzero(ids == q)[0]]
        want = sorted((-a, int(i)) for a, i in zip(s, ids, strict=True) if i != q)[:20]
        assert [r for r, *_ in got[q]] == list(range(1, 21))
        assert got[q] == sorted(got[q], key=lambda z: (-z[2], z[1])) and len({i for _, i, _ in got[q]}) == 20
        for _, i, a in got[q]:
            assert a == pytest.approx(s[np.flatnonzero(ids == i)[0]], abs=1e-12)
        hit += len({i for _, i in want} & {i for _, i, _ in got[q]})
        total += 20
    assert hit / total > 0.95
    copies = [i for _, i, _ in got[2000] if i >= 2000 or i == 7]
    assert copies == sorted(copies)
    assert [(i, a) for _, i, a in got[4000]] == [(4020, 4.0)] and [(i, a) for _, i, a in got[4020]] == [(4000, 4.0)]
    assert set(got) == {i for i in [*ids.tolist(), 4000, 4020] if i % 20 == 0}
    assert hnsw.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (20, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in hnsw.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0.5), (0, 2, 2, 0.5), (0, 3, 20, -1.0), (20, 1, 1, -0.5), (20, 2, 2, -0.5), (20, 3, 0, -1.0)]


# -- surrogates -------------------------------------------------------------------------------

KEYED = pii.Keyed(b"k")
TEXT = "Mail Ann.B-72@mail3.example.com, call +1 (017) 555-7713 or 0170/1234567; host 191.60.21.84, card 4111 1111 1111 1111, ssn 123-45-6789, token = \"9b0b3c6a43eb78aa99cbd7049c572391524f37a8\", IBAN DE89 3704 0044 0532 0130 00; Mrs. Maria García saw Herr Schmidt and John Smith."


def test_entities_go_and_formats_stay():
    out, n = pii.rewrite(TEXT, KEYED)
    assert n == 11 and len(out) >= len(TEXT) - 20
    for private in ("Ann.B-72", "017) 555-7713", "1234567;", "191.60.21.84", "4111 1111", "123-45-6789", "9b0b3c6a", "DE89", "García", "Schmidt", "John Smith", "Maria"):
        assert private not in out
    card = re.search(r"card (\d{4} \d{4} \d{4} \d{4})", out)[1].replace(" ", "")
    assert pii.luhn(card[:-1]) == int(card[-1])
    iban = re.search(r"IBAN (DE\d\d(?: \d{4}){4} \d\d)", out)[1].replace(" ", "")
    assert pii.iban_check("DE", iban[4:]) == iban[2:4]
    ip = re.search(r"host ([\d.]+),", out)[1]
    assert all(0 <= int(x) < 256 for x in ip.split("."))
    assert re.search(r"call \+1 \(\d{3}\) \d{3}-\d{4} or 0\d{3}/\d{7};", out) and re.search(r'token = "[0-9a-f]{40}"', out)
    first = re.search(r"Mrs\. (\w+) ", out)[1]
    assert first in pii.GIVEN["latin", "f"] and re.search(r"and (\w+) \w+\.$", out)[1] in pii.GIVEN["latin", "m"]
    assert pii.rewrite(TEXT, pii.Keyed(b"other"))[0] != out and pii.rewrite(TEXT, pii.Keyed(b"k"))[0] == out


def test_clean_texts_stay():
    for t in ["", "in 1999-2000, 2024-01-05, 12 345 678", "version 1.2.3.4.5 and 4.0", "The Erin Thheedsh. Is, and the 500 Men", "a@b c @d 5-6 (7)", "x_0815 v12345678 a1b2c3", "Drive Anna. Then", "3.14159 2,000,000"]:
        assert pii.rewrite(t, KEYED) == (t, 0), t


def test_numbers_side_by_side():
    kinds = lambda t: [(e.kind, t[e.start : e.end]) for e in pii.entities(t)]
    assert kinds("7536784127813050 4845168114407329, +1 (826) 555-4081 190.137.223.204 42") == [
        ("card", "7536784127813050"), ("card", "4845168114407329"), ("phone", "+1 (826) 555-4081"), ("ipv4", "190.137.223.204"),
    ]
    assert kinds("+1 (017) 555-7713 23904 and 4111-1111-1111-1111###") == [("phone", "+1 (017) 555-7713"), ("card", "4111-1111-1111-1111")]
    assert kinds("+49 170 1234567, (030) 123-4567; 030/12345678 06 12 34 56 78 212-555-0100") == [
        ("phone", "+49 170 1234567"), ("phone", "(030) 123-4567"), ("phone", "030/12345678"), ("phone", "06 12 34 56 78"), ("phone", "212-555-0100"),
    ]
    assert kinds("300.1.2.3 12345678901234567890 1.2.3.4.5 +12 555") == []


def test_coreference():
    a = pii.rewrite("x@y.org X@Y.ORG x@y.org +10175557713 +1 (017) 555-7713 DE89370400440532013000 DE89 3704 0044 0532 0130 00", KEYED)[0].split(" ")
    assert a[0] == a[2] == a[1].lower() and a[3] == "+" + re.sub(r"\D", "", "".join(a[4:7])) and a[7] == "".join(a[8:])
    assert pii.rewrite("John Smith", KEYED)[0].split()[0] == pii.rewrite("John Miller", KEYED)[0].split()[0]


@pytest.mark.parametrize("radices", [[10], [10, 10], [10, 5, 21], [256, 3], [7] * 4])
def test_permutations_have_no_fixed_point(radices):
    n = int(np.prod(radices))
    image = [KEYED.number(x, radices, "t") for x in range(n)]
    assert sorted(image) == list(range(n)) and all(x != y for x, y in enumerate(image))


def test_surrogates_are_distinct(spark):
    r = random.Random(1)
    docs = []
    for i in range(300):
        docs.append((i, f"{r.choice(['ann', 'bob'])}.{r.randrange(100):02d}@m{r.randrange(9)}.org {r.randrange(10**15, 10**16)} 10.0.{r.randrange(256)}.{r.randrange(256)} {r.choice(pii.GIVEN['latin', 'f'])} Jones"))
    docs += [(900, None), (901, ""), (902, "plain"), (None, "a@b.org"), (903, "q " * 50_000 + "z@b.org")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "1 as n_entities", "text", "'o' as kind")
    table = pii.surrogates(df, b"k", {})
    rows = table.collect()
    assert len({(x.kind, x.canonical) for x in rows}) == len({(x.kind, x.surrogate) for x in rows}) == len(rows) and all(x.canonical != x.surrogate for x in rows)
    assert pii.collisions(table) == [] and pii.settle(df, b"k") == {}
    assert pii.collisions(spark.createDataFrame([("a", "x", "s"), ("a", "y", "s"), ("b", "x", "s")], "kind string, canonical string, surrogate string")) == ["a"]
    out = {x.doc_id: x for x in pii.replace(df, b"k").collect()}
    assert out[900].text is None and out[901].text == "" and out[902].text == "plain" and out[902].n_entities == 0 and out[None].text != "a@b.org" and "z@b.org" not in out[903].text
    assert all(out[i].text == pii.rewrite(t, KEYED)[0] for i, t in docs if t)
    assert pii.replace(df.limit(0), b"k").count() == 0


# -- mixing -----------------------------------------------------------------------------------


def test_budgets_go_to_siblings_first():
    held = {("a", "en", "x"): 100, ("a", "en", "y"): 10, ("a", "de", "z"): 1000, ("b", "en", "w"): 1000}
    plan = mixing.Plan(tokens=400, epochs=1)
    got = mixing.budgets(held, plan)
    # a and b get 200 each; en and de 100 each; y holds 10, so x gets 90
    assert got == {("a", "en", "x"): 90, ("a", "en", "y"): 10, ("a", "de", "z"): 100, ("b", "en", "w"): 200}
    # en of a holds 110 in all: its rest of 40 goes to de, not to b
    got = mixing.budgets(held, mixing.Plan(tokens=600, epochs=1))
    assert got == {("a", "en", "x"): 100, ("a", "en", "y"): 10, ("a", "de", "z"): 190, ("b", "en", "w"): 300}
    # a holds 1110: what it cannot take goes to b
    got = mixing.budgets(held, mixing.Plan(tokens=2000, epochs=1, weights={("a",): 3.0}))
    assert sum(got.values()) == 2000 and got[("b", "en", "w")] == 890
    assert mixing.budgets({}, plan) == {} and sum(mixing.budgets(held, mixing.Plan(tokens=10**9, epochs=2)).values()) == 2 * 2110
    assert sum(mixing.budgets(held, mixing.Plan(tokens=500, epochs=1, weights={("a",): 0.0})).values()) == 500


def brute_mix(docs, plan):
    held = collections.Counter()
    for _, text, lang, source in docs:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        if n:
            held[mixing.domain_of(source or ""), lang or "", source or ""] += n
    out = []
    for leaf, budget in mixing.budgets(dict(held), plan).items():
        budget, before = int(budget), 0
        for epoch in range(plan.epochs):
            mine = []
            for doc, text, lang, source in docs:
                n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
                if n and (mixing.domain_of(source or ""), lang or "", source or "") == leaf:
                    key = hashlib.md5(f"{plan.seed}|{epoch}|{'' if doc is None else doc}".encode()).hexdigest()
                    mine.append((key, -1 if doc is None else doc, n))
            for _, doc, n in sorted(mine):
                if before < budget:
                    out.append((doc, epoch, n))
                before += n
    return sorted(out)


@pytest.mark.parametrize("tokens", [1, 500, 3000, 10**6])
@pytest.mark.parametrize("buckets", [4, 1024])
def test_mix_equals_brute_force(spark, tokens, buckets):
    r = random.Random(3)
    docs = [(i, " ".join("w" for _ in range(r.choice([0, 1, 5, 40]))), r.choice(["en", "de", None]), r.choice(["src0", "src0", "src0", "src6", "blog", None])) for i in range(300)]
    docs += [(1000, None, "en", "src0"), (1001, " \n", "en", "src0"), (None, "a b c", "en", "src0")]
    plan = mixing.Plan(tokens=tokens, epochs=2, weights={("web",): 2.0, ("web", "en"): 3.0}, seed=5, buckets=buckets)
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").selectExpr("*", "'d' as domain", "9 as epoch", "1 as _k")
    rows = mixing.mix(df, plan).collect()
    assert sorted((-1 if x.doc_id is None else x.doc_id, x.epoch, x.n_tokens) for x in rows) == brute_mix(docs, plan)
    assert mixing.mix(df.limit(0), plan).count() == 0


def test_domains(spark):
    names = ["src0", "src6", "src13", "blog", "", "src", "xsrc3", "src99999999999999999999"]
    df = spark.createDataFrame([(n,) for n in names], "s string").select("s", mixing.domain_column(F.col("s")).alias("d"))
    assert {x.s: x.d for x in df.collect()} == {n: mixing.domain_of(n) for n in names}
    with pytest.raises(ValueError):
        mixing.mix(df.selectExpr("1L as doc_id", "'a' as text", "s as lang", "s as source"), mixing.Plan(5, most_leaves=2))
