import random

import numpy as np
import pyarrow as pa
import pytest

from tomolake.llm import decontam
from tomolake.llm.decontam import Bounds


def words(r, n):
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.choice([2, 3, 5, 7]))) for _ in range(n))


@pytest.fixture(scope="module")
def bench():
    r = random.Random(1)
    return [(i, words(r, 40)) for i in range(12)] + [(50, "tiny item"), (51, None), (52, "")]


def edited(r, text, n):
    t = list(text)
    for _ in range(n):
        k = r.randrange(len(t))
        t[k : k + 1] = r.choice([["q"], [], ["z", t[k]]])
    return "".join(t)


def semi_global(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_finds_edited_passages_and_leaves_clean_ones(spark, bench):
    r = random.Random(2)
    docs, want = [], set()
    for i in range(60):
        t = words(r, 60)
        if i % 3 == 0:
            k = r.randrange(12)
            passage = bench[k][1][20:160]
            t = t[:100] + " " + edited(r, passage.upper() if i % 2 else passage.replace(" ", ",\n"), i % 4) + " " + t[100:]
            want.add((i, k))
        docs.append((i, t))
    docs += [(100, None), (101, ""), (102, bench[0][1][:40]), (103, words(r, 4000) + " " + bench[3][1]), (103, words(r, 10) + bench[3][1])]
    want |= {(103, 3)}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    rows = decontam.find(df, b).collect()
    assert {(x.doc_id, x.item_id) for x in rows} == want and all(x.edits <= 6 for x in rows)
    assert sum(x.doc_id == 103 for x in rows) == 2
    sliced = decontam.find(df, b, Bounds(slice_chars=300)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, sliced))
    more = df.selectExpr("doc_id", "text", "1 as item_id", "'x' as edits")
    left = decontam.clean(more, b)
    assert left.columns == more.columns and sorted(x.doc_id for x in left.collect()) == sorted(i for i, _ in docs if (i not in {d for d, _ in want}))
    assert decontam.find(df.limit(0), b).count() == 0 and decontam.find(df, b.limit(0)).count() == 0 and decontam.clean(df, b.limit(0)).count() == len(docs)


def test_equals_brute_force_windows(bench):
    """A document is reported exactly when some whole window of an item is within the edit budget."""
    r = random.Random(3)
    bounds = Bounds(q=6, window=40, edit_rate=0.08)
    items = bench[:3]
    index = decontam.Index([i for i, _ in items], [t for _, t in items], bounds)
    for trial in range(30):
        t = words(r, 8) + " " + edited(r, items[trial % 3][1][10:70], trial % 7) + " " + words(r, 8)
        data, off = decontam.normal(pa.array([t], pa.large_string()))
        found = {k for _, k, *_ in index.matches(data, off)}
        text = data.tobytes().decode()
        sure, none = set(), set()
        for k, item in enumerate(index.items):
            item = item.decode()
            w, e = int(index.w[k]), int(index.e[k])
            best = min(semi_global(item[s : s + w], text) for s in range(0, len(item) - w + 1))
            (sure if best <= e else none).add(k)
        assert sure == found, (trial, sure, found)


def test_kernels():
    x = np.frombuffer(b"the quick brown fox jumps over", np.uint8)
    for q in (1, 2, 3, 5, 8, 12, 13):
        g = decontam.grams(x, q)
        assert len(g) == len(x) - q + 1 and (decontam.grams(x[4:], q) == g[4:]).all()
        assert len({*g.tolist()}) == len({x[i : i + q].tobytes() for i in range(len(g))})
    data, off = decontam.normal(pa.array(["  Hello,  WORLD! ", None, "", "...", "É1-2"], pa.large_string()))
    assert [data[off[k] : off[k + 1]].tobytes().decode() for k in range(5)] == ["hello world", "", "", "", "é1 2"]
    assert decontam.aligned(np.frombuffer(b"abcdefghij", np.uint8), np.frombuffer(b"xxabcdXefghjyy", np.uint8), 4) == (2, 2, 12)
    assert decontam.aligned(np.frombuffer(b"abcdefghij", np.uint8), np.frombuffer(b"zzzz", np.uint8), 3)[0] == 4
