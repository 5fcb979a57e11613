"""Decontamination in characters: single windows with edits anywhere, other scripts, typographic signs, and bounded work."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tomolake.llm import decontam
from tomolake.llm.decontam import Bounds

LATIN, CYRILLIC = "abcdefghijklmnop", "абвгдежзиклмнопр"


def text_of(r, letters, n):
    return " ".join("".join(r.choice(letters) for _ in range(r.choice([2, 3, 5, 7]))) for _ in range(n))


def one(texts):
    return decontam.normal(pa.array(texts, pa.large_string()))


def brute(index, text):
    """The items of which some whole window is within its edits somewhere in the text."""
    out = set()
    for k, item in enumerate(index.items):
        item = item.decode()
        w, e = int(index.w[k]), int(index.e[k])
        for s in range(len(item) - w + 1):
            row = [0] * (len(text) + 1)
            for i, c in enumerate(item[s : s + w], 1):
                new = [i]
                for j, d in enumerate(text, 1):
                    new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
                row = new
            if min(row) <= e:
                out.add(k)
                break
    return out


@pytest.mark.parametrize("letters", [LATIN, CYRILLIC])
def test_single_windows_with_edits_anywhere(letters):
    """A passage of exactly one window with as many edits as the budget allows, at any places, is found."""
    r = random.Random(11)
    items = [text_of(r, letters, 70) for _ in range(3)]
    index = decontam.Index([0, 1, 2], items, Bounds())
    assert index.w.tolist() == [80] * 3 and index.e.tolist() == [6] * 3
    for trial in range(500):
        k = trial % 3
        s = r.randrange(len(items[k]) - 80)
        t, n = list(items[k][s : s + 80]), trial % 7
        places = r.sample(range(80), n) if trial % 2 else [0, 79, 9, 70, 40, 41][:n]
        for at in places:
            t[at] = "z" if letters is LATIN else "я"
        noise = lambda: text_of(r, "qrstuvwxy" if letters is LATIN else "стуфхцчш", 12)
        data, off = one([noise() + " " + "".join(t).strip() + " " + noise()])
        hits = list(index.matches(data, off))
        assert [h[1] for h in hits] == [k] and hits[0][4] <= 6, (trial, n)


def test_equals_brute_force_in_characters():
    r = random.Random(12)
    items = [text_of(r, CYRILLIC, 14), text_of(r, LATIN, 14)]
    bounds = Bounds(q=6, window=40, edit_rate=0.08)
    index = decontam.Index([0, 1], items, bounds)
    for trial in range(24):
        t = list(items[trial % 2][8:52])
        for _ in range(trial % 6):
            t[r.randrange(len(t))] = "ы"
        data, off = one([text_of(r, "xyzъэю", 6) + " " + "".join(t) + " " + text_of(r, "xyzъэю", 6)])
        assert {h[1] for h in index.matches(data, off)} == brute(index, data.tobytes().decode()), trial


def test_typographic_twins_are_equal():
    data, off = one(["“Hello” — world… it’s ‹so›", '"Hello" - world... it\'s <so>', "Привет, мир！", "привет мир", "x²—", "…"])
    texts = [data[off[k] : off[k + 1]].tobytes().decode() for k in range(6)]
    assert texts == ["hello world it s so"] * 2 + ["привет мир"] * 2 + ["x²", ""]


@pytest.mark.parametrize("most", [1, 50, 4_000_000])
def test_shared_grams_are_worked_off_in_parts(most):
    """However few hits may be held at once, the result is the same, also for items and texts that repeat themselves."""
    r = random.Random(13)
    common = text_of(r, LATIN, 20)
    items = [common + " " + text_of(r, LATIN, 20) for _ in range(6)] + ["na " * 60]
    texts = [common, text_of(r, LATIN, 40), "la la " + "na " * 400, None, items[3].upper(), text_of(r, "xyz", 900) + " " + items[5]]
    index = decontam.Index(list(range(7)), items, Bounds(most_hits=most))
    data, off = one(texts)
    got = {h[:2] for h in index.matches(data, off)}
    assert got == {(0, k) for k in range(6)} | {(2, 6)} | {(4, k) for k in range(6)} | {(5, k) for k in range(6)}


def test_ties_and_slices(spark):
    """Of equal windows the first is reported; slices give what one index gives."""
    r = random.Random(14)
    passage = text_of(r, LATIN, 40)
    docs = spark.createDataFrame([(1, "so " + passage + " and " + passage), (2, None), (3, "")], "doc_id long, text string")
    b = spark.createDataFrame([(7, passage), (8, passage), (9, text_of(r, CYRILLIC, 40))], "item_id long, text string")
    whole = sorted(map(tuple, decontam.find(docs, b).collect()))
    assert [x[:3] for x in whole] == [(1, 7, 3), (1, 8, 3)] and all(x[4] == 0 for x in whole)
    assert sorted(map(tuple, decontam.find(docs, b, Bounds(slice_chars=10)).collect())) == whole
    assert sorted(x.doc_id for x in decontam.clean(docs, b, Bounds(slice_chars=10)).collect()) == [2, 3]


def test_characters():
    code, at = decontam.characters(np.frombuffer("aé€😀z".encode(), np.uint8))
    assert code.tolist() == [ord(c) for c in "aé€😀z"] and at.tolist() == [0, 1, 3, 6, 10]
