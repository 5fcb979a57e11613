"""Excerpts whose edits lie near both ends."""

import random

import numpy as np
import pyarrow as pa

from tomolake.llm import decontam


def test_edits_near_both_ends_of_an_excerpt():
    r = random.Random(5)
    items = [" ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.choice([2, 3, 5, 7]))) for _ in range(60)) for _ in range(4)]
    index = decontam.Index(list(range(4)), items, decontam.Bounds())
    for trial in range(200):
        k = trial % 4
        s = r.randrange(20, len(items[k]) - 110)
        t = list(items[k][s : s + 80])
        for at in (r.randrange(1, 10), r.randrange(70, 79)):
            t[at] = "z"
        noise = lambda: " ".join("".join(r.choice("qrstuvwx") for _ in range(5)) for _ in range(30))
        data, off = decontam.normal(pa.array([noise() + " " + "".join(t) + " " + noise()], pa.large_string()))
        hits = list(index.matches(data, off))
        assert [h[1] for h in hits] == [k] and hits[0][4] <= 6, trial


def test_distances_agree_with_alignment():
    r = random.Random(6)
    draw = lambda n: np.frombuffer("".join(r.choice("ab") for _ in range(n)).encode(), np.uint8)
    for _ in range(50):
        text, patterns = draw(r.randrange(0, 30)), np.stack([draw(9) for _ in range(5)])
        assert decontam.distances(patterns, text, 3).tolist() == [decontam.aligned(p, text, 3)[0] for p in patterns]
