import numpy as np
import pytest

from tomolake.operators.index import KeyIndex, align, positions


def test_lookup_and_errors():
    i = KeyIndex(["a", "b", "c"], "x")
    assert i.get_index("b") == 1 and i.get_key(2) == "c" and "a" in i and "z" not in i and len(i) == 3 and list(i) == ["a", "b", "c"]
    for bad in (-1, 3):
        with pytest.raises(IndexError):
            i.get_key(bad)
    with pytest.raises(KeyError):
        i.get_index("z")
    with pytest.raises(ValueError, match="unique"):
        KeyIndex(["a", "a"])
    assert KeyIndex([]).to_list() == []


def test_set_operations_keep_order():
    a, b = KeyIndex(["c", "a", "b"]), KeyIndex(["b", "d", "c"])
    assert (a & b).to_list() == ["c", "b"]
    assert (a | b).to_list() == ["c", "a", "b", "d"]
    assert (a - b).to_list() == ["a"]
    assert (a ^ b).to_list() == ["a", "d"]
    assert (a & frozenset("ab")).to_list() == ["a", "b"]
    assert KeyIndex(["a"]) <= a and a >= KeyIndex(["b"]) and not a <= b
    assert align(a, b, KeyIndex(["b"])).to_list() == ["b"]
    assert a.is_aligned(KeyIndex(["c", "a", "b"])) and not a.is_aligned(KeyIndex(["a", "b", "c"]))
    assert a == KeyIndex(["c", "a", "b"]) and hash(a) == hash(KeyIndex(["c", "a", "b"])) and a != KeyIndex(["c", "a", "b"], "n")


def test_take_mask():
    a = KeyIndex(["c", "a", "b"])
    assert a.take([2, 0]).to_list() == ["b", "c"]
    assert a.mask([True, False, True]).to_list() == ["c", "b"]
    with pytest.raises(IndexError):
        a.take([3])
    with pytest.raises(ValueError):
        a.mask([True])


@pytest.mark.parametrize("key,want", [(0, [0]), (-1, [4]), (slice(1, 4, 2), [1, 3]), (slice(None, None, -1), [4, 3, 2, 1, 0]), ([0, -1], [0, 4]), ([], []), ([True, False, False, False, True], [0, 4]), (np.array([1, 2]), [1, 2])])
def test_positions(key, want):
    assert positions(key, 5) == want


@pytest.mark.parametrize("key,error", [(5, IndexError), ([True], ValueError), ("a", TypeError), (1.5, TypeError), (True, TypeError)])
def test_bad_positions(key, error):
    with pytest.raises(error):
        positions(key, 5)
