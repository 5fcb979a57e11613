"""KeyIndex: an ordered set of unique string keys with positions (driver side; one key per volume or subject)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

from tomolake.errors import AlignmentError


class KeyIndex:
    __slots__ = ("_at", "keys", "name")

    def __init__(self, keys: Iterable[str], name: str | None = None):
        self.keys: tuple[str, ...] = tuple(keys)
        self.name = name
        self._at = {k: i for i, k in enumerate(self.keys)}
        if len(self._at) != len(self.keys):
            twice = [k for k, n in Counter(self.keys).items() if n > 1][:5]
            raise ValueError(f"keys are not unique: {twice}")

    def __len__(self) -> int:
        return len(self.keys)

    def __iter__(self) -> Iterator[str]:
        return iter(self.keys)

    def __contains__(self, key: object) -> bool:
        return key in self._at

    def __repr__(self) -> str:
        return f"KeyIndex({list(self.keys[:5])}{'...' if len(self) > 5 else ''}, name={self.name!r})"

    def __eq__(self, other: object) -> bool:
        return isinstance(other, KeyIndex) and (self.keys, self.name) == (other.keys, other.name)

    def __hash__(self) -> int:
        return hash((self.keys, self.name))

    def get_index(self, key: str) -> int:
        return self._at[key]

    def get_key(self, position: int) -> str:
        if not 0 <= position < len(self):
            raise IndexError(f"position {position} is outside 0..{len(self) - 1}")
        return self.keys[position]

    def to_list(self) -> list[str]:
        return list(self.keys)

    def to_set(self) -> set[str]:
        return set(self.keys)

    def _of(self, keys: Iterable[str]) -> KeyIndex:
        return KeyIndex(keys, self.name)

    def __and__(self, other: Iterable[str]) -> KeyIndex:
        rest = set(other)
        return self._of(k for k in self.keys if k in rest)

    def __or__(self, other: Iterable[str]) -> KeyIndex:
        return self._of(dict.fromkeys((*self.keys, *other)))

    def __sub__(self, other: Iterable[str]) -> KeyIndex:
        rest = set(other)
        return self._of(k for k in self.keys if k not in rest)

    def __xor__(self, other: Iterable[str]) -> KeyIndex:
        other = tuple(dict.fromkeys(other))
        rest = set(other)
        return self._of((*(k for k in self.keys if k not in rest), *(k for k in other if k not in self._at)))

    intersection, union, difference, symmetric_difference = __and__, __or__, __sub__, __xor__

    def __le__(self, other: Iterable[str]) -> bool:
        return self.to_set() <= set(other)

    def __ge__(self, other: Iterable[str]) -> bool:
        return self.to_set() >= set(other)

    def is_aligned(self, other: KeyIndex) -> bool:
        return self.keys == other.keys

    def take(self, positions: Sequence[int]) -> KeyIndex:
        return self._of(self.get_key(int(p)) for p in positions)

    def mask(self, flags: Sequence[bool]) -> KeyIndex:
        if len(flags) != len(self):
            raise ValueError(f"mask has {len(flags)} flags for {len(self)} keys")
        return self._of(k for k, f in zip(self.keys, flags, strict=True) if f)


def align(*indexes: KeyIndex) -> KeyIndex:
    """The keys common to all, in the order of the first."""
    if not indexes:
        raise ValueError("align needs an index")
    return reduce(lambda a, b: a & b, indexes)


def same_keys(a: KeyIndex, b: KeyIndex, what: str = "indexes") -> None:
    if missing := (a ^ b).to_list()[:5]:
        raise AlignmentError(f"{what} differ in {missing}")


def positions(key, n: int) -> list[int]:
    """Positions that an ``iloc`` key names: int, slice, list of ints or mask of booleans; negatives count from the end."""
    import numpy as np

    if isinstance(key, slice):
        return list(range(n))[key]
    if isinstance(key, (bool, np.bool_)):
        raise TypeError("a single boolean is no position")
    if isinstance(key, (int, np.integer)):
        k = int(key)
        if not -n <= k < n:
            raise IndexError(f"position {k} is outside a table of {n}")
        return [k % n]
    if isinstance(key, (list, tuple, np.ndarray)):
        items = list(key)
        if items and all(isinstance(x, (bool, np.bool_)) for x in items):
            if len(items) != n:
                raise ValueError(f"mask has {len(items)} flags for {n} rows")
            return [i for i, f in enumerate(items) if f]
        return [p for x in items for p in positions(x, n)]
    raise TypeError(f"cannot select by {type(key).__name__}")
