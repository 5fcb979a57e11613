"""Orientation of affines: axis codes, validity, reorientation with the affine kept true."""

from __future__ import annotations

import json
from dataclasses import dataclass
from itertools import permutations

import numpy as np

_PLUS, _MINUS = "RAS", "LPI"


@dataclass(frozen=True)
class Orientation:
    axcodes: tuple[str, str, str]
    affine: tuple[tuple[float, ...], ...]
    source: str = "identity"
    confidence: str = "header"

    def array(self) -> np.ndarray:
        return np.array(self.affine)


def axis_order(affine: np.ndarray) -> tuple[tuple[int, int], ...]:
    """For each voxel axis (world axis, sign): the one-to-one assignment with the largest total of direction cosines."""
    r = np.asarray(affine, float)[:3, :3]
    norm = np.linalg.norm(r, axis=0)
    r = r / np.where(norm > 0, norm, 1)
    best = max(permutations(range(3)), key=lambda p: sum(abs(r[p[v], v]) for v in range(3)))
    return tuple((w, 1 if r[w, v] >= 0 else -1) for v, w in enumerate(best))


def axcodes(affine: np.ndarray) -> tuple[str, str, str]:
    return tuple((_PLUS if s > 0 else _MINUS)[w] for w, s in axis_order(affine))


def is_valid(affine: np.ndarray) -> bool:
    """Not the identity, a determinant between 1e-6 and 1e6 in size, and axes at right angles."""
    a = np.asarray(affine, float)
    if a.shape != (4, 4) or not np.isfinite(a).all() or np.allclose(a, np.eye(4)):
        return False
    r = a[:3, :3]
    if not 1e-6 < abs(np.linalg.det(r)) < 1e6:
        return False
    n = r / np.linalg.norm(r, axis=0)
    return bool(np.allclose(n.T @ n, np.eye(3), atol=1e-3))


def reorient(data: np.ndarray, affine: np.ndarray, target: str = "RAS") -> tuple[np.ndarray, np.ndarray]:
    """Data with its axes permuted and flipped to ``target``, and the affine under which every voxel keeps its place in the world."""
    want = [(_PLUS.index(c), 1) if c in _PLUS else (_MINUS.index(c), -1) for c in target]
    have = axis_order(affine)
    order = [next(v for v, (w, _) in enumerate(have) if w == axis) for axis, _ in want]
    out = np.transpose(data, [*order, *range(3, data.ndim)])
    a = np.asarray(affine, float).copy()
    a[:3, :3] = a[:3, order]
    for k, ((_, sign), v) in enumerate(zip(want, order, strict=True)):
        if have[v][1] != sign:
            out = np.flip(out, k)
            a[:3, 3] += a[:3, k] * (out.shape[k] - 1)
            a[:3, k] *= -1
    return np.ascontiguousarray(out), a


def detect(affine: np.ndarray, source: str) -> Orientation:
    a = np.asarray(affine, float)
    return Orientation(axcodes(a), tuple(map(tuple, a.tolist())), source, "header" if is_valid(a) else "low")


def dicom_affine(orientation: list[float], position: list[float], spacing: tuple[float, float], step: np.ndarray) -> np.ndarray:
    """The RAS affine of a series: columns for (column, row, slice) voxel axes from DICOM's LPS vectors."""
    row, col = np.array(orientation[:3], float), np.array(orientation[3:], float)
    a = np.eye(4)
    a[:3, 0], a[:3, 1], a[:3, 2], a[:3, 3] = row * spacing[1], col * spacing[0], step, position
    return np.diag([-1.0, -1.0, 1.0, 1.0]) @ a


def orientation_to_meta(o: Orientation) -> dict[str, str]:
    return {"axcodes": "".join(o.axcodes), "affine_json": json.dumps([list(r) for r in o.affine]), "orientation_source": o.source, "orientation_confidence": o.confidence}


def orientation_from_meta(meta: dict[str, str]) -> Orientation | None:
    if "axcodes" not in meta or "affine_json" not in meta:
        return None
    return Orientation(tuple(meta["axcodes"]), tuple(map(tuple, json.loads(meta["affine_json"]))), meta.get("orientation_source", "identity"), meta.get("orientation_confidence", "header"))
