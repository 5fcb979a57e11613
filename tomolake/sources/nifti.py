"""NIfTI-1 files: header, voxels and writing, on struct and numpy alone."""

from __future__ import annotations

import gzip
import math
import struct
from dataclasses import dataclass

import numpy as np

from tomolake.errors import IngestError

#: NIfTI-1 data type codes; fixed values.
DTYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
CODES = {v: k for k, v in DTYPES.items()}


@dataclass(frozen=True)
class NiftiHeader:
    shape: tuple[int, ...]
    spacing: tuple[float, ...]
    datatype: int
    bitpix: int
    slope: float
    inter: float
    xyzt_units: int
    qform_code: int
    sform_code: int
    affine: np.ndarray
    source: str
    offset: int
    order: str
    description: str

    @property
    def dtype(self) -> np.dtype:
        if self.datatype not in DTYPES:
            raise IngestError(f"NIfTI data type {self.datatype} is not supported")
        return np.dtype(self.order + DTYPES[self.datatype])


def _plain(raw: bytes) -> bytes:
    return gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw


def head_bytes(path: str, n: int = 352) -> bytes:
    """The first bytes of a local file, unpacked; the voxels behind them are not read."""
    with open(path, "rb") as f:
        gz = f.read(2) == b"\x1f\x8b"
    with (gzip.open if gz else open)(path, "rb") as f:
        return f.read(n)


def _quaternion(b: float, c: float, d: float, spacing, qfac: float, offset) -> np.ndarray:
    a = math.sqrt(max(0.0, 1 - b * b - c * c - d * d))
    r = np.array(
        [
            [a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)],
            [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)],
            [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - c * c - b * b],
        ]
    )
    out = np.eye(4)
    out[:3, :3] = r * np.array([spacing[0], spacing[1], spacing[2] * (qfac if qfac else 1)])
    out[:3, 3] = offset
    return out


def parse_header(raw: bytes) -> NiftiHeader:
    """Header of a single-file NIfTI-1; the affine is the sform, else the qform, else one of the spacing alone."""
    if len(raw) < 348:
        raise IngestError("too short for a NIfTI header")
    order = next((o for o in "<>" if struct.unpack(o + "i", raw[:4])[0] == 348), None)
    if order is None:
        raise IngestError("not a NIfTI-1 file")
    get = lambda fmt, at: struct.unpack_from(order + fmt, raw, at)
    dim, pixdim = get("8h", 40), get("8f", 76)
    if not 1 <= dim[0] <= 7:
        raise IngestError(f"a NIfTI file has 1 to 7 dimensions, not {dim[0]}")
    shape = [max(1, d) for d in dim[1 : dim[0] + 1]]
    while len(shape) > 3 and shape[-1] == 1:
        shape.pop()
    shape += [1] * (3 - len(shape))
    datatype, bitpix = get("2h", 70)
    offset, slope, inter = get("3f", 108)
    qcode, scode = get("2h", 252)
    b, c, d, *q = get("6f", 256)
    if scode > 0:
        affine, source = np.vstack([np.array(get("12f", 280)).reshape(3, 4), [0, 0, 0, 1]]), "sform"
    elif qcode > 0:
        affine, source = _quaternion(b, c, d, pixdim[1:4], pixdim[0], q), "qform"
    else:
        affine, source = np.diag([*(p or 1.0 for p in pixdim[1:4]), 1.0]), "identity"
    return NiftiHeader(
        tuple(shape), tuple(float(p) for p in pixdim[1 : len(shape) + 1]), datatype, bitpix, 1.0 if math.isnan(slope) else slope, 0.0 if math.isnan(inter) else inter, raw[123],
        qcode, scode, affine, source, int(offset) or 352, order, raw[148:228].split(b"\0")[0].decode("utf-8", "ignore"),
    )


def parse(raw: bytes) -> tuple[np.ndarray, NiftiHeader]:
    """Voxels (scaled when the header scales them) and header."""
    raw = _plain(raw)
    h = parse_header(raw)
    n = int(np.prod(h.shape))
    if len(raw) < h.offset + n * h.dtype.itemsize:
        raise IngestError("the file ends before its voxels do")
    a = np.frombuffer(raw, h.dtype, n, h.offset).reshape(h.shape, order="F")
    a = a.astype(h.dtype.newbyteorder("="))
    if h.slope not in (0.0, 1.0) or (h.slope and h.inter):
        a = a.astype(np.float64) * h.slope + h.inter
    return np.ascontiguousarray(a), h


def header_meta(h: NiftiHeader) -> dict[str, object]:
    """The attributes of a volume that its header tells (scaling is applied to the voxels, so it is the identity here)."""
    from tomolake.functions.naming import SPATIAL_UNITS, affine_to_json, tuple_text
    from tomolake.functions.orientation import axcodes

    return {
        "voxel_spacing": tuple_text(round(s, 6) for s in h.spacing[:3]), "dimensions": tuple_text(h.shape), "datatype": h.datatype, "bitpix": h.bitpix, "scl_slope": h.slope, "scl_inter": h.inter,
        "xyzt_units": h.xyzt_units, "spatial_units": SPATIAL_UNITS.get(h.xyzt_units & 7, "unknown"), "qform_code": h.qform_code, "sform_code": h.sform_code,
        "axcodes": "".join(axcodes(h.affine)), "affine_json": affine_to_json(h.affine), "orientation_source": h.source,
    }


def write_nifti(path: str, a: np.ndarray, affine: np.ndarray, sform: int = 1, qform: int = 0, units: int = 2, slope: float = 1.0, inter: float = 0.0, order: str = "<") -> None:
    """A single-file NIfTI-1; gzipped when the name ends in .gz."""
    code = CODES.get(a.dtype.str[1:])
    if code is None:
        a, code = (a.astype(np.uint8), 2) if a.dtype == bool else (a.astype(np.float32), 16)
    affine = np.asarray(affine, float)
    size = np.linalg.norm(affine[:3, :3], axis=0)
    h = bytearray(352)
    put = lambda fmt, at, *v: struct.pack_into(order + fmt, h, at, *v)
    put("i", 0, 348)
    put("8h", 40, a.ndim, *a.shape, *([1] * (7 - a.ndim)))
    put("2h", 70, code, a.dtype.itemsize * 8)
    rotation = affine[:3, :3] / np.where(size > 0, size, 1)
    qfac = -1.0 if np.linalg.det(rotation) < 0 else 1.0
    put("8f", 76, qfac, *size, *([1.0] * 4))
    put("3f", 108, 352.0, slope, inter)
    h[123] = units
    put("2h", 252, qform, sform)
    r = rotation.copy()
    r[:, 2] *= qfac
    quaternion = _to_quaternion(r)
    put("6f", 256, *quaternion, *affine[:3, 3])
    put("12f", 280, *affine[:3].ravel())
    h[344:348] = b"n+1\0"
    body = bytes(h) + a.astype(a.dtype.newbyteorder(order)).tobytes(order="F")
    with open(path, "wb") as f:
        f.write(gzip.compress(body, 6, mtime=0) if path.endswith(".gz") else body)


def _to_quaternion(r: np.ndarray) -> tuple[float, float, float]:
    """(b, c, d) of a rotation with a not negative, by the eigenvector of its largest eigenvalue."""
    k = np.array(
        [
            [r[0, 0] - r[1, 1] - r[2, 2], 0, 0, 0],
            [r[0, 1] + r[1, 0], r[1, 1] - r[0, 0] - r[2, 2], 0, 0],
            [r[0, 2] + r[2, 0], r[1, 2] + r[2, 1], r[2, 2] - r[0, 0] - r[1, 1], 0],
            [r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1], r.trace()],
        ]
    )
    w, v = np.linalg.eigh(k / 3)
    b, c, d, a = v[:, w.argmax()]
    return tuple(float(x) for x in (np.array([b, c, d]) * (-1 if a < 0 else 1)))
