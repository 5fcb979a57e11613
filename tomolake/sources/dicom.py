"""DICOM series: little-endian files, explicit or implicit VR, plain, deflated or with RLE pixels."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from tomolake.errors import IngestError

LONG_VR = {b"OB", b"OW", b"OF", b"OD", b"OL", b"SQ", b"UN", b"UT", b"UC", b"UR"}
#: Tags that are read; fixed values.
TAGS = {
    (0x0002, 0x0010): "syntax", (0x0008, 0x0060): "modality", (0x0008, 0x103E): "series_description", (0x0018, 0x0060): "kvp", (0x0018, 0x1152): "exposure",
    (0x0018, 0x0080): "repetition_time", (0x0018, 0x0081): "echo_time", (0x0018, 0x0087): "magnetic_field_strength", (0x0018, 0x0050): "thickness", (0x0020, 0x0013): "instance",
    (0x0020, 0x0032): "position", (0x0020, 0x0037): "orientation", (0x0028, 0x0010): "rows", (0x0028, 0x0011): "columns", (0x0028, 0x0030): "spacing", (0x0028, 0x0100): "bits",
    (0x0028, 0x0103): "signed", (0x7FE0, 0x0010): "pixels",
}
SHORT = {"rows", "columns", "bits", "signed"}
NUMBERS = {"kvp", "exposure", "repetition_time", "echo_time", "magnetic_field_strength", "thickness"}
LITTLE = {"1.2.840.10008.1.2", "1.2.840.10008.1.2.1"}
DEFLATED, RLE = "1.2.840.10008.1.2.1.99", "1.2.840.10008.1.2.5"


def unpacked_bits(raw: bytes, size: int) -> bytes:
    """PackBits: a count and literal bytes, or a count and one byte that repeats."""
    out, at = bytearray(), 0
    while at < len(raw) and len(out) < size:
        n = raw[at]
        if n < 128:
            out += raw[at + 1 : at + 2 + n]
            at += 2 + n
        elif n > 128:
            out += raw[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out[:size])


def rle_frame(raw: bytes, n: int, width: int) -> bytes:
    """``n`` little-endian values of ``width`` bytes from an RLE frame, whose segments are byte planes, highest first."""
    count, *offsets = struct.unpack_from("<16I", raw, 0)
    if count != width:
        raise IngestError(f"an RLE frame of {count} segments does not hold values of {width} bytes")
    ends = [*offsets[1:count], len(raw)]
    planes = [np.frombuffer(unpacked_bits(raw[a:b], n), np.uint8) for a, b in zip(offsets, ends, strict=False)]
    if any(len(p) != n for p in planes):
        raise IngestError("an RLE segment is too short")
    return np.stack(planes[::-1], 1).tobytes()


def fragments(raw: bytes, at: int) -> bytes:
    """The items of encapsulated pixels after their offset table, put together."""
    out, first = b"", True
    while at + 8 <= len(raw):
        group, element, size = struct.unpack_from("<HHI", raw, at)
        if (group, element) != (0xFFFE, 0xE000):
            break
        if not first:
            out += raw[at + 8 : at + 8 + size]
        first, at = False, at + 8 + size
    return out


def parse_file(raw: bytes, pixels: bool = True) -> dict:
    """The known elements of one file; nested sequences are stepped over."""
    at = 132 if raw[128:132] == b"DICM" else 0
    out: dict = {}
    explicit, n = True, len(raw)
    in_meta = at > 0
    if not at and n > 6:  # no preamble: explicit when a value representation follows the tag
        explicit = raw[4:6].isalpha() and raw[4:6].isupper()
    while at + 8 <= n:
        group, element = struct.unpack_from("<HH", raw, at)
        if in_meta and group != 2:
            in_meta = False
            if out.get("syntax") == DEFLATED:
                raw, at = zlib.decompress(raw[at:], -15), 0
                n = len(raw)
                group, element = struct.unpack_from("<HH", raw, at)
            explicit = out.get("syntax", "1.2.840.10008.1.2.1") != "1.2.840.10008.1.2"
        if group == 0xFFFE:  # items and delimiters of sequences of undefined length
            at += 8
            continue
        if explicit:
            vr = raw[at + 4 : at + 6]
            if vr in LONG_VR:
                size = struct.unpack_from("<I", raw, at + 8)[0]
                at += 12
            else:
                size = struct.unpack_from("<H", raw, at + 6)[0]
                at += 8
        else:
            vr, size = b"", struct.unpack_from("<I", raw, at + 4)[0]
            at += 8
        name = TAGS.get((group, element))
        if size == 0xFFFFFFFF:
            if name == "pixels":
                if out.get("syntax") != RLE:
                    raise IngestError(f"pixels in transfer syntax {out.get('syntax')} are not supported")
                if pixels:
                    out["packed"] = fragments(raw, at)
                break
            continue  # its items are read one by one
        if vr == b"SQ":
            at += size
            continue
        value = raw[at : at + size]
        at += size
        if name is None or name in out or (name == "pixels" and not pixels):
            continue
        if name == "pixels":
            out[name] = value
        elif name in SHORT:
            out[name] = struct.unpack_from("<H", value)[0]
        else:
            text = value.decode("latin-1").strip("\0 ")
            if name == "syntax" and text not in LITTLE | {DEFLATED, RLE}:
                raise IngestError(f"transfer syntax {text} is not supported")
            if name in ("position", "orientation", "spacing"):
                out[name] = [float(x) for x in text.split("\\") if x.strip()]
            elif name in NUMBERS:
                out[name] = float(text.split("\\")[0]) if text else None
            elif name == "instance":
                out[name] = int(float(text)) if text else None
            else:
                out[name] = text
    if "rows" not in out or "columns" not in out:
        raise IngestError("not a DICOM image")
    if "packed" in out:
        out["pixels"] = rle_frame(out.pop("packed"), out["rows"] * out["columns"], max(1, out.get("bits", 16) // 8))
    return out


def ordered(slices: list[dict]) -> list[dict]:
    """By instance number; without one, by the third coordinate of the position."""
    if all(s.get("instance") is not None for s in slices):
        return sorted(slices, key=lambda s: s["instance"])
    return sorted(slices, key=lambda s: s.get("position", [0, 0, 0])[2])


def series_meta(slices: list[dict]) -> dict[str, object]:
    """The attributes of a series from its ordered slices."""
    from tomolake.functions.naming import affine_to_json, tuple_text
    from tomolake.functions.orientation import axcodes, dicom_affine

    first, last = slices[0], slices[-1]
    spacing = tuple(first.get("spacing", [1.0, 1.0]))
    thick = first.get("thickness") or 1.0
    p, q = np.array(first.get("position", [0.0, 0, 0])), np.array(last.get("position", [0.0, 0, 0]))
    iop = first.get("orientation", [1.0, 0, 0, 0, 1, 0])
    step = (q - p) / (len(slices) - 1) if len(slices) > 1 and not np.allclose(p, q) else np.cross(iop[:3], iop[3:]) * thick
    affine = dicom_affine(iop, p.tolist(), spacing, step)
    known = "orientation" in first and "position" in first
    return {
        "voxel_spacing": tuple_text((spacing[0], spacing[1], round(float(np.linalg.norm(step)), 6))), "dimensions": tuple_text((first["columns"], first["rows"], len(slices))),
        "modality": first.get("modality", ""), "series_description": first.get("series_description", ""), **{k: first.get(k) for k in ("kvp", "exposure", "repetition_time", "echo_time", "magnetic_field_strength")},
        "axcodes": "".join(axcodes(affine)), "affine_json": affine_to_json(affine), "orientation_source": "dicom_iop" if known else "identity",
    }


def stack(slices: list[dict], dtype: str | None = None) -> np.ndarray:
    """(x, y, z) voxels: rows and columns swapped, slices along the last axis."""
    out = []
    for s in slices:
        kind = np.dtype(("i" if s.get("signed") else "u") + str(max(1, s.get("bits", 16) // 8))).newbyteorder("<")
        n = s["rows"] * s["columns"]
        if len(s.get("pixels", b"")) < n * kind.itemsize:
            raise IngestError("a slice has too few pixels")
        out.append(np.frombuffer(s["pixels"], kind, n).reshape(s["rows"], s["columns"]).astype(kind.newbyteorder("=")))
    if len({a.shape for a in out}) != 1:
        raise IngestError("slices differ in size")
    a = np.ascontiguousarray(np.stack(out, -1).transpose(1, 0, 2))
    return a.astype(dtype) if dtype else a


def write_file(pixels: np.ndarray, instance: int | None, position, orientation=(1, 0, 0, 0, 1, 0), spacing=(1.0, 1.0), implicit: bool = False, modality: str = "CT") -> bytes:
    """A minimal file of one slice (rows x columns, uint16 or int16)."""

    def element(group, elem, vr, value):
        value += (b"\0" if vr in (b"UI", b"OW") else b" ") * (len(value) % 2)
        if implicit and group != 2:
            return struct.pack("<HHI", group, elem, len(value)) + value
        if vr in LONG_VR:
            return struct.pack("<HH2sHI", group, elem, vr, 0, len(value)) + value
        return struct.pack("<HH2sH", group, elem, vr, len(value)) + value

    join = lambda v: "\\".join(f"{x:g}" for x in v).encode()
    body = element(2, 0x10, b"UI", (b"1.2.840.10008.1.2" if implicit else b"1.2.840.10008.1.2.1"))
    body += element(8, 0x60, b"CS", modality.encode())
    if instance is not None:
        body += element(0x20, 0x13, b"IS", str(instance).encode())
    body += element(0x20, 0x32, b"DS", join(position)) + element(0x20, 0x37, b"DS", join(orientation))
    body += element(0x28, 0x10, b"US", struct.pack("<H", pixels.shape[0])) + element(0x28, 0x11, b"US", struct.pack("<H", pixels.shape[1]))
    body += element(0x28, 0x30, b"DS", join(spacing)) + element(0x28, 0x100, b"US", struct.pack("<H", 16))
    body += element(0x28, 0x103, b"US", struct.pack("<H", int(pixels.dtype.kind == "i")))
    return b"\0" * 128 + b"DICM" + body + element(0x7FE0, 0x10, b"OW", pixels.astype(pixels.dtype.newbyteorder("<")).tobytes())
