"""Scalar functions on names, units, affines and tuples, as Columns (and in Python where the driver needs them)."""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Series names; a file stem that ends in one after an underscore, in any case, tells it. Fixed values.
SERIES = (
    "T1w T2w T1rho T1map T2map T2star FLAIR FLASH PD PDmap PDT2 inplaneT1 inplaneT2 angio T1gd bold cbv phase dwi CT HRCT CTA CTPA phasediff magnitude fieldmap epi"
).split()
#: Parts of upper-case file stems, the first that fits wins, and their series. Fixed values.
NAME_PARTS = [
    ("T1GD", "T1gd"), ("T1CE", "T1gd"), ("T1C", "T1gd"), ("T1W", "T1w"), ("T1", "T1w"), ("T2W", "T2w"), ("T2", "T2w"), ("FLAIR", "FLAIR"),
    ("DWI", "dwi"), ("DTI", "dwi"), ("BOLD", "bold"), ("FUNC", "bold"),
    ("LUNG_", "CT"), ("LIVER_", "CT"), ("COLON_", "CT"), ("PANCREAS_", "CT"), ("SPLEEN_", "CT"), ("HEPATIC", "CT"), ("_CT_", "CT"), ("_CT.", "CT"),
]
#: NIfTI spatial unit codes (low three bits of xyzt_units); fixed values.
SPATIAL_UNITS = {1: "m", 2: "mm", 3: "um"}


def generate_obs_id(subject: str, collection: str, k: int = 0) -> str:
    return f"{subject}_{collection}" + (f"_acq-{k}" if k else "")


def file_stem(path: Column) -> Column:
    """The file name without directories and without .nii, .nii.gz."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.nii(\.gz)?$", "")


def series_type(name: Column) -> Column:
    """The series that a file stem tells: by its last part, else by parts of the name, else ``unknown``."""
    up = F.upper(name)
    last = F.element_at(F.split(up, "_"), -1)
    out = F.lit("unknown")
    for part, series in reversed(NAME_PARTS):
        out = F.when(up.contains(part), F.lit(series)).otherwise(out)
    endings = F.create_map(*(F.lit(x) for s in SERIES for x in (s.upper(), s)))
    return F.coalesce(F.try_element_at(endings, last), out)


def infer_series_type(name: str, header_text: str = "") -> str:
    """The same rule for one stem; a description from the header is asked last."""
    up = name.upper()
    by_name = next((s for s in SERIES if s.upper() == up.split("_")[-1]), None) or next((s for part, s in NAME_PARTS if part in up), None)
    return by_name or next((s for s in SERIES if s.lower() in header_text.lower()), "unknown")


def spatial_units(code: Column) -> Column:
    low = code.cast("int").bitwiseAND(F.lit(7))
    out = F.lit("unknown")
    for k, unit in SPATIAL_UNITS.items():
        out = F.when(low == k, F.lit(unit)).otherwise(out)
    return out


def affine_from_json(text: Column) -> Column:
    return F.from_json(text, "array<array<double>>")


def affine_to_json(affine) -> str:
    return json.dumps(np.asarray(affine, float).tolist())


def tuple_text(values: Sequence) -> str:
    return str(tuple(values))


def tuple_values(text: Column, kind: str = "double") -> Column:
    """The numbers of a tuple's text."""
    return F.transform(F.split(F.regexp_replace(text, r"[()\s]", ""), ","), lambda x: x.cast(kind))


def result_summary(value) -> str:
    """How a result shows in a table: shape and type of an array, four digits of a float, else its text."""
    if isinstance(value, np.ndarray) and value.ndim:
        return f"{'x'.join(map(str, value.shape))} {value.dtype}"
    if isinstance(value, (float, np.floating)):
        return f"{value:.4f}"
    return str(value)


def adjacent_uri(uri: str, name: str | None = None, fn=None) -> str:
    """A sibling of ``uri``: ``name``, else its own name with the function's, else with ``_written``."""
    parent, _, own = uri.rstrip("/").rpartition("/")
    if name:
        return f"{parent}/{name}"
    called = getattr(fn, "__name__", "")
    return f"{parent}/{own}_{called if called and called != '<lambda>' else 'written'}"


def nan_to(column: Column, default: float) -> Column:
    return F.coalesce(F.nanvl(column, F.lit(default)), F.lit(default))
