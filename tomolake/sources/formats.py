"""Python data sources: ``spark.read.format("nifti")`` and ``"dicom_series"`` after ``register(spark)``.

A partition holds files (or series) of about ``partition_bytes`` together, 64 MB unless told. ``mode`` is ``header`` (attributes only; the voxels
are not read) or ``tiles`` (rows of the tile table).
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tomolake.operators.voxels import TILE_DDL, check_shape, tiles_of

_NIFTI = "path string, voxel_spacing string, dimensions string, datatype int, bitpix int, scl_slope double, scl_inter double, xyzt_units int, spatial_units string, qform_code int, sform_code int, axcodes string, affine_json string, orientation_source string"
_DICOM = "path string, voxel_spacing string, dimensions string, modality string, series_description string, kvp double, exposure double, repetition_time double, echo_time double, magnetic_field_strength double, axcodes string, affine_json string, orientation_source string"


class _Files(InputPartition):
    def __init__(self, pairs: list[tuple[str, str]]):
        self.pairs = pairs


def grouped(pairs: list[tuple[str, str]], size, most_bytes: int, most_files: int = 4096) -> list[list[tuple[str, str]]]:
    """The pairs in their order, cut where a group would pass ``most_bytes`` or ``most_files``; a larger file stands alone."""
    out: list[list[tuple[str, str]]] = []
    total = 0
    for pair in pairs:
        n = size(pair[0])
        if not out or total + n > most_bytes or len(out[-1]) == most_files:
            out.append([])
            total = 0
        out[-1].append(pair)
        total += n
    return out


def _bytes_of(path: str) -> int:
    return sum(e.stat().st_size for e in os.scandir(path) if e.is_file()) if os.path.isdir(path) else os.path.getsize(path)


class _Reader(DataSourceReader):
    def __init__(self, kind: str, options: dict):
        self.kind, self.path, self.mode = kind, options.get("path"), options.get("mode", "header")
        self.most_bytes = int(options.get("partition_bytes", 64 << 20))
        if not self.path:
            raise ValueError("load() needs a path")
        if self.mode not in ("header", "tiles"):
            raise ValueError(f"unknown mode {self.mode!r}")

    def partitions(self) -> list[InputPartition]:
        from tomolake.sources import ingest

        pairs, _ = ingest.resolve(self.path, self.kind)
        return [_Files(g) for g in grouped(pairs, (lambda p: 16 << 10) if self.mode == "header" else _bytes_of, self.most_bytes)]

    def read(self, part: _Files) -> Iterator[tuple]:
        for path, subject in part.pairs:
            yield from self._rows(path, subject)

    def _rows(self, path: str, subject: str) -> Iterator[tuple]:
        from tomolake.config import TileConfig
        from tomolake.sources import dicom, ingest, nifti

        if self.mode == "tiles":
            a, _ = (ingest.read_nifti if self.kind == "nifti" else ingest.read_dicom)(path)
            yield from tiles_of(subject, a, TileConfig().extents(check_shape(a.shape)))
        elif self.kind == "nifti":
            meta = nifti.header_meta(nifti.parse_header(nifti.head_bytes(path)))
            yield (path, *(meta[c.split()[0]] for c in _NIFTI.split(", ")[1:]))
        else:
            slices = dicom.ordered([dicom.parse_file(open(f, "rb").read(), pixels=False) for f in ingest.series_files(path)])
            meta = dicom.series_meta(slices)
            yield (path, *(meta[c.split()[0]] for c in _DICOM.split(", ")[1:]))


class NiftiSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "nifti"

    def schema(self) -> str:
        return TILE_DDL if self.options.get("mode") == "tiles" else _NIFTI

    def reader(self, schema) -> DataSourceReader:
        return _Reader("nifti", self.options)


class DicomSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dicom_series"

    def schema(self) -> str:
        return TILE_DDL if self.options.get("mode") == "tiles" else _DICOM

    def reader(self, schema) -> DataSourceReader:
        return _Reader("dicom", self.options)


def register(spark: SparkSession) -> None:
    for source in (NiftiSource, DicomSource):
        spark.dataSource.register(source)
