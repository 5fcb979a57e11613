"""Incremental writers: memory-bounded on the driver, visible only when they finish."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tomolake.config import get_config
from tomolake.errors import AlignmentError, SchemaError, ShapeError, StorageError
from tomolake.operators import voxels
from tomolake.operators.frames import OBS, SUBJECT
from tomolake.operators.volumeset import HEADER_DDL, MANIFEST, VolumeSet, commit, write_tiles
from tomolake.storage import Store

RESERVED = (SUBJECT, OBS)


class VolumeSetWriter:
    """``with VolumeSetWriter(...) as w: w.write_volume(...)``; tiles go out in batches of about ``flush_mb``; an exception leaves nothing visible."""

    def __init__(self, spark: SparkSession, uri: str, name: str = "volumes", shape: tuple[int, ...] | None = None, flush_mb: int = 64):
        self.spark, self.uri, self.name, self.shape = spark, uri.rstrip("/"), name, tuple(shape) if shape else None
        if Store(spark).exists(f"{self.uri}/{MANIFEST}"):
            raise StorageError(f"{uri} holds a collection")
        self._flush_bytes = flush_mb << 20
        self._tiles: list[tuple] = []
        self._held = 0
        self._dirs: list[str] = []
        self._heads: list[tuple] = []
        self._rows: list[dict] = []
        self._ids: set[str] = set()

    @property
    def n_written(self) -> int:
        return len(self._rows)

    def write_volume(self, array: np.ndarray, obs_id: str, subject: str, attrs: dict | None = None, meta: dict[str, str] | None = None) -> None:
        shape = voxels.check_shape(array.shape)
        if self.shape and shape[:3] != self.shape[:3]:
            raise ShapeError(f"{obs_id} has shape {shape}, the collection {self.shape}")
        if obs_id in self._ids:
            raise AlignmentError(f"obs_id {obs_id!r} was written")
        if clash := set(attrs or {}) & set(RESERVED):
            raise SchemaError(f"attributes clash with index columns: {sorted(clash)}")
        cfg = get_config().write.tile
        extents = cfg.extents(shape)
        for row in voxels.tiles_of(obs_id, array, extents):
            self._tiles.append(row)
            self._held += len(row[-1])
            if self._held >= self._flush_bytes:
                self._flush()
        self._ids.add(obs_id)
        self._heads.append((obs_id, list(shape), array.dtype.str, list(extents), {"tile_orientation": cfg.orientation.value} | (meta or {})))
        self._rows.append({SUBJECT: subject, OBS: obs_id} | (attrs or {}))

    def write_batch(self, volumes: Iterable[tuple]) -> None:
        for v in volumes:
            self.write_volume(*v)

    def _flush(self) -> None:
        if self._tiles:
            pdf = pd.DataFrame(self._tiles, columns=voxels.TILE_COLUMNS)
            self._dirs.append(write_tiles(self.spark.createDataFrame(pdf, voxels.TILE_DDL), self.uri))
            self._tiles, self._held = [], 0

    def finalize(self) -> VolumeSet:
        self._flush()
        if self._rows:
            pdf = pd.DataFrame(self._rows)
            obs = self.spark.createDataFrame(pdf.where(pdf.notna(), None) if pdf.isna().any().any() else pdf)
        else:
            obs = self.spark.createDataFrame([], f"{SUBJECT} string, {OBS} string")
        commit(self.spark, self.uri, self.name, obs, self.spark.createDataFrame(self._heads, HEADER_DDL), self._dirs)
        return VolumeSet(self.spark, self.uri)

    def abort(self) -> None:
        store = Store(self.spark)
        for d in self._dirs:
            store.delete(f"{self.uri}/{d}")

    def __enter__(self) -> VolumeSetWriter:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.finalize()
        else:
            self.abort()


class StudyWriter:
    """Collections and subjects of one study, committed together by ``finalize`` (or the end of the ``with``)."""

    def __init__(self, spark: SparkSession, uri: str):
        from tomolake.operators.study import MANIFEST as STUDY

        self.spark, self.uri = spark, uri.rstrip("/")
        if Store(spark).exists(f"{self.uri}/{STUDY}"):
            raise StorageError(f"{uri} holds a study")
        self._meta: DataFrame | None = None
        self._sets: dict[str, VolumeSetWriter] = {}
        self._done: dict[str, str] = {}

    @property
    def collection_names(self) -> list[str]:
        return list(self._sets)

    def write_obs_meta(self, meta: DataFrame | pd.DataFrame) -> None:
        df = self.spark.createDataFrame(meta) if isinstance(meta, pd.DataFrame) else meta
        if SUBJECT not in df.columns:
            raise SchemaError(f"{SUBJECT} is missing")
        self._meta = df

    def add_collection(self, name: str, shape: tuple[int, ...] | None = None) -> VolumeSetWriter:
        if name in self._sets:
            raise ValueError(f"collection {name!r} exists")
        rel = f"collections/{name}-{uuid.uuid4().hex[:8]}"
        w = VolumeSetWriter(self.spark, f"{self.uri}/{rel}", name, shape)
        self._sets[name], self._done[name] = w, rel
        return w

    def finalize(self):
        from tomolake.operators.study import Study, commit_study

        ids = [i for w in self._sets.values() for i in w._ids]
        if len(ids) != len(set(ids)):
            twice = sorted({i for i in ids if ids.count(i) > 1})[:5]
            raise AlignmentError(f"obs ids occur in two collections: {twice}")
        sets = {n: w.finalize() for n, w in self._sets.items()}
        meta = self._meta
        if meta is None:
            subjects = sorted({r[SUBJECT] for w in self._sets.values() for r in w._rows})
            meta = self.spark.createDataFrame([(s,) for s in subjects], f"{SUBJECT} string")
        commit_study(self.spark, self.uri, meta, {n: (self._done[n], s.root_obs) for n, s in sets.items()})
        return Study(self.spark, self.uri)

    def __enter__(self) -> StudyWriter:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.finalize()
        else:
            for w in self._sets.values():
                w.abort()
