"""VolumeSet: a collection of volumes (obs, headers, tiles) and its views.

A view is a lazily filtered ``obs``; headers and tiles follow by semi-joins, always
against the root, so views of views stay flat.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomolake.config import SliceOrientation, get_config
from tomolake.errors import AlignmentError, SchemaError, ShapeError, StorageError, ViewError
from tomolake.functions.naming import adjacent_uri, generate_obs_id
from tomolake.operators import frames, voxels
from tomolake.operators.frames import OBS, SUBJECT
from tomolake.operators.index import KeyIndex, positions
from tomolake.operators.volume import TileFiles, VolumeRef, codes, stored
from tomolake.plans.predicate import predicate
from tomolake.storage import Store, opened, snapshot

HEADER_DDL = "obs_id string, shape array<int>, dtype string, tile array<int>, meta map<string,string>"
MANIFEST = "_collection.json"

#: A row group holds about as many bytes of tiles, where tiles are smaller than that.
GROUP_BYTES = 1 << 20


def tile_options(tile_bytes: int | None = None) -> dict[str, str]:
    """Row limits that give Parquet a row group every few tiles and a page a tile, so that tile predicates prune.

    Small tiles go together up to ``GROUP_BYTES``, so that footers stay small beside the voxels.
    """
    w = get_config().write
    usual = 1 if w.tile.orientation is SliceOrientation.ISOTROPIC else 4  # cubes are large
    per_group = w.tiles_per_group or max(usual if not tile_bytes else 1, GROUP_BYTES // max(1, tile_bytes or GROUP_BYTES))
    return w.compression.options() | {
        "parquet.block.row.count.limit": str(per_group), "parquet.page.row.count.limit": str(max(1, per_group // 64)), "parquet.page.size.row.check.min": "1",
    }


def write_tiles(tiles: DataFrame, root: str, tile_bytes: int | None = None) -> str:
    placed = tiles.repartitionByRange("obs_id").sortWithinPartitions("obs_id", "ct", "cz", "cy", "cx")
    return snapshot(placed, root, "tiles", **tile_options(tile_bytes))


def retiled(rows: Iterable[tuple[str, np.ndarray]]) -> Iterator[tuple]:
    cfg = get_config().write.tile
    for obs_id, a in rows:
        yield from voxels.tiles_of(obs_id, a, cfg.extents(a.shape))


def commit(spark: SparkSession, uri: str, name: str, obs: DataFrame, headers: DataFrame, tile_dirs: Sequence[str], extra: dict | None = None) -> dict:
    """Writes obs and headers as snapshots and the manifest that makes all of it visible at once."""
    store = Store(spark)
    obs_rel = snapshot(obs, uri, "obs")
    head_rel = snapshot(headers, uri, "volumes")
    stored = spark.read.parquet(f"{uri}/{head_rel}")
    same = stored.agg(
        F.count("*").alias("n"), F.min(F.slice("shape", 1, 3)).alias("s0"), F.max(F.slice("shape", 1, 3)).alias("s1"), F.min(F.slice("tile", 1, 3)).alias("t0"), F.max(F.slice("tile", 1, 3)).alias("t1")
    ).first()
    manifest = {
        "name": name, "shape": list(same.s0) if same.n and same.s0 == same.s1 else None, "tile": list(same.t0) if same.n and same.t0 == same.t1 else None, "n_volumes": same.n,
        "obs": obs_rel, "volumes": head_rel, "tiles": list(tile_dirs),
    } | (extra or {})
    store.write_json(f"{uri}/{MANIFEST}", manifest)
    return manifest


class VolumeSet:
    def __init__(self, spark: SparkSession, uri: str, name: str | None = None, obs: DataFrame | None = None):
        self.spark, self.uri = spark, uri.rstrip("/")
        self.manifest = Store(spark).read_json(f"{self.uri}/{MANIFEST}")
        self.name = name or self.manifest["name"]
        self._obs = obs
        self._index: KeyIndex | None = None
        self._local: TileFiles | None = None
        self._headers: dict[str, dict] = {}

    # -- tables

    def local_tiles(self) -> TileFiles | None:
        """The tile files, kept open; None when this driver cannot open them."""
        if self._local is None:
            places = [opened(f"{self.uri}/{t}") for t in self.manifest["tiles"]]
            if any(p is None for p in places):
                return None
            self._local = TileFiles(places, [set(self._hidden.get(t, ())) for t in self.manifest["tiles"]])
        return self._local

    def warm(self, obs_id: str) -> None:
        """Reads what later reads of the volume need besides voxels."""
        self.header_of(obs_id)
        if (files := self.local_tiles()) is not None:
            files.tiles_of(obs_id)

    def header_of(self, obs_id: str) -> dict:
        """A volume's header row; the last few thousand are remembered."""
        if obs_id not in self._headers:
            place = opened(f"{self.uri}/{self.manifest['volumes']}")
            if place is not None:
                import pyarrow.dataset as ds

                rows = ds.dataset(place[1], format="parquet", filesystem=place[0]).to_table(filter=ds.field(OBS) == obs_id).to_pylist()
                rows = [r | {"meta": dict(r["meta"] or [])} for r in rows]
            else:
                rows = [r.asDict(recursive=True) for r in self.headers.where(F.col(OBS) == obs_id).limit(1).collect()]
            if not rows:
                raise KeyError(obs_id)
            if len(self._headers) > 4096:
                self._headers.clear()
            self._headers[obs_id] = rows[0]
        return self._headers[obs_id]

    @property
    def root_obs(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.uri}/{self.manifest['obs']}")

    @property
    def obs(self) -> DataFrame:
        return self.root_obs if self._obs is None else self._obs

    @property
    def is_view(self) -> bool:
        return self._obs is not None

    def _kept(self, df: DataFrame) -> DataFrame:
        return frames.keep_keys(df, self.obs.select(OBS), OBS) if self.is_view else df

    @property
    def headers(self) -> DataFrame:
        return self._kept(self.spark.read.parquet(f"{self.uri}/{self.manifest['volumes']}"))

    @property
    def tile_paths(self) -> list[str]:
        return [f"{self.uri}/{t}" for t in self.manifest["tiles"]]

    @property
    def tiles(self) -> DataFrame:
        if not self.manifest["tiles"]:
            return self.spark.createDataFrame([], voxels.TILE_DDL)
        return self._kept(self._root_tiles())

    @property
    def _hidden(self) -> dict[str, list[str]]:
        """Ids that a renaming has left behind, by tile directory."""
        return self.manifest.get("hidden") or {}

    def _root_tiles(self) -> DataFrame:
        plain = [f"{self.uri}/{t}" for t in self.manifest["tiles"] if t not in self._hidden]
        parts = [self.spark.read.parquet(*plain)] if plain else []
        parts += [self.spark.read.parquet(f"{self.uri}/{t}").where(~F.col(OBS).isin(ids)) for t, ids in self._hidden.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def to_obs(self) -> DataFrame:
        return self.obs

    # -- properties

    @property
    def index(self) -> KeyIndex:
        """obs ids in canonical order (one short string a volume reaches the driver)."""
        if self._index is None:
            self._index = KeyIndex((r[0] for r in self.obs.select(OBS, SUBJECT).orderBy(SUBJECT, OBS).toLocalIterator()), OBS)
        return self._index

    @property
    def subjects(self) -> list[str]:
        return list(dict.fromkeys(r[0] for r in self.obs.select(SUBJECT, OBS).orderBy(SUBJECT, OBS).toLocalIterator()))

    @property
    def shape(self) -> tuple[int, ...] | None:
        return tuple(self.manifest["shape"]) if self.manifest.get("shape") else None

    @property
    def tile(self) -> tuple[int, ...] | None:
        """The extents of all volumes' tiles, when they are the same."""
        return tuple(self.manifest["tile"]) if self.manifest.get("tile") else None

    @property
    def is_uniform(self) -> bool:
        return self.shape is not None

    def __len__(self) -> int:
        return self.obs.count() if self.is_view else self.manifest["n_volumes"]

    def __iter__(self) -> Iterator[VolumeRef]:
        return (VolumeRef(self, k) for k in self.index)

    def __contains__(self, obs_id: str) -> bool:
        return bool(self._present([obs_id]))

    def _present(self, ids: Sequence[str]) -> set[str]:
        """Which of the ids there are: a point lookup, unless all keys are here already."""
        if self._index is not None:
            return {i for i in ids if i in self._index}
        if not self.is_view and len(ids) == 1:
            try:
                return {self.header_of(ids[0])[OBS]}
            except KeyError:
                return set()
        return {r[0] for r in self._of_ids(ids).obs.select(OBS).collect()}

    def __repr__(self) -> str:
        return f"VolumeSet({self.name!r}, {len(self)} volumes, shape={self.shape}{', view' if self.is_view else ''})"

    # -- selection

    def _view(self, obs: DataFrame) -> VolumeSet:
        return VolumeSet(self.spark, self.uri, self.name, obs)

    def _of_ids(self, ids: Sequence[str]) -> VolumeSet:
        return self._view(frames.of_values(self.obs, OBS, ids))

    def filter(self, expr: str) -> VolumeSet:
        return self._view(self.obs.where(predicate(expr, self.obs.columns)))

    @property
    def iloc(self) -> _ILoc:
        return _ILoc(self)

    @property
    def loc(self) -> _Loc:
        return _Loc(self)

    def __getitem__(self, key):
        if isinstance(key, str):
            return self.loc[key]
        if isinstance(key, list) and key and all(isinstance(k, str) for k in key):
            return self.loc[key]
        return self.iloc[key]

    def sel(self, subject: str | Sequence[str]):
        """A subject's only volume, or a view of several; KeyError when there is none."""
        wanted = [subject] if isinstance(subject, str) else list(subject)
        view = self._view(self.obs.where(F.col(SUBJECT).isin(wanted)))
        ids = [r[0] for r in view.obs.select(OBS).limit(2).collect()]
        if not ids:
            raise KeyError(subject)
        return VolumeRef(self, ids[0]) if len(ids) == 1 and isinstance(subject, str) else view

    def head(self, n: int = 5) -> VolumeSet:
        return self._view(frames.head(self.obs, n, SUBJECT, OBS))

    def tail(self, n: int = 5) -> VolumeSet:
        return self._view(frames.tail(self.obs, n, SUBJECT, OBS))

    def at(self, places: Sequence[int]) -> VolumeSet:
        """The volumes at these places of the canonical order, by a join on positions."""
        return self._view(frames.at_places(self.obs, places, SUBJECT, OBS))

    def sample(self, n: int = 5, seed: int | None = None) -> VolumeSet:
        return self.at(frames.sample_positions(len(self), n, seed))

    def groupby_subject(self) -> Iterator[tuple[str, VolumeSet]]:
        """(subject, view) in canonical order: the ids are read once, each view is a filter on its own."""
        for s in self.subjects:
            yield s, self._view(self.obs.where(F.col(SUBJECT) == s))

    def subject_counts(self) -> DataFrame:
        """(obs_subject_id, n_volumes, first_obs, last_obs) in one aggregate: the batched form of ``groupby_subject``."""
        return frames.volumes_of_subjects(self.obs, SUBJECT, OBS)

    def get_obs_row_by_obs_id(self, obs_id: str) -> pd.DataFrame:
        return self.obs.where(F.col(OBS) == obs_id).toPandas()

    def volume(self, obs_id: str) -> VolumeRef:
        if obs_id not in self:
            raise KeyError(obs_id)
        return VolumeRef(self, obs_id)

    # -- batched voxel operators

    def slices(self, kind: str, at: int) -> DataFrame:
        """One plane of every volume, as cut tiles (one scan, pruned to the tiles that meet the plane where all have the same extents)."""
        box = [(0, 1 << 30)] * 3
        box[voxels.AXES[kind]] = (at, at + 1)
        return voxels.cropped(self.tiles, tuple(box), self.tile)

    def boxes(self, box: voxels.Box) -> DataFrame:
        return voxels.cropped(self.tiles, box, self.tile)

    def statistics(self, percentiles: Sequence[float] = ()) -> DataFrame:
        return voxels.statistics(self.tiles, percentiles)

    def histogram(self, bins: int, lo: float | None = None, hi: float | None = None) -> DataFrame:
        return voxels.histogram(self.tiles, bins, lo, hi)

    def foreground(self) -> DataFrame:
        return voxels.foreground(self.tiles)

    # -- pipelines

    def map(self, fn: Callable):
        from tomolake.operators.mapped import LazySet

        return LazySet(self).map(fn).run()

    def map_batches(self, fn: Callable, batch_size: int = 8):
        from tomolake.operators.mapped import run_batches

        return run_batches(self, fn, batch_size)

    def lazy(self):
        from tomolake.operators.mapped import LazySet

        return LazySet(self)

    # -- persistence

    def write(self, uri: str | None = None, name: str | None = None) -> VolumeSet:
        """The view as a collection of its own: semi-joined tables to Parquet, no voxel passes the driver."""
        uri = (uri or adjacent_uri(self.uri, name)).rstrip("/")
        if Store(self.spark).exists(f"{uri}/{MANIFEST}"):
            raise StorageError(f"{uri} holds a collection")
        tiles = [write_tiles(self.tiles, uri)]
        commit(self.spark, uri, name or self.name, self.obs, self.headers, tiles)
        return VolumeSet(self.spark, uri)

    def copy(self) -> VolumeSet:
        """A set of its own with the same rows; a change of it needs write() first when it is a view."""
        return VolumeSet(self.spark, self.uri, self.name, self._obs)

    def _check_not_view(self, what: str) -> None:
        if self.is_view:
            raise ViewError(f"a view cannot {what}; write it first")

    def append_rows(self, obs: DataFrame, headers: DataFrame, tiles: DataFrame) -> VolumeSet:
        """Adds volumes: new obs and header snapshots, one more tile directory, one manifest swap."""
        self._check_not_view("be appended to")
        new = headers
        if self.shape is not None:
            bad = new.where(F.slice("shape", 1, 3) != F.array(*map(F.lit, self.shape))).limit(1).collect()
            if bad:
                raise ShapeError(f"{bad[0].obs_id} has shape {bad[0].shape}, the collection {self.shape}")
        twice = frames.keep_keys(obs.select(OBS), self.root_obs.select(OBS), OBS).limit(5).collect()
        if twice:
            raise AlignmentError(f"obs ids exist: {[r[0] for r in twice]}")
        tile_dirs = [*self.manifest["tiles"], write_tiles(tiles, self.uri)]
        keep = {k: v for k, v in self.manifest.items() if k not in ("name", "shape", "tile", "n_volumes", "obs", "volumes", "tiles")}
        self.manifest = commit(self.spark, self.uri, self.manifest["name"], frames.append(self.root_obs, obs), frames.append(self.headers, headers), tile_dirs, keep)
        self._index, self._local = None, None
        self._headers.clear()
        return self

    def append(self, niftis: Sequence[tuple[str, str]] | None = None, dicoms: Sequence[tuple[str, str]] | None = None, reorient: bool | None = None) -> VolumeSet:
        """Ingests more files, (path, subject) pairs; a subject that is here already gets ``_acq-k`` names."""
        from tomolake.sources import ingest

        if (niftis is None) == (dicoms is None):
            raise ValueError("give niftis or dicoms")
        self._check_not_view("be appended to")
        fmt = "nifti" if niftis is not None else "dicom"
        mine = self.spark.createDataFrame([(s,) for s in dict.fromkeys(s for _, s in niftis or dicoms)], f"{SUBJECT} string")
        have = {r[0]: r[1] for r in frames.keep_keys(self.root_obs, mine, SUBJECT).groupBy(SUBJECT).count().collect()}
        return self.append_rows(*ingest.ingested(self.spark, niftis or dicoms, self.name, fmt, reorient, have))

    def rename_volume(self, old: str, new: str) -> None:
        """One volume under another id: its tiles are written again, the other tile files stay; readers see all of it or nothing."""
        self._check_not_view("be renamed in")
        if old not in self:
            raise KeyError(old)
        if old == new:
            return
        if new in self:
            raise AlignmentError(f"obs_id {new!r} exists")
        renamed = F.when(F.col(OBS) == old, F.lit(new)).otherwise(F.col(OBS))
        fresh = write_tiles(self.tiles.where(F.col(OBS) == old).withColumn(OBS, F.lit(new)), self.uri)
        keep = {k: v for k, v in self.manifest.items() if k not in ("name", "shape", "tile", "n_volumes", "obs", "volumes", "tiles")}
        hidden = {t: [*self._hidden.get(t, []), old] for t in self.manifest["tiles"]}
        self.manifest = commit(
            self.spark, self.uri, self.manifest["name"], self.root_obs.withColumn(OBS, renamed), self.headers.withColumn(OBS, renamed), [*self.manifest["tiles"], fresh], keep | {"hidden": hidden}
        )
        self._index, self._local = None, None
        self._headers.clear()

    def validate(self) -> None:
        """obs and volumes pair one to one, tiles cover each volume, and the count is true."""
        obs, heads = self.root_obs.select(OBS), self.spark.read.parquet(f"{self.uri}/{self.manifest['volumes']}")
        if bad := frames.duplicates(obs, OBS).limit(5).collect():
            raise AlignmentError(f"obs ids occur twice: {[r[0] for r in bad]}")
        apart = obs.withColumn("a", F.lit(1)).join(heads.select(OBS).withColumn("b", F.lit(1)), OBS, "full_outer").where("a is null or b is null").limit(5).collect()
        if apart:
            raise AlignmentError(f"obs and volumes differ in {[r[0] for r in apart]}")
        if heads.count() != self.manifest["n_volumes"]:
            raise AlignmentError(f"the manifest says {self.manifest['n_volumes']} volumes")
        size = F.aggregate("shape", F.lit(1).cast("long"), lambda a, x: a * x)
        cover = self._root_tiles().groupBy(OBS).agg(F.sum(F.col("nx").cast("long") * F.col("ny") * F.col("nz") * F.col("nt")).alias("n")) if self.tile_paths else None
        if cover is not None and (bad := heads.select(OBS, size.alias("size")).join(cover, OBS, "left").where("n is null or n <> size").limit(5).collect()):
            raise AlignmentError(f"tiles do not cover {[r[0] for r in bad]}")

    # -- construction

    @classmethod
    def from_arrays(cls, spark: SparkSession, uri: str, volumes: Iterable[tuple[str, str, np.ndarray]], name: str = "volumes", obs: pd.DataFrame | None = None) -> VolumeSet:
        """A collection of (subject, obs_id, array); ``obs`` adds columns by obs_id."""
        from tomolake.operators.writers import VolumeSetWriter

        extra = {} if obs is None else {r[OBS]: {k: v for k, v in r.items() if k not in (OBS, SUBJECT)} for r in obs.to_dict("records")}
        with VolumeSetWriter(spark, uri, name) as w:
            for subject, obs_id, a in volumes:
                w.write_volume(a, obs_id, subject, extra.get(obs_id))
        return cls(spark, uri)

    @classmethod
    def from_table(cls, spark: SparkSession, uri: str, df: DataFrame, array: str, shape: Sequence[int], name: str = "volumes") -> VolumeSet:
        """A collection of a table's array column (C order): ``df`` has obs_subject_id and obs_id; its other columns become obs. No voxel passes the driver."""
        uri, shape = uri.rstrip("/"), voxels.check_shape(shape)
        if Store(spark).exists(f"{uri}/{MANIFEST}"):
            raise StorageError(f"{uri} holds a collection")
        if missing := [c for c in (SUBJECT, OBS, array) if c not in df.columns]:
            raise SchemaError(f"columns {missing} are missing")
        cfg = get_config().write.tile
        extents, kind = cfg.extents(shape), {"float": "<f4", "double": "<f8", "int": "<i4", "smallint": "<i2", "tinyint": "|i1", "bigint": "<i8"}.get(df.schema[array].dataType.elementType.simpleString())
        if kind is None:
            raise SchemaError(f"{array} is no array of numbers")

        def cut(pdfs):
            for pdf in pdfs:
                rows = [t for k, a in zip(pdf[OBS], pdf[array], strict=True) for t in voxels.tiles_of(k, np.asarray(a, kind).reshape(shape), extents)]
                yield pd.DataFrame(rows, columns=voxels.TILE_COLUMNS)

        one = lambda v: F.array(*(F.lit(int(x)) for x in v))
        heads = df.select(OBS, one(shape).alias("shape"), F.lit(kind).alias("dtype"), one(extents).alias("tile"), F.create_map(F.lit("tile_orientation"), F.lit(cfg.orientation.value)).alias("meta"))
        tiles = write_tiles(df.select(OBS, array).mapInPandas(cut, voxels.TILE_DDL), uri, int(np.prod(extents)) * np.dtype(kind).itemsize)
        commit(spark, uri, name, df.select(SUBJECT, OBS, *(c for c in df.columns if c not in (SUBJECT, OBS, array))), heads, [tiles])
        return cls(spark, uri)

    @classmethod
    def zeros(cls, spark: SparkSession, uri: str, subject: str, obs_id: str, shape: tuple[int, ...], dtype="float32", name: str = "volumes") -> VolumeSet:
        """A collection of one empty volume."""
        return cls.from_arrays(spark, uri, [(subject, obs_id, np.zeros(voxels.check_shape(shape), dtype))], name)

    @classmethod
    def from_niftis(
        cls, spark: SparkSession, uri: str, niftis: Sequence[tuple[str, str]], obs: pd.DataFrame | None = None, reorient: bool | str | None = None, validate_dimensions: bool = True,
        valid_subject_ids: Sequence[str] | None = None, name: str = "volumes",
    ) -> VolumeSet:
        """A collection of NIfTI files, (path, subject) pairs."""
        from tomolake.sources import ingest

        return ingest.build_collection(spark, uri, niftis, name, "nifti", reorient, validate_dimensions, obs, valid_subject_ids)

    @classmethod
    def from_dicoms(
        cls, spark: SparkSession, uri: str, dicoms: Sequence[tuple[str, str]], obs: pd.DataFrame | None = None, reorient: bool | str | None = None, validate_dimensions: bool = True,
        valid_subject_ids: Sequence[str] | None = None, name: str = "volumes",
    ) -> VolumeSet:
        """A collection of DICOM series, (directory, subject) pairs."""
        from tomolake.sources import ingest

        return ingest.build_collection(spark, uri, dicoms, name, "dicom", reorient, validate_dimensions, obs, valid_subject_ids)

    def export_niftis(self, directory: str, compression: bool = True) -> DataFrame:
        """(obs_id, path): every volume as a NIfTI file in a directory that all executors share; a volume is put together in one task."""
        import json

        heads = self.headers.select(OBS, "shape", F.col("meta").alias("_meta"))
        suffix = ".nii.gz" if compression else ".nii"

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            from tomolake.sources.nifti import write_nifti

            first = pdf.iloc[0]
            a = voxels.assemble(pdf.to_dict("records"), tuple((0, int(n)) for n in first["shape"]), first["dtype"])
            meta = dict(first["_meta"] or {})
            affine = np.array(json.loads(meta["affine_json"])) if "affine_json" in meta else np.eye(4)
            os.makedirs(directory, exist_ok=True)
            path = os.path.join(directory, f"{first[OBS]}{suffix}")
            a, slope, inter = stored(a, meta)
            write_nifti(path, a, affine, slope=slope, inter=inter, **codes(meta))
            return pd.DataFrame({OBS: [first[OBS]], "path": [path]})

        return self.tiles.join(heads, OBS).groupBy(OBS).applyInPandas(one, f"{OBS} string, path string")

    def to_dataset(self, patch_size=None, labels=None, transform=None):
        from tomolake.operators.samples import Loading, SampleConfig, SampleFrame

        cfg = SampleConfig(Loading.PATCH, tuple(patch_size)) if patch_size else SampleConfig(Loading.FULL_VOLUME)
        return SampleFrame([self], cfg, labels, transform)


def unique_obs_ids(pairs: Sequence[tuple[str, str]], collection: str, have: dict[str, int] | None = None) -> list[str]:
    """obs ids for (path, subject) pairs in order; later volumes of a subject are acquisitions 1, 2, ..."""
    seen, out = dict(have or {}), []
    for _, subject in pairs:
        out.append(generate_obs_id(subject, collection, seen.get(subject, 0)))
        seen[subject] = seen.get(subject, 0) + 1
    return out


class _ILoc:
    def __init__(self, vs: VolumeSet):
        self.vs = vs

    def __getitem__(self, key):
        places = positions(key, len(self.vs))
        if isinstance(key, (int, np.integer)):
            return VolumeRef(self.vs, self.vs.at(places).obs.first()[OBS] if self.vs._index is None else self.vs._index.get_key(places[0]))
        if twice := [k for k, n in Counter(places).items() if n > 1][:5]:
            raise ValueError(f"positions are not unique: {twice}")
        return self.vs.at(places)


class _Loc:
    def __init__(self, vs: VolumeSet):
        self.vs = vs

    def __getitem__(self, key):
        ids = [key] if isinstance(key, str) else list(key)
        have = self.vs._present(ids)
        if missing := [i for i in ids if i not in have][:5]:
            raise KeyError(missing if not isinstance(key, str) else key)
        return VolumeRef(self.vs, key) if isinstance(key, str) else self.vs._of_ids(ids)


