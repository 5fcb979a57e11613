"""Study: subjects (obs_meta) with named collections of volumes, and views of both."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomolake.errors import AlignmentError, SchemaError, StorageError, ViewError
from tomolake.operators import frames
from tomolake.operators.frames import OBS, SUBJECT
from tomolake.operators.index import KeyIndex, positions
from tomolake.operators.volume import VolumeRef
from tomolake.operators.volumeset import VolumeSet
from tomolake.plans.predicate import predicate
from tomolake.storage import Store, snapshot

MANIFEST = "_study.json"


def commit_study(spark: SparkSession, uri: str, meta: DataFrame, collections: dict[str, tuple[str, DataFrame]]) -> dict:
    """Recomputes ``obs_ids``, writes obs_meta as a snapshot and swaps the manifest. collections: name to (directory, obs)."""
    whole = None
    for _, obs in collections.values():
        whole = obs.select(SUBJECT, OBS) if whole is None else whole.unionByName(obs.select(SUBJECT, OBS))
    full = frames.with_obs_ids(meta, whole) if whole is not None else meta.drop("obs_ids").withColumn("obs_ids", F.lit("[]"))
    rel = snapshot(full, uri, "obs_meta")
    manifest = {"obs_meta": rel, "subject_count": spark.read.parquet(f"{uri}/{rel}").count(), "collections": {n: d for n, (d, _) in collections.items()}}
    Store(spark).write_json(f"{uri}/{MANIFEST}", manifest)
    return manifest


class Study:
    def __init__(self, spark: SparkSession, uri: str, meta: DataFrame | None = None, names: Sequence[str] | None = None, propagate: bool = True):
        self.spark, self.uri = spark, uri.rstrip("/")
        self.manifest = Store(spark).read_json(f"{self.uri}/{MANIFEST}")
        self._meta, self._names, self._propagate = meta, names, propagate
        self._index: KeyIndex | None = None

    # -- tables and properties

    @property
    def root_meta(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.uri}/{self.manifest['obs_meta']}")

    @property
    def obs_meta(self) -> DataFrame:
        return self.root_meta if self._meta is None else self._meta

    @property
    def is_view(self) -> bool:
        return self._meta is not None or self._names is not None

    @property
    def collection_names(self) -> list[str]:
        have = list(self.manifest["collections"])
        return have if self._names is None else [n for n in have if n in self._names]

    @property
    def n_collections(self) -> int:
        return len(self.collection_names)

    @property
    def index(self) -> KeyIndex:
        if self._index is None:
            self._index = KeyIndex((r[0] for r in self.obs_meta.select(SUBJECT).orderBy(SUBJECT).toLocalIterator()), SUBJECT)
        return self._index

    @property
    def obs_subject_ids(self) -> list[str]:
        return self.index.to_list()

    def __len__(self) -> int:
        return self.obs_meta.count() if self._meta is not None else self.manifest["subject_count"]

    def __iter__(self) -> Iterator[str]:
        return iter(self.collection_names)

    def __contains__(self, name: str) -> bool:
        return name in self.collection_names

    def __repr__(self) -> str:
        return f"Study({len(self)} subjects, collections={self.collection_names}{', view' if self.is_view else ''})"

    def collection(self, name: str) -> VolumeSet:
        """A collection; on a view of subjects, only their volumes (``propagate=False`` gives all)."""
        if name not in self.collection_names:
            raise KeyError(name)
        root = VolumeSet(self.spark, f"{self.uri}/{self.manifest['collections'][name]}" if "://" not in self.manifest["collections"][name] and not self.manifest["collections"][name].startswith("/") else self.manifest["collections"][name], name)
        if self._meta is None or not self._propagate:
            return root
        return VolumeSet(self.spark, root.uri, name, frames.keep_keys(root.root_obs, self._meta.select(SUBJECT), SUBJECT))

    def __getattr__(self, name: str):
        if name.startswith("_") or name == "manifest":
            raise AttributeError(name)
        if name in self.collection_names:
            return self.collection(name)
        raise AttributeError(name)

    @property
    def all_obs(self) -> DataFrame:
        """(obs_subject_id, obs_id, collection) of all collections."""
        parts = [self.collection(n).obs.select(SUBJECT, OBS, F.lit(n).alias("collection")) for n in self.collection_names]
        if not parts:
            return self.spark.createDataFrame([], f"{SUBJECT} string, {OBS} string, collection string")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    @property
    def all_obs_ids(self) -> list[str]:
        return [r[0] for r in self.all_obs.select(OBS).orderBy(OBS).toLocalIterator()]

    def get_volume(self, obs_id: str) -> VolumeRef:
        row = self.all_obs.where(F.col(OBS) == obs_id).limit(1).collect()
        if not row:
            raise KeyError(obs_id)
        return VolumeRef(self.collection(row[0].collection), obs_id)

    def get_obs_row_by_obs_subject_id(self, subject: str) -> pd.DataFrame:
        return self.obs_meta.where(F.col(SUBJECT) == subject).toPandas()

    # -- selection

    def _view(self, meta: DataFrame | None = None, names: Sequence[str] | None = None) -> Study:
        return Study(self.spark, self.uri, self._meta if meta is None else meta, self._names if names is None else names, self._propagate)

    def _of_ids(self, ids: Sequence[str]) -> Study:
        KeyIndex(ids)  # repeated subjects are an error
        return self._view(frames.of_values(self.obs_meta, SUBJECT, ids))

    def _at(self, places: Sequence[int]) -> Study:
        KeyIndex(map(str, places))  # so are repeated places
        return self._view(frames.at_places(self.obs_meta, places, SUBJECT))

    def filter(self, expr: str) -> Study:
        return self._view(self.obs_meta.where(predicate(expr, self.obs_meta.columns)))

    @property
    def iloc(self) -> _Select:
        return _Select(lambda key: self._at(positions(key, len(self))))

    @property
    def loc(self) -> _Select:
        def by_label(key):
            ids = [key] if isinstance(key, str) else list(key)
            view = self._of_ids(ids)
            have = set(self.index) if self._index is not None else {r[0] for r in view.obs_meta.select(SUBJECT).collect()}
            if missing := [i for i in ids if i not in have][:5]:
                raise KeyError(missing)
            return view

        return _Select(by_label)

    def __getitem__(self, key):
        if isinstance(key, str):
            return self.loc[key]
        if isinstance(key, list) and key and all(isinstance(k, str) for k in key):
            return self.loc[key]
        return self.iloc[key]

    def sel(self, subject: str | Sequence[str]) -> Study:
        return self.loc[subject]

    def head(self, n: int = 5) -> Study:
        return self._view(frames.head(self.obs_meta, n, SUBJECT))

    def tail(self, n: int = 5) -> Study:
        return self._view(frames.tail(self.obs_meta, n, SUBJECT))

    def sample(self, n: int = 5, seed: int | None = None) -> Study:
        return self._at(frames.sample_positions(len(self), n, seed))

    def select_collections(self, names: Sequence[str]) -> Study:
        if missing := [n for n in names if n not in self.collection_names]:
            raise KeyError(missing)
        return self._view(names=list(names))

    def copy(self) -> Study:
        return self._view()

    # -- summary and checks

    def describe(self) -> dict:
        """Counts, shapes, and the value counts of columns with at most ten values."""
        meta = self.obs_meta.drop("obs_ids")
        labels = frames.label_columns(meta, (SUBJECT,))
        out: dict = {"subjects": len(self), "collections": {}, "labels": {c: {} for c in labels}}
        for n in self.collection_names:
            c = self.collection(n)
            out["collections"][n] = {"volumes": len(c), "shape": c.shape}
        if labels:
            for r in frames.value_counts(meta, *labels).orderBy("label", F.desc("n"), "value").collect():
                out["labels"][r.label][r.value] = r.n
        return out

    def validate(self) -> None:
        if self.root_meta.count() != self.manifest["subject_count"]:
            raise AlignmentError(f"the manifest says {self.manifest['subject_count']} subjects")
        root = Study(self.spark, self.uri)
        obs = {n: root.collection(n).obs for n in root.collection_names}
        if bad := frames.study_faults(self.root_meta, obs).orderBy("fault", "key").limit(5).collect():
            raise AlignmentError("; ".join(f"{r.fault}: {r['key']}" for r in bad))
        for n in root.collection_names:
            root.collection(n).validate()

    # -- persistence and change

    def _check_not_view(self, what: str) -> None:
        if self.is_view:
            raise ViewError(f"a view cannot {what}; write it first")

    def write(self, uri: str) -> Study:
        """The view as a study of its own; collections without volumes are left out."""
        uri = uri.rstrip("/")
        if Store(self.spark).exists(f"{uri}/{MANIFEST}"):
            raise StorageError(f"{uri} holds a study")
        done = {}
        for n in self.collection_names:
            part = VolumeSet(self.spark, self.collection(n).uri, n, frames.keep_keys(self.collection(n).root_obs, self.obs_meta.select(SUBJECT), SUBJECT))
            if len(part):
                rel = f"collections/{n}-{uuid.uuid4().hex[:8]}"
                done[n] = (rel, part.write(f"{uri}/{rel}", n).root_obs)
        commit_study(self.spark, uri, self.obs_meta, done)
        return Study(self.spark, uri)

    def _recommit(self, meta: DataFrame, dirs: dict[str, str]) -> None:
        obs = {n: (d, VolumeSet(self.spark, d if d.startswith("/") or "://" in d else f"{self.uri}/{d}", n).root_obs) for n, d in dirs.items()}
        self.manifest = commit_study(self.spark, self.uri, meta, obs)
        self._index = None

    def add_collection(self, name: str, source: VolumeSet) -> Study:
        """Registers a collection: linked when it lies below this study, else copied."""
        self._check_not_view("gain a collection")
        if name in self.manifest["collections"]:
            raise ValueError(f"collection {name!r} exists")
        unknown = frames.drop_keys(source.obs.select(SUBJECT), self.root_meta.select(SUBJECT), SUBJECT).limit(5).collect()
        if unknown:
            raise AlignmentError(f"subjects are not in obs_meta: {sorted({r[0] for r in unknown})}")
        used = frames.keep_keys(source.obs.select(OBS), self.all_obs.select(OBS), OBS).limit(5).collect()
        if used:
            raise AlignmentError(f"obs ids are in use: {[r[0] for r in used]}")
        if not source.is_view and source.uri.startswith(f"{self.uri}/collections/"):
            rel = source.uri[len(self.uri) + 1 :]
        else:
            rel = f"collections/{name}-{uuid.uuid4().hex[:8]}"
            source.write(f"{self.uri}/{rel}", name)
        self._recommit(self.root_meta, self.manifest["collections"] | {name: rel})
        return self

    def rename_collection(self, old: str, new: str) -> Study:
        self._check_not_view("rename a collection")
        if old not in self.manifest["collections"]:
            raise KeyError(old)
        if new in self.manifest["collections"]:
            raise ValueError(f"collection {new!r} exists")
        self.manifest["collections"] = {(new if n == old else n): d for n, d in self.manifest["collections"].items()}
        Store(self.spark).write_json(f"{self.uri}/{MANIFEST}", self.manifest)
        return self

    def append(self, images: dict[str, object], obs_meta: pd.DataFrame | DataFrame | None = None, reorient: bool | None = None, format_hint: str | None = None) -> Study:
        """Ingests more images by collection; new subjects need rows of ``obs_meta``; new names become collections."""
        from tomolake.sources import ingest

        self._check_not_view("be appended to")
        resolved = {n: ingest.resolve(s, format_hint) for n, s in images.items()}
        have = self.root_meta
        new = None
        if obs_meta is not None:
            new = self.spark.createDataFrame(obs_meta) if isinstance(obs_meta, pd.DataFrame) else obs_meta
            if SUBJECT not in new.columns:
                raise SchemaError(f"{SUBJECT} is missing")
            new = frames.drop_keys(new, have.select(SUBJECT), SUBJECT)
        known = have.select(SUBJECT) if new is None else have.select(SUBJECT).unionByName(new.select(SUBJECT))
        _check_known(known, {s for pairs, _ in resolved.values() for _, s in pairs})
        dirs = dict(self.manifest["collections"])
        for n, (pairs, fmt) in resolved.items():
            if n in dirs:
                self.collection(n).append(**{"niftis" if fmt == "nifti" else "dicoms": pairs}, reorient=reorient)
            else:
                dirs[n] = f"collections/{n}-{uuid.uuid4().hex[:8]}"
                ingest.build_collection(self.spark, f"{self.uri}/{dirs[n]}", pairs, n, fmt, reorient)
        self._recommit(frames.append(have, new) if new is not None else have, dirs)
        return self

    # -- construction

    @classmethod
    def from_images(
        cls, spark: SparkSession, uri: str, images: dict[str, object], obs_meta: pd.DataFrame | DataFrame | None = None, validate_alignment: bool = False,
        reorient: bool | None = None, format_hint: str | None = None,
    ) -> Study:
        from tomolake.sources import ingest

        uri = uri.rstrip("/")
        if Store(spark).exists(f"{uri}/{MANIFEST}"):
            raise StorageError(f"{uri} holds a study")
        if not images:
            raise ValueError("images is empty")
        resolved = {n: ingest.resolve(s, format_hint) for n, s in images.items()}
        by = {n: {s for _, s in pairs} for n, (pairs, _) in resolved.items()}
        everyone = sorted(set().union(*by.values()))
        if validate_alignment and (apart := {n: sorted(set(everyone) - s)[:5] for n, s in by.items() if s != set(everyone)}):
            raise AlignmentError(f"subjects are missing: {apart}")
        if obs_meta is None:
            meta = spark.createDataFrame([(s,) for s in everyone], f"{SUBJECT} string")
        else:
            meta = spark.createDataFrame(obs_meta) if isinstance(obs_meta, pd.DataFrame) else obs_meta
            if SUBJECT not in meta.columns:
                raise SchemaError(f"{SUBJECT} is missing")
            _check_known(meta, everyone)
        done = {}
        for n, (pairs, fmt) in resolved.items():
            rel = f"collections/{n}-{uuid.uuid4().hex[:8]}"
            done[n] = (rel, ingest.build_collection(spark, f"{uri}/{rel}", pairs, n, fmt, reorient, check_shapes=fmt == "dicom").root_obs)
        commit_study(spark, uri, meta, done)
        return cls(spark, uri)

    @classmethod
    def from_collections(cls, spark: SparkSession, uri: str, collections: dict[str, VolumeSet], obs_meta: pd.DataFrame | DataFrame | None = None) -> Study:
        """A study of existing collections: linked when they lie below ``uri``/collections, else copied."""
        uri = uri.rstrip("/")
        done, whole = {}, None
        for n, c in collections.items():
            if not c.is_view and c.uri.startswith(f"{uri}/collections/"):
                done[n] = (c.uri[len(uri) + 1 :], c.root_obs)
            else:
                rel = f"collections/{n}-{uuid.uuid4().hex[:8]}"
                done[n] = (rel, c.write(f"{uri}/{rel}", n).root_obs)
            s = done[n][1].select(SUBJECT)
            whole = s if whole is None else whole.unionByName(s)
        if obs_meta is None:
            meta = whole.distinct()
        else:
            meta = spark.createDataFrame(obs_meta) if isinstance(obs_meta, pd.DataFrame) else obs_meta
            if bad := frames.drop_keys(whole, meta.select(SUBJECT), SUBJECT).limit(5).collect():
                raise AlignmentError(f"obs_meta has no rows for {sorted({r[0] for r in bad})}")
        commit_study(spark, uri, meta, done)
        return cls(spark, uri)


def _check_known(meta: DataFrame, subjects) -> None:
    """Every subject has a row in ``meta``: an anti-join, so that the table stays where it is."""
    if not subjects:
        return
    wanted = meta.sparkSession.createDataFrame([(s,) for s in sorted(subjects)], f"{SUBJECT} string")
    if missing := frames.drop_keys(wanted, meta.select(SUBJECT), SUBJECT).orderBy(SUBJECT).limit(5).collect():
        raise AlignmentError(f"obs_meta has no rows for {[r[0] for r in missing]}")


class _Select:
    def __init__(self, pick):
        self.pick = pick

    def __getitem__(self, key):
        if isinstance(key, np.ndarray):
            key = key.tolist()
        return self.pick(key)
