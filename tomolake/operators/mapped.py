"""Maps over volumes: lazy pipelines that run as one pass, and their results.

A function takes (volume array, obs row) and returns a value or (value, updates);
updates are new columns, and the next function sees them. Composed functions run in
one stage over a stream of sorted tiles, one volume at a time; filters act before it.
"""

from __future__ import annotations

import json
import pickle
import weakref
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomolake.config import get_config
from tomolake.errors import SchemaError, StorageError
from tomolake.functions.naming import adjacent_uri, result_summary
from tomolake.operators import frames, voxels
from tomolake.operators.frames import OBS, SUBJECT
from tomolake.operators.index import positions
from tomolake.operators.volumeset import HEADER_DDL, MANIFEST, VolumeSet, commit, unique_obs_ids, write_tiles
from tomolake.plans.predicate import predicate
from tomolake.storage import Store, snapshot

RESULT_DDL = f"{OBS} string, {SUBJECT} string, kind string, dtype string, shape array<int>, payload binary, updates binary"


def composed(fns: Sequence[Callable]) -> Callable:
    """(array, row) to (value, all updates): each function sees the value and the updated row of the one before."""

    def run(value, row: dict):
        updates: dict = {}
        for f in fns:
            out = f(value, row | updates)
            if isinstance(out, tuple) and len(out) == 2 and isinstance(out[1], dict):
                value, new = out
                updates |= new
            else:
                value = out
        return value, updates

    return run


def _packed(obs_id, subject, value, updates) -> tuple:
    if isinstance(value, np.ndarray):
        return obs_id, subject, "array", value.dtype.str, list(value.shape), np.ascontiguousarray(value).tobytes(), pickle.dumps(updates)
    return obs_id, subject, "object", None, None, pickle.dumps(value), pickle.dumps(updates)


def unpacked(row) -> object:
    if row["kind"] == "array":
        return np.frombuffer(row["payload"], np.dtype(row["dtype"])).reshape([int(x) for x in row["shape"]])
    return pickle.loads(row["payload"])


RESULT_COLUMNS = [c.split()[0] for c in RESULT_DDL.split(", ")]


def _row_json(vs: VolumeSet):
    return F.to_json(F.struct(*vs.obs.columns), {"ignoreNullFields": "false"})


def _with_rows(vs: VolumeSet) -> DataFrame:
    """Tiles, and for each volume one row more that holds its obs row (as JSON) and its number of axes."""
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in vs.tiles.schema.fields if f.name != OBS]
    obs = vs.obs.select(OBS, _row_json(vs).alias("_row")).join(vs.headers.select(OBS, F.size("shape").alias("_axes")), OBS)
    rows = obs.select(OBS, *empty, "_row", "_axes")
    return vs.tiles.withColumn("_row", F.lit(None).cast("string")).withColumn("_axes", F.lit(None).cast("int")).unionByName(rows)


def _volume(rows: list[dict]) -> tuple[np.ndarray, dict] | None:
    """(array, obs row) of a volume's rows as ``_with_rows`` gives them."""
    head = next((r for r in rows if r["_row"] is not None), None)
    tiles = [r for r in rows if r["_row"] is None]
    if head is None or not tiles:
        return None
    a = voxels.assembled(tiles)
    return a.reshape(a.shape[: head["_axes"]]), json.loads(head["_row"])


def _apply(vs: VolumeSet, fns: Sequence[Callable]) -> DataFrame:
    run = composed(fns)

    def each(batches):
        import pyarrow as pa

        for rows in voxels.streamed(batches):
            if (found := _volume(rows)) is not None:
                a, row = found
                value, updates = run(a, row)
                packed = _packed(rows[0][OBS], None if row[SUBJECT] is None else str(row[SUBJECT]), value, updates)
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(packed, _result_types(), strict=True)], names=RESULT_COLUMNS)

    return voxels.by_volume(_with_rows(vs)).mapInArrow(each, RESULT_DDL)


def _result_types() -> list:
    import pyarrow as pa

    return [pa.string()] * 4 + [pa.list_(pa.int32()), pa.binary(), pa.binary()]


@dataclass(frozen=True)
class LazySet:
    """Filters and functions to come; nothing runs before an extraction or ``write``.

    Positions are the root's: ``filter(p).head(n)`` is the first n of the root that pass p.
    """

    source: VolumeSet
    exprs: tuple[str, ...] = ()
    subjects: frozenset[str] | None = None
    views: tuple[VolumeSet, ...] = ()
    fns: tuple[Callable, ...] = ()

    def filter(self, expr: str) -> LazySet:
        predicate(expr, self.source.obs.columns)
        return replace(self, exprs=(*self.exprs, expr))

    def filter_subjects(self, ids: Sequence[str]) -> LazySet:
        return replace(self, subjects=frozenset(ids) if self.subjects is None else self.subjects & frozenset(ids))

    def _within(self, view: VolumeSet) -> LazySet:
        return replace(self, views=(*self.views, view))

    @property
    def iloc(self):
        from tomolake.operators.study import _Select

        return _Select(lambda key: self._within(self.source.at(positions(key, len(self.source)))))

    @property
    def loc(self):
        from tomolake.operators.study import _Select

        def pick(key):
            ids = [key] if isinstance(key, str) else list(key)
            have = self.source._present(ids)
            if missing := [i for i in ids if i not in have][:5]:
                raise KeyError(missing)
            return self._within(self.source._of_ids(ids))

        return _Select(pick)

    def head(self, n: int = 5) -> LazySet:
        return self._within(self.source.head(n))

    def tail(self, n: int = 5) -> LazySet:
        return self._within(self.source.tail(n))

    def sample(self, n: int = 5, seed: int | None = None) -> LazySet:
        """Of those that pass so far, in the order of their ids."""
        obs = self.to_obs()
        return self._within(self.source._view(frames.at_places(obs, frames.sample_positions(obs.count(), n, seed), OBS)))

    def map(self, fn: Callable) -> LazySet:
        return replace(self, fns=(*self.fns, fn))

    def resolve(self) -> VolumeSet:
        """All filters as one plan over ``obs``."""
        obs = self.source.obs
        for e in self.exprs:
            obs = obs.where(predicate(e, obs.columns))
        if self.subjects is not None:
            obs = frames.of_values(obs, SUBJECT, sorted(self.subjects))
        for view in self.views:
            obs = frames.keep_keys(obs, view.obs.select(OBS), OBS)
        return self.source._view(obs)

    def to_obs(self) -> DataFrame:
        return self.resolve().obs

    def count(self) -> int:
        return self.to_obs().count()

    __len__ = count

    def iter_volumes(self) -> Iterator:
        return iter(self.resolve())

    def to_numpy_stack(self) -> np.ndarray:
        return np.stack([v.to_numpy() for v in self.resolve()])

    def run(self) -> MappedSet:
        """The results, written next to nothing yet: cached when first used."""
        vs = self.resolve()
        return MappedSet(vs, _held(_apply(vs, self.fns)), self.fns)

    def write(self, uri: str | None = None, name: str | None = None) -> VolumeSet:
        vs = self.resolve()
        if not self.fns:
            return vs.write(uri, name)
        return MappedSet(vs, _apply(vs, self.fns), self.fns).write(uri, name)


def _release(jdf) -> None:
    try:
        jdf.unpersist(False)
    except Exception:  # the session may be gone
        pass


def _held(df: DataFrame) -> DataFrame:
    """``df`` cached until nothing on the driver refers to it any more."""
    df.persist()
    weakref.finalize(df, _release, df._jdf)
    return df


@dataclass(frozen=True)
class MappedSet:
    """Results of a map, one row a volume."""

    source: VolumeSet
    results: DataFrame
    fns: tuple[Callable, ...] = ()

    def map(self, fn: Callable) -> MappedSet:
        """Another function on the results; it sees the updates so far."""
        source = self.source
        rows = source.obs.select(OBS, _row_json(source).alias("_row"))

        def run(pdfs):
            for pdf in pdfs:
                out = []
                for r in pdf.to_dict("records"):
                    old = pickle.loads(r["updates"])
                    value, new = composed([fn])(unpacked(r), json.loads(r["_row"]) | old)
                    out.append(_packed(r[OBS], r[SUBJECT], value, old | new))
                yield pd.DataFrame(out, columns=RESULT_COLUMNS)

        return MappedSet(source, _held(self.results.join(rows, OBS).mapInPandas(run, RESULT_DDL)), (*self.fns, fn))

    def _rows(self) -> Iterator[dict]:
        return (r.asDict() for r in self.results.orderBy(SUBJECT, OBS).toLocalIterator())

    def __iter__(self) -> Iterator:
        return (unpacked(r) for r in self._rows())

    def __len__(self) -> int:
        return self.results.count()

    def __getitem__(self, k: int):
        return self.to_list()[k]

    def to_list(self) -> list:
        return list(self)

    def to_dataframe(self, columns: Sequence[str] | None = None) -> DataFrame:
        """Ids, the updates as typed columns, and ``result``: shape and type of arrays, else a short text."""
        kinds = {k: t for k, t in self.update_kinds().items() if k not in (SUBJECT, OBS, "result")}

        def run(pdfs):
            for pdf in pdfs:
                out = []
                for r in pdf.to_dict("records"):
                    u = pickle.loads(r["updates"])
                    out.append((r[SUBJECT], r[OBS], *(_cast(u.get(k), t) for k, t in kinds.items()), result_summary(unpacked(r))))
                yield pd.DataFrame(out, columns=[SUBJECT, OBS, *kinds, "result"], dtype=object)

        df = self.results.mapInPandas(run, ", ".join([f"{SUBJECT} string, {OBS} string", *(f"`{k}` {t}" for k, t in kinds.items()), "result string"])).orderBy(SUBJECT, OBS)
        return df.select(*columns) if columns else df

    def _repr_html_(self) -> str:
        return self.to_dataframe().limit(20).toPandas()._repr_html_()

    def update_kinds(self) -> dict[str, str]:
        """Type of every update column: bigint, double, boolean or string; one small row a type and column reaches the driver."""

        def run(pdfs):
            seen = set()
            for pdf in pdfs:
                for u in pdf["updates"]:
                    for k, v in pickle.loads(u).items():
                        kind = "boolean" if isinstance(v, (bool, np.bool_)) else "bigint" if isinstance(v, (int, np.integer)) else "double" if isinstance(v, (float, np.floating)) else "string"
                        seen.add((k, kind))
            yield pd.DataFrame(sorted(seen), columns=["k", "kind"])

        out: dict[str, str] = {}
        for r in self.results.select("updates").mapInPandas(run, "k string, kind string").distinct().orderBy("k", "kind").collect():
            old = out.get(r.k)
            out[r.k] = r.kind if old in (None, r.kind) else "double" if {old, r.kind} == {"bigint", "double"} else "string"
        return out

    def write(self, uri: str | None = None, name: str | None = None) -> VolumeSet:
        """Array results as a collection, updates as columns of its obs; tiles are cut inside the tasks."""
        spark, source = self.source.spark, self.source
        uri = (uri or adjacent_uri(source.uri, name, self.fns[-1] if self.fns else None)).rstrip("/")
        if Store(spark).exists(f"{uri}/{MANIFEST}"):
            raise StorageError(f"{uri} holds a collection")
        name = name or source.name
        staged = spark.read.parquet(f"{uri}/{snapshot(self.results, uri, 'results')}")
        if staged.where("kind <> 'array'").limit(1).collect():
            Store(spark).delete(f"{uri}/results")
            raise SchemaError("only array results can be written as volumes")
        pairs = [(r[OBS], r[SUBJECT]) for r in staged.select(OBS, SUBJECT).orderBy(SUBJECT, OBS).collect()]
        renamed = spark.createDataFrame([(old, new) for (old, _), new in zip(pairs, unique_obs_ids(pairs, name), strict=True)], f"{OBS} string, new_id string")
        keyed = staged.join(renamed, OBS)
        kinds = self.update_kinds() if pairs else {}
        cfg = get_config().write.tile

        def cut(pdfs):
            for pdf in pdfs:
                for r in pdf.to_dict("records"):
                    a = unpacked(r)
                    yield pd.DataFrame(list(voxels.tiles_of(r["new_id"], a, cfg.extents(voxels.check_shape(a.shape)))), columns=voxels.TILE_COLUMNS)

        def heads(pdfs):
            for pdf in pdfs:
                rows = [(r["new_id"], [int(x) for x in r["shape"]], r["dtype"], list(cfg.extents(tuple(int(x) for x in r["shape"]))), {"tile_orientation": cfg.orientation.value}) for r in pdf.to_dict("records")]
                yield pd.DataFrame(rows, columns=["obs_id", "shape", "dtype", "tile", "meta"])

        def updates(pdfs):
            for pdf in pdfs:
                rows = []
                for old, new, u in zip(pdf[OBS], pdf["new_id"], pdf["updates"], strict=True):
                    u = pickle.loads(u)
                    rows.append((old, new, *(_cast(u.get(k), t) for k, t in kinds.items())))
                yield pd.DataFrame(rows, columns=["_old", "_new", *(f"_u_{k}" for k in kinds)], dtype=object)

        tiles = write_tiles(keyed.mapInPandas(cut, voxels.TILE_DDL), uri)
        headers = keyed.select("new_id", "shape", "dtype").mapInPandas(heads, HEADER_DDL)
        ups = keyed.select(OBS, "new_id", "updates").mapInPandas(updates, ", ".join(["_old string", "_new string", *(f"`_u_{k}` {t}" for k, t in kinds.items())]))
        obs = source.obs.join(ups, F.col(OBS) == F.col("_old"))
        old = [c for c in source.obs.columns if c not in (OBS, SUBJECT)]
        cols = [F.col(SUBJECT), F.col("_new").alias(OBS), *(F.col(f"_u_{c}").alias(c) if c in kinds else F.col(c) for c in old), *(F.col(f"_u_{k}").alias(k) for k in kinds if k not in old)]
        commit(spark, uri, name, obs.select(*cols), headers, [tiles])
        Store(spark).delete(f"{uri}/results")
        return VolumeSet(spark, uri)


def _cast(value, kind: str):
    return None if value is None else {"bigint": int, "double": float, "boolean": bool, "string": str}[kind](value)


def run_batches(vs: VolumeSet, fn: Callable, batch_size: int = 8) -> MappedSet:
    """``fn`` on lists of (array, row), ``batch_size`` volumes in canonical order each; returns a value a volume."""
    if batch_size < 1:
        raise ValueError("batch_size is at least 1")
    placed = frames.with_position(vs.obs.select(OBS, SUBJECT), SUBJECT, OBS).select(OBS, "pos", F.floor(F.col("pos") / batch_size).alias("_batch"))

    def each(batches):
        import pyarrow as pa

        for rows in voxels.streamed(batches, "_batch"):
            of: dict[str, list[dict]] = {}
            for r in rows:
                of.setdefault(r[OBS], []).append(r)
            items = [(k, *found) for k, v in of.items() if (found := _volume(v)) is not None]
            out = fn([(a, row) for _, a, row in items])
            if len(out) != len(items):
                raise ValueError(f"a batch function returned {len(out)} results for {len(items)} volumes")
            packed = []
            for (k, _, row), v in zip(items, out, strict=True):
                value, updates = v if isinstance(v, tuple) and len(v) == 2 and isinstance(v[1], dict) else (v, {})
                packed.append(_packed(k, None if row[SUBJECT] is None else str(row[SUBJECT]), value, updates))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*packed, strict=True), _result_types(), strict=True)], names=RESULT_COLUMNS)

    tiles = _with_rows(vs).join(placed, OBS).repartition("_batch").sortWithinPartitions("_batch", "pos")
    return MappedSet(vs, _held(tiles.mapInArrow(each, RESULT_DDL)), (fn,))
