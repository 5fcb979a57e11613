"""Sample frames for training: volumes, patches, slices and image-mask pairs with reproducible draws.

Draws come from numpy's ``default_rng`` seeded by (seed, epoch, idx), in the task
that cuts the sample, so a sample does not depend on how rows are dealt out.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from enum import Enum

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomolake.config import get_config
from tomolake.errors import AlignmentError, ConfigurationError, ShapeError
from tomolake.operators import frames, voxels
from tomolake.operators.frames import OBS, SUBJECT
from tomolake.operators.volumeset import VolumeSet


class Loading(Enum):
    FULL_VOLUME = "full_volume"
    PATCH = "patch"
    SLICE_2D = "slice_2d"


@dataclass(frozen=True)
class SampleConfig:
    mode: Loading = Loading.FULL_VOLUME
    patch_size: tuple[int, int, int] | None = None
    patches_per_volume: int = 1
    orientation: str = "axial"
    value_filter: str | None = None
    label_column: str | None = None
    seed: int = 0

    def __post_init__(self):
        if self.mode is Loading.PATCH and self.patch_size is None:
            raise ConfigurationError("patches need a patch_size")
        if self.patches_per_volume < 1:
            raise ConfigurationError("patches_per_volume is at least 1")
        if self.orientation not in voxels.AXES:
            raise ConfigurationError(f"unknown orientation {self.orientation!r}")


def patch_start(shape: Sequence[int], patch: Sequence[int], idx: int, seed: int = 0, epoch: int = 0) -> list[int]:
    """A patch's first corner: uniform where it fits, 0 along an axis that is too short. Seed and epoch 0 draw from ``default_rng(idx)``."""
    rng = np.random.default_rng(idx if not seed and not epoch else [seed, epoch, idx])
    return [int(rng.integers(0, max(0, s - p) + 1)) for s, p in zip(shape, patch, strict=False)]


def guided_start(shape: Sequence[int], patch: Sequence[int], coords: np.ndarray, idx: int, seed: int = 0, epoch: int = 0) -> list[int]:
    """A corner whose patch is centred on a drawn foreground voxel, moved inside the volume; uniform without foreground."""
    if not len(coords):
        return patch_start(shape, patch, idx, seed, epoch)
    rng = np.random.default_rng(idx if not seed and not epoch else [seed, epoch, idx])
    centre = coords[int(rng.integers(len(coords)))]
    return [int(min(max(0, c - p // 2), max(0, s - p))) for c, s, p in zip(centre, shape, patch, strict=False)]


def pair_start(shape: Sequence[int], patch: Sequence[int], coords: Callable[[], np.ndarray], idx: int, prob: float, seed: int, epoch: int) -> list[int]:
    """A pair's corner: guided by the foreground (asked for only then) with probability ``prob``, else uniform."""
    guided = prob > 0 and np.random.default_rng([seed, epoch, idx, 1]).random() < prob
    return guided_start(shape, patch, coords(), idx, seed, epoch) if guided else patch_start(shape, patch, idx, seed, epoch)


def check_alignment(sets: Sequence[VolumeSet]) -> None:
    """All collections have the same subjects, each as often."""
    first = sets[0].obs.groupBy(SUBJECT).count()
    for other in sets[1:]:
        counts = other.obs.groupBy(SUBJECT).agg(F.count("*").alias("other"))
        bad = first.join(counts, SUBJECT, "full_outer").where("not (count <=> other)").limit(5).collect()
        if bad:
            raise AlignmentError(f"collections differ in subjects {[r[SUBJECT] for r in bad]}")


def volume_shapes(vs: VolumeSet) -> DataFrame:
    return vs.headers.groupBy("shape").agg(F.count("*").alias("n"))


def check_shapes(vs: VolumeSet, patch: Sequence[int] | None = None) -> None:
    """One shape for all; with a patch size, shapes may differ but must hold the patch."""
    if patch is not None:
        small = F.lit(False)
        for axis, p in enumerate(patch):
            small = small | (F.get("shape", F.lit(axis)) < int(p))
        if bad := vs.headers.where(small).select("shape").distinct().orderBy("shape").limit(5).collect():
            raise ShapeError(f"patch {tuple(patch)} does not fit in {[list(r['shape']) for r in bad]}")
    elif len(shapes := volume_shapes(vs).orderBy("shape").limit(5).collect()) > 1:
        raise ShapeError(f"volumes differ in shape: {[list(r['shape']) for r in shapes]}")


def label_frame(vs: VolumeSet, labels) -> DataFrame | None:
    """(obs_id, label) from an obs column's name, a DataFrame (first column that is no id), a dict or a function of obs_id; unmatched ids are left out."""
    spark = vs.spark
    if labels is None:
        return None
    if isinstance(labels, str):
        return vs.obs.select(OBS, F.col(labels).alias("label")).where("label is not null")
    if isinstance(labels, pd.DataFrame):
        pdf = labels.reset_index() if OBS not in labels.columns else labels
        pdf = pdf.rename(columns={pdf.columns[0]: OBS}) if OBS not in pdf.columns else pdf
        column = next(c for c in pdf.columns if c not in (OBS, SUBJECT))
        labels = spark.createDataFrame(pdf[[OBS, column]].rename(columns={column: "label"}))
    elif isinstance(labels, dict):
        labels = spark.createDataFrame([(str(k), v) for k, v in labels.items()], [OBS, "label"])
    elif callable(labels):
        return _called(vs, labels)
    elif isinstance(labels, DataFrame):
        column = next(c for c in labels.columns if c not in (OBS, SUBJECT))
        labels = labels.select(OBS, F.col(column).alias("label"))
    return vs.obs.select(OBS).join(labels, OBS).select(OBS, "label").where("label is not null")


def _called(vs: VolumeSet, fn: Callable) -> DataFrame:
    """(obs_id, label) of a function of obs_id, applied in the tasks; its type is that of the first label in key order."""
    first = vs.obs.select(OBS).orderBy(OBS).first()
    kind = "string" if first is None else {bool: "boolean", int: "bigint", float: "double"}.get(type(fn(first[OBS])), "string")

    def run(pdfs):
        for pdf in pdfs:
            yield pd.DataFrame({OBS: pdf[OBS], "label": pd.Series([fn(k) for k in pdf[OBS]], dtype=object)})

    return vs.obs.select(OBS).mapInPandas(run, f"{OBS} string, label {kind}").where("label is not null")


def cut_boxes(vs: VolumeSet, boxes: DataFrame) -> DataFrame:
    """(idx, obs_id, shape, dtype, voxels) of every box (idx, obs_id, x0 to z1).

    A box names the tiles that it meets, so boxes and tiles join on the tile's number, and only those tiles are put together.
    """
    heads = vs.headers.select(OBS, F.col("tile").alias("_tile"))
    asked = boxes.select("idx", OBS, "x0", "y0", "z0", "x1", "y1", "z1").join(heads, OBS)
    for k, a in enumerate("xyz"):
        asked = asked.where(F.col(f"{a}1") > F.col(f"{a}0")).withColumn(f"c{a}", F.explode(F.expr(f"sequence(cast({a}0 div _tile[{k}] as int), cast(({a}1 - 1) div _tile[{k}] as int))")))
    tiles = vs.tiles.withColumnsRenamed({"x0": "tx", "y0": "ty", "z0": "tz"})
    pairs = asked.drop("_tile").join(tiles, [OBS, "cx", "cy", "cz"])

    def each(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.string(), pa.list_(pa.int32()), pa.string(), pa.binary()]
        out: list[tuple] = []
        size = 0
        for rows in voxels.streamed(batches, "idx"):
            r = rows[0]
            box = tuple((r[f"{a}0"], r[f"{a}1"]) for a in "xyz") + ((0, max(x["t0"] + x["nt"] for x in rows)),)
            a = voxels.assemble([x | {"x0": x["tx"], "y0": x["ty"], "z0": x["tz"]} for x in rows], box, r["dtype"])
            a = a[..., 0] if a.shape[3] == 1 else a
            out.append((r["idx"], r[OBS], list(a.shape), a.dtype.str, a.tobytes()))
            size += a.nbytes
            if size > 16 << 20 or len(out) == 1024:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["idx", OBS, "shape", "dtype", "voxels"])
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["idx", OBS, "shape", "dtype", "voxels"])

    dealt = pairs.repartition("idx").sortWithinPartitions("idx")  # a task holds the tiles of one sample at a time
    return dealt.mapInArrow(each, f"idx long, {OBS} string, shape array<int>, dtype string, voxels binary")


def _placed(vs: VolumeSet) -> DataFrame:
    """(pos, obs_id) in canonical order: aligned collections pair by position."""
    return frames.with_position(vs.obs.select(OBS, SUBJECT), SUBJECT, OBS).select("pos", OBS)


class SampleFrame:
    """Samples of one or more aligned collections (channels), by index or as a DataFrame of cut samples."""

    def __init__(self, sets: Sequence[VolumeSet], config: SampleConfig = SampleConfig(), labels=None, transform: Callable | None = None):
        if not sets:
            raise ValueError("no collections")
        self.sets = [s.filter(config.value_filter) if config.value_filter and i == 0 else s for i, s in enumerate(sets)]
        self.config, self.transform = config, transform
        if len(sets) > 1:
            if config.value_filter:
                keep = self.sets[0].obs.select(SUBJECT).distinct()
                self.sets[1:] = [s._view(frames.keep_keys(s.obs, keep, SUBJECT)) for s in self.sets[1:]]
            check_alignment(self.sets)
        for s in self.sets:
            check_shapes(s, config.patch_size if config.mode is Loading.PATCH else None)
        self.ids = [s.index.to_list() for s in self.sets]
        frame = label_frame(self.sets[0], labels if labels is not None else config.label_column)
        self.labels = None if frame is None else {r[0]: r[1] for r in frame.toLocalIterator()}
        self._epoch = 0
        self._shape = self.sets[0].shape

    def set_epoch(self, epoch: int) -> None:
        self._epoch = epoch

    @property
    def per_volume(self) -> int:
        if self.config.mode is Loading.PATCH:
            return self.config.patches_per_volume
        return self._shape[voxels.AXES[self.config.orientation]] if self.config.mode is Loading.SLICE_2D else 1

    def __len__(self) -> int:
        return len(self.ids[0]) * self.per_volume

    def _box(self, shape: Sequence[int], idx: int) -> voxels.Box:
        c = self.config
        box = [(0, n) for n in shape[:3]]
        if c.mode is Loading.PATCH:
            start = patch_start(shape[:3], c.patch_size, idx, c.seed, self._epoch)
            box = [(a, min(a + p, n)) for a, p, n in zip(start, c.patch_size, shape, strict=False)]
        elif c.mode is Loading.SLICE_2D:
            k = idx % self.per_volume
            box[voxels.AXES[c.orientation]] = (k, k + 1)
        return tuple(box) + tuple((0, n) for n in shape[3:])

    def __getitem__(self, idx: int) -> dict:
        if not 0 <= idx < len(self):
            raise IndexError(idx)
        v = idx // self.per_volume
        refs = [s.volume(ids[v]) for s, ids in zip(self.sets, self.ids, strict=True)]
        box = self._box(refs[0].shape, idx)
        image = np.stack([r.box(box) for r in refs])
        if self.config.mode is Loading.SLICE_2D:
            image = image.squeeze(axis=1 + voxels.AXES[self.config.orientation])
        out = {"image": image, "idx": v, "obs_id": self.ids[0][v]}
        if self.config.mode is Loading.PATCH:
            out |= {"patch_idx": idx % self.per_volume, "patch_start": [a for a, _ in box[:3]]}
        if self.config.mode is Loading.SLICE_2D:
            out["slice_idx"] = idx % self.per_volume
        if self.labels is not None and self.ids[0][v] in self.labels:
            out["label"] = self.labels[self.ids[0][v]]
        return self.transform(out) if self.transform else out

    def __iter__(self) -> Iterator[dict]:
        return (self[k] for k in range(len(self)))

    def plan(self) -> DataFrame:
        """(idx, obs_id, x0, y0, z0, x1, y1, z1): the box of every sample, made in the tasks."""
        cfg, epoch, per = self.config, self._epoch, self.per_volume
        ids = frames.with_position(self.sets[0].obs.select(OBS, SUBJECT), SUBJECT, OBS).join(self.sets[0].headers.select(OBS, "shape"), OBS)
        rows = ids.select(OBS, "shape", F.explode(F.sequence(F.col("pos") * per, F.col("pos") * per + (per - 1))).alias("idx"))
        axis = voxels.AXES[cfg.orientation]

        def run(pdfs):
            for pdf in pdfs:
                out = []
                for o, s, i in zip(pdf[OBS], pdf["shape"], pdf["idx"], strict=True):
                    lo, hi = [0, 0, 0], [int(n) for n in s[:3]]
                    if cfg.mode is Loading.PATCH:
                        lo = patch_start(hi, cfg.patch_size, int(i), cfg.seed, epoch)
                        hi = [min(a + p, n) for a, p, n in zip(lo, cfg.patch_size, hi, strict=True)]
                    elif cfg.mode is Loading.SLICE_2D:
                        lo[axis], hi[axis] = int(i) % per, int(i) % per + 1
                    out.append((int(i), o, *lo, *hi))
                yield pd.DataFrame(out, columns=["idx", OBS, "x0", "y0", "z0", "x1", "y1", "z1"])

        return rows.mapInPandas(run, f"idx long, {OBS} string, x0 int, y0 int, z0 int, x1 int, y1 int, z1 int")

    def cut(self) -> DataFrame:
        """(idx, obs_id, shape, dtype, voxels) of every sample; several collections are channels, the first axis of the shape, and must have one dtype."""
        boxes = self.plan()
        first = cut_boxes(self.sets[0], boxes)
        if len(self.sets) == 1:
            return first
        placed = boxes.withColumn("pos", F.floor(F.col("idx") / self.per_volume)).drop(OBS)
        parts, same = [F.col("voxels")], F.lit(True)
        for k, s in enumerate(self.sets[1:]):
            other = cut_boxes(s, placed.join(_placed(s), "pos")).select("idx", F.col("shape").alias(f"_s{k}"), F.col("dtype").alias(f"_d{k}"), F.col("voxels").alias(f"_v{k}"))
            first = first.join(other, "idx")
            parts.append(F.col(f"_v{k}"))
            same = same & (F.col(f"_d{k}") == F.col("dtype")) & (F.col(f"_s{k}") == F.col("shape"))
        stacked = F.when(same, F.concat(*parts)).otherwise(F.raise_error(F.concat(F.lit("channels differ in shape or type: "), F.col(OBS))).cast("binary"))
        return first.select("idx", OBS, F.concat(F.array(F.lit(len(self.sets))), F.col("shape")).alias("shape"), "dtype", stacked.alias("voxels"))


class SegmentationFrame:
    """Image-mask pairs of two aligned collections; patches may follow the foreground of the mask."""

    def __init__(self, image: VolumeSet, mask: VolumeSet, patch_size: Sequence[int] | None = None, patches_per_volume: int = 1, foreground_prob: float = 0.0, seed: int = 0, transform: Callable | None = None):
        if patches_per_volume < 1:
            raise ConfigurationError("patches_per_volume is at least 1")
        if not 0 <= foreground_prob <= 1:
            raise ConfigurationError("foreground_prob is between 0 and 1")
        check_alignment([image, mask])
        if patch_size is not None:
            check_shapes(image, patch_size)
        else:
            check_shapes(image)
        self.image, self.mask, self.patch, self.per = image, mask, tuple(patch_size) if patch_size else None, patches_per_volume if patch_size else 1
        self.prob, self.seed, self.transform, self._epoch = foreground_prob, seed, transform, 0
        self.ids = list(zip(image.index.to_list(), mask.index.to_list(), strict=True))
        self._coords: dict[str, np.ndarray] = {}
        self._held = 0

    def set_epoch(self, epoch: int) -> None:
        self._epoch = epoch

    def __len__(self) -> int:
        return len(self.ids) * self.per

    def _foreground(self, mask_id: str) -> np.ndarray:
        if mask_id not in self._coords:
            found = np.argwhere(self.mask.volume(mask_id).to_numpy() != 0)[:, :3].astype(np.int32)
            while self._coords and self._held + found.nbytes > get_config().read.memory_mb << 20:
                self._held -= self._coords.pop(next(iter(self._coords))).nbytes
            self._coords[mask_id] = found
            self._held += found.nbytes
        return self._coords[mask_id]

    def __getitem__(self, idx: int) -> dict:
        if not 0 <= idx < len(self):
            raise IndexError(idx)
        image_id, mask_id = self.ids[idx // self.per]
        a, b = self.image.volume(image_id), self.mask.volume(mask_id)
        if a.shape[:3] != b.shape[:3]:
            raise ShapeError(f"{image_id} and {mask_id} differ in shape")
        box = tuple((0, n) for n in a.shape[:3])
        out = {"obs_id": image_id, "mask_obs_id": mask_id, "idx": idx // self.per}
        if self.patch:
            start = pair_start(a.shape[:3], self.patch, lambda: self._foreground(mask_id), idx, self.prob, self.seed, self._epoch)
            box = tuple((s, min(s + p, n)) for s, p, n in zip(start, self.patch, a.shape, strict=False))
            out |= {"patch_idx": idx % self.per, "patch_start": start}
        out |= {"image": a.box(box + tuple((0, n) for n in a.shape[3:]))[None], "mask": b.box(box + tuple((0, n) for n in b.shape[3:]))[None]}
        return self.transform(out) if self.transform else out

    def __iter__(self) -> Iterator[dict]:
        return (self[k] for k in range(len(self)))

    def plan(self) -> DataFrame:
        """(idx, pos, obs_id, mask_obs_id, x0 to z1): the box of every pair; a mask whose foreground guides patches is put together in one task."""
        patch, per, prob, seed, epoch = self.patch, self.per, self.prob, self.seed, self._epoch
        names = ["idx", "mask_obs_id", "x0", "y0", "z0", "x1", "y1", "z1"]
        heads = _placed(self.mask).join(self.mask.headers.select(OBS, "shape"), OBS).select(OBS, "pos", "shape")
        guided = patch is not None and prob > 0
        if guided:
            empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.mask.tiles.schema.fields if f.name != OBS]
            tiles = self.mask.tiles.withColumn("pos", F.lit(None).cast("long")).withColumn("shape", F.lit(None).cast("array<int>"))
            rows = voxels.by_volume(tiles.unionByName(heads.select(OBS, *empty, "pos", "shape")))
        else:
            rows = heads

        def boxes(mask_id: str, pos: int, shape, coords):
            for idx in range(pos * per, pos * per + per):
                lo, hi = [0, 0, 0], [int(n) for n in shape[:3]]
                if patch is not None:
                    lo = pair_start(hi, patch, coords, idx, prob, seed, epoch)
                    hi = [min(a + p, n) for a, p, n in zip(lo, patch, hi, strict=True)]
                yield (idx, mask_id, *lo, *hi)

        def run(batches):
            import pyarrow as pa

            if guided:
                held = voxels.streamed(batches)
            else:
                held = ([r] for batch in batches for r in batch.to_pylist())
            for some in held:
                head = next((r for r in some if r["shape"] is not None), None)
                if head is None:
                    continue
                out = list(boxes(head[OBS], head["pos"], head["shape"], lambda some=some: np.argwhere(voxels.assembled([r for r in some if r["shape"] is None]) != 0)[:, :3]))
                kinds = [pa.int64(), pa.string(), *[pa.int32()] * 6]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        made = rows.mapInArrow(run, "idx long, mask_obs_id string, x0 int, y0 int, z0 int, x1 int, y1 int, z1 int").withColumn("pos", F.floor(F.col("idx") / per))
        return made.join(_placed(self.image), "pos").select("idx", "pos", OBS, *names[1:])

    def cut(self) -> DataFrame:
        """(idx, obs_id, mask_obs_id, shape, dtype, image, mask_dtype, mask) of every pair."""
        boxes = self.plan()
        image = cut_boxes(self.image, boxes).withColumnRenamed("voxels", "image")
        mask = cut_boxes(self.mask, boxes.select("idx", F.col("mask_obs_id").alias(OBS), "x0", "y0", "z0", "x1", "y1", "z1"))
        mask = mask.select("idx", F.col(OBS).alias("mask_obs_id"), F.col("dtype").alias("mask_dtype"), F.col("voxels").alias("mask"))
        return image.join(mask, "idx").select("idx", OBS, "mask_obs_id", "shape", "dtype", "image", "mask_dtype", "mask")


# -- loaders ----------------------------------------------------------------------------------


class Loader:
    """Batches of a frame: shuffled by (seed, epoch) or in order; shards are disjoint and padded to one length.

    With ``workers`` samples are cut by so many threads, ``prefetch`` batches ahead (reads and decompression leave
    Python's lock); order and values are the same as without. ``torch`` gives tensors instead of arrays.
    """

    def __init__(self, frame, batch_size: int = 4, shuffle: bool = False, drop_last: bool = False, seed: int = 0, rank: int = 0, world: int = 1, workers: int = 0, prefetch: int = 2, torch: bool = False):
        if workers < 0 or prefetch < 1:
            raise ConfigurationError("workers are not negative and prefetch is at least 1")
        self.workers, self.prefetch, self.torch = workers, prefetch, torch
        if batch_size < 1 or not 0 <= rank < world:
            raise ConfigurationError("batch_size is at least 1 and rank below world")
        self.frame, self.batch_size, self.shuffle, self.drop_last, self.seed, self.rank, self.world, self.epoch = frame, batch_size, shuffle, drop_last, seed, rank, world, 0

    def set_epoch(self, epoch: int) -> None:
        self.epoch = epoch
        if hasattr(self.frame, "set_epoch"):
            self.frame.set_epoch(epoch)

    def order(self) -> list[int]:
        n = len(self.frame)
        ids = np.random.default_rng([self.seed, self.epoch]).permutation(n).tolist() if self.shuffle else list(range(n))
        if self.world > 1 and n:
            ids = (ids * (-(-self.world * -(-n // self.world) // n)))[: self.world * -(-n // self.world)]
        return ids[self.rank :: self.world]

    def __len__(self) -> int:
        n = len(self.order())
        return n // self.batch_size if self.drop_last else -(-n // self.batch_size)

    def __iter__(self) -> Iterator[dict]:
        ids = self.order()
        parts = [ids[k * self.batch_size : (k + 1) * self.batch_size] for k in range(len(self))]
        if not self.workers:
            yield from (self._batch([self.frame[i] for i in part]) for part in parts)
            return
        with ThreadPoolExecutor(self.workers) as pool:
            ahead: deque = deque()
            try:
                for part in parts:
                    ahead.append([pool.submit(self.frame.__getitem__, i) for i in part])
                    if len(ahead) > self.prefetch:
                        yield self._batch([f.result() for f in ahead.popleft()])
                while ahead:
                    yield self._batch([f.result() for f in ahead.popleft()])
            finally:
                pool.shutdown(cancel_futures=True)

    def _batch(self, rows: list[dict]) -> dict:
        out = {c: np.stack([r[c] for r in rows]) if isinstance(rows[0][c], np.ndarray) else [r[c] for r in rows] for c in rows[0]}
        if self.torch:
            import torch

            out = {c: torch.from_numpy(np.ascontiguousarray(v)) if isinstance(v, np.ndarray) else v for c, v in out.items()}
        return out


def training_loader(frame, batch_size: int = 4, seed: int = 0, **options) -> Loader:
    return Loader(frame, batch_size, shuffle=True, drop_last=True, seed=seed, **options)


def validation_loader(frame, batch_size: int = 4, **options) -> Loader:
    return Loader(frame, batch_size, **options)


def inference_loader(frame, batch_size: int = 1, **options) -> Loader:
    """Every sample once, in order."""
    return Loader(frame, batch_size, **options)


def segmentation_loader(
    image: VolumeSet, mask: VolumeSet, batch_size: int = 4, patch_size: Sequence[int] | None = None, patches_per_volume: int = 1, foreground_prob: float = 0.0, seed: int = 0, transform: Callable | None = None, **options
) -> Loader:
    """A shuffled loader of image-mask pairs."""
    return training_loader(SegmentationFrame(image, mask, patch_size, patches_per_volume, foreground_prob, seed, transform), batch_size, seed, **options)


def distributed_loader(frame, rank: int, world: int, batch_size: int = 4, shuffle: bool = True, seed: int = 0, **options) -> Loader:
    return Loader(frame, batch_size, shuffle, drop_last=True, seed=seed, rank=rank, world=world, **options)


def batches(keys: DataFrame, key: str, batch_size: int, seed: int | None = None, epoch: int = 0, drop_last: bool = False) -> DataFrame:
    """(key, pos, batch): keys in order, or shuffled by a hash of (seed, epoch, key)."""
    if seed is None:
        placed = frames.with_position(keys.select(key), key)
    else:
        placed = frames.with_position(keys.select(key, F.xxhash64(F.lit(seed), F.lit(epoch), F.col(key)).alias("_h")), "_h", key)
    out = placed.withColumn("batch", F.floor(F.col("pos") / batch_size)).select(key, "pos", "batch")
    return out.where(F.col("batch") < F.lit(keys.count() // batch_size)) if drop_last else out


def shards(keys: DataFrame, key: str, world: int) -> DataFrame:
    """(key, pos, rank), with the first keys again at the end so that all ranks have equally many."""
    placed = frames.with_position(keys.select(key), key)
    n = keys.count()
    pad = -n % world
    again = placed.where(F.col("pos") < pad).withColumn("pos", F.col("pos") + n)
    return placed.unionByName(again).withColumn("rank", (F.col("pos") % world).cast("int"))


class Compose:
    def __init__(self, transforms: Sequence[Callable]):
        self.transforms = list(transforms)

    def __call__(self, x):
        for t in self.transforms:
            x = t(x)
        return x
