"""The voxel plane: tiles of arrays, and operators over tile tables and over array columns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomolake.errors import ShapeError

TILE_DDL = "obs_id string, cx int, cy int, cz int, ct int, x0 int, y0 int, z0 int, t0 int, nx int, ny int, nz int, nt int, dtype string, voxels binary"
TILE_COLUMNS = [c.split()[0] for c in TILE_DDL.split(", ")]
AXES = {"sagittal": 0, "coronal": 1, "axial": 2}
Box = tuple[tuple[int, int], ...]


# -- tiles and arrays -------------------------------------------------------------------------


def check_shape(shape: Sequence[int]) -> tuple[int, ...]:
    if len(shape) not in (3, 4) or any(int(s) < 1 for s in shape):
        raise ShapeError(f"a volume has 3 or 4 dimensions of at least 1, not {tuple(shape)}")
    return tuple(int(s) for s in shape)


def tiles_of(obs_id: str, a: np.ndarray, extents: Sequence[int]) -> Iterator[tuple]:
    """Rows of the tile table, in C order of the tile grid."""
    check_shape(a.shape)
    ext = (*extents, *([1] if len(extents) < a.ndim else []))[: a.ndim]
    grid = [range(-(-s // e)) for s, e in zip(a.shape, ext, strict=True)]
    for c in product(*grid):
        lo = [i * e for i, e in zip(c, ext, strict=True)]
        part = a[tuple(slice(x, x + e) for x, e in zip(lo, ext, strict=True))]
        pad = [1] * (4 - a.ndim)
        yield (obs_id, *(int(i) for i in c), *([0] * len(pad)), *lo, *([0] * len(pad)), *part.shape, *pad, a.dtype.str, np.ascontiguousarray(part).tobytes())


def tile_array(row, ndim: int = 4) -> np.ndarray:
    shape = (row["nx"], row["ny"], row["nz"], row["nt"])[:ndim]
    return np.frombuffer(row["voxels"], np.dtype(row["dtype"])).reshape(shape)


def normal_box(shape: Sequence[int], key: Sequence[slice | int | None]) -> tuple[Box, tuple[int, ...]]:
    """((from, to) along each axis, axes that a single number drops) of a NumPy-like key; missing axes are whole."""
    key = (*key, *([slice(None)] * (len(shape) - len(key))))
    if len(key) > len(shape):
        raise IndexError(f"{len(key)} indices for {len(shape)} axes")
    box, dropped = [], []
    for axis, (k, n) in enumerate(zip(key, shape, strict=True)):
        if k is None:
            k = slice(None)
        if isinstance(k, slice):
            a, b, step = k.indices(n)
            if step != 1:
                raise TypeError("boxes have no steps")
            box.append((a, max(a, b)))
        elif isinstance(k, (int, np.integer)) and not isinstance(k, bool):
            if not -n <= k < n:
                raise IndexError(f"index {k} is outside axis {axis} of {n}")
            box.append((int(k) % n, int(k) % n + 1))
            dropped.append(axis)
        else:
            raise TypeError(f"cannot index a volume by {type(k).__name__}")
    return tuple(box), tuple(dropped)


def box_predicate(box: Box, extents: Sequence[int]) -> Column:
    """Tiles that meet the box, as ranges of tile numbers: these reach the Parquet scan."""
    cond = F.lit(True)
    for c, (a, b), e in zip(("cx", "cy", "cz", "ct"), box, extents, strict=False):
        cond = cond & (F.col(c) >= a // e) & (F.col(c) <= max(a, b - 1) // e)
    return cond


def assemble(rows, box: Box, dtype: str) -> np.ndarray:
    """The box from tiles that cover it."""
    out = np.zeros([b - a for a, b in box], np.dtype(dtype))
    for r in rows:
        lo = (r["x0"], r["y0"], r["z0"], r["t0"])[: len(box)]
        tile = tile_array(r, len(box))
        src, dst = [], []
        for (a, b), s, n in zip(box, lo, tile.shape, strict=True):
            x, y = max(a, s), min(b, s + n)
            if x >= y:
                break
            src.append(slice(x - s, y - s))
            dst.append(slice(x - a, y - a))
        else:
            out[tuple(dst)] = tile[tuple(src)]
    return out


# -- batched operators over tile tables ---------------------------------------------------------


def cropped(tiles: DataFrame, box: Box, extents: Sequence[int] | None = None) -> DataFrame:
    """Tile rows cut to the box, with origins relative to it; tiles outside never leave the scan."""
    if extents is not None:
        tiles = tiles.where(box_predicate(box, extents))
    names = (("x0", "nx"), ("y0", "ny"), ("z0", "nz"), ("t0", "nt"))
    for (o, n), (a, b) in zip(names, box, strict=False):
        tiles = tiles.where((F.col(o) < b) & (F.col(o) + F.col(n) > a))
    full = (*box, *([(0, 1 << 30)] * (4 - len(box))))

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                tile, cut = tile_array(r), []
                for (o, n), (a, b) in zip(names, full, strict=True):
                    x, y = max(a, r[o]), min(b, r[o] + r[n])
                    cut.append(slice(x - r[o], y - r[o]))
                    r[o], r[n] = x - a, y - x
                out.append(r | {"voxels": np.ascontiguousarray(tile[tuple(cut)]).tobytes()})
            yield pa.RecordBatch.from_pylist(out, schema=batch.schema)

    return tiles.select(*TILE_COLUMNS).mapInArrow(run, TILE_DDL)


def streamed(batches, key: str = "obs_id") -> Iterator[list[dict]]:
    """Rows that arrive sorted by ``key``, those of one key (a volume) at a time; voxels stay in Arrow's buffers."""
    held: list[dict] = []
    for batch in batches:
        voxel = batch.column("voxels")
        for k, r in enumerate(batch.drop_columns("voxels").to_pylist()):
            if held and r[key] != held[0][key]:
                yield held
                held = []
            held.append(r | {"voxels": voxel[k].as_buffer()})
    if held:
        yield held


def assembled(rows: list[dict]) -> np.ndarray:
    """The whole volume of its tile rows, with as many axes as tiles show (4; the last one goes when it has one place)."""
    shape = [max(r[o] + r[n] for r in rows) for o, n in (("x0", "nx"), ("y0", "ny"), ("z0", "nz"), ("t0", "nt"))]
    return assemble(rows, tuple((0, n) for n in shape), rows[0]["dtype"])


def by_volume(tiles: DataFrame) -> DataFrame:
    """Tiles dealt out so that a task's rows come volume by volume: one shuffle of packed voxels, none of single ones."""
    return tiles.repartition("obs_id").sortWithinPartitions("obs_id")


def whole(tiles: DataFrame) -> DataFrame:
    """(obs_id, shape, dtype, voxels): volumes put together in a stream over sorted tiles; a task holds one volume at a time."""
    schema = pa.schema([("obs_id", pa.string()), ("shape", pa.list_(pa.int32())), ("dtype", pa.string()), ("voxels", pa.binary())])

    def run(batches):
        for rows in streamed(batches):
            a = assembled(rows)
            yield pa.RecordBatch.from_pylist([{"obs_id": rows[0]["obs_id"], "shape": list(a.shape), "dtype": rows[0]["dtype"], "voxels": a.tobytes()}], schema=schema)

    return by_volume(tiles.select(*TILE_COLUMNS)).mapInArrow(run, "obs_id string, shape array<int>, dtype string, voxels binary")


def values(tiles: DataFrame) -> DataFrame:
    """(obs_id, value): every voxel as a double, exploded in the JVM from one array a tile."""

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["obs_id"] for r in rows], pa.string()), pa.array([np.frombuffer(r["voxels"], np.dtype(r["dtype"])).astype(float) for r in rows], pa.list_(pa.float64()))],
                names=["obs_id", "v"],
            )

    arrays = tiles.select("obs_id", "dtype", "voxels").mapInArrow(run, "obs_id string, v array<double>")
    return arrays.select("obs_id", F.explode("v").alias("value"))


def statistics(tiles: DataFrame, percentiles: Sequence[float] = ()) -> DataFrame:
    """(obs_id, n, mean, std, min, max, median, p..): population deviation; percentiles interpolate linearly.

    Packed tiles are shuffled once by obs_id and a task takes one volume at a time, so no voxel is ever a row.
    """
    names = ["n", "mean", "std", "min", "max", "median", *(f"p{int(p)}" for p in percentiles)]
    schema = pa.schema([("obs_id", pa.string()), ("n", pa.int64()), *((c, pa.float64()) for c in names[1:])])

    def run(batches):
        for rows in streamed(batches):
            v = np.concatenate([np.frombuffer(r["voxels"], np.dtype(r["dtype"])) for r in rows]).astype(float)
            q = np.percentile(v, [50, *percentiles], overwrite_input=True)
            one = [len(v), v.mean(), v.std(), v.min(), v.max(), *q]
            yield pa.RecordBatch.from_arrays([pa.array([rows[0]["obs_id"]]), *(pa.array([x], f.type) for x, f in zip(one, schema.remove(0), strict=True))], schema=schema)

    ddl = "obs_id string, n long, " + ", ".join(f"`{c}` double" for c in names[1:])
    return by_volume(tiles.select("obs_id", "dtype", "voxels")).mapInArrow(run, ddl)


def ranges(tiles: DataFrame) -> DataFrame:
    """(obs_id, lo, hi): the least and the greatest voxel of each volume, combined from one row a tile."""

    def run(batches):
        for batch in batches:
            rows = [(r["obs_id"], v.min(), v.max()) for r in batch.to_pylist() if len(v := np.frombuffer(r["voxels"], np.dtype(r["dtype"])))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), *(pa.array([float(r[k]) for r in rows], pa.float64()) for k in (1, 2))], names=["obs_id", "lo", "hi"])

    part = tiles.select("obs_id", "dtype", "voxels").mapInArrow(run, "obs_id string, lo double, hi double")
    return part.groupBy("obs_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def histogram(tiles: DataFrame, bins: int, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """(obs_id, bin, lo, hi, n) with empty bins; the last bin is closed, values outside are dropped.

    Without a range each volume has its own, from its least to its greatest voxel (half a unit to both sides where they are equal).
    """
    if lo is None or hi is None:
        own = ranges(tiles)
        flat = F.col("lo") == F.col("hi")
        own = own.select("obs_id", F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
        tiles = tiles.select("obs_id", "dtype", "voxels").join(own, "obs_id")
    else:
        tiles = tiles.select("obs_id", "dtype", "voxels", F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"))

    def partial(batches):
        for batch in batches:
            rows = batch.to_pylist()
            counts = [np.histogram(np.frombuffer(r["voxels"], np.dtype(r["dtype"])), bins, (r["lo"], r["hi"]))[0] for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("obs_id"), batch.column("lo"), batch.column("hi"), pa.array(counts, pa.list_(pa.int64()))], names=["obs_id", "lo", "hi", "c"])

    parts = tiles.mapInArrow(partial, "obs_id string, lo double, hi double, c array<long>").select("obs_id", "lo", "hi", F.posexplode("c").alias("bin", "c"))
    width = (F.col("hi") - F.col("lo")) / bins
    total = parts.groupBy("obs_id", "lo", "hi", "bin").agg(F.sum("c").alias("n"))
    return total.select("obs_id", "bin", (F.col("lo") + F.col("bin") * width).alias("lo"), (F.col("lo") + (F.col("bin") + 1) * width).alias("hi"), "n")


def foreground(tiles: DataFrame) -> DataFrame:
    """(obs_id, x, y, z): coordinates of non-zero voxels."""

    def run(batches):
        for batch in batches:
            out: list[pd.DataFrame] = []
            for r in batch.to_pylist():
                at = np.argwhere(tile_array(r)[..., 0] != 0) + [r["x0"], r["y0"], r["z0"]]
                out.append(pd.DataFrame({"obs_id": r["obs_id"], "x": at[:, 0], "y": at[:, 1], "z": at[:, 2]}))
            if out:
                yield pa.RecordBatch.from_pandas(pd.concat(out), schema=pa.schema([("obs_id", pa.string()), *((c, pa.int32()) for c in "xyz")]), preserve_index=False)

    return tiles.select(*TILE_COLUMNS).mapInArrow(run, "obs_id string, x int, y int, z int")


# -- operators over array columns (small volumes as rows, C order) ------------------------------


def cells(df: DataFrame, key: str, array: str, shape: tuple[int, int, int]) -> DataFrame:
    """(key, x, y, z, value) of a C-order array column."""
    _, ny, nz = shape
    p = df.select(key, F.posexplode(array).alias("p", "v"))
    return p.select(key, F.floor(F.col("p") / (ny * nz)).cast("int").alias("x"), (F.floor(F.col("p") / nz) % ny).cast("int").alias("y"), (F.col("p") % nz).cast("int").alias("z"), F.col("v").cast("double").alias("value"))


def cell_box(df: DataFrame, key: str, array: str, shape: tuple[int, int, int], box: Box) -> DataFrame:
    """The cells of a box: its places in the array are picked before anything is exploded."""
    _, ny, nz = shape
    axes = [F.sequence(F.lit(a), F.lit(b - 1)) if b > a else F.array().cast("array<int>") for a, b in box]
    place = lambda x, y, z: F.struct(x.alias("x"), y.alias("y"), z.alias("z"), F.get(array, x * (ny * nz) + y * nz + z).cast("double").alias("value"))
    picked = F.flatten(F.flatten(F.transform(axes[0], lambda x: F.transform(axes[1], lambda y: F.transform(axes[2], lambda z: place(x, y, z))))))
    return df.select(key, F.inline(picked))


def plane(df: DataFrame, key: str, array: str, shape: tuple[int, int, int], kind: str, at: int) -> DataFrame:
    """One plane of each volume; kind is axial (z), sagittal (x) or coronal (y)."""
    box = [(0, n) for n in shape]
    box[AXES[kind]] = (at, at + 1)
    return cell_box(df, key, array, shape, tuple(box)).drop("xyz"[AXES[kind]])


def array_statistics(df: DataFrame, key: str, array: str, percentiles: Sequence[float] = ()) -> DataFrame:
    v = df.select(key, F.explode(array).alias("v")).select(key, F.col("v").cast("double").alias("v"))
    return v.groupBy(key).agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"), F.expr("percentile(v, 0.5)").alias("median"),
        *(F.expr(f"percentile(v, {p / 100})").alias(f"p{int(p)}") for p in percentiles),
    )


def array_histogram(df: DataFrame, key: str, array: str, bins: int, lo: float, hi: float) -> DataFrame:
    """(key, bin, n), empty bins included: counted inside each row, without a shuffle."""
    w = (hi - lo) / bins
    return df.select(
        key,
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.lit(bins - 1)),
                lambda b: F.struct(
                    b.alias("bin"),
                    F.size(F.filter(array, lambda v: (v.cast("double") >= lo) & (v.cast("double") <= hi) & (F.least(F.floor((v.cast("double") - lo) / w), F.lit(bins - 1)) == b))).alias("n"),
                ),
            )
        ).alias("h"),
    ).select(key, F.col("h.bin").alias("bin"), F.col("h.n").cast("long").alias("n"))
