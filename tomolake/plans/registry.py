"""Registered queries: this engine's operators over the driver's tables.

Subjects are ``customer`` (c_custkey), observations ``orders`` (o_orderkey, foreign
key o_custkey), volumes ``embeddings`` (64 floats as 4 x 4 x 4 in C order), labels
``labels``; each has its SQL in ``oracles``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomolake.functions import naming
from tomolake.operators import frames, samples, voxels
from tomolake.operators.index import positions
from tomolake.plans import engine
from tomolake.plans.predicate import predicate, where
from tomolake.streaming.windows import first_of_key, windowed

SHAPE = (4, 4, 4)
PATCH = (2, 2, 2)
_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(f):
    _Q[f.__name__] = f
    return f


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _r(c, digits: int = 6):
    return F.round(c, digits)


def _meta(s, d):
    return _t(s, d, "customer")


def _obs(s, d):
    return _t(s, d, "orders")


def _vol(s, d):
    return _t(s, d, "embeddings")


# -- metadata ---------------------------------------------------------------------------------


@_query
def meta_scan(s, d):
    return _meta(s, d).where(predicate("c_acctbal > 0", ["c_acctbal"])).select("c_custkey", "c_name", "c_acctbal")


@_query
def subject_filter(s, d):
    return where(_meta(s, d), "c_acctbal > 5000 and c_mktsegment == 'BUILDING'").select("c_custkey", "c_name")


@_query
def subject_filter_in(s, d):
    return where(_meta(s, d), "(c_nationkey in [1, 2, 3]) | (c_acctbal < -500) and not c_mktsegment == 'MACHINERY'").select("c_custkey", "c_nationkey")


@_query
def view_filter_chain(s, d):
    return where(where(_meta(s, d), "c_acctbal > 1000"), "c_nationkey <= 10").select("c_custkey", "c_nationkey")


@_query
def volume_filter(s, d):
    return where(_obs(s, d), "o_totalprice >= 150000 and o_orderstatus != 'P'").select("o_orderkey", "o_custkey")


@_query
def subject_filter_semi(s, d):
    keys = where(_meta(s, d), "c_mktsegment == 'AUTOMOBILE'").select(F.col("c_custkey").alias("o_custkey"))
    return frames.keep_keys(_obs(s, d), keys, "o_custkey").select("o_orderkey", "o_custkey")


def _placed(s, d):
    return frames.with_position(_obs(s, d).select("o_orderkey", "o_custkey"), "o_orderkey")


@_query
def iloc_slice(s, d):
    return _placed(s, d).where(F.col("pos").isin(positions(slice(10, 50), 1000)))


@_query
def iloc_step(s, d):
    return _placed(s, d).where(F.col("pos").isin(positions(slice(0, 200, 7), 1000)))


@_query
def iloc_negative(s, d):
    return frames.tail(_obs(s, d), 5, "o_orderkey").select("o_orderkey", "o_custkey")


@_query
def iloc_mask(s, d):
    return _placed(s, d).where(F.col("pos") % 100 == 3)


@_query
def loc_list(s, d):
    return frames.of_values(_obs(s, d), "o_orderkey", [1, 2, 3, 77, 130]).select("o_orderkey", "o_totalprice")


@_query
def sel_subject(s, d):
    return frames.of_values(_obs(s, d), "o_custkey", [7, 22]).select("o_orderkey", "o_custkey")


@_query
def head_n(s, d):
    return frames.head(_meta(s, d), 10, "c_custkey").select("c_custkey", "c_name")


@_query
def tail_n(s, d):
    return frames.tail(_meta(s, d), 10, "c_custkey").select("c_custkey", "c_name")


@_query
def lazy_filter_head_rootpos(s, d):
    """The first 100 of the root that pass, not the first 100 that pass."""
    return frames.with_position(_obs(s, d).select("o_orderkey", "o_totalprice"), "o_orderkey").where("pos < 100 and o_totalprice > 150000").select("o_orderkey", "pos")


@_query
def sample_seeded(s, d):
    chosen = frames.sample_positions(150, 20, 42)
    return frames.with_position(_meta(s, d).select("c_custkey"), "c_custkey").where(F.col("pos").isin(chosen))


@_query
def subject_volume_join(s, d):
    return _obs(s, d).join(_meta(s, d), F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "o_custkey", "c_name", "c_mktsegment")


@_query
def obs_ids_json(s, d):
    return frames.obs_ids_json(_obs(s, d), "o_custkey", "o_orderkey")


@_query
def merge_obs_ids_default(s, d):
    obs = _obs(s, d).select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return frames.with_obs_ids(_meta(s, d).select("c_custkey"), obs, "c_custkey", "o_orderkey")


@_query
def orphan_observations(s, d):
    keys = _meta(s, d).where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return frames.drop_keys(_obs(s, d), keys, "o_custkey").select("o_orderkey", "o_custkey")


@_query
def missing_subjects(s, d):
    keys = _obs(s, d).where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return frames.drop_keys(_meta(s, d).select("c_custkey"), keys, "c_custkey")


@_query
def duplicate_obs_ids(s, d):
    return frames.duplicates(_t(s, d, "lineitem"), "l_orderkey", "l_suppkey")


@_query
def cross_collection_duplicates(s, d):
    """obs ids that two collections share."""
    a = _obs(s, d).where("o_orderstatus = 'F'").select("o_orderkey")
    b = _t(s, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return frames.duplicates(a.unionByName(b), "o_orderkey")


@_query
def validate_counts(s, d):
    parts = [_t(s, d, n).agg(F.lit(n).alias("tbl"), F.count("*").alias("n")) for n in ("customer", "orders", "embeddings")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@_query
def study_faults(s, d):
    meta = _meta(s, d).where("c_custkey % 50 <> 0").select(F.col("c_custkey").cast("string").alias("sid"))
    sets = {"late": _obs(s, d).where("o_totalprice > 100000"), "open": _obs(s, d).where("o_totalprice > 250000")}
    return frames.study_faults(meta, {n: o.select(F.col("o_custkey").cast("string").alias("sid"), F.col("o_orderkey").cast("string").alias("oid")) for n, o in sets.items()}, "sid", "oid")


@_query
def groupby_subject(s, d):
    return frames.volumes_of_subjects(_obs(s, d), "o_custkey", "o_orderkey")


@_query
def subjects_first_seen(s, d):
    return frames.subjects_first_seen(_placed(s, d), "o_custkey", "pos")


@_query
def describe_labels(s, d):
    meta = _meta(s, d)
    return frames.value_counts(meta, *frames.label_columns(meta, ("c_custkey", "c_name")))


def _sides(s, d):
    a = frames.with_position(_meta(s, d).where("c_acctbal > 0").select(F.col("c_custkey").alias("key")), "key")
    b = frames.with_position(_meta(s, d).where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("key")), "key")
    return a, b


@_query
def index_intersection(s, d):
    return frames.index_and(*_sides(s, d))


@_query
def index_union(s, d):
    return frames.index_or(*_sides(s, d))


@_query
def index_difference(s, d):
    return frames.index_minus(*_sides(s, d))


@_query
def index_symdiff(s, d):
    return frames.index_xor(*_sides(s, d))


@_query
def index_aligned(s, d):
    return frames.misaligned(*_sides(s, d))


@_query
def index_subset(s, d):
    a, b = _sides(s, d)
    return frames.index_minus(b, a).agg((F.count("*") == 0).alias("is_subset"))


@_query
def align_three(s, d):
    a, b = _sides(s, d)
    c = _meta(s, d).where("c_nationkey < 15").select(F.col("c_custkey").alias("key"))
    return frames.common_keys([a, b, c], "key")


@_query
def acquisition_ids(s, d):
    return frames.acquisitions(_obs(s, d).select("o_orderkey", "o_custkey"), "o_custkey", ["o_orderkey"], "CT").select("o_orderkey", "obs_id")


NAMES = ["sub-01_T1w", "scan_t1ce_x", "lung_001", "sub-02_dwi", "a_flair", "plain", "x_ct_y", "sub_bold", "FUNC_run", "PDT2", "T2_axial", "hrct"]


@_query
def series_type(s, d):
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("p_partkey") % len(NAMES) + 1).cast("int"))
    return _t(s, d, "part").select("p_partkey", name.alias("name"), naming.series_type(name).alias("series"))


@_query
def file_stems(s, d):
    path = F.concat(F.lit("/data/"), F.col("p_brand"), F.lit("/"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 2 == 0, ".nii.gz").otherwise(".nii"))
    return _t(s, d, "part").select("p_partkey", naming.file_stem(path).alias("stem"))


@_query
def spatial_units(s, d):
    return _t(s, d, "part").select("p_partkey", naming.spatial_units(F.col("p_size")).alias("units"))


@_query
def affine_parse(s, d):
    size = F.col("p_size").cast("string")
    text = F.concat(F.lit("[["), size, F.lit(",0,0,1.5],[0,"), size, F.lit(",0,2],[0,0,1,"), size, F.lit("],[0,0,0,1]]"))
    a = naming.affine_from_json(text)
    return _t(s, d, "part").select("p_partkey", (a[0][0] + a[1][1] + a[2][2]).alias("trace3"), a[2][3].alias("z_offset"))


@_query
def tuple_parse(s, d):
    text = F.concat(F.lit("("), F.col("p_size").cast("string"), F.lit(", 2.5, 1.0)"))
    v = naming.tuple_values(text)
    return _t(s, d, "part").select("p_partkey", v[0].alias("a"), v[1].alias("b"), F.size(v).alias("n"))


@_query
def upsert_meta(s, d):
    meta = _meta(s, d).select("c_custkey", "c_name", "c_acctbal")
    delta = meta.where("c_custkey <= 5").select("c_custkey", (F.col("c_acctbal") + 1000).alias("c_acctbal"))
    new = s.range(1).select(F.lit(900000001).cast("long").alias("c_custkey"), F.lit(12.5).alias("c_acctbal"))
    return frames.upsert(meta, delta.unionByName(new), "c_custkey")


@_query
def delete_meta(s, d):
    meta = _meta(s, d)
    return frames.delete(meta, predicate("c_acctbal < 0 or c_nationkey == 3", meta.columns)).select("c_custkey")


@_query
def add_column_fill(s, d):
    return frames.add_column(_meta(s, d).select("c_custkey"), "site", "string", "A1")


@_query
def drop_column(s, d):
    return frames.drop_column(_meta(s, d), "c_acctbal", ("c_custkey",))


@_query
def append_obs(s, d):
    o = _obs(s, d).select("o_orderkey", "o_custkey", "o_orderstatus")
    return frames.append(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1").drop("o_orderstatus"))


# -- voxels -----------------------------------------------------------------------------------


def _plane(s, d, kind, at):
    c = voxels.plane(_vol(s, d), "vec_id", "embedding", SHAPE, kind, at)
    return c.withColumn("value", _r("value"))


@_query
def axial_slice(s, d):
    return _plane(s, d, "axial", 2)


@_query
def sagittal_slice(s, d):
    return _plane(s, d, "sagittal", 1)


@_query
def coronal_slice(s, d):
    return _plane(s, d, "coronal", 3)


@_query
def roi_box(s, d):
    return voxels.cell_box(_vol(s, d), "vec_id", "embedding", SHAPE, ((1, 3), (0, 2), (2, 4))).withColumn("value", _r("value"))


def tile_table(df: DataFrame, key: str, array: str, shape=SHAPE, extents=PATCH) -> DataFrame:
    """The tile table of an array column."""

    def run(pdfs):
        for pdf in pdfs:
            rows = [t for k, a in zip(pdf[key], pdf[array], strict=True) for t in voxels.tiles_of(str(k), np.asarray(a, np.float32).reshape(shape), extents)]
            yield pd.DataFrame(rows, columns=voxels.TILE_COLUMNS)

    return df.select(key, array).mapInPandas(run, voxels.TILE_DDL)


@_query
def tile_roundtrip(s, d):
    """Cut to 2 x 2 x 2 tiles and put together again."""

    def flat(pdfs):
        for pdf in pdfs:
            yield pd.DataFrame({"vec_id": pdf["obs_id"].astype("int64"), "v": [np.frombuffer(x, np.float32).astype(float) for x in pdf["voxels"]]})

    v = voxels.whole(tile_table(_vol(s, d), "vec_id", "embedding")).mapInPandas(flat, "vec_id long, v array<double>")
    return v.select("vec_id", F.posexplode("v").alias("p", "value")).select("vec_id", F.col("p").cast("long").alias("p"), _r("value").alias("value"))


@_query
def tile_box(s, d):
    """A box out of the tile table: only tiles that meet it are read."""
    cut = voxels.cropped(tile_table(_vol(s, d), "vec_id", "embedding"), ((1, 3), (0, 2), (2, 4)), PATCH)
    return voxels.values(cut).groupBy("obs_id").agg(F.count("*").alias("n"), _r(F.sum("value"), 4).alias("total")).withColumn("obs_id", F.col("obs_id").cast("long"))


@_query
def tile_statistics(s, d):
    st = voxels.statistics(tile_table(_vol(s, d), "vec_id", "embedding"), (25, 90))
    return st.select(F.col("obs_id").cast("long").alias("vec_id"), "n", *(_r(c).alias(c) for c in ("mean", "std", "min", "max", "median", "p25", "p90")))


@_query
def tile_histogram(s, d):
    h = voxels.histogram(tile_table(_vol(s, d), "vec_id", "embedding"), 8, -0.4, 0.4)
    return h.select(F.col("obs_id").cast("long").alias("vec_id"), F.col("bin").cast("long").alias("bin"), "n")


@_query
def volume_statistics(s, d):
    st = voxels.array_statistics(_vol(s, d), "vec_id", "embedding")
    return st.select("vec_id", *(_r(c).alias(c) for c in ("mean", "std", "min", "max", "median")))


@_query
def volume_percentiles(s, d):
    st = voxels.array_statistics(_vol(s, d), "vec_id", "embedding", (5, 25, 75, 95))
    return st.select("vec_id", *(_r(c).alias(c) for c in ("p5", "p25", "p75", "p95")))


@_query
def histogram(s, d):
    return voxels.array_histogram(_vol(s, d), "vec_id", "embedding", 10, -1.0, 1.0)


@_query
def histogram_range(s, d):
    return voxels.array_histogram(_vol(s, d), "vec_id", "embedding", 4, -0.1, 0.1)


@_query
def uniform_shape(s, d):
    return samples.volume_shapes(engine.plain(s, d)).select(F.aggregate("shape", F.lit(1).cast("long"), lambda a, n: a * n).alias("n_voxels"), "n")


@_query
def foreground_coords(s, d):
    return engine.above(s, d, 0.2).foreground().select(F.col("obs_id").cast("long").alias("vec_id"), "x", "y", "z")


@_query
def reorient_las(s, d):
    """Volumes turned to LAS: the first axis flipped."""
    return engine.volumes_las(s, d)


@_query
def reorient_lps(s, d):
    """Volumes turned to LPS: the first two axes flipped."""
    return engine.volumes_lps(s, d)


# -- maps -------------------------------------------------------------------------------------


def _mapped(s, d, fn, ddl: str) -> DataFrame:
    """A Python function on whole volumes with their row, in Arrow batches: (array, row) to a tuple of the schema's columns."""
    names = [c.split()[0] for c in ddl.split(", ")]

    def run(pdfs):
        for pdf in pdfs:
            rows = [fn(np.asarray(a, float).reshape(SHAPE), {"vec_id": int(k), "label": int(y)}) for k, a, y in zip(pdf["vec_id"], pdf["embedding"], pdf["label"], strict=True)]
            yield pd.DataFrame(rows, columns=names)

    return _vol(s, d).select("vec_id", "embedding", "label").mapInPandas(run, ddl)


@_query
def map_normalize(s, d):
    """(v - mean) / deviation of each volume, with SQL functions alone."""
    v = _vol(s, d).withColumn("e", F.transform("embedding", lambda x: x.cast("double")))
    n = F.size("e")
    mean = F.aggregate("e", F.lit(0.0), lambda a, x: a + x) / n
    v = v.withColumn("mean", mean)
    v = v.withColumn("std", F.sqrt(F.aggregate(F.transform("e", lambda x: (x - F.col("mean")) * (x - F.col("mean"))), F.lit(0.0), lambda a, x: a + x) / n))
    z = F.transform("e", lambda x: (x - F.col("mean")) / F.col("std"))
    return v.select("vec_id", F.posexplode(z).alias("p", "value")).select("vec_id", F.col("p").cast("long").alias("p"), _r("value", 5).alias("value"))


@_query
def map_obs_updates(s, d):
    m = engine.plain(s, d).map(lambda a, row: (0, {"peak": round(float(a.max()), 6), "positive": bool(a.astype(float).mean() > 0)}))
    return m.to_dataframe().select(F.col("obs_id").cast("long").alias("vec_id"), "peak", "positive")


@_query
def map_chain(s, d):
    from tomolake.operators.mapped import composed

    chain = composed([lambda a, row: (np.clip(a, 0, None), {"kept": int((a > 0).sum())}), lambda a, row: (a.sum() * row["kept"], {})])

    def fn(a, row):
        value, updates = chain(a, row)
        return row["vec_id"], updates["kept"], round(float(value), 4)

    return _mapped(s, d, fn, "vec_id long, kept long, value double")


@_query
def map_batches(s, d):
    """Each volume's total within its batch of eight (canonical order)."""


    def totals(items):
        whole = sum(float(a.astype(float).sum()) for a, _ in items)
        return [(0, {"in_batch": whole})] * len(items)

    vs = engine.plain(s, d)
    out = vs.map_batches(totals, 8).to_dataframe().select(F.col("obs_id").cast("long").alias("vec_id"), "in_batch")
    placed = frames.with_position(vs.obs.select(F.col("obs_id").cast("long").alias("vec_id")), "vec_id")
    return placed.join(out, "vec_id").select("vec_id", F.floor(F.col("pos") / 8).alias("batch"), _r("in_batch", 4).alias("in_batch"))


# -- samples ----------------------------------------------------------------------------------

@_query
def foreground_patch(s, d):
    """A patch centred on each volume's strongest voxel, moved inside."""


    def start(a, row):
        x, y, z = samples.guided_start(a.shape, PATCH, np.array([np.unravel_index(a.argmax(), a.shape)]), 0)
        return 0, {"x": x, "y": y, "z": z}

    return engine.plain(s, d).map(start).to_dataframe().select(F.col("obs_id").cast("long").alias("vec_id"), "x", "y", "z")


@_query
def slice2d_samples(s, d):
    plan = samples.SampleFrame([engine.plain(s, d)], samples.SampleConfig(samples.Loading.SLICE_2D)).plan()
    return plan.select("idx", F.col("obs_id").cast("long").alias("vec_id"), F.col("z0").cast("long").alias("z"))


@_query
def segmentation_pairs(s, d):
    """Image and mask of every pair, cut by the plan; volumes with an empty mask have no row."""
    cut = samples.SegmentationFrame(engine.plain(s, d), engine.above(s, d, 0.1)).cut()

    def under(pdfs):
        for pdf in pdfs:
            rows = []
            for k, a, b, ka, kb in zip(pdf["obs_id"], pdf["image"], pdf["mask"], pdf["dtype"], pdf["mask_dtype"], strict=True):
                x = np.frombuffer(a, ka).astype(float)[np.frombuffer(b, kb) != 0]
                rows += [(int(k), len(x), float(x.sum()))] if len(x) else []
            yield pd.DataFrame(rows, columns=["vec_id", "n", "total"])

    return cut.mapInPandas(under, "vec_id long, n long, total double").withColumn("total", _r("total", 5))


@_query
def label_join(s, d):
    return _t(s, d, "documents").select("doc_id", "source").join(_t(s, d, "labels"), "doc_id", "left").select("doc_id", "source", "quality", "toxic")


@_query
def train_batches(s, d):
    return samples.batches(_vol(s, d), "vec_id", 16, drop_last=True)


@_query
def rank_shards(s, d):
    return samples.shards(_vol(s, d), "vec_id", 3)


# -- events -----------------------------------------------------------------------------------


@_query
def event_windows(s, d):
    e = _t(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = windowed(e, "ts", ["event_type"], "1 hour", "10 minutes", "value")
    return w.select(F.date_format(F.col("window.start"), "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", _r("total", 4).alias("total"))


@_query
def event_users(s, d):
    return first_of_key(_t(s, d, "events"), "user_id", "ts", "1 hour").select("user_id")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean intensity and axial mid-slice of every volume whose subject passes a predicate."""
    keys = where(_meta(spark, sf_dir), "c_acctbal > 0").select(F.col("c_custkey").alias("vec_id"), "c_mktsegment")
    v = frames.keep_keys(_vol(spark, sf_dir), keys, "vec_id")
    stats = voxels.array_statistics(v, "vec_id", "embedding").select("vec_id", _r("mean").alias("mean"))
    cells = voxels.plane(v, "vec_id", "embedding", SHAPE, "axial", SHAPE[2] // 2)
    mid = cells.groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("x", "y", "value"))).alias("p"), F.round(F.sum("value"), 4).alias("mid_total"))
    mid = mid.select("vec_id", F.transform("p", lambda c: c.value).alias("mid_slice"), "mid_total")
    return stats.join(mid, "vec_id").join(keys, "vec_id").select("vec_id", "c_mktsegment", "mean", "mid_slice", "mid_total")


_Q["flagship"] = lambda s, d: flagship(s, d).drop("mid_slice")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)
