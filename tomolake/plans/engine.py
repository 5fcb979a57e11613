"""Registered queries that go through studies and collections: written from the tables, opened, selected, mapped, changed.

Subjects are ``customer`` (``s`` and nine digits of c_custkey). Collection CT holds all ``embeddings`` as 4 x 4 x 4 volumes
(``CT`` and nine digits of vec_id; its subject is vec_id modulo 150), MR those with an even vec_id, negated, and seg the
voxels of all above 0.1 as 0 and 1. Their SQL is in ``engine_oracles``.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomolake.config import CompressionConfig, OrientationConfig, ReadConfig, SliceOrientation, TileConfig, get_config
from tomolake.errors import AlignmentError, ConfigurationError, IngestError, SchemaError, ShapeError, StorageError, TomolakeError, ViewError
from tomolake.functions import naming, orientation
from tomolake.operators import frames, samples, stats, voxels
from tomolake.operators.frames import OBS, SUBJECT
from tomolake.operators.index import KeyIndex
from tomolake.operators.mapped import composed
from tomolake.operators.meta import MetaTable
from tomolake.operators.samples import Loading, SampleConfig, SampleFrame, SegmentationFrame
from tomolake.operators.study import Study
from tomolake.operators.volumeset import VolumeSet
from tomolake.operators.writers import StudyWriter, VolumeSetWriter
from tomolake.plans import workspace
from tomolake.sources import dicom, ingest, nifti
from tomolake.storage import delete_uri, uri_exists

SHAPE = (4, 4, 4)
_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(f):
    _Q[f.__name__] = f
    return f


# -- the collections ----------------------------------------------------------------------------


def _key(prefix: str, c) -> F.Column:
    return F.concat(F.lit(prefix), F.lpad(c.cast("string"), 9, "0"))


def _rows(s: SparkSession, d: str, prefix: str) -> DataFrame:
    e = s.read.parquet(f"{d}/embeddings.parquet")
    return e.select(_key("s", F.col("vec_id") % 150).alias(SUBJECT), _key(prefix, F.col("vec_id")).alias(OBS), "vec_id", "label", "embedding")


def ct(s, d) -> VolumeSet:
    return VolumeSet(s, workspace.once(s, d, "CT", lambda uri: VolumeSet.from_table(s, uri, _rows(s, d, "CT"), "embedding", SHAPE, "CT")))


def mr(s, d) -> VolumeSet:
    def make(uri):
        even = _rows(s, d, "MR").where("vec_id % 2 = 0").withColumn("embedding", F.transform("embedding", lambda x: -x))
        VolumeSet.from_table(s, uri, even, "embedding", SHAPE, "MR")

    return VolumeSet(s, workspace.once(s, d, "MR", make))


def seg(s, d) -> VolumeSet:
    def make(uri):
        mask = _rows(s, d, "SG").withColumn("embedding", F.transform("embedding", lambda x: (x.cast("double") > 0.1).cast("float")))
        VolumeSet.from_table(s, uri, mask, "embedding", SHAPE, "seg")

    return VolumeSet(s, workspace.once(s, d, "seg", make))


def plain(s, d) -> VolumeSet:
    """All embeddings under nine digits of vec_id, which are their subjects too: canonical order is that of vec_id."""

    def make(uri):
        e = s.read.parquet(f"{d}/embeddings.parquet")
        VolumeSet.from_table(s, uri, e.select(_key("", F.col("vec_id")).alias(SUBJECT), _key("", F.col("vec_id")).alias(OBS), "label", "embedding"), "embedding", SHAPE, "plain")

    return VolumeSet(s, workspace.once(s, d, "plain", make))


def above(s, d, level: float) -> VolumeSet:
    """The voxels of ``plain`` above a level, as 0 and 1."""

    def make(uri):
        e = s.read.parquet(f"{d}/embeddings.parquet").withColumn("embedding", F.transform("embedding", lambda x: (x.cast("double") > level).cast("float")))
        VolumeSet.from_table(s, uri, e.select(_key("", F.col("vec_id")).alias(SUBJECT), _key("", F.col("vec_id")).alias(OBS), "embedding"), "embedding", SHAPE, "above")

    return VolumeSet(s, workspace.once(s, d, f"above-{level}", make))


def subjects(s, d) -> DataFrame:
    c = s.read.parquet(f"{d}/customer.parquet")
    return c.select(_key("s", F.col("c_custkey")).alias(SUBJECT), "c_acctbal", "c_mktsegment", "c_nationkey")


def study(s, d) -> Study:
    return Study(s, workspace.once(s, d, "study", lambda uri: Study.from_collections(s, uri, {"CT": ct(s, d), "MR": mr(s, d)}, subjects(s, d))))


def _ids(df: DataFrame) -> DataFrame:
    return df.select(SUBJECT, OBS)


def _voxels(vs: VolumeSet) -> DataFrame:
    """(obs_id, n, total) of a collection's stored voxels."""
    v = voxels.values(vs.tiles).groupBy(OBS).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return v


def _sums(cut: DataFrame) -> DataFrame:
    return voxels.values(cut).groupBy(OBS).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def _results(m, ddl: str, row: Callable) -> DataFrame:
    """The results of a map as rows, taken apart in the tasks."""
    from tomolake.operators.mapped import unpacked

    names = [c.split()[0] for c in ddl.split(", ")]

    def run(pdfs):
        for pdf in pdfs:
            yield pd.DataFrame([x for r in pdf.to_dict("records") for x in row(r[OBS], unpacked(r))], columns=names)

    return m.results.mapInPandas(run, ddl)


def _raises(kind: type[Exception], f: Callable) -> bool:
    try:
        f()
    except kind:
        return True
    return False


def _cases(s: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    return s.createDataFrame(rows, ddl)


# -- opening and sources --------------------------------------------------------------------------


@_query
def open_collection(s, d):
    return VolumeSet(s, ct(s, d).uri).obs.select(SUBJECT, OBS, "label")


@_query
def open_study(s, d):
    return Study(s, study(s, d).uri).obs_meta.select(SUBJECT, "c_mktsegment", "obs_ids")


@_query
def open_volume(s, d):
    """A handle on every volume's header."""
    return ct(s, d).headers.select(OBS, F.col("shape")[0].cast("long").alias("nx"), F.col("shape")[2].cast("long").alias("nz"), "dtype", F.col("meta")["tile_orientation"].alias("tiles"))


def _niftis(s, d) -> str:
    """Every embedding as a NIfTI file, named by its subject and id, written in the tasks."""

    def make(uri):
        path = workspace.local_path(uri)
        os.makedirs(path, exist_ok=True)

        def run(pdfs):
            for pdf in pdfs:
                for k, a in zip(pdf["vec_id"], pdf["embedding"], strict=True):
                    nifti.write_nifti(os.path.join(path, f"p{int(k):09d}_T1w.nii"), np.asarray(a, "<f4").reshape(SHAPE), np.diag([1.0, 1.0, 2.0, 1.0]))
                yield pdf[["vec_id"]]

        s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").mapInPandas(run, "vec_id long").count()

    return workspace.local_path(workspace.once(s, d, "niftis", make))


def _series(s, d) -> str:
    """Every embedding as a DICOM series of four slices of whole numbers, written in the tasks."""

    def make(uri):
        path = workspace.local_path(uri)

        def run(pdfs):
            for pdf in pdfs:
                for k, e in zip(pdf["vec_id"], pdf["embedding"], strict=True):
                    a = np.floor(np.asarray(e, float) * 1000 + 2000).astype("uint16").reshape(SHAPE)
                    os.makedirs(f"{path}/p{int(k):09d}", exist_ok=True)
                    for z in range(SHAPE[2]):  # file names in another order than the slices
                        with open(f"{path}/p{int(k):09d}/f{(z * 3) % 4}.dcm", "wb") as f:
                            f.write(dicom.write_file(a[:, :, z].T, z + 1, (0, 0, float(z) * 2)))
                yield pdf[["vec_id"]]

        s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").mapInPandas(run, "vec_id long").count()

    return workspace.local_path(workspace.once(s, d, "series", make))


def _from_niftis(s, d) -> VolumeSet:
    return VolumeSet(s, workspace.once(s, d, "T1w", lambda uri: VolumeSet.from_niftis(s, uri, ingest.resolve_nifti(_niftis(s, d)), name="T1w")))


def _from_dicoms(s, d) -> VolumeSet:
    return VolumeSet(s, workspace.once(s, d, "scan", lambda uri: VolumeSet.from_dicoms(s, uri, ingest.resolve_dicom(_series(s, d)), name="scan")))


@_query
def source_formats(s, d):
    n, m = _niftis(s, d), _series(s, d)
    some = sorted(os.listdir(n))[0]
    cases = {"directory": n, "pattern": f"{n}/*.nii", "file": f"{n}/{some}", "pairs": [(f"{n}/{some}", "p")], "series": m, "series pairs": [(f"{m}/p000000000", "p")]}
    rows = [(k, ingest.resolve(v)[1]) for k, v in cases.items()]
    rows += [(k, "error") for k, v in {"none": [], "nowhere": f"{n}/nowhere", "text pattern": f"{n}/*.txt"}.items() if _raises(IngestError, lambda v=v: ingest.detect_format(v))]
    return _cases(s, rows, "source string, format string")


@_query
def nifti_resolve(s, d):
    """Files of a directory with their subjects, which a function of the path names."""
    found = ingest.resolve_nifti(_niftis(s, d), lambda p: ingest.default_subject_id(p).split("_")[0])
    return _cases(s, [(os.path.basename(p), subject) for p, subject in found], "file string, subject string")


@_query
def nifti_pairs(s, d):
    """Images with their labels: here every image is its own label but for those that are left out."""
    n = _niftis(s, d)
    labels = workspace.local_path(workspace.fresh(s, "labels"))
    os.makedirs(labels)
    for f in sorted(os.listdir(n)):
        if int(f[1:10]) % 3 == 0:
            os.symlink(f"{n}/{f}", f"{labels}/{f}")
    return _cases(s, [(subject, label is not None) for _, label, subject in ingest.discover_pairs(n, labels, "*.nii")], "subject string, has_label boolean")


@_query
def dicom_resolve(s, d):
    return _cases(s, [(os.path.basename(p), subject) for p, subject in ingest.resolve(_series(s, d))[0]], "directory string, subject string")


@_query
def nifti_collection(s, d):
    return _from_niftis(s, d).obs.select(SUBJECT, OBS, "series_type", "dimensions", "voxel_spacing", "datatype", "spatial_units", "axcodes", "orientation_source")


@_query
def nifti_voxels(s, d):
    return _voxels(_from_niftis(s, d))


@_query
def nifti_headers(s, d):
    n = _niftis(s, d)
    h = ingest.header_frame(s, [f"{n}/{f}" for f in sorted(os.listdir(n))])
    return h.select(naming.file_stem(F.col("source_path")).alias("stem"), "dimensions", "bitpix", "sform_code", F.from_json("affine_json", "array<array<double>>")[2][2].alias("dz"))


@_query
def dicom_collection(s, d):
    return _from_dicoms(s, d).obs.select(SUBJECT, OBS, "modality", "dimensions", "voxel_spacing", "axcodes", "orientation_source")


@_query
def dicom_voxels(s, d):
    """Slices in the order of their instance numbers, whatever their files are called: the total of each axial plane."""
    vs = _from_dicoms(s, d)
    planes = None
    for z in range(SHAPE[2]):
        p = voxels.values(vs.slices("axial", z)).groupBy(OBS).agg(F.sum("value").cast("long").alias("total")).select(OBS, F.lit(z).cast("long").alias("z"), "total")
        planes = p if planes is None else planes.unionByName(p)
    return planes


@_query
def obs_by_position(s, d):
    """Columns of a table of one's own beside the generated ones, by position."""
    pairs = ingest.resolve_nifti(_niftis(s, d))
    mine = pd.DataFrame({SUBJECT: [p[1] for p in pairs], "rank": range(len(pairs))})
    vs = VolumeSet.from_niftis(s, workspace.fresh(s, "ranked"), pairs, mine, name="T1w")
    return vs.obs.select(SUBJECT, OBS, F.col("rank").cast("long").alias("rank"))


@_query
def study_from_images(s, d):
    st = Study.from_images(s, workspace.fresh(s, "images"), {"T1w": _niftis(s, d), "scan": _series(s, d)})
    return st.all_obs.select(SUBJECT, OBS, "collection")


@_query
def study_from_collections(s, d):
    return study(s, d).all_obs


@_query
def empty_volume(s, d):
    vs = VolumeSet.zeros(s, workspace.fresh(s, "zeros"), "s1", "v1", (3, 4, 5), "int16")
    return _voxels(vs).select(OBS, "n", "total")


@_query
def uri_life(s, d):
    uri = ct(s, d).head(2).write(workspace.fresh(s, "short")).uri
    before, gone, after = uri_exists(s, uri), delete_uri(s, uri), uri_exists(s, uri)
    return _cases(s, [("before", before), ("deleted", gone), ("after", after)], "what string, is_so boolean")


# -- selection ------------------------------------------------------------------------------------


@_query
def collection_iloc(s, d):
    return ct(s, d).iloc[10:50].obs.select(SUBJECT, OBS)


@_query
def collection_iloc_list(s, d):
    return ct(s, d).iloc[[3, 1, 77, -1]].obs.select(SUBJECT, OBS)


@_query
def study_iloc(s, d):
    return study(s, d).iloc[0:120:7].obs_meta.select(SUBJECT, "c_nationkey")


@_query
def study_loc(s, d):
    return study(s, d).loc[["s000000002", "s000000077", "s000000149"]].obs_meta.select(SUBJECT, "c_nationkey")


@_query
def collection_loc(s, d):
    return ct(s, d).loc[["CT000000002", "CT000000300"]].obs.select(SUBJECT, OBS, "label")


@_query
def brackets(s, d):
    """What each kind of key selects."""
    vs, st = ct(s, d), study(s, d)
    rows = [("place", vs[3].obs_id), ("id", vs["CT000000300"].obs_id), ("last", vs[-1].obs_id)]
    rows += [("ids", r[0]) for r in vs[["CT000000002", "CT000000009"]].obs.select(OBS).collect()] + [("range", r[0]) for r in vs[2:5].obs.select(OBS).collect()]
    rows += [("subject", r[0]) for r in st["s000000007"].obs_meta.select(SUBJECT).collect()] + [("subjects", r[0]) for r in st[0:2].obs_meta.select(SUBJECT).collect()]
    rows += [("missing", "KeyError")] * _raises(KeyError, lambda: vs["nobody"]) + [("missing subject", "KeyError")] * _raises(KeyError, lambda: st.loc["nobody"])
    return _cases(s, rows, "key string, selected string")


@_query
def collection_sel(s, d):
    return ct(s, d).sel("s000000007").obs.select(SUBJECT, OBS)


@_query
def lazy_filters(s, d):
    lazy = ct(s, d).lazy().filter("label >= 3").filter_subjects([f"s{k:09d}" for k in range(0, 150, 2)]).filter_subjects([f"s{k:09d}" for k in range(0, 150, 3)])
    return lazy.to_obs().select(SUBJECT, OBS, "label")


@_query
def lazy_many_subjects(s, d):
    """More subjects than a literal list holds: resolved by a join."""
    return ct(s, d).lazy().filter_subjects([f"s{k:09d}" for k in range(5, 3000)]).filter("label < 5").to_obs().select(SUBJECT, OBS)


@_query
def lazy_iloc_loc(s, d):
    return ct(s, d).lazy().iloc[0:200].filter("label in [1, 2]").to_obs().select(SUBJECT, OBS)


@_query
def lazy_head_of_root(s, d):
    """The first 100 of the root that pass, not the first 100 that pass; and the same from the end."""
    lazy = ct(s, d).lazy().filter("label >= 5")
    return lazy.head(100).to_obs().select(OBS, F.lit("head").alias("side")).unionByName(lazy.tail(60).to_obs().select(OBS, F.lit("tail").alias("side")))


@_query
def some_collections(s, d):
    st = study(s, d)
    view = st.select_collections(["MR"])
    rows = [("root", n) for n in st.collection_names] + [("view", n) for n in view.collection_names] + [("missing", "KeyError")] * _raises(KeyError, lambda: view.collection("CT"))
    return _cases(s, rows, "study string, collection string")


@_query
def collection_by_name(s, d):
    st = study(s, d)
    return st.MR.obs.select(SUBJECT, OBS).unionByName(st.collection("CT").filter("label == 9").obs.select(SUBJECT, OBS))


@_query
def one_volume(s, d):
    """A volume of the study, read whole."""
    a = study(s, d).get_volume("MR000000042").to_numpy()
    return _cases(s, [(p, round(float(v), 6)) for p, v in enumerate(a.ravel())], "p long, value double")


@_query
def row_lookup(s, d):
    one = study(s, d).get_obs_row_by_obs_subject_id("s000000007")
    two = ct(s, d).get_obs_row_by_obs_id("CT000000300")
    return _cases(s, [("subject", one[SUBJECT][0], int(one["c_nationkey"][0])), ("volume", two[OBS][0], int(two["label"][0]))], "kind string, key string, value long")


@_query
def view_obs(s, d):
    """The volumes of a view's subjects, and with a filter of their own on top."""
    view = study(s, d).filter("c_acctbal > 3000 and c_nationkey < 12")
    return view.CT.obs.select(OBS, F.lit("CT").alias("kind")).unionByName(view.MR.filter("label <= 4").obs.select(OBS, F.lit("MR").alias("kind")))


@_query
def view_guard(s, d):
    st, vs = study(s, d), ct(s, d)
    view, few = st.filter("c_acctbal > 0"), vs.filter("label == 1")
    cases = {
        "study is none": not st.is_view, "view is one": view.is_view, "collection of a view is one": view.CT.is_view, "copy of a view is one": view.copy().is_view,
        "view refuses a collection": _raises(ViewError, lambda: view.add_collection("x", vs)), "view refuses renaming": _raises(ViewError, lambda: view.rename_collection("CT", "x")),
        "view refuses volumes": _raises(ViewError, lambda: few.append(niftis=[("a.nii", "p")])), "view refuses an id": _raises(ViewError, lambda: few.rename_volume("CT000000001", "x")),
    }
    return _cases(s, list(cases.items()), "what string, is_so boolean")


@_query
def view_algebra(s, d):
    """Keys of two views: in both, in one alone, in either."""
    a, b = study(s, d).filter("c_acctbal > 3000").index, study(s, d).filter("c_nationkey < 8").index
    rows = [(k, x) for k, keys in (("and", a & b), ("minus", a - b), ("xor", a ^ b), ("or", a | b)) for x in keys]
    return _cases(s, rows, f"op string, {SUBJECT} string")


@_query
def collection_head_tail(s, d):
    vs = ct(s, d)
    return vs.head(7).obs.select(OBS, F.lit("head").alias("side")).unionByName(vs.tail(5).obs.select(OBS, F.lit("tail").alias("side")))


@_query
def study_head_tail(s, d):
    st = study(s, d)
    return st.head(7).obs_meta.select(SUBJECT, F.lit("head").alias("side")).unionByName(st.tail(5).obs_meta.select(SUBJECT, F.lit("tail").alias("side")))


@_query
def study_sample(s, d):
    """Twenty of all subjects, by a seed."""
    return study(s, d).sample(20, 42).obs_meta.select(SUBJECT)


@_query
def collection_sample(s, d):
    return ct(s, d).sample(20, 7).obs.select(OBS)


@_query
def lazy_sample(s, d):
    return ct(s, d).lazy().filter("label >= 5").sample(20, 7).to_obs().select(OBS, "label")


@_query
def canonical_order(s, d):
    return _cases(s, list(enumerate(ct(s, d).index)), f"pos long, {OBS} string")


# -- index ------------------------------------------------------------------------------------------


@_query
def index_take_mask(s, d):
    index = ct(s, d).index
    rows = [("take", k) for k in index.take([5, 2, 9])] + [("mask", k) for k in index.mask([i % 50 == 3 for i in range(len(index))])]
    rows += [("short mask", "ValueError")] * _raises(ValueError, lambda: index.mask([True])) + [("outside", "IndexError")] * _raises(IndexError, lambda: index.take([10**9]))
    return _cases(s, rows, "op string, key string")


@_query
def index_lookup(s, d):
    index = ct(s, d).index
    rows = [("get_index", index.get_index("CT000000300")), ("get_key", int(index.get_key(11)[2:])), ("contains", int("CT000000300" in index)), ("lacks", int("x" in index)), ("length", len(index))]
    rows += [("repeated keys", 1)] * _raises(ValueError, lambda: KeyIndex(["a", "a"]))
    return _cases(s, rows, "op string, value long")


@_query
def index_relations(s, d):
    a, b = ct(s, d).index, ct(s, d).filter("label < 5").index
    cases = {"subset": b <= a, "superset": a >= b, "not subset": a <= b, "equal": a == KeyIndex(list(a), OBS), "aligned": a.is_aligned(KeyIndex(a)), "other order is not": a.is_aligned(KeyIndex(list(a)[::-1]))}
    return _cases(s, list(cases.items()), "relation string, holds boolean")


# -- joins and aggregates -----------------------------------------------------------------------------


@_query
def tiles_of_view(s, d):
    """Volumes of a filter with their tiles."""
    t = ct(s, d).filter("label == 3").tiles
    return t.groupBy(OBS).agg(F.count("*").alias("tiles"), F.sum(F.length("voxels")).alias("bytes"))


@_query
def channel_samples(s, d):
    """Image and mask as two channels of every sample, put together in the plan."""
    cut = SampleFrame([ct(s, d), seg(s, d)]).cut()

    def run(pdfs):
        for pdf in pdfs:
            rows = []
            for k, shape, kind, raw in zip(pdf[OBS], pdf["shape"], pdf["dtype"], pdf["voxels"], strict=True):
                a = np.frombuffer(raw, kind).reshape([int(x) for x in shape]).astype(float)
                rows += [(k, p, round(float(x), 6), float(y)) for p, (x, y) in enumerate(zip(a[0].ravel(), a[1].ravel(), strict=True))]
            yield pd.DataFrame(rows, columns=[OBS, "p", "c0", "c1"])

    return cut.mapInPandas(run, f"{OBS} string, p long, c0 double, c1 double")


@_query
def sample_labels(s, d):
    """Labels from a table by obs_id; volumes without one are left out."""
    labels = s.read.parquet(f"{d}/labels.parquet").where("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return samples.label_frame(ct(s, d), labels.select(_key("CT", F.col("doc_id")).alias(OBS), "toxic"))


@_query
def label_function(s, d):
    """Labels by a function of obs_id, and by a column."""
    vs = ct(s, d)
    by_call = samples.label_frame(vs, lambda k: int(k[2:]) % 7).select(OBS, F.lit("function").alias("source"), F.col("label").cast("long").alias("label"))
    return by_call.unionByName(samples.label_frame(vs, "label").select(OBS, F.lit("column").alias("source"), F.col("label").cast("long").alias("label")))


@_query
def collection_counts(s, d):
    st = study(s, d)
    rows = [("subjects", len(st)), ("collections", st.n_collections), ("CT", len(st.CT)), ("MR", len(st.MR)), ("view of CT", len(st.CT.filter("label == 1"))), ("view of subjects", len(st.filter("c_nationkey == 3")))]
    return _cases(s, rows, "what string, n long")


@_query
def subject_counts(s, d):
    return ct(s, d).subject_counts()


@_query
def subject_views(s, d):
    """A view for each subject of a filter, one after the other."""
    some = ct(s, d).filter("obs_subject_id in ['s000000003', 's000000011']")
    return _cases(s, [(subject, r[0]) for subject, view in some.groupby_subject() for r in view.obs.select(OBS).collect()], f"{SUBJECT} string, {OBS} string")


@_query
def voxel_statistics(s, d):
    st = ct(s, d).statistics([25, 90])
    return st.select(OBS, "n", *(F.round(c, 6).alias(c) for c in ("mean", "std", "min", "max", "median", "p25", "p90")))


@_query
def voxel_histogram(s, d):
    h = ct(s, d).histogram(8, -0.4, 0.4)
    return h.select(OBS, F.col("bin").cast("long").alias("bin"), "n")


@_query
def voxel_histogram_own_range(s, d):
    """Each volume over its own range: the counts add up to its voxels."""
    h = ct(s, d).histogram(5)
    return h.groupBy(OBS).agg(F.count("*").alias("bins"), F.sum("n").alias("n"), F.round(F.min("lo"), 6).alias("lo"), F.round(F.max("hi"), 6).alias("hi"))


@_query
def study_describe(s, d):
    found = study(s, d).describe()
    rows = [("c_mktsegment", k, n) for k, n in found["labels"]["c_mktsegment"].items()] + [("subjects", "", found["subjects"])] + [("volumes", c, v["volumes"]) for c, v in found["collections"].items()]
    return _cases(s, rows, "what string, value string, n long")


@_query
def volume_shapes(s, d):
    return samples.volume_shapes(ct(s, d)).select(F.col("shape")[0].cast("long").alias("x"), F.col("shape")[1].cast("long").alias("y"), F.col("shape")[2].cast("long").alias("z"), "n")


@_query
def mask_foreground(s, d):
    return seg(s, d).foreground()


@_query
def all_obs_ids(s, d):
    return _cases(s, [(i,) for i in study(s, d).all_obs_ids], f"{OBS} string")


@_query
def scan_counters(s, d):
    """Rows that a scan reads, by Spark's own counters."""
    found = stats.scan_stats(ct(s, d).root_obs)
    return _cases(s, [("rows", found.rows), ("scans", found.scans)], "what string, n long")


# -- voxels -------------------------------------------------------------------------------------------


@_query
def tiles_axial(s, d):
    return _sums(ct(s, d).slices("axial", 2))


@_query
def tiles_sagittal(s, d):
    return _sums(ct(s, d).slices("sagittal", 1))


@_query
def tiles_coronal(s, d):
    return _sums(ct(s, d).slices("coronal", 3))


@_query
def tiles_region(s, d):
    return _sums(ct(s, d).boxes(((1, 3), (0, 2), (2, 4))))


@_query
def volume_reads(s, d):
    """NumPy-like reads of one volume."""
    v = ct(s, d).volume("CT000000300")
    reads = {"axial": v.axial(1), "coronal": v.coronal(2), "sagittal": v.sagittal(0), "box": v[1:3, :2, 2:], "line": v[1, 2], "voxel": np.asarray(v[1, 2, 3]), "slice": v.slice(slice(0, 2)), "negative": v[-1, :, -2]}
    rows = [(k, int(a.size), round(float(a.astype(float).sum()), 4)) for k, a in reads.items()]
    return _cases(s, rows, "read string, n long, total double")


@_query
def volume_properties(s, d):
    v = ct(s, d).volume("CT000000300")
    rows = [("shape", "x".join(map(str, v.shape))), ("ndim", str(v.ndim)), ("dtype", str(v.dtype)), ("tile", "x".join(map(str, v.tile))), ("tiles", v.tile_orientation), ("obs_id", v.obs_id)]
    return _cases(s, rows, "property string, value string")


@_query
def volume_numbers(s, d):
    """Statistics and histogram of one volume."""
    v = ct(s, d).volume("CT000000300")
    counts, edges = v.compute_histogram(4, (-1.0, 1.0))
    rows = [(k, round(x, 6)) for k, x in v.get_statistics([25, 75]).items()] + [(f"bin {i}", float(n)) for i, n in enumerate(counts)] + [("edges", float(len(edges)))]
    return _cases(s, rows, "what string, value double")


@_query
def stacked_head(s, d):
    """The first eight volumes as one array, and one after the other."""
    lazy = ct(s, d).lazy().head(8)
    stack = lazy.to_numpy_stack()
    rows = [(i, stack.ndim, round(float(a.astype(float).sum()), 4), round(float(v.to_numpy().astype(float).sum()), 4)) for i, (a, v) in enumerate(zip(stack, lazy.iter_volumes(), strict=True))]
    return _cases(s, rows, "place long, axes long, total double, again double")


@_query
def tile_extents(s, d):
    kinds = {o.value: TileConfig(o, cube=8).extents((20, 30, 5)) for o in SliceOrientation} | {"given": TileConfig(x=3, y=4, z=50).extents((20, 30, 5)), "four axes": TileConfig(SliceOrientation.CORONAL, t=2).extents((20, 30, 5, 9))}
    return _cases(s, [(k, "x".join(map(str, v))) for k, v in kinds.items()], "tiles string, extents string")


def _reoriented(s, d, target: str) -> DataFrame:
    def turn(a, row):
        return orientation.reorient(a, np.eye(4), target)[0]

    cells = lambda k, a: [(int(k[2:]), int(x), int(y), int(z), round(float(v), 6)) for (x, y, z), v in np.ndenumerate(a)]
    return _results(ct(s, d).map(turn), "vec_id long, x int, y int, z int, value double", cells)


@_query
def volumes_las(s, d):
    return _reoriented(s, d, "LAS")


@_query
def volumes_lps(s, d):
    return _reoriented(s, d, "LPS")


AFFINES = {
    "identity": np.eye(4), "spaced": np.diag([1.0, 1.0, 2.0, 1.0]), "flipped": np.diag([-1.0, -1.0, 3.0, 1.0]), "turned": np.array([[0.0, 0, 2, 1], [1, 0, 0, 2], [0, -1, 0, 3], [0, 0, 0, 1]]),
    "sheared": np.array([[1.0, 0.5, 0, 0], [0, 1, 0, 0], [0, 0, 2, 0], [0, 0, 0, 1]]), "flat": np.diag([1.0, 1.0, 0.0, 1.0]),
}


@_query
def orientations(s, d):
    """Axis codes, validity, and the way through a header's attributes and back."""
    rows = []
    for k, a in AFFINES.items():
        o = orientation.detect(a, "sform")
        rows.append((k, "".join(o.axcodes), orientation.is_valid(a), o.confidence, orientation.orientation_from_meta(orientation.orientation_to_meta(o)) == o))
    return _cases(s, rows, "affine string, axcodes string, is_valid boolean, confidence string, returns boolean")


@_query
def nifti_export(s, d):
    """Every volume as a file, and the files as a collection again."""
    path = workspace.local_path(workspace.fresh(s, "export"))
    files = [(r["path"], r[OBS]) for r in ct(s, d).export_niftis(path).collect()]
    back = VolumeSet.from_niftis(s, workspace.fresh(s, "again"), files, name="back")
    return _voxels(back).select(F.regexp_extract(OBS, "(CT[0-9]+)", 1).alias(OBS), "n", "total")


@_query
def renamed_volume(s, d):
    """A volume under another id: rows, header, tiles and reads follow, and the old id is free again."""
    vs = ct(s, d).loc[["CT000000001", "CT000000002", "CT000000003"]].write(workspace.fresh(s, "few"))
    v = vs.volume("CT000000002").set_obs_id("X2")
    same = bool((v.to_numpy() == ct(s, d).volume("CT000000002").to_numpy()).all())
    vs.volume("CT000000001").set_obs_id("CT000000002")
    vs.validate()
    return _voxels(vs).join(vs.obs.select(OBS, "label"), OBS).select(OBS, "label", "total", F.lit(same).alias("same"))


# -- maps ---------------------------------------------------------------------------------------------


@_query
def mapped_normalized(s, d):
    """(v - mean) / deviation of every volume, by an eager map."""
    m = ct(s, d).map(lambda a, row: (a.astype(float) - a.astype(float).mean()) / a.astype(float).std())
    return _results(m, "vec_id long, p long, value double", lambda k, a: [(int(k[2:]), p, round(float(v), 5)) for p, v in enumerate(a.ravel())])


@_query
def mapped_updates(s, d):
    """New columns from a map, as a typed table."""
    m = ct(s, d).map(lambda a, row: (a, {"peak": round(float(a.max()), 6), "positive": bool(a.astype(float).mean() > 0), "twice": 2 * row["label"], "kind": f"l{row['label']}"}))
    return m.to_dataframe()


@_query
def mapped_update_kinds(s, d):
    m = ct(s, d).map(lambda a, row: (1, {"i": 1, "f": 1.5, "b": True, "t": "x", "mixed": 1 if row["label"] else 2.5}))
    return _cases(s, sorted(m.update_kinds().items()), "column string, kind string")


@_query
def mapped_chain(s, d):
    """A function on the results of a map sees its updates."""
    m = ct(s, d).map(lambda a, row: (np.clip(a.astype(float), 0, None), {"kept": int((a > 0).sum())})).map(lambda a, row: round(float(a.sum() * row["kept"]), 4))
    return _results(m, "vec_id long, value double", lambda k, v: [(int(k[2:]), v)])


@_query
def mapped_composed(s, d):
    """Lazy functions run as one pass."""
    m = ct(s, d).lazy().filter("label >= 2").map(lambda a, row: (a.astype(float) + row["label"], {"n": 1})).map(lambda a, row: float(a.sum()) * row["n"]).run()
    return _results(m, "vec_id long, value double", lambda k, v: [(int(k[2:]), round(v, 4))])


@_query
def mapped_batches(s, d):
    """Each volume's total within its batch of eight (canonical order)."""

    def totals(items):
        return [round(sum(float(a.astype(float).sum()) for a, _ in items), 4)] * len(items)

    return _results(ct(s, d).map_batches(totals, 8), "vec_id long, in_batch double", lambda k, v: [(int(k[2:]), v)])


@_query
def mapped_extract(s, d):
    """Results as a list, by place and one after the other."""
    m = ct(s, d).head(6).map(lambda a, row: row["label"])
    again = list(m)
    return _cases(s, [(i, int(x), int(y), int(m[i])) for i, (x, y) in enumerate(zip(m.to_list(), again, strict=True))], "place long, label long, again long, by_place long")


@_query
def mapped_summaries(s, d):
    """How results show in a table."""
    return ct(s, d).head(3).map(lambda a, row: a[:2]).to_dataframe(["result"]).unionByName(ct(s, d).head(2).map(lambda a, row: 1.25).to_dataframe(["result"]))


@_query
def transforms(s, d):
    """A transform of samples, composed of two."""
    f = SampleFrame([ct(s, d).head(4)], transform=samples.Compose([lambda x: x | {"image": x["image"] * 2}, lambda x: x | {"n": int(x["image"].size)}]))
    return _cases(s, [(x["obs_id"], x["n"], round(float(x["image"].astype(float).sum()), 4)) for x in f], f"{OBS} string, n long, total double")


@_query
def composed_updates(s, d):
    run = composed([lambda v, row: (v + row["a"], {"b": 10}), lambda v, row: v * row["b"], lambda v, row: (v, {"c": v})])
    value, updates = run(1, {"a": 2})
    return _cases(s, [("value", value), *sorted(updates.items())], "what string, value long")


# -- writing and changing -----------------------------------------------------------------------------


@_query
def table_life(s, d):
    """A table made empty, filled, changed and read back."""
    t = MetaTable.create(s, workspace.fresh(s, "table"), {"label": "int32", "score": float, "note": "U8"})
    rows = _rows(s, d, "CT")
    t.append(rows.select(SUBJECT, OBS, "label", (F.col("label") / 2).alias("score")))
    t.update(rows.where("vec_id < 20").select(SUBJECT, OBS, F.lit("low").alias("note"), F.lit(-1.0).alias("score")), columns=["note"])
    t.add_column("site", "U4", "A1")
    t.delete("label == 9")
    return t.read(["note", "score", "site"], "label >= 3")


@_query
def written_collection(s, d):
    out = ct(s, d).filter("label >= 6").write(workspace.fresh(s, "high"), "high")
    again = VolumeSet(s, out.uri)
    again.validate()
    return _voxels(again)


@_query
def written_study(s, d):
    """A view as a study of its own; obs_ids are those of its volumes."""
    out = study(s, d).filter("c_nationkey < 6").write(workspace.fresh(s, "part"))
    again = Study(s, out.uri)
    again.validate()
    return again.obs_meta.select(SUBJECT, "obs_ids")


@_query
def written_map(s, d):
    """Array results as a collection, updates as its columns."""
    out = ct(s, d).filter("label == 4").map(lambda a, row: (a[:2] * 2, {"peak": round(float(a.max()), 6)})).write(workspace.fresh(s, "twice"), "CT")
    out.validate()
    return _voxels(VolumeSet(s, out.uri)).join(out.obs.select(OBS, "peak", "label", SUBJECT), OBS)


@_query
def written_lazy(s, d):
    """Filters and functions to come, written in one pass."""
    out = ct(s, d).lazy().filter("label < 3").head(120).map(lambda a, row: a + row["label"]).map(lambda a, row: a.astype("float32")).write(workspace.fresh(s, "lazy"), "moved")
    return _voxels(out).join(out.obs.select(OBS, SUBJECT), OBS).groupBy(SUBJECT).agg(F.sum("n").alias("n"), F.round(F.sum("total"), 2).alias("total"))


@_query
def collection_writer(s, d):
    """Volumes one by one, with attributes; nothing shows before the end."""
    uri = workspace.fresh(s, "one-by-one")
    w = VolumeSetWriter(s, uri, "mine")
    for k in range(3):
        w.write_volume(np.full((2, 3, k + 1), k, "int16"), f"v{k}", f"p{k}", {"age": 40 + k})
    hidden = not uri_exists(s, f"{uri}/_collection.json")
    out = w.finalize()
    broken = workspace.fresh(s, "broken")

    def fail():
        with VolumeSetWriter(s, broken) as bad:
            bad.write_volume(np.zeros((2, 2, 2)), "v", "p")
            raise RuntimeError

    left = _raises(RuntimeError, fail) and not uri_exists(s, f"{broken}/_collection.json")
    return _voxels(out).join(out.obs, OBS).select(OBS, SUBJECT, F.col("age").cast("long").alias("age"), "n", "total", F.lit(hidden).alias("hidden"), F.lit(left).alias("nothing_left"))


@_query
def study_writer(s, d):
    uri = workspace.fresh(s, "written")
    with StudyWriter(s, uri) as w:
        w.write_obs_meta(subjects(s, d).where("c_nationkey = 3").select(SUBJECT, "c_nationkey"))
        who = [r[0] for r in subjects(s, d).where("c_nationkey = 3").orderBy(SUBJECT).limit(2).collect()]
        one, two = w.add_collection("one"), w.add_collection("two")
        one.write_batch([(np.ones((2, 2, 2), "float32"), "a", who[0]), (np.ones((2, 2, 2), "float32"), "b", who[1])])
        two.write_volume(np.ones((3, 3, 3), "float32"), "c", who[0])
    out = Study(s, uri)
    out.validate()
    return out.obs_meta.select(SUBJECT, "c_nationkey", F.regexp_replace("obs_ids", '"', "").alias("obs_ids"))


def _pairs(s, d, keep) -> list[tuple[str, str]]:
    return [(p, subject) for p, subject in ingest.resolve_nifti(_niftis(s, d), lambda p: ingest.default_subject_id(p).split("_")[0]) if keep(int(subject[1:]))]


@_query
def appended_volumes(s, d):
    """More files for a collection: a subject's second volume is its first acquisition more."""
    vs = VolumeSet.from_niftis(s, workspace.fresh(s, "grown"), _pairs(s, d, lambda k: k % 5 == 0), name="T1w")
    vs.append(niftis=_pairs(s, d, lambda k: k % 10 == 0 or k % 5 == 1))
    vs.validate()
    return vs.obs.select(SUBJECT, OBS)


@_query
def appended_study(s, d):
    """More images and subjects for a study, one of the collections new."""
    st = Study.from_images(s, workspace.fresh(s, "growing"), {"T1w": _pairs(s, d, lambda k: k % 7 == 0)})
    new = _pairs(s, d, lambda k: k % 7 == 1)
    st.append({"T1w": new, "T2w": _pairs(s, d, lambda k: k % 14 == 0)}, pd.DataFrame({SUBJECT: [p[1] for p in new]}))
    st.validate()
    return st.obs_meta.select(SUBJECT, "obs_ids")


@_query
def added_collection(s, d):
    """A collection more, one under another name, and what is refused."""
    st = study(s, d).filter("c_nationkey < 3").write(workspace.fresh(s, "more"))
    high = VolumeSet.from_table(s, workspace.fresh(s, "extra"), _rows(s, d, "EX").join(st.obs_meta.select(SUBJECT), SUBJECT, "left_semi"), "embedding", SHAPE, "EX")
    st.add_collection("EX", high)
    refused = _raises(ValueError, lambda: st.add_collection("EX", high)) and _raises(AlignmentError, lambda: st.add_collection("all", ct(s, d)))
    st.rename_collection("MR", "T2")
    again = Study(s, st.uri)
    again.validate()
    return again.all_obs.groupBy("collection").agg(F.count("*").alias("n")).withColumn("refused", F.lit(refused))


@_query
def copied_collection(s, d):
    """A copy of a view holds the view's rows."""
    view = ct(s, d).filter("label == 2")
    return view.copy().obs.select(SUBJECT, OBS)


@_query
def collection_faults(s, d):
    """A sound collection passes; one whose obs lack a row, hold one twice or whose tiles are gone does not."""
    vs = ct(s, d).head(4).write(workspace.fresh(s, "sound"))
    vs.validate()

    def broken(obs, tiles):
        from tomolake.operators.volumeset import commit, write_tiles

        uri = workspace.fresh(s, "unsound")
        commit(s, uri, "x", obs, vs.headers, [write_tiles(tiles, uri)])
        return _raises(AlignmentError, VolumeSet(s, uri).validate)

    first = vs.index.to_list()[0]
    cases = {
        "sound": not _raises(AlignmentError, vs.validate), "row missing": broken(vs.obs.where(F.col(OBS) != first), vs.tiles), "row twice": broken(vs.obs.unionByName(vs.obs.where(F.col(OBS) == first)), vs.tiles),
        "tiles missing": broken(vs.obs, vs.tiles.where(~((F.col(OBS) == first) & (F.col("cz") == 1)))),
    }
    return _cases(s, list(cases.items()), "collection string, is_so boolean")


@_query
def every_study_fault(s, d):
    """All four faults of a study at once."""
    meta = s.createDataFrame([("a", '["1"]'), ("b", '["2","3"]'), ("b", '["2","3"]'), ("c", '["9"]')], f"{SUBJECT} string, obs_ids string")
    one = s.createDataFrame([("a", "1"), ("b", "2"), ("z", "7")], f"{SUBJECT} string, {OBS} string")
    two = s.createDataFrame([("b", "3"), ("a", "7")], f"{SUBJECT} string, {OBS} string")
    return frames.study_faults(meta, {"one": one, "two": two})


@_query
def guards(s, d):
    """What is refused, and with which error."""
    vs, st = ct(s, d), study(s, d)
    bad = {
        "column exists": (SchemaError, lambda: frames.add_column(vs.obs, "label", "int")), "key column": (SchemaError, lambda: frames.drop_column(vs.obs, OBS, (OBS,))),
        "no such column": (TomolakeError, lambda: vs.filter("nothing == 1").obs.collect()), "unknown type": (SchemaError, lambda: MetaTable.create(s, workspace.fresh(s, "t"), {"x": "complex"})),
        "table exists": (StorageError, lambda: vs.write(vs.uri)), "nothing there": (StorageError, lambda: VolumeSet(s, workspace.fresh(s, "none"))), "patch too large": (ShapeError, lambda: SampleFrame([vs], SampleConfig(Loading.PATCH, (5, 1, 1)))),
        "not aligned": (AlignmentError, lambda: samples.check_alignment([vs, mr(s, d)])), "no subjects": (SchemaError, lambda: Study.from_images(s, workspace.fresh(s, "t"), {"a": _niftis(s, d)}, pd.DataFrame({"x": [1]}))),
        "no such collection": (KeyError, lambda: st.collection("PET")), "outside": (IndexError, lambda: vs.iloc[10**9]), "two axes": (ShapeError, lambda: voxels.check_shape((3, 4))),
    }
    return _cases(s, [(k, kind.__name__, _raises(kind, f)) for k, (kind, f) in bad.items()], "what string, error string, is_raised boolean")


# -- samples ------------------------------------------------------------------------------------------


def _sampled(cut: DataFrame, column: str = "voxels", kind: str = "dtype") -> DataFrame:
    def run(pdfs):
        for pdf in pdfs:
            yield pd.DataFrame({"idx": pdf["idx"], OBS: pdf[OBS], "n": [len(np.frombuffer(v, k)) for v, k in zip(pdf[column], pdf[kind], strict=True)], "total": [round(float(np.frombuffer(v, k).astype(float).sum()), 4) for v, k in zip(pdf[column], pdf[kind], strict=True)]})

    return cut.mapInPandas(run, f"idx long, {OBS} string, n long, total double")


@_query
def volume_samples(s, d):
    return _sampled(SampleFrame([ct(s, d)]).cut())


@_query
def patch_draws(s, d):
    """Two patches of every volume, drawn by the sample's number."""
    return _sampled(SampleFrame([ct(s, d)], SampleConfig(Loading.PATCH, (2, 2, 2), 2)).cut())


@_query
def slice_samples(s, d):
    return _sampled(SampleFrame([ct(s, d)], SampleConfig(Loading.SLICE_2D, orientation="coronal")).cut())


@_query
def pair_samples(s, d):
    """Every image with its mask: voxels under the mask."""
    cut = SegmentationFrame(ct(s, d), seg(s, d)).cut()

    def run(pdfs):
        for pdf in pdfs:
            rows = []
            for i, k, m, a, b, ka, kb in zip(pdf["idx"], pdf[OBS], pdf["mask_obs_id"], pdf["image"], pdf["mask"], pdf["dtype"], pdf["mask_dtype"], strict=True):
                x, y = np.frombuffer(a, ka).astype(float), np.frombuffer(b, kb)
                rows.append((i, k, m, int((y != 0).sum()), round(float(x[y != 0].sum()), 4)))
            yield pd.DataFrame(rows, columns=["idx", OBS, "mask_obs_id", "n", "total"])

    return cut.mapInPandas(run, f"idx long, {OBS} string, mask_obs_id string, n long, total double")


@_query
def guided_patches(s, d):
    """Patches that follow the foreground of every mask: how much of it they hold."""
    cut = SegmentationFrame(ct(s, d), seg(s, d), (2, 2, 2), 2, foreground_prob=1.0, seed=3).cut()
    return _sampled(cut.select("idx", OBS, F.col("mask").alias("voxels"), F.col("mask_dtype").alias("dtype")))


@_query
def loader_batches(s, d):
    """Batches of a validation loader, cut by threads; those without workers are the same."""
    f = SampleFrame([ct(s, d).head(10)])
    rows = [(k, o, round(float(a.astype(float).sum()), 4)) for k, b in enumerate(samples.validation_loader(f, 4, workers=3)) for o, a in zip(b["obs_id"], b["image"], strict=True)]
    plain = [(k, o, round(float(a.astype(float).sum()), 4)) for k, b in enumerate(samples.validation_loader(f, 4)) for o, a in zip(b["obs_id"], b["image"], strict=True)]
    return _cases(s, [(*r, rows == plain) for r in rows], f"batch long, {OBS} string, total double, same boolean")


@_query
def training_epochs(s, d):
    """Two epochs of a shuffled loader: whole batches of other orders over the same samples."""
    f = SampleFrame([ct(s, d)])
    t = samples.training_loader(f, 16, seed=1)
    one = t.order()
    t.set_epoch(1)
    two = t.order()
    pair = samples.segmentation_loader(ct(s, d).head(5), seg(s, d).head(5), 2, (2, 2, 2))
    rows = [("samples", len(f)), ("batches", len(t)), ("differ", int(one != two)), ("same samples", int(sorted(one) == sorted(two) == list(range(len(f))))), ("pair batches", len(pair)), ("inference", len(samples.inference_loader(f)))]
    return _cases(s, rows, "what string, n long")


@_query
def loader_ranks(s, d):
    """Every rank's samples of an unshuffled loader; they are equally many."""
    f = SampleFrame([ct(s, d)])
    return _cases(s, [(r, i) for r in range(3) for i in samples.distributed_loader(f, r, 3, shuffle=False).order()], "rank long, idx long")


@_query
def dataset_of_collection(s, d):
    f = ct(s, d).filter("label == 1").to_dataset(patch_size=(2, 2, 2))
    return _cases(s, [("samples", len(f)), ("patch", int(f[0]["image"].size))], "what string, n long")


@_query
def settings(s, d):
    """Bounds of the settings, and their defaults."""
    bad = {
        "tile of 0": lambda: TileConfig(x=0), "level below 0": lambda: CompressionConfig(level=-1), "unknown orientation": lambda: OrientationConfig("XYZ"), "no workers": lambda: ReadConfig(max_workers=0),
        "patch without size": lambda: SampleConfig(Loading.PATCH), "no patches": lambda: SampleConfig(patches_per_volume=0), "unknown plane": lambda: SampleConfig(orientation="up"),
    }
    rows = [(k, "refused") for k, f in bad.items() if _raises(ConfigurationError, f)]
    c = get_config()
    rows += [("workers", str(c.read.max_workers)), ("tiles", c.write.tile.orientation.value), ("target", c.write.orientation.target)]
    return _cases(s, rows, "setting string, value string")


@_query
def store_options(s, d):
    """What the settings of an object store set in the session's Hadoop options; they are put back afterwards."""
    from tomolake.config import S3Config

    conf = s.sparkContext._jsc.hadoopConfiguration()
    keys = ["fs.s3a.endpoint.region", "fs.s3a.endpoint", "fs.s3a.path.style.access", "fs.s3a.multipart.size"]
    before = {k: conf.get(k) for k in keys}
    S3Config(region="eu-west-1", endpoint="http://store:9000", use_virtual_addressing=False, multipart_mb=32).apply(s)
    rows = [(k, conf.get(k)) for k in keys]
    for k, v in before.items():
        conf.unset(k) if v is None else conf.set(k, v)
    return _cases(s, rows, "option string, value string")


@_query
def exported_names(s, d):
    """Every public name resolves."""
    import tomolake

    return _cases(s, [(k, getattr(tomolake, k).__name__ == k) for k in tomolake.__all__], "name string, resolves boolean").groupBy("resolves").agg(F.count("*").alias("n")).where("n >= 30").select("resolves")


@_query
def arrived_volumes(s, d):
    """Files that arrive in a folder in two waves, as a stream appends them; what a third run finds again is not new."""
    from tomolake.streaming.arrivals import append_arrivals

    n, uri = _niftis(s, d), workspace.fresh(s, "seen")
    folder = workspace.local_path(workspace.fresh(s, "arrivals"))
    os.makedirs(folder)
    for wave, marks in ((0, "a"), (1, "b"), (None, "c")):
        for f in sorted(os.listdir(n)) if wave is not None else []:
            if int(f[1:10]) % 4 == wave:
                os.link(f"{n}/{f}", f"{folder}/{f}")
        append_arrivals(s, folder, uri, "seen", workspace.fresh(s, "progress") if marks == "c" else f"{uri}-progress", "*.nii").awaitTermination()
    return VolumeSet(s, uri).obs.select(SUBJECT, OBS)


@_query
def small_functions(s, d):
    """Functions of names and values on the driver."""
    rows = [
        ("stem", ingest.default_subject_id("/a/b/lung_001.nii.gz")), ("summary of array", naming.result_summary(np.zeros((2, 3), "int16"))), ("summary of number", naming.result_summary(1.25)), ("summary of text", naming.result_summary("x")),
        ("named sibling", naming.adjacent_uri("/x/ct", "mr")), ("sibling", naming.adjacent_uri("/x/ct")), ("tuple", naming.tuple_text((1.0, 2.5))), ("affine", json.dumps(json.loads(naming.affine_to_json(np.eye(4)))[3])),
    ]
    return _cases(s, rows, "what string, value string")


@_query
def nan_defaults(s, d):
    c = s.read.parquet(f"{d}/customer.parquet")
    x = F.when(F.col("c_custkey") % 3 == 0, F.lit(float("nan"))).when(F.col("c_custkey") % 3 == 1, F.lit(None).cast("double")).otherwise(F.col("c_acctbal"))
    return c.select("c_custkey", naming.nan_to(x, 1.5).alias("value"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)
