import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tomolake.config import SliceOrientation, TileConfig, WriteConfig, configure
from tomolake.errors import AlignmentError, SchemaError, ShapeError, StorageError, ViewError
from tomolake.operators.meta import MetaTable
from tomolake.operators.study import Study
from tomolake.operators.volumeset import VolumeSet
from tomolake.operators.writers import StudyWriter, VolumeSetWriter


@pytest.fixture(scope="module")
def arrays():
    rng = np.random.default_rng(0)
    return {f"s{i}": rng.normal(size=(6, 5, 4)).astype("float32") for i in range(5)}


@pytest.fixture(scope="module")
def study(spark, tmp_path_factory, arrays):
    uri = str(tmp_path_factory.mktemp("study") / "a")
    with StudyWriter(spark, uri) as w:
        w.write_obs_meta(pd.DataFrame({"obs_subject_id": list(arrays), "age": [30, 40, 50, 60, 70], "diagnosis": ["healthy", "tumor", "tumor", "healthy", "tumor"]}))
        ct, seg = w.add_collection("CT", (6, 5, 4)), w.add_collection("seg")
        for k, (s, a) in enumerate(arrays.items()):
            ct.write_volume(a, f"{s}_CT", s, {"dose": float(k), "site": "x" if k % 2 else "y"})
            seg.write_volume((a > 0.5).astype("uint8"), f"{s}_seg", s)
        assert w.collection_names == ["CT", "seg"] and ct.n_written == 5
    return Study(spark, uri)


def test_open_and_describe(study):
    assert len(study) == 5 and study.n_collections == 2 and study.collection_names == ["CT", "seg"] and "CT" in study
    assert len(study.CT) == 5 and study.CT.shape == (6, 5, 4) and study.CT.is_uniform
    d = study.describe()
    assert d["collections"]["seg"] == {"volumes": 5, "shape": (6, 5, 4)} and d["labels"]["diagnosis"] == {"tumor": 3, "healthy": 2}
    assert study.all_obs_ids == sorted([f"s{i}_{c}" for i in range(5) for c in ("CT", "seg")])
    study.validate()
    with pytest.raises(AttributeError):
        study.nothing
    with pytest.raises(KeyError):
        study.collection("nothing")


def test_obs_ids_column(study):
    assert {r.obs_subject_id: r.obs_ids for r in study.obs_meta.collect()}["s1"] == '["s1_CT","s1_seg"]'


def test_reads(study, arrays):
    v, a = study.get_volume("s2_CT"), arrays["s2"]
    assert v.shape == (6, 5, 4) and v.dtype == np.float32 and v.ndim == 3 and v.tile == (6, 5, 1) and v.tile_orientation == "axial"
    np.testing.assert_array_equal(v.to_numpy(), a)
    np.testing.assert_array_equal(v.axial(3), a[:, :, 3])
    np.testing.assert_array_equal(v.sagittal(0), a[0])
    np.testing.assert_array_equal(v.coronal(4), a[:, 4])
    np.testing.assert_array_equal(v.slice(slice(1, 3), None, slice(0, 2)), a[1:3, :, 0:2])
    np.testing.assert_array_equal(v[1:4, 2], a[1:4, 2])
    np.testing.assert_array_equal(v[-1], a[-1])
    with pytest.raises(TypeError):
        v["a"]
    with pytest.raises(IndexError):
        v[99]
    st = v.get_statistics([25])
    assert st["std"] == pytest.approx(a.std()) and st["p25"] == pytest.approx(np.percentile(a, 25))
    n, edges = v.compute_histogram(5, (-1, 1))
    np.testing.assert_array_equal(n, np.histogram(a, 5, (-1, 1))[0])
    with pytest.raises(KeyError):
        study.get_volume("zz")


def test_selection(study):
    ct = study.CT
    assert ct.iloc[0].obs_id == "s0_CT" and ct.iloc[-1].obs_id == "s4_CT" and ct["s1_CT"].obs_id == "s1_CT"
    assert ct.iloc[1:4:2].index.to_list() == ["s1_CT", "s3_CT"] and ct.iloc[[3, 0]].index.to_list() == ["s0_CT", "s3_CT"]
    assert ct.iloc[[True, False, False, False, True]].index.to_list() == ["s0_CT", "s4_CT"] and len(ct[[]]) == 0
    assert ct.loc[["s4_CT", "s1_CT"]].index.to_list() == ["s1_CT", "s4_CT"]
    with pytest.raises(KeyError):
        ct.loc["zz"]
    with pytest.raises(KeyError):
        ct.loc[["zz"]]
    with pytest.raises(IndexError):
        ct.iloc[9]
    assert ct.sel("s2").obs_id == "s2_CT" and ct.sel(["s1", "s2"]).subjects == ["s1", "s2"]
    with pytest.raises(KeyError):
        ct.sel("zz")
    assert ct.head(2).index.to_list() == ["s0_CT", "s1_CT"] and ct.tail(1).index.to_list() == ["s4_CT"] and len(ct.head(99)) == 5
    assert ct.sample(3, seed=1).index.to_list() == ct.sample(3, seed=1).index.to_list()
    assert ct.filter("dose > 2 and obs_subject_id != 's4'").index.to_list() == ["s3_CT"]
    assert ct.filter("dose > 1").filter("site == 'y'").index.to_list() == ["s2_CT", "s4_CT"]
    assert {s: len(v) for s, v in ct.groupby_subject()} == {f"s{i}": 1 for i in range(5)}
    assert ct.get_obs_row_by_obs_id("s3_CT").dose.tolist() == [3.0]
    assert [v.obs_id for v in ct.head(2)] == ["s0_CT", "s1_CT"]


def test_study_views_propagate(study):
    view = study.filter("age > 35").filter("diagnosis == 'tumor'")
    assert view.obs_subject_ids == ["s1", "s2", "s4"] and view.CT.index.to_list() == ["s1_CT", "s2_CT", "s4_CT"] and len(view) == 3
    assert len(Study(study.spark, study.uri, view.obs_meta, propagate=False).CT) == 5
    assert study.iloc[[0, -1]].obs_subject_ids == ["s0", "s4"] and study.loc["s3"].obs_subject_ids == ["s3"] and study[1:3].obs_subject_ids == ["s1", "s2"]
    assert study.head(2).obs_subject_ids == ["s0", "s1"] and study.tail(2).obs_subject_ids == ["s3", "s4"] and len(study.sample(2, 3)) == 2
    assert study.select_collections(["seg"]).collection_names == ["seg"]
    for bad in ([0, 0],):
        with pytest.raises(ValueError):
            study.iloc[bad]
    with pytest.raises(KeyError):
        study.loc[["zz"]]
    with pytest.raises(ViewError):
        view.rename_collection("CT", "x")
    assert study.get_obs_row_by_obs_subject_id("s1").age.tolist() == [40]


def test_batched_operators_equal_numpy(study, arrays):
    ct = study.CT
    st = {r.obs_id: r for r in ct.statistics([25]).collect()}
    for s, a in arrays.items():
        r = st[f"{s}_CT"]
        a = a.astype(float)
        np.testing.assert_allclose([r["mean"], r["std"], r["min"], r["max"], r["median"], r["p25"]], [a.mean(), a.std(), a.min(), a.max(), np.median(a), np.percentile(a, 25)], rtol=1e-9)
    h = ct.histogram(6, -2, 2).where("obs_id = 's0_CT'").orderBy("bin").collect()
    assert [r.n for r in h] == np.histogram(arrays["s0"], 6, (-2, 2))[0].tolist()
    cut = ct.slices("axial", 2).where("obs_id = 's1_CT'").collect()
    assert len(cut) == 1 and cut[0].nz == 1 and np.frombuffer(cut[0].voxels, "f4").tolist() == arrays["s1"][:, :, 2].ravel().tolist()
    box = ct.boxes(((1, 3), (0, 2), (1, 3))).groupBy("obs_id").agg(F.sum(F.col("nx") * F.col("ny") * F.col("nz")).alias("n")).collect()
    assert {r.n for r in box} == {8}
    from tomolake.operators import voxels

    for r in voxels.whole(ct.tiles).collect():
        np.testing.assert_array_equal(np.frombuffer(r.voxels, r.dtype).reshape(r["shape"])[..., 0], arrays[r.obs_id[:2]])
    fg = study.seg.foreground().where("obs_id = 's0_seg'").collect()
    assert {(r.x, r.y, r.z) for r in fg} == set(map(tuple, np.argwhere(arrays["s0"] > 0.5).tolist()))


def test_lazy_and_mapped(study, arrays, tmp_path):
    lazy = study.CT.lazy()
    assert lazy.filter("dose >= 2").head(3).to_obs().count() == 1  # root positions
    assert lazy.filter("dose >= 1").filter_subjects(["s1", "s2", "s9"]).filter_subjects(["s2"]).count() == 1
    assert lazy.iloc[1:3].loc["s2_CT"].resolve().index.to_list() == ["s2_CT"] and len(lazy.tail(2)) == 2
    assert lazy.sample(2, 5).resolve().index.to_list() == lazy.sample(2, 5).resolve().index.to_list()
    assert lazy.head(2).to_numpy_stack().shape == (2, 6, 5, 4)

    def peak(a, row):
        return a * 2, {"peak": float(a.max()), "n": int(row["dose"])}

    m = study.CT.head(2).map(peak)
    np.testing.assert_array_equal(m[0], arrays["s0"] * 2)
    m2 = m.map(lambda a, row: (a + row["n"], {"note": "ok"}))
    np.testing.assert_allclose(m2.to_list()[1], arrays["s1"] * 2 + 1)
    t = m2.to_dataframe().toPandas()
    assert t.note.tolist() == ["ok", "ok"] and t.result.tolist() == ["6x5x4 float32"] * 2 and t.n.tolist() == [0, 1]
    out = m2.write(str(tmp_path / "m"), "doubled")
    assert out.index.to_list() == ["s0_doubled", "s1_doubled"] and out.shape == (6, 5, 4)
    assert out.obs.select("peak", "n", "note", "dose").where("n = 1").first().note == "ok"
    np.testing.assert_allclose(out["s1_doubled"].to_numpy(), arrays["s1"] * 2 + 1)
    out.validate()
    lz = study.CT.lazy().filter("dose < 2").map(peak).map(lambda a, row: a[:3]).write(str(tmp_path / "lz"))
    assert lz.shape == (3, 5, 4) and len(lz) == 2
    scalars = study.CT.map(lambda a, row: float(a.mean()))
    assert scalars.to_list() == pytest.approx([float(a.mean()) for a in arrays.values()])
    with pytest.raises(SchemaError):
        scalars.write(str(tmp_path / "bad"))
    b = study.CT.map_batches(lambda items: [len(items)] * len(items), batch_size=2)
    assert b.to_list() == [2, 2, 2, 2, 1]


def test_write_view_and_reopen(study, arrays, tmp_path):
    out = study.filter("age >= 60").write(str(tmp_path / "w"))
    assert len(out) == 2 and out.CT.index.to_list() == ["s3_CT", "s4_CT"]
    np.testing.assert_array_equal(out.get_volume("s4_seg").to_numpy(), (arrays["s4"] > 0.5).astype("uint8"))
    out.validate()
    with pytest.raises(StorageError):
        study.write(str(tmp_path / "w"))
    out.rename_collection("seg", "mask")
    again = Study(out.spark, out.uri)
    assert again.collection_names == ["CT", "mask"] and len(again.mask) == 2
    extra = VolumeSet.from_arrays(out.spark, str(tmp_path / "pet"), [("s3", "s3_PET", np.ones((3, 3, 3), "int16"))], "PET")
    again.add_collection("PET", extra)
    assert {r.obs_subject_id: r.obs_ids for r in again.obs_meta.collect()}["s3"] == '["s3_CT","s3_PET","s3_seg"]'
    with pytest.raises(AlignmentError):
        again.add_collection("P2", VolumeSet.from_arrays(out.spark, str(tmp_path / "p2"), [("s0", "s0_P", np.ones((3, 3, 3)))]))
    joined = Study.from_collections(out.spark, str(tmp_path / "fc"), {"PET": extra, "CT": study.CT.head(1)})
    assert joined.obs_subject_ids == ["s0", "s3"] and len(joined.CT) == 1


def test_writer_errors(spark, tmp_path):
    with pytest.raises(ShapeError), VolumeSetWriter(spark, str(tmp_path / "x"), shape=(2, 2, 2)) as w:
        w.write_volume(np.zeros((3, 3, 3)), "a", "s")
    with pytest.raises(StorageError):
        VolumeSet(spark, str(tmp_path / "x"))
    w = VolumeSetWriter(spark, str(tmp_path / "y"))
    w.write_volume(np.zeros((3, 3, 3)), "a", "s")
    with pytest.raises(AlignmentError):
        w.write_volume(np.zeros((3, 3, 3)), "a", "s")
    with pytest.raises(ShapeError):
        w.write_volume(np.zeros((3, 3)), "b", "s")
    with pytest.raises(SchemaError):
        w.write_volume(np.zeros((3, 3, 3)), "b", "s", {"obs_id": 1})


@pytest.mark.parametrize("kind", list(SliceOrientation))
@pytest.mark.parametrize("shape,dtype", [((7, 5, 3), "uint8"), ((7, 5, 3, 4), "int16"), ((5, 5, 5), "float64"), ((4, 3, 2), "uint16")])
def test_roundtrip_of_tiles(spark, tmp_path, make, kind, shape, dtype):
    configure(write=WriteConfig(tile=TileConfig(kind, cube=3)))
    a = make(shape, dtype)
    vs = VolumeSet.from_arrays(spark, str(tmp_path / "t"), [("s", "v", a)])
    v = vs["v"]
    np.testing.assert_array_equal(v.to_numpy(), a)
    np.testing.assert_array_equal(v[1:4, 2:3], a[1:4, 2:3])
    if a.ndim == 4:
        np.testing.assert_array_equal(v.axial(1, t=2), a[:, :, 1, 2])
        np.testing.assert_array_equal(v.slice(slice(0, 2)), a[:2])


def test_tile_predicates_prune_row_groups(spark, tmp_path, make):
    vs = VolumeSet.from_arrays(spark, str(tmp_path / "p"), [(f"s{i}", f"v{i}", make((8, 8, 16), seed=i)) for i in range(4)])
    import pyarrow.parquet as pq
    from pathlib import Path

    groups = sum(pq.ParquetFile(p).num_row_groups for t in vs.tile_paths for p in Path(t).glob("*.parquet"))
    assert groups >= 16
    plan = vs.tiles.where((F.col("obs_id") == "v1") & (F.col("cz") >= 3) & (F.col("cz") <= 3))._jdf.queryExecution().toString()
    assert "EqualTo(obs_id,v1)" in plan and "GreaterThanOrEqual(cz,3)" in plan


def test_meta_table(spark, tmp_path):
    pdf = pd.DataFrame({"obs_subject_id": ["a", "b"], "obs_id": ["v1", "v2"], "age": [45, 67], "vol": [1.5, 2.5]})
    t = MetaTable.from_pandas(spark, str(tmp_path / "m"), pdf)
    assert len(t) == 2 and t.columns == ["obs_subject_id", "obs_id", "age", "vol"]
    assert t.read(["vol"], "age > 50").collect()[0].asDict() == {"obs_subject_id": "b", "obs_id": "v2", "vol": 2.5}
    assert t.read(["vol"], include_index=False).columns == ["vol"]
    t.add_column("grade", "int32", 3)
    t.update(pd.DataFrame({"obs_subject_id": ["a", "c"], "obs_id": ["v1", "v3"], "age": [99, 1]}))
    got = {r.obs_id: (r.age, r.vol, r.grade) for r in MetaTable(spark, str(tmp_path / "m")).df.collect()}
    assert got == {"v1": (99, 1.5, 3), "v2": (67, 2.5, 3), "v3": (1, None, None)}
    t.delete("age == 99")
    t.drop_column("vol")
    assert len(t) == 2 and "vol" not in t.columns
    for bad in (lambda: t.add_column("obs_id", "int32"), lambda: t.drop_column("obs_id"), lambda: t.add_column("a\0b", "int32"), lambda: t.read(["zz"]), lambda: t.add_column("q", "weird")):
        with pytest.raises(SchemaError):
            bad()
    e = MetaTable.create(spark, str(tmp_path / "e"), {"i": "int32", "f": "float64", "u": "uint16", "s": "U64"})
    assert len(e) == 0 and dict(e.df.dtypes) == {"obs_subject_id": "string", "obs_id": "string", "i": "int", "f": "double", "u": "int", "s": "string"}


def test_validate_finds_faults(spark, study, tmp_path):
    out = study.head(2).write(str(tmp_path / "v"))
    bad = dict(out.manifest, subject_count=9)
    from tomolake.storage import Store

    Store(spark).write_json(f"{out.uri}/_study.json", bad)
    with pytest.raises(AlignmentError):
        Study(spark, out.uri).validate()
    c = out.CT
    Store(spark).write_json(f"{c.uri}/_collection.json", dict(c.manifest, n_volumes=7))
    with pytest.raises(AlignmentError):
        VolumeSet(spark, c.uri).validate()
