import json
import struct

import numpy as np
import pandas as pd
import pytest

from tomolake.config import SliceOrientation, TileConfig, configure, get_config, reset_config
from tomolake.config import CompressionConfig, Compressor, OrientationConfig, ReadConfig, WriteConfig
from tomolake.errors import AlignmentError, ConfigurationError, IngestError, SchemaError, ShapeError, StorageError, TomolakeError, ViewError
from tomolake.functions import naming, orientation
from tomolake.operators.study import Study
from tomolake.operators.volumeset import VolumeSet
from tomolake.sources import dicom, ingest, nifti
from tomolake.streaming.arrivals import append_arrivals

RAS = np.array([[1.0, 0, 0, -16], [0, 1, 0, -16], [0, 0, 2, -8], [0, 0, 0, 1]])
LPS = np.diag([-1.0, -1, 1, 1]) @ RAS


@pytest.mark.parametrize("dtype", ["uint8", "int16", "uint16", "int32", "float32", "float64"])
@pytest.mark.parametrize("gz", [False, True])
def test_nifti_roundtrip(tmp_path, make, dtype, gz):
    a = make((5, 4, 3), dtype)
    p = str(tmp_path / ("a.nii.gz" if gz else "a.nii"))
    nifti.write_nifti(p, a, RAS)
    b, h = nifti.parse(open(p, "rb").read())
    np.testing.assert_array_equal(a, b)
    np.testing.assert_allclose(h.affine, RAS)
    assert h.source == "sform" and b.dtype == a.dtype and nifti.parse_header(nifti.head_bytes(p)).shape == (5, 4, 3)


def test_nifti_variants(tmp_path, make):
    a = make((4, 4, 4, 3), "int16")
    p = str(tmp_path / "b.nii")
    nifti.write_nifti(p, a, RAS, order=">", slope=2.0, inter=1.0)
    b, h = nifti.parse(open(p, "rb").read())
    np.testing.assert_array_equal(b, a * 2.0 + 1)
    assert h.order == ">" and h.shape == (4, 4, 4, 3)
    c, s = np.cos(0.3), np.sin(0.3)
    oblique = np.eye(4)
    oblique[:3, :3] = np.array([[c, -s, 0], [s, c, 0], [0, 0, -1]]) * [1, 2, 3]
    oblique[:3, 3] = [1, 2, 3]
    nifti.write_nifti(p, a, oblique, sform=0, qform=1)
    h = nifti.parse_header(open(p, "rb").read())
    assert h.source == "qform"
    np.testing.assert_allclose(h.affine, oblique, atol=1e-5)
    nifti.write_nifti(p, a, np.diag([2.0, 2, 2, 1]), sform=0, qform=0, slope=float("nan"), inter=float("nan"))
    h = nifti.parse_header(open(p, "rb").read())
    assert h.source == "identity" and (h.slope, h.inter) == (1.0, 0.0) and h.affine[0, 0] == 2
    nifti.write_nifti(p, make((4, 4, 4))[..., None], RAS)
    assert nifti.parse_header(open(p, "rb").read()).shape == (4, 4, 4)
    for bad in (b"", b"x" * 400):
        with pytest.raises(IngestError):
            nifti.parse(bad)
    with pytest.raises(IngestError):
        nifti.parse(open(p, "rb").read()[:360])


@pytest.mark.parametrize("target", ["RAS", "LAS", "LPS"])
@pytest.mark.parametrize("affine", [RAS, LPS, RAS[:, [2, 0, 1, 3]]])
def test_reorient_keeps_world(make, target, affine):
    a = make((6, 5, 4), seed=2)
    b, m = orientation.reorient(a, affine, target)
    assert "".join(orientation.axcodes(m)) == target
    for _ in range(20):
        v = np.random.default_rng(_).integers(0, b.shape)
        world = m @ [*v, 1]
        old = np.rint(np.linalg.inv(affine) @ world)[:3].astype(int)
        assert b[tuple(v)] == a[tuple(old)]


def test_orientation_checks():
    assert orientation.axcodes(RAS) == ("R", "A", "S") and orientation.axcodes(LPS) == ("L", "P", "S")
    assert orientation.is_valid(RAS) and not orientation.is_valid(np.eye(4)) and not orientation.is_valid(np.zeros((4, 4)))
    sheared = RAS.copy()
    sheared[0, 1] = 0.5
    assert not orientation.is_valid(sheared)
    o = orientation.detect(RAS, "sform")
    assert orientation.orientation_from_meta(orientation.orientation_to_meta(o)) == o and orientation.orientation_from_meta({}) is None


def write_series(d, a, implicit=False, suffix=".dcm", instances=True):
    d.mkdir(parents=True)
    for k in np.random.default_rng(0).permutation(a.shape[2]):
        raw = dicom.write_file(a[:, :, k].T, int(k) + 1 if instances else None, (0, 0, float(k) * 2), implicit=implicit)
        (d / f"f{(k * 7) % a.shape[2]}{suffix}").write_bytes(raw)


@pytest.mark.parametrize("kw", [{}, {"implicit": True}, {"suffix": ""}, {"instances": False}])
def test_dicom_series(tmp_path, kw):
    a = np.random.default_rng(42).integers(0, 4095, (6, 5, 4)).astype("uint16")
    write_series(tmp_path / "s", a, **kw)
    b, m = ingest.read_dicom(str(tmp_path / "s"))
    np.testing.assert_array_equal(a, b)
    assert b.dtype == np.uint16 and m["dimensions"] == "(6, 5, 4)" and m["axcodes"] == "LPS" and m["modality"] == "CT"
    assert json.loads(m["affine_json"])[2][2] == 2.0
    assert ingest.read_dicom(str(tmp_path / "s"), "float32")[0].dtype == np.float32
    with pytest.raises(IngestError):
        dicom.parse_file(struct.pack("<HH2sH", 8, 0x60, b"CS", 2) + b"CT")


@pytest.fixture
def files(tmp_path, make):
    for kind in ("T1w", "FLAIR"):
        (tmp_path / kind).mkdir()
        for i in range(3):
            nifti.write_nifti(str(tmp_path / kind / f"sub{i}.nii.gz"), make((6, 5, 4), seed=i), RAS)
    return tmp_path


def test_resolution(files):
    assert ingest.detect_format(str(files / "T1w" / "*.nii.gz")) == "nifti" and ingest.detect_format(str(files)) == "nifti"
    pairs, fmt = ingest.resolve(str(files / "T1w"))
    assert fmt == "nifti" and [s for _, s in pairs] == ["sub0", "sub1", "sub2"]
    assert ingest.resolve([("x/a.nii", "p")]) == ([("x/a.nii", "p")], "nifti")
    write_series(files / "d" / "p1", np.zeros((4, 4, 2), "uint16"))
    assert ingest.resolve(str(files / "d")) == ([(str(files / "d" / "p1"), "p1")], "dicom")
    for bad in ([], "/nowhere", str(files / "*.txt")):
        with pytest.raises(IngestError):
            ingest.detect_format(bad)
    with pytest.raises(IngestError):
        ingest.resolve_dicom("x/*")
    (files / "labels").mkdir()
    (files / "labels" / "sub1.nii.gz").write_bytes((files / "T1w" / "sub1.nii.gz").read_bytes())
    found = ingest.discover_pairs(str(files / "T1w"), str(files / "labels"))
    assert [bool(label) for _, label, _ in found] == [False, True, False]


def test_study_from_images(spark, files, tmp_path, make):
    uri = str(tmp_path / "st")
    s = Study.from_images(spark, uri, {"T1w": str(files / "T1w"), "FLAIR": str(files / "FLAIR" / "*.nii.gz")}, validate_alignment=True)
    assert s.obs_subject_ids == ["sub0", "sub1", "sub2"] and s.FLAIR.shape == (6, 5, 4)
    s.validate()
    np.testing.assert_array_equal(s.get_volume("sub1_T1w").to_numpy(), make((6, 5, 4), seed=1))
    row = s.T1w.get_obs_row_by_obs_id("sub0_T1w").iloc[0]
    assert row.voxel_spacing == "(1.0, 1.0, 2.0)" and row.axcodes == "RAS" and row.sform_code == 1 and row.spatial_units == "mm"
    assert s.T1w.filter("voxel_spacing == '(1.0, 1.0, 2.0)'").index.to_list() == ["sub0_T1w", "sub1_T1w", "sub2_T1w"]
    assert s.get_volume("sub0_T1w").orientation_info.axcodes == ("R", "A", "S")
    out = s.get_volume("sub2_T1w").to_nifti(str(tmp_path / "out.nii"))
    a, h = nifti.parse(open(out, "rb").read())
    np.testing.assert_array_equal(a, make((6, 5, 4), seed=2))
    np.testing.assert_allclose(h.affine, RAS)
    # more of an old subject, and a new one that needs a row
    nifti.write_nifti(str(tmp_path / "n.nii.gz"), make((6, 5, 4), seed=9), RAS)
    with pytest.raises(AlignmentError):
        s.append({"T1w": [(str(tmp_path / "n.nii.gz"), "new")]})
    s.append({"T1w": [(str(tmp_path / "n.nii.gz"), "sub0"), (str(tmp_path / "n.nii.gz"), "new")], "T2w": [(str(tmp_path / "n.nii.gz"), "new")]}, pd.DataFrame({"obs_subject_id": ["new"]}))
    assert s.T1w.index.to_list() == ["new_T1w", "sub0_T1w", "sub0_T1w_acq-1", "sub1_T1w", "sub2_T1w"] and len(s) == 4 and "T2w" in s
    Study(spark, uri).validate()
    assert len(s.T1w.sel("sub0")) == 2
    for call, error in (
        (lambda: Study.from_images(spark, uri, {"a": str(files / "T1w")}), StorageError),
        (lambda: Study.from_images(spark, str(tmp_path / "q1"), {}), ValueError),
        (lambda: Study.from_images(spark, str(tmp_path / "q2"), {"a": str(files / "T1w")}, pd.DataFrame({"x": [1]})), SchemaError),
        (lambda: Study.from_images(spark, str(tmp_path / "q3"), {"a": str(files / "T1w")}, pd.DataFrame({"obs_subject_id": ["sub0"]})), AlignmentError),
        (lambda: Study.from_images(spark, str(tmp_path / "q4"), {"a": str(files / "T1w"), "b": [(str(tmp_path / "n.nii.gz"), "sub0")]}, validate_alignment=True), AlignmentError),
        (lambda: s.T1w.append(niftis=[], dicoms=[]), ValueError),
        (lambda: s.head(1).T1w.append(niftis=[(str(tmp_path / "n.nii.gz"), "x")]), ViewError),
    ):
        with pytest.raises(error):
            call()
    nifti.write_nifti(str(tmp_path / "odd.nii.gz"), make((2, 2, 2)), RAS)
    with pytest.raises(ShapeError):
        s.FLAIR.append(niftis=[(str(tmp_path / "odd.nii.gz"), "sub0")])


def test_collection_of_files(spark, files, tmp_path, make):
    pairs, _ = ingest.resolve(str(files / "T1w"))
    obs = pd.DataFrame({"obs_subject_id": ["sub0", "sub1", "sub2"], "age": [1, 2, 3]})
    vs = ingest.build_collection(spark, str(tmp_path / "c"), pairs, "MR", "nifti", reorient_to="LPS", check_shapes=True, obs=obs, valid_subjects=["sub0", "sub1", "sub2"])
    assert vs.filter("age > 1").index.to_list() == ["sub1_MR", "sub2_MR"] and vs.obs.first().axcodes == "LPS"
    np.testing.assert_array_equal(vs["sub0_MR"].to_numpy(), make((6, 5, 4), seed=0)[::-1, ::-1])
    nifti.write_nifti(str(files / "T1w" / "sub3.nii.gz"), make((3, 3, 3)), RAS)
    mixed, _ = ingest.resolve(str(files / "T1w"))
    for kw, error in (({"check_shapes": True}, ShapeError), ({"valid_subjects": ["sub0"]}, AlignmentError), ({"obs": obs}, AlignmentError), ({"obs": obs.assign(axcodes="x").iloc[[0]]}, AlignmentError), ({"obs": pd.DataFrame({"a": [1]})}, SchemaError)):
        with pytest.raises(error):
            ingest.build_collection(spark, str(tmp_path / "e"), mixed, "MR", "nifti", **kw)
    hetero = ingest.build_collection(spark, str(tmp_path / "h"), mixed, "MR", "nifti")
    assert hetero.shape is None and not hetero.is_uniform and len(hetero) == 4
    with pytest.raises(FileNotFoundError):
        ingest.build_collection(spark, str(tmp_path / "g"), [("/no.nii", "s")], "x", "nifti")
    heads = ingest.header_frame(spark, [p for p, _ in pairs]).collect()
    assert {r.dimensions for r in heads} == {"(6, 5, 4)"}
    a = np.random.default_rng(1).integers(0, 4095, (6, 5, 4)).astype("uint16")
    write_series(tmp_path / "d" / "p1", a)
    write_series(tmp_path / "d" / "p2", a + 1)
    dv = ingest.build_collection(spark, str(tmp_path / "dc"), *([ingest.resolve(str(tmp_path / "d"))[0]]), "CT", "dicom", check_shapes=True)
    np.testing.assert_array_equal(dv["p2_CT"].to_numpy(), a + 1)
    assert dv.obs.first().kvp is None and dv.obs.first().modality == "CT"


def test_constructors_and_export(spark, files, tmp_path, make):
    pairs, _ = ingest.resolve(str(files / "T1w"))
    vs = VolumeSet.from_niftis(spark, str(tmp_path / "c"), pairs, name="MR", reorient="LAS")
    out = {r.obs_id: r.path for r in vs.export_niftis(str(tmp_path / "x")).collect()}
    assert sorted(out) == ["sub0_MR", "sub1_MR", "sub2_MR"]
    a, h = nifti.parse(open(out["sub1_MR"], "rb").read())
    np.testing.assert_array_equal(a, make((6, 5, 4), seed=1)[::-1])
    assert orientation.axcodes(h.affine) == ("L", "A", "S")
    write_series(tmp_path / "d" / "p1", np.ones((4, 4, 2), "uint16"))
    assert VolumeSet.from_dicoms(spark, str(tmp_path / "dc"), [(str(tmp_path / "d" / "p1"), "p1")], name="CT")["p1_CT"].to_numpy().sum() == 32
    z = VolumeSet.zeros(spark, str(tmp_path / "z"), "s", "v", (3, 4, 5), "uint8")
    assert z["v"].dtype == np.uint8 and z["v"].to_numpy().sum() == 0
    assert "sub0_MR" in vs.map(lambda a, row: float(a.mean()))._repr_html_()


def test_arrivals(spark, files, tmp_path, make):
    uri, ck = str(tmp_path / "arr"), str(tmp_path / "ck")
    append_arrivals(spark, str(files / "T1w"), uri, "MR", ck).awaitTermination()
    assert len(VolumeSet(spark, uri)) == 3
    nifti.write_nifti(str(files / "T1w" / "sub9.nii.gz"), make((6, 5, 4)), RAS)
    append_arrivals(spark, str(files / "T1w"), uri, "MR", ck).awaitTermination()
    append_arrivals(spark, str(files / "T1w"), uri, "MR", str(tmp_path / "ck2")).awaitTermination()  # all paths again: none is new
    assert VolumeSet(spark, uri).index.to_list() == ["sub0_MR", "sub1_MR", "sub2_MR", "sub9_MR"]


@pytest.mark.parametrize("name,want", [("sub-01_ses-01_T1w", "T1w"), ("SUB_flair", "FLAIR"), ("T1_MPRAGE", "T1w"), ("brats_t1ce", "T1gd"), ("lung_003", "CT"), ("x_ct_y", "CT"), ("run_bold", "bold"), ("FUNC1", "bold"), ("what", "unknown")])
def test_series(spark, name, want):
    from pyspark.sql import functions as F

    assert naming.infer_series_type(name) == want
    assert spark.range(1).select(naming.series_type(F.lit(name)).alias("s")).first().s == want


def test_names():
    assert naming.infer_series_type("what", "a dwi scan") == "dwi"
    assert naming.generate_obs_id("s", "CT") == "s_CT" and naming.generate_obs_id("s", "CT", 2) == "s_CT_acq-2"
    assert naming.result_summary(np.zeros((4, 4, 4), "float32")) == "4x4x4 float32" and naming.result_summary(0.12345) == "0.1235" and naming.result_summary("x") == "x"
    assert naming.adjacent_uri("/a/b", "c") == "/a/c" and naming.adjacent_uri("/a/b", fn=test_names) == "/a/b_test_names" and naming.adjacent_uri("/a/b", fn=lambda: 0) == "/a/b_written"
    assert ingest.default_subject_id("/x/y.nii.gz") == "y"


def test_config():
    t = TileConfig(SliceOrientation.ISOTROPIC)
    assert t.extents((100, 50, 200)) == (64, 50, 64) and TileConfig().extents((9, 8, 7, 6)) == (9, 8, 1, 1) and TileConfig(SliceOrientation.CORONAL, x=4).extents((9, 8, 7)) == (4, 1, 7)
    configure(write=WriteConfig(tile=t))
    assert get_config().write.tile is t and get_config().read == ReadConfig()
    assert reset_config().write.tile.orientation is SliceOrientation.AXIAL
    assert CompressionConfig(Compressor.ZSTD, 99).options()["parquet.compression.codec.zstd.level"] == "22"
    for bad in (lambda: TileConfig(x=0), lambda: ReadConfig(max_workers=0), lambda: OrientationConfig("XYZ"), lambda: CompressionConfig(level=-1)):
        with pytest.raises(ConfigurationError):
            bad()
    for error, base in ((ShapeError, ValueError), (AlignmentError, ValueError), (SchemaError, ValueError), (IngestError, ValueError), (StorageError, RuntimeError), (ViewError, TypeError)):
        assert issubclass(error, base) and issubclass(error, TomolakeError)


def test_arrivals_go_by_files_not_by_hundreds(spark, files, tmp_path, make, monkeypatch):
    """The query takes a wave in one batch, whatever the table's rows up to the operator's bound; small batches give the same volumes."""
    from tomolake.plans import engine

    calls, plain = [], VolumeSet.append
    monkeypatch.setattr(VolumeSet, "append", lambda self, *a, **k: calls.append(1) or plain(self, *a, **k))
    d = str(tmp_path / "sf")
    spark.createDataFrame([(i, 0, [float(i)] * 64) for i in range(420)], "vec_id long, label int, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    got = sorted(r.obs_id for r in engine.queries()["arrived_volumes"](spark, d).collect())
    assert len(got) == len(set(got)) == 210 and len(calls) == 1
    uri = str(tmp_path / "small")
    append_arrivals(spark, str(files / "T1w"), uri, "MR", str(tmp_path / "ck"), max_files=1).awaitTermination()
    assert sorted(VolumeSet(spark, uri).index.to_list()) == ["sub0_MR", "sub1_MR", "sub2_MR"] and len(calls) == 3
