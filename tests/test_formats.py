import numpy as np
import pytest

from tomolake.functions import tables
from tomolake.operators.stats import scan_stats
from tomolake.operators.torch_adapters import as_torch
from tomolake.operators.volumeset import VolumeSet
from tomolake.sources import dicom, formats, nifti

AFFINE = np.diag([2.0, 2.0, 3.0, 1.0])


def test_sources(spark, tmp_path, make):
    (tmp_path / "n").mkdir()
    for i in range(3):
        nifti.write_nifti(str(tmp_path / "n" / f"s{i}.nii.gz"), make((5, 4, 3), seed=i), AFFINE)
    formats.register(spark)
    df = spark.read.format("nifti").load(str(tmp_path / "n"))
    assert df.count() == 3 and df.where("axcodes = 'RAS'").select("voxel_spacing").distinct().first()[0] == "(2.0, 2.0, 3.0)"
    tiles = spark.read.format("nifti").option("mode", "tiles").load(str(tmp_path / "n"))
    assert tiles.count() == 9
    row = tiles.where("obs_id = 's1' and cz = 2").first()
    np.testing.assert_array_equal(np.frombuffer(row.voxels, row.dtype).reshape(5, 4), make((5, 4, 3), seed=1)[:, :, 2])
    d = tmp_path / "d" / "p1"
    d.mkdir(parents=True)
    for k in range(2):
        (d / f"{k}.dcm").write_bytes(dicom.write_file(np.full((4, 5), k, "uint16"), k + 1, (0, 0, k)))
    heads = spark.read.format("dicom_series").load(str(tmp_path / "d")).collect()
    assert len(heads) == 1 and heads[0].dimensions == "(5, 4, 2)" and heads[0].kvp is None


def test_table_function_and_stats(spark, tmp_path, make):
    a = make((4, 3, 2))
    vs = VolumeSet.from_arrays(spark, str(tmp_path / "v"), [("s", "v", a), ("t", "w", a + 1)])
    tables.register(spark)
    vs.tiles.createOrReplaceTempView("tiles")
    q = "SELECT v.* FROM tiles t, LATERAL voxels(t.voxels, t.dtype, t.x0, t.y0, t.z0, t.t0, t.nx, t.ny, t.nz, t.nt) v WHERE t.obs_id = 'v'"
    got = np.zeros_like(a)
    for r in spark.sql(q).collect():
        got[r.x, r.y, r.z] = r.value
    np.testing.assert_allclose(got, a)
    st = scan_stats(vs.tiles.where("obs_id = 'w'"))
    assert st.scans == 1 and st.files >= 1 and 0 < st.rows <= 4 and st.bytes > 0 and st.bytes_per_row > 0


def test_adapters_need_their_libraries():
    try:
        import torch  # noqa: F401
    except ImportError:
        with pytest.raises(ImportError, match="torch"):
            as_torch([])
