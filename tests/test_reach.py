"""Files by URI, scaled export, packed DICOM pixels, grouped partitions, counters of reads."""

import json
import zlib

import numpy as np
import pytest

from tomolake.errors import IngestError
from tomolake.operators.stats import Reads
from tomolake.operators.study import Study
from tomolake.operators.volumeset import VolumeSet
from tomolake.sources import dicom, formats, ingest, nifti

AFFINE = np.diag([1.0, 1.0, 2.0, 1.0])


def test_files_by_uri(spark, tmp_path, make):
    """Files of a store that only Spark's readers open: listed, read and checked through Hadoop."""
    for i in range(3):
        nifti.write_nifti(str(tmp_path / f"s{i}.nii.gz"), make((5, 4, 3), seed=i), AFFINE)
    (tmp_path / "note.txt").write_text("x")
    uri = f"file://{tmp_path}"
    assert ingest.detect_format(f"{uri}/*.nii.gz") == "nifti" and [s for _, s in ingest.resolve(uri)[0]] == ["s0", "s1", "s2"]
    vs = VolumeSet.from_niftis(spark, str(tmp_path / "c"), ingest.resolve(f"{uri}/s[01].nii.gz")[0], name="T1w")
    assert len(vs) == 2 and vs.shape == (5, 4, 3)
    np.testing.assert_array_equal(vs["s1_T1w"].to_numpy(), make((5, 4, 3), seed=1))
    st = Study.from_images(spark, str(tmp_path / "st"), {"T1w": f"{uri}/*.nii.gz"})
    assert st.obs_subject_ids == ["s0", "s1", "s2"]
    with pytest.raises(FileNotFoundError):
        VolumeSet.from_niftis(spark, str(tmp_path / "d"), [(f"{uri}/none.nii.gz", "p")])


def test_scaled_export(spark, tmp_path):
    """Whole numbers under a scaling come back as they were stored; voxels that no whole numbers give stay as they are."""
    raw = np.arange(60, dtype="int16").reshape(5, 4, 3)
    nifti.write_nifti(str(tmp_path / "a.nii"), raw, AFFINE, slope=0.5, inter=-3.0)
    vs = VolumeSet.from_niftis(spark, str(tmp_path / "c"), [(str(tmp_path / "a.nii"), "a")], name="x")
    assert vs["a_x"].meta["orientation_confidence"] == "header" and vs["a_x"].orientation_info.confidence == "header"
    np.testing.assert_allclose(vs["a_x"].to_numpy(), raw * 0.5 - 3)
    out = vs["a_x"].to_nifti(str(tmp_path / "b.nii"), compression=False)
    h = nifti.parse_header(open(out, "rb").read())
    assert (h.slope, h.inter, h.datatype) == (0.5, -3.0, 4)
    np.testing.assert_allclose(nifti.parse(open(out, "rb").read())[0], raw * 0.5 - 3)
    far = vs.map(lambda a, row: a + 0.123).write(str(tmp_path / "far"), "far")
    np.testing.assert_allclose(nifti.parse(open(far["a_far"].to_nifti(str(tmp_path / "f"), False), "rb").read())[0], raw * 0.5 - 3 + 0.123)
    path = vs.export_niftis(str(tmp_path / "all"), compression=False).first()["path"]
    assert nifti.parse_header(open(path, "rb").read()).slope == 0.5


def packed(plane: bytes) -> bytes:
    """PackBits by literal runs and repeats."""
    out, at = b"", 0
    while at < len(plane):
        run = 1
        while run < 128 and at + run < len(plane) and plane[at + run] == plane[at]:
            run += 1
        if run > 1:
            out += bytes([257 - run, plane[at]])
        else:
            out += bytes([0, plane[at]])
        at += run
    return out + b"\0" * (len(out) % 2)


def with_syntax(raw: bytes, syntax: bytes, body) -> bytes:
    """A plain file under another transfer syntax: ``body`` makes the new data set of the old one."""
    old = b"1.2.840.10008.1.2.1\0"
    at = raw.index(old) + len(old)
    syntax += b"\0" * (len(syntax) % 2)
    head = raw[: raw.index(old) - 2] + len(syntax).to_bytes(2, "little") + syntax
    return head + body(raw[at:])


def test_packed_dicom_pixels(tmp_path):
    a = (np.arange(20).reshape(4, 5) * 300 // 700 * 700).astype("uint16")
    plain = dicom.write_file(a, 1, (0, 0, 0))

    def rle(data):
        at = data.index(b"\xe0\x7f\x10\x00")
        pixels = np.frombuffer(data[at + 12 :], np.uint8).reshape(-1, 2)
        planes = [packed(pixels[:, k].tobytes()) for k in (1, 0)]
        offsets = [64, 64 + len(planes[0])] + [0] * 13
        frame = (2).to_bytes(4, "little") + b"".join(x.to_bytes(4, "little") for x in offsets) + b"".join(planes)
        item = lambda x: b"\xfe\xff\x00\xe0" + len(x).to_bytes(4, "little") + x
        return data[:at] + b"\xe0\x7f\x10\x00OB\0\0\xff\xff\xff\xff" + item(b"") + item(frame) + b"\xfe\xff\xdd\xe0\0\0\0\0"

    def deflate(data):
        z = zlib.compressobj(wbits=-15)
        return z.compress(data) + z.flush()

    for syntax, body in ((b"1.2.840.10008.1.2.5", rle), (b"1.2.840.10008.1.2.1.99", deflate)):
        s = dicom.parse_file(with_syntax(plain, syntax, body))
        np.testing.assert_array_equal(dicom.stack([s]), a.T[:, :, None])
        assert dicom.parse_file(with_syntax(plain, syntax, body), pixels=False)["rows"] == 4
    with pytest.raises(IngestError, match="4.50"):
        dicom.parse_file(with_syntax(plain, b"1.2.840.10008.1.2.4.50", rle))
    with pytest.raises(IngestError):
        dicom.rle_frame((1).to_bytes(4, "little") + bytes(60) + b"\0\0", 4, 2)


def test_files_share_partitions(spark, tmp_path, make):
    for i in range(9):
        nifti.write_nifti(str(tmp_path / f"s{i}.nii"), make((5, 4, 3), seed=i), AFFINE)
    formats.register(spark)
    df = spark.read.format("nifti").option("mode", "tiles").load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 1 and df.count() == 27
    small = spark.read.format("nifti").option("mode", "tiles").option("partition_bytes", 1500).load(str(tmp_path))
    assert small.rdd.getNumPartitions() == 5 and small.count() == 27
    assert formats.grouped([("a", "1"), ("b", "2"), ("c", "3")], lambda p: 10, 5) == [[("a", "1")], [("b", "2")], [("c", "3")]]


def test_counters_of_reads(spark, tmp_path, make):
    vs = VolumeSet.from_arrays(spark, str(tmp_path / "c"), [("s", f"v{i}", make((8, 8, 16), seed=i)) for i in range(2)])
    with Reads(vs) as r:
        for _ in range(3):
            vs["v0"].axial(2)
        vs["v1"].to_numpy()
    assert (r.stats.misses, r.stats.hits, r.stats.reads) == (2, 2, 4) and r.stats.hit_rate == r.stats.miss_rate == 0.5
    assert r.stats.groups >= 3 + 4 and r.stats.bytes > 0 and 0 <= r.stats.parallel_rate <= 1
    assert Reads(vs).__enter__().stats.hit_rate == 0.0


def test_meta_of_files_stays(spark, tmp_path, make):
    nifti.write_nifti(str(tmp_path / "a.nii"), make((5, 4, 3)), AFFINE)
    vs = VolumeSet.from_niftis(spark, str(tmp_path / "c"), [(str(tmp_path / "a.nii"), "a")], name="x")
    m = vs["a_x"].meta
    assert json.loads(m["affine_json"])[2][2] == 2.0 and m["datatype"] == "16" and float(m["scl_slope"]) == 1.0


def test_reads_by_another_file_system(spark, tmp_path, make, monkeypatch):
    """Single reads of a store that pyarrow opens take the same row groups, without a job."""
    from pyarrow import fs

    from tomolake.config import S3Config
    from tomolake.operators import volumeset
    from tomolake.storage import opened

    vs = VolumeSet.from_arrays(spark, str(tmp_path / "c"), [("s", f"v{i}", make((8, 8, 16), seed=i)) for i in range(2)])
    store = fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem())
    monkeypatch.setattr(volumeset, "opened", lambda uri: (store, uri.removeprefix(f"{tmp_path}/")))
    far = VolumeSet(spark, vs.uri)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup())
    np.testing.assert_array_equal(far.volume("v1").to_numpy(), make((8, 8, 16), seed=1))
    np.testing.assert_array_equal(far.volume("v0").axial(3), make((8, 8, 16), seed=0)[:, :, 3])
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup()) == jobs
    assert opened("hdfs://x/y") is None and opened(str(tmp_path / "none")) is None
    system, path = opened("s3a://bucket/a/b")
    assert isinstance(system, fs.S3FileSystem) and path == "bucket/a/b" and S3Config(endpoint="http://host:9000", use_virtual_addressing=False).filesystem() is not None
