import numpy as np
import pandas as pd
import pytest

from tomolake.errors import AlignmentError, ConfigurationError, ShapeError
from tomolake.operators import samples
from tomolake.operators.samples import Loading, SampleConfig, SampleFrame, SegmentationFrame
from tomolake.operators.volumeset import VolumeSet


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    return {f"s{i}": rng.normal(size=(8, 7, 6)).astype("float32") for i in range(4)}


@pytest.fixture(scope="module")
def sets(spark, tmp_path_factory, data):
    d = tmp_path_factory.mktemp("samples")
    obs = pd.DataFrame({"obs_id": [f"{s}_a" for s in data], "grade": [0, 1, 0, 1]})
    a = VolumeSet.from_arrays(spark, str(d / "a"), [(s, f"{s}_a", x) for s, x in data.items()], "a", obs)
    b = VolumeSet.from_arrays(spark, str(d / "b"), [(s, f"{s}_b", x + 1) for s, x in data.items()], "b")
    mask = np.zeros((8, 7, 6), "uint8")
    mask[5:7, 4:6, 3:5] = 1
    m = VolumeSet.from_arrays(spark, str(d / "m"), [(s, f"{s}_m", mask if s != "s3" else mask * 0) for s in data], "m")
    return a, b, m


def test_full_volumes_with_channels_and_labels(sets, data):
    f = SampleFrame(sets[:2], labels="grade")
    assert len(f) == 4 and f[2]["image"].shape == (2, 8, 7, 6) and f[1]["label"] == 1
    np.testing.assert_array_equal(f[2]["image"][1], data["s2"] + 1)
    assert SampleFrame(sets[:1], labels={"s1_a": "x"})[0].get("label") is None
    assert SampleFrame(sets[:1], labels=lambda k: k[:2])[3]["label"] == "s3"
    assert SampleFrame(sets[:1], labels=pd.DataFrame({"obs_id": ["s0_a"], "y": [7]}))[0]["label"] == 7
    assert len(SampleFrame(sets[:2], SampleConfig(value_filter="grade == 1"))) == 2
    assert SampleFrame(sets[:1], transform=lambda s: s["idx"])[3] == 3
    with pytest.raises(IndexError):
        f[4]


def test_patches(sets, data):
    f = SampleFrame(sets[:1], SampleConfig(Loading.PATCH, (3, 3, 3), 2))
    assert len(f) == 8
    for i in range(8):
        s = f[i]
        rng = np.random.default_rng(i)
        start = [int(rng.integers(0, n - 3 + 1)) for n in (8, 7, 6)]
        x, y, z = start
        assert s["patch_start"] == start
        np.testing.assert_array_equal(s["image"][0], data[f"s{i // 2}"][x : x + 3, y : y + 3, z : z + 3])
    rows = {r.idx: r for r in f.cut().collect()}
    assert len(rows) == 8
    for i, r in rows.items():
        np.testing.assert_array_equal(np.frombuffer(r.voxels, r.dtype).reshape(r["shape"]), f[i]["image"][0])
    f.set_epoch(1)
    assert any(f[i]["patch_start"] != [rows[i]["shape"]] for i in range(8))
    with pytest.raises(ShapeError):
        SampleFrame(sets[:1], SampleConfig(Loading.PATCH, (9, 1, 1)))
    assert sets[0].to_dataset(patch_size=(2, 2, 2))[0]["image"].shape == (1, 2, 2, 2)


@pytest.mark.parametrize("kind,axis", [("axial", 2), ("coronal", 1), ("sagittal", 0)])
def test_slices(sets, data, kind, axis):
    f = SampleFrame(sets[:1], SampleConfig(Loading.SLICE_2D, orientation=kind))
    n = (8, 7, 6)[axis]
    assert len(f) == 4 * n
    np.testing.assert_array_equal(f[n + 2]["image"][0], np.take(data["s1"], 2, axis))
    assert f.plan().count() == 4 * n


def test_segmentation(sets):
    f = SegmentationFrame(sets[0], sets[2], (4, 4, 4), 3, foreground_prob=1.0)
    assert len(f) == 12
    for i in range(9):
        s = f[i]
        assert s["image"].shape == s["mask"].shape == (1, 4, 4, 4) and s["mask"].sum() > 0 and s["mask_obs_id"].endswith("_m")
    assert f[11]["mask"].sum() == 0
    assert SegmentationFrame(sets[0], sets[2])[0]["mask"].shape == (1, 8, 7, 6)
    assert samples.guided_start((8, 7, 6), (4, 4, 4), np.array([[7, 0, 3]]), 0) == [4, 0, 1]
    with pytest.raises(AlignmentError):
        SegmentationFrame(sets[0].head(2), sets[2])
    with pytest.raises(ConfigurationError):
        SegmentationFrame(sets[0], sets[2], foreground_prob=2)


def test_loaders(sets):
    f = SampleFrame(sets[:1])
    t = samples.training_loader(f, 3, seed=1)
    assert len(t) == 1 and next(iter(t))["image"].shape == (3, 1, 8, 7, 6)
    assert len(samples.validation_loader(f, 3)) == 2 and samples.validation_loader(f).order() == [0, 1, 2, 3]
    order = t.order()
    t.set_epoch(1)
    assert sorted(order) == sorted(t.order()) == [0, 1, 2, 3]
    ranks = [samples.distributed_loader(f, r, 3).order() for r in range(3)]
    assert {len(r) for r in ranks} == {2} and set(sum(ranks, [])) == {0, 1, 2, 3}
    with pytest.raises(ConfigurationError):
        samples.distributed_loader(f, 3, 3)
    for bad in ({"mode": Loading.PATCH}, {"patches_per_volume": 0}, {"orientation": "up"}):
        with pytest.raises(ConfigurationError):
            SampleConfig(**bad)
    assert samples.Compose([lambda x: x + 1, lambda x: x * 2])(1) == 4


def test_batches_and_shards(spark):
    keys = spark.range(10).toDF("k")
    b = {r.k: r.batch for r in samples.batches(keys, "k", 4).collect()}
    assert [b[i] for i in range(10)] == [0, 0, 0, 0, 1, 1, 1, 1, 2, 2]
    assert samples.batches(keys, "k", 4, drop_last=True).count() == 8
    one, two = ([r.k for r in samples.batches(keys, "k", 4, seed=5, epoch=e).orderBy("pos").collect()] for e in (0, 1))
    assert sorted(one) == sorted(two) and one != two
    s = samples.shards(keys, "k", 3).collect()
    assert len(s) == 12 and sorted(sum(1 for r in s if r.rank == k) for k in range(3)) == [4, 4, 4]
