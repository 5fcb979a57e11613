"""Queries over studies and collections against their SQL; the seeded ones against plain numpy."""

import os

import numpy as np
import pytest

from tomolake.plans import engine, engine_oracles
from tomolake.operators import samples

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
SEEDED = {"study_sample", "collection_sample", "lazy_sample", "patch_draws", "guided_patches"}


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(v[i] + 0.0) if isinstance(v[i], float) else str(v[i]) for i in order) for v in values)


def test_all_but_draws_have_sql():
    assert set(engine.queries()) - set(engine_oracles.oracle_sql()) == SEEDED and set(engine_oracles.oracle_sql()) <= set(engine.queries())


@pytest.mark.parametrize("name", sorted(set(engine.queries()) - SEEDED))
def test_query(spark, duck, name):
    df = engine.queries()[name](spark, SF)
    want = duck.execute(engine_oracles.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, want.fetchall())


@pytest.fixture(scope="module")
def volumes(duck):
    found = duck.execute("SELECT vec_id, label, embedding FROM embeddings").fetchall()
    order = sorted(found, key=lambda r: (r[0] % 150, r[0]))
    return [(f"CT{k:09d}", label, np.array(e, "f4").reshape(4, 4, 4)) for k, label, e in order]


def test_seeded_samples(spark, duck, volumes):
    draw = lambda n, k, seed: np.sort(np.random.default_rng(seed).choice(n, size=k, replace=False))
    q = engine.queries()
    people = sorted(f"s{r[0]:09d}" for r in duck.execute("SELECT c_custkey FROM customer").fetchall())
    assert sorted(r[0] for r in q["study_sample"](spark, SF).collect()) == [people[i] for i in draw(len(people), 20, 42)]
    assert sorted(r[0] for r in q["collection_sample"](spark, SF).collect()) == sorted(volumes[i][0] for i in draw(len(volumes), 20, 7))
    high = sorted(k for k, label, _ in volumes if label >= 5)
    assert sorted(r[0] for r in q["lazy_sample"](spark, SF).collect()) == [high[i] for i in draw(len(high), 20, 7)]


def test_patch_draws(spark, volumes):
    got = {r.idx: (r.obs_id, r.n, r.total) for r in engine.queries()["patch_draws"](spark, SF).collect()}
    assert len(got) == 2 * len(volumes)
    for i in range(len(got)):
        k, _, a = volumes[i // 2]
        rng = np.random.default_rng(i)
        x, y, z = (int(rng.integers(0, 3)) for _ in range(3))
        assert got[i][:2] == (k, 8) and got[i][2] == pytest.approx(a[x : x + 2, y : y + 2, z : z + 2].astype(float).sum(), abs=1e-3)


def test_guided_patches(spark, volumes):
    """The plan draws what the frame draws by index, and every patch holds foreground where there is some."""
    got = {r.idx: r.total for r in engine.queries()["guided_patches"](spark, SF).collect()}
    frame = samples.SegmentationFrame(engine.ct(spark, SF), engine.seg(spark, SF), (2, 2, 2), 2, foreground_prob=1.0, seed=3)
    assert len(got) == len(frame) == 2 * len(volumes)
    for i in range(0, len(got), 17):
        assert got[i] == float(frame[i]["mask"].sum())
    assert all(got[i] > 0 for i in got if (volumes[i // 2][2].astype(float) > 0.1).any())


def test_plans_prune_and_keep_voxels_packed(spark):
    """Slices reach the scan as tile numbers; statistics and maps shuffle packed tiles once and explode nothing."""
    vs = engine.ct(spark, SF)
    assert vs.tile == (4, 4, 1)
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = vs.slices("axial", 2)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(cz,2)" in plan and "LessThanOrEqual(cz,2)" in plan
    for df in (vs.statistics(), vs.lazy().map(lambda a, row: a).run().results):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "explode" not in plan
    assert vs.statistics()._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_positions_never_meet_in_one_task(spark):
    """However many partitions there are, the runs are many and even."""
    from tomolake.operators import frames

    df = spark.range(4000).selectExpr("concat('k', lpad(id * 7919 % 4000, 6, '0')) as k")
    spark.conf.set("spark.sql.shuffle.partitions", "1000")
    try:
        bounds = frames.run_bounds(df, "k")
        few = frames.run_bounds(df.limit(40), "k")
        placed = {r.k: r.pos for r in frames.with_position(df.where("k < 'k000200'"), "k").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(bounds) > 900 and len(few) >= 10 and placed == {f"k{i:06d}": i for i in range(200)}


def test_every_shape_is_checked(spark, tmp_path):
    from tomolake.errors import ShapeError
    from tomolake.operators.volumeset import HEADER_DDL, VolumeSet, commit

    n = 1500
    heads = spark.createDataFrame([(f"v{i}", [10 + i, 9, 9] if i != 1234 else [2, 9, 9], "<f4", [9, 9, 1], {}) for i in range(n)], HEADER_DDL)
    obs = heads.selectExpr("obs_id as obs_subject_id", "obs_id")
    commit(spark, str(tmp_path / "many"), "many", obs, heads, [])
    vs = VolumeSet(spark, str(tmp_path / "many"))
    samples.check_shapes(vs, (2, 9, 9))
    with pytest.raises(ShapeError, match=r"\[\[2, 9, 9\]\]"):
        samples.check_shapes(vs, (3, 9, 9))
    with pytest.raises(ShapeError):
        samples.check_shapes(vs)


def test_column_subset(spark, tmp_path):
    from tomolake.errors import SchemaError
    from tomolake.operators.meta import MetaTable

    t = MetaTable.create(spark, str(tmp_path / "t"), spark.createDataFrame([("s", "a", 1, "x")], "obs_subject_id string, obs_id string, n int, note string"))
    t.update(spark.createDataFrame([("s", "a", 5, "y"), ("s", "b", 6, "z")], "obs_subject_id string, obs_id string, n int, note string"), columns=["n"])
    assert sorted(map(tuple, t.df.select("obs_id", "n", "note").collect())) == [("a", 5, "x"), ("b", 6, None)]
    with pytest.raises(SchemaError):
        t.update(t.df, columns=["nothing"])
