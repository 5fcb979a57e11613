import numpy as np
import pytest
from pyspark.sql import functions as F

from tomolake.errors import SchemaError
from tomolake.operators import frames


def test_positions_without_a_global_window(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"))
    got = sorted((r.k, r.pos) for r in frames.with_position(df, "k").collect())
    assert got == [(k, k) for k in range(5000)]
    strings = spark.createDataFrame([(f"{i:03d}",) for i in np.random.default_rng(1).permutation(300)], "k string")
    assert all(int(r.k) == r.pos for r in frames.with_position(strings, "k").collect())
    assert frames.with_position(df.limit(0), "k").count() == 0
    plan = frames.with_position(df, "k")._jdf.queryExecution().toString()
    assert "Window" in plan


def test_head_tail_sample(spark):
    df = spark.range(20).toDF("k")
    assert [r.k for r in frames.head(df, 3, "k").collect()] == [0, 1, 2]
    assert sorted(r.k for r in frames.tail(df, 3, "k").collect()) == [17, 18, 19]
    assert frames.head(df, -1, "k").count() == 0
    assert frames.sample_positions(10, 4, 7) == sorted(np.random.default_rng(7).choice(10, 4, replace=False).tolist())
    assert frames.sample_positions(3, 9, 0) == [0, 1, 2]


def test_obs_ids(spark):
    obs = spark.createDataFrame([("s1", "b"), ("s1", "a"), ("s2", "c")], "obs_subject_id string, obs_id string")
    meta = spark.createDataFrame([("s1",), ("s3",)], "obs_subject_id string")
    got = {r[0]: r[1] for r in frames.with_obs_ids(meta, obs).collect()}
    assert got == {"s1": '["a","b"]', "s3": "[]"}


def test_upsert(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("b", 2, 2.0)], "k string, n int, v double")
    delta = spark.createDataFrame([("b", 20), ("c", 30)], "k string, n int")
    got = {r.k: (r.n, r.v) for r in frames.upsert(df, delta, "k").collect()}
    assert got == {"a": (1, 1.0), "b": (20, 2.0), "c": (30, None)}
    cleared = frames.upsert(df, spark.createDataFrame([("a", None)], "k string, n int"), "k")
    assert {r.k: r.n for r in cleared.collect()} == {"a": None, "b": 2}
    with pytest.raises(SchemaError):
        frames.upsert(df, delta.withColumnRenamed("n", "x"), "k")


def test_delete_keeps_unknown(spark):
    df = spark.createDataFrame([(1,), (None,)], "k int")
    assert [r.k for r in frames.delete(df, F.col("k") == 1).collect()] == [None]


def test_labels(spark):
    df = spark.createDataFrame([(i, i % 3, "x") for i in range(50)], "k int, g int, c string")
    assert frames.label_columns(df) == ["g", "c"]
    assert {(r.label, r.value): r.n for r in frames.value_counts(df, "g", "c").collect()} == {("g", "0"): 17, ("g", "1"): 17, ("g", "2"): 16, ("c", "x"): 50}


def test_study_faults(spark):
    meta = spark.createDataFrame([("s1", '["a"]'), ("s2", "[]")], "obs_subject_id string, obs_ids string")
    ct = spark.createDataFrame([("s1", "a"), ("s9", "z")], "obs_subject_id string, obs_id string")
    pt = spark.createDataFrame([("s1", "a"), ("s2", "q")], "obs_subject_id string, obs_id string")
    got = {(r.fault, r["key"]) for r in frames.study_faults(meta, {"ct": ct, "pt": pt}).collect()}
    assert got == {("observation without subject", "z"), ("obs_id used twice", "a"), ("obs_ids is stale", "s1"), ("obs_ids is stale", "s2")}
