"""Relational operators of the metadata plane: DataFrame in, DataFrame out; ``with_position`` and ``label_columns`` run small jobs of their own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tomolake.errors import SchemaError

SUBJECT, OBS = "obs_subject_id", "obs_id"


# -- positions --------------------------------------------------------------------------------


MOST_RUNS = 1024


def run_bounds(df: DataFrame, key: str) -> list:
    """Where ``with_position`` cuts: quantiles of a sample of the keys that grows with the number of partitions."""
    n = min(MOST_RUNS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    seen = df.select(F.col(key).alias("k")).where("k is not null").orderBy(F.xxhash64("k"), "k").limit(max(1000, 20 * n))
    found = sorted({r.k for r in seen.collect()})
    n = max(1, min(n, len(found) // 2))  # few keys give few runs, not one
    return sorted({found[len(found) * i // n] for i in range(1, n)})


def with_position(df: DataFrame, *keys: str, name: str = "pos") -> DataFrame:
    """``df`` with root positions from 0 in the order of ``keys`` (unique).

    Rows are cut into runs at quantiles of the first key (of a sample in fixed hash order), runs are
    counted, and positions are added up from the counts before and the place within the run: no task holds
    all rows, as it would under a window without partitions. Runs are a function of the row alone, so both
    uses of ``df`` agree however the plan is executed.
    """
    bounds = run_bounds(df, keys[0])
    kind = df.schema[keys[0]].dataType
    run = F.size(F.filter(F.array(*(F.lit(b).cast(kind) for b in bounds)), lambda b: b <= F.col(keys[0]))) if bounds else F.lit(0)
    cut = df.withColumn("_run", F.when(F.col(keys[0]).isNull(), -1).otherwise(run))
    sizes = cut.groupBy("_run").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_run", "_before")
    local = F.row_number().over(Window.partitionBy("_run").orderBy(*keys))
    placed = cut.join(F.broadcast(before), "_run")  # one row a run
    return placed.withColumn(name, (F.col("_before") + local - 1).cast("long")).drop("_run", "_before")


#: isin() lists up to this many values; longer lists become a join.
MOST_LITERALS = 1000


def of_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Rows whose column is one of the values."""
    values = list(dict.fromkeys(values))
    if len(values) <= MOST_LITERALS:
        return df.where(F.col(column).isin(values))
    kind = df.schema[column].dataType.simpleString()
    return keep_keys(df, df.sparkSession.createDataFrame([(v,) for v in values], f"`{column}` {kind}"), column)


def at_places(df: DataFrame, places: Sequence[int], *keys: str) -> DataFrame:
    """Rows at these places of the order of ``keys``: a range where they are one, else a list or a join."""
    places = [int(p) for p in places]
    if not places:
        return df.limit(0)
    placed = with_position(df, *keys)
    if places == list(range(places[0], places[-1] + 1)):
        return placed.where((F.col("pos") >= places[0]) & (F.col("pos") <= places[-1])).drop("pos")
    return of_values(placed, "pos", places).drop("pos")


def head(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """First n by key order; a top-n, not a sort of everything."""
    return df.orderBy(*keys).limit(max(0, n))


def tail(df: DataFrame, n: int, *keys: str) -> DataFrame:
    return df.orderBy(*(F.desc(k) for k in keys)).limit(max(0, n))


def sample_positions(total: int, n: int, seed: int | None) -> list[int]:
    """Positions drawn without replacement; the draw is numpy's, so a seed gives the same rows everywhere."""
    import numpy as np

    return sorted(np.random.default_rng(seed).choice(total, size=min(n, total), replace=False).tolist())


# -- joins ------------------------------------------------------------------------------------


def keep_keys(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows whose key is in ``keys`` (a view is this semi-join, always against the root)."""
    return df.join(keys, on, "left_semi")


def drop_keys(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    return df.join(keys, on, "left_anti")


def obs_ids_json(obs: DataFrame, subject: str = SUBJECT, obs_id: str = OBS) -> DataFrame:
    """(subject, obs_ids): JSON of the sorted obs ids of each subject."""
    return obs.groupBy(subject).agg(F.to_json(F.array_sort(F.collect_list(F.col(obs_id).cast("string")))).alias("obs_ids"))


def with_obs_ids(meta: DataFrame, obs: DataFrame, subject: str = SUBJECT, obs_id: str = OBS) -> DataFrame:
    """``meta`` with ``obs_ids`` recomputed; subjects without observations have "[]"."""
    base = meta.drop("obs_ids")
    return base.join(obs_ids_json(obs, subject, obs_id), subject, "left").withColumn("obs_ids", F.coalesce("obs_ids", F.lit("[]")))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, n) of keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def common_keys(frames: Sequence[DataFrame], key: str, order: str = "pos") -> DataFrame:
    """Keys of the first frame, in its order, that every other frame has."""
    out = frames[0]
    for f in frames[1:]:
        out = keep_keys(out, f.select(key), key)
    return out.select(key, order)


# -- ordered set operations on (key, pos) frames -----------------------------------------------


def index_and(a: DataFrame, b: DataFrame, key: str = "key") -> DataFrame:
    return keep_keys(a, b.select(key), key)


def index_or(a: DataFrame, b: DataFrame, key: str = "key") -> DataFrame:
    """a's order, then b's new keys."""
    both = a.select(key, F.lit(0).alias("_side"), "pos").unionByName(b.select(key, F.lit(1).alias("_side"), "pos"))
    first = both.groupBy(key).agg(F.min(F.struct("_side", "pos")).alias("_f"))
    return first.select(key, F.col("_f._side").alias("side"), F.col("_f.pos").alias("pos"))


def index_minus(a: DataFrame, b: DataFrame, key: str = "key") -> DataFrame:
    return drop_keys(a, b.select(key), key)


def index_xor(a: DataFrame, b: DataFrame, key: str = "key") -> DataFrame:
    return index_minus(a, b, key).withColumn("side", F.lit(0)).unionByName(index_minus(b, a, key).withColumn("side", F.lit(1)))


def misaligned(a: DataFrame, b: DataFrame, key: str = "key") -> DataFrame:
    """Positions at which two ordered frames differ; empty when they are aligned."""
    x, y = a.select("pos", F.col(key).alias("left")), b.select("pos", F.col(key).alias("right"))
    return x.join(y, "pos", "full_outer").where(~F.col("left").eqNullSafe(F.col("right")))


# -- mutation ---------------------------------------------------------------------------------


def upsert(df: DataFrame, delta: DataFrame, *keys: str) -> DataFrame:
    """``delta``'s values where it has the key and the column, else ``df``'s; new keys are added with nulls elsewhere."""
    extra = [c for c in delta.columns if c not in df.columns]
    if extra:
        raise SchemaError(f"unknown columns {extra}")
    values = [c for c in df.columns if c not in keys]
    given = delta.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in values if c in delta.columns), F.lit(True).alias("_hit"))
    joined = df.join(given, list(keys), "full_outer")
    out = [
        F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).cast(df.schema[c].dataType).alias(c) if c in delta.columns else F.col(c)
        for c in values
    ]
    return joined.select(*keys, *out).select(*df.columns)


def delete(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is not true (null keeps the row)."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def add_column(df: DataFrame, name: str, dtype: str, fill=None) -> DataFrame:
    if name in df.columns:
        raise SchemaError(f"column {name!r} exists")
    return df.withColumn(name, F.lit(fill).cast(dtype))


def drop_column(df: DataFrame, name: str, fixed: Sequence[str] = ()) -> DataFrame:
    if name in fixed or name not in df.columns:
        raise SchemaError(f"column {name!r} cannot be dropped")
    return df.drop(name)


def append(df: DataFrame, rows: DataFrame) -> DataFrame:
    return df.unionByName(rows, allowMissingColumns=True)


# -- aggregation ------------------------------------------------------------------------------


def subjects_first_seen(obs: DataFrame, subject: str, position: str) -> DataFrame:
    return obs.groupBy(subject).agg(F.min(position).alias("first_pos"))


def volumes_of_subjects(obs: DataFrame, subject: str, obs_id: str) -> DataFrame:
    return obs.groupBy(subject).agg(F.count("*").alias("n_volumes"), F.min(obs_id).alias("first_obs"), F.max(obs_id).alias("last_obs"))


def label_columns(df: DataFrame, skip: Sequence[str] = (), most: int = 10) -> list[str]:
    """Columns with at most ``most`` distinct values, counted in one pass by bounded sets."""
    names = [c for c in df.columns if c not in skip]
    if not names:
        return []
    row = df.agg(*(F.approx_count_distinct(c, 0.01).alias(c) for c in names)).first()
    near = [c for c in names if row[c] <= most + 2]
    if not near:
        return []
    exact = df.agg(*(F.count_distinct(c).alias(c) for c in near)).first()
    return [c for c in near if exact[c] <= most]


def value_counts(df: DataFrame, *names: str) -> DataFrame:
    """(label, value, n) of every named column, in one shuffle."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("label"), F.col(c).cast("string").alias("value")) for c in names))).alias("p")
    return df.select(pairs).groupBy("p.label", "p.value").agg(F.count("*").alias("n")).select("label", "value", "n")


def acquisitions(obs: DataFrame, subject: str, order: Sequence[str], collection: str) -> DataFrame:
    """``obs`` with ``obs_id``: subject_collection, and _acq-k from a subject's second volume on."""
    k = F.row_number().over(Window.partitionBy(subject).orderBy(*order)) - 1
    base = F.concat_ws("_", F.col(subject).cast("string"), F.lit(collection))
    return obs.withColumn("_k", k).withColumn("obs_id", F.when(F.col("_k") == 0, base).otherwise(F.concat(base, F.lit("_acq-"), F.col("_k").cast("string")))).drop("_k")


def study_faults(meta: DataFrame, collections: dict[str, DataFrame], subject: str = SUBJECT, obs_id: str = OBS) -> DataFrame:
    """(fault, key): orphan observations, duplicate obs ids across collections, stale ``obs_ids``; empty for a sound study."""
    whole = None
    for name, obs in collections.items():
        one = obs.select(F.col(subject).cast("string").alias("s"), F.col(obs_id).cast("string").alias("o"), F.lit(name).alias("c"))
        whole = one if whole is None else whole.unionByName(one)
    keys = meta.select(F.col(subject).cast("string").alias("s"))
    out = meta.select(F.lit("subject listed twice").alias("fault"), F.col(subject).cast("string").alias("key")).groupBy("fault", "key").count().where("count > 1").drop("count")
    if whole is not None:
        out = out.unionByName(whole.join(keys, "s", "left_anti").select(F.lit("observation without subject").alias("fault"), F.col("o").alias("key")))
        out = out.unionByName(duplicates(whole, "o").select(F.lit("obs_id used twice").alias("fault"), F.col("o").alias("key")))
        if "obs_ids" in meta.columns:
            true = with_obs_ids(keys, whole.select("s", "o"), "s", "o")
            said = meta.select(F.col(subject).cast("string").alias("s"), F.to_json(F.array_sort(F.from_json("obs_ids", "array<string>"))).alias("said"))
            out = out.unionByName(true.join(said, "s").where("not (obs_ids <=> said)").select(F.lit("obs_ids is stale").alias("fault"), F.col("s").alias("key")))
    return out
