"""Tables that cut lineage, and connected components built on them.

Intermediate tables are written to the folder that all executors share
(``spark.checkpoint.dir``); a lost executor then costs a task, not a plan.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_scopes: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is set and the executors are this machine's threads (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="scratch-")
    return _own["dir"]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may be gone at exit
        pass


def remove(df: DataFrame | None) -> None:
    """Delete a table made by ``written`` once nothing reads it any more."""
    path = getattr(df, "_scratch_path", None)
    if path:
        _remove(df.sparkSession, path)


def collected(spark: SparkSession) -> None:
    """Shuffle files of jobs that are done go now, not when the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextlib.contextmanager
def scope() -> Iterator[None]:
    """Tables written inside are deleted at its end, but for those that ``keep`` names: use it where a result is written out whole."""
    made: list[DataFrame] = []
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes.remove(made)
        for df in made:
            remove(df)


def keep(df: DataFrame, inner: bool = False) -> DataFrame:
    """``df`` outlives the open scopes; with ``inner`` only the innermost, and is the next one's."""
    held = any(d is df for made in _scopes for d in made)
    for made in _scopes:
        made[:] = [d for d in made if d is not df]
    if inner and held and len(_scopes) > 1:
        _scopes[-2].append(df)
    return df


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(schema).parquet(path)
    out._scratch_path = path
    if _scopes:
        _scopes[-1].append(out)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(node, component) for every node of ``edges`` (a long, b long); component is the smallest node.

    Each round hooks a node's label to the least label beside it and then jumps
    to that label's own label, so rounds grow with the logarithm of the longest
    path. Hubs are pre-aggregated (``min`` combines on the map side); every
    round is written out.
    """
    e = edges.where("a is not null and b is not null and a <> b")
    both = written(e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("component")), "cc-0")
    for k in range(1, most_rounds + 1):
        beside = (
            both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("least"))
        )
        hooked = labels.join(beside, labels.node == beside.a, "left").select(
            "node", "component", F.least("component", F.coalesce("least", "component")).alias("hooked")
        )
        # the old component takes the best label that any of its nodes has found
        root = hooked.groupBy("component").agg(F.min("hooked").alias("to")).withColumnRenamed("component", "root")
        new = written(
            hooked.join(root, hooked.hooked == root.root, "left").select(
                "node", F.least("hooked", F.coalesce("to", "hooked")).alias("component"), (F.col("component")).alias("was")
            ),
            f"cc-{k}",
        )
        changed = new.where("component <> was").limit(1).count()
        remove(labels)
        labels = new.select("node", "component")
        labels._scratch_path = new._scratch_path
        if not changed:
            remove(both)
            return labels
    raise RuntimeError("components did not settle")


def _marked(df: DataFrame, key: str, ids: DataFrame, bits: int) -> DataFrame:
    """``df`` with ``_maybe``: false only where ``key`` is surely not in ``ids`` (one column)."""

    def place(c):
        return F.pmod(F.xxhash64(c), F.lit(1 << bits))

    h = ids.select(place(F.col(ids.columns[0])).alias("h"))
    table = h.groupBy(F.expr("bitmap_bucket_number(h)").alias("_bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(h))").alias("_bits"))
    rows = df.withColumn("_h", place(F.col(key).cast(ids.schema[0].dataType))).withColumn("_bucket", F.expr("bitmap_bucket_number(_h)")).withColumn("_at", F.expr("bitmap_bit_position(_h)"))
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    bit = byte.bitwiseAND(F.expr("cast(pow(2, _at % 8) as int)")) != 0
    return rows.join(F.broadcast(table), "_bucket", "left").withColumn("_maybe", F.coalesce(bit, F.lit(False))).drop("_h", "_bucket", "_at", "_bits")


def prefiltered(df: DataFrame, key: str, ids: DataFrame, bits: int = 26) -> DataFrame:
    """The rows of ``df`` whose ``key`` may be in ``ids`` (one column), before a join that decides.

    A bit table of at most 2**bits bits (8 MB) is broadcast, in rows of 4 KB; it
    has false positives only. Long rows that the join would drop then need no shuffle.
    """
    return _marked(df, key, ids, bits).where("_maybe").drop("_maybe")


def without(df: DataFrame, key: str, ids: DataFrame, bits: int = 26) -> DataFrame:
    """The rows of ``df`` whose ``key`` is not in ``ids``; only those that the bit table finds are shuffled."""
    marked = _marked(df, key, ids, bits)
    gone = ids.select(F.col(ids.columns[0]).alias("_gone")).distinct()
    asked = marked.where("_maybe").drop("_maybe")
    return marked.where("not _maybe").drop("_maybe").unionByName(asked.join(gone, asked[key] == gone["_gone"], "left_anti"))
