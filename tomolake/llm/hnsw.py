"""Approximate nearest neighbours by inner product: a small-world graph per shard.

Distinct vectors are dealt to shards of about ``shard_rows`` by hash; a shard is one
task, so its work has a bound. A shard's graph is hierarchical: each node has a level
drawn geometrically; on every layer nodes are inserted in turn, linked to diverse
near neighbours among those before (a neighbour is skipped when one already chosen
is nearer to it), with links back; lists that overflow are thinned by the same rule.
The candidates of an insertion are the nearest nodes themselves, by products of
blocks of the shard: at a shard's size that is cheaper than to search the graph for
them, and no candidate is missed.
The index is a row per shard of flat arrays. Vectors of unequal length get one more
coordinate that makes all norms equal, which turns inner product into nearness.

Queries are dealt to blocks as large as a shard, so that a shard's copies for further
blocks weigh no more than the queries that it must meet anyway; each (shard, block)
descends the layers and widens to a beam of ``ef``, many queries in step. Scores are recomputed in double precision from
the original vectors, and the shards' best are merged.

Equal vectors are one node that carries its smallest ids (one more than ``k``), so a
vector that a third of all rows repeat neither fills a task nor bends the graph.

Defined cases: null, empty or zero vectors and ones with null or non-finite parts
take no part; vectors of different dimension do not meet; null ids take no part;
repeated ids count once per vector; ties go to the smaller id; vectors are read at
any length; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tomolake.llm import scratch


@dataclass(frozen=True)
class Graph:
    m: int = 16
    candidates: int = 64
    ef: int = 160
    shard_rows: int = 8192
    block_rows: int = 8192
    step: int = 256  # queries in step
    seed: int = 3


def _pick(x: np.ndarray, base: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` diverse of ``ids`` (nearest first), filled up with the nearest of the rest."""
    if len(ids) <= most:
        return ids
    v = x[ids]
    near, among = v @ base, v @ v.T
    nearest = np.full(len(ids), -np.inf, np.float32)
    chosen: list[int] = []
    for k in range(len(ids)):
        if near[k] > nearest[k]:
            chosen.append(k)
            if len(chosen) == most:
                break
            np.maximum(nearest, among[k], out=nearest)
    if len(chosen) < most:
        rest = np.setdiff1d(np.arange(len(ids)), chosen)[: most - len(chosen)]
        chosen += rest.tolist()
    return ids[chosen]


def _layer(x: np.ndarray, nodes: np.ndarray, most: int, g: Graph) -> np.ndarray:
    """Neighbours of each of ``nodes`` (numbers of all nodes; -1 pads), inserted in turn."""
    n = len(nodes)
    lists: list[list[int]] = [[] for _ in range(n)]
    y = x[nodes]

    def thin(j: int) -> None:
        ids = np.array(lists[j])
        ids = ids[np.argsort(-(y[ids] @ y[j]), kind="stable")]
        lists[j] = _pick(y, y[j], ids, most).tolist()

    for lo in range(0, n, 256):
        hi = min(n, lo + 256)
        s = y[lo:hi] @ y[:hi].T
        s[np.arange(hi) >= np.arange(lo, hi)[:, None]] = -np.inf
        wide = min(g.candidates, hi)
        top = np.argpartition(-s, wide - 1, axis=1)[:, :wide]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)
        for i in range(lo, hi):
            if not i:
                continue
            ids = _pick(y, y[i], top[i - lo][: min(i, wide)], g.m)
            lists[i] += ids.tolist()
            for j in ids.tolist():
                lists[j].append(i)
                if len(lists[j]) > 2 * most:
                    thin(j)
    out = np.full((n, most), -1, np.int32)
    for j in range(n):
        if len(lists[j]) > most:
            thin(j)
        out[j, : len(lists[j])] = nodes[lists[j]]
    return out


def lifted(vectors: np.ndarray) -> np.ndarray:
    """The vectors with one more coordinate, so that all norms are equal."""
    sq = (vectors**2).sum(1)
    return np.concatenate([vectors, np.sqrt(np.maximum(sq.max() - sq, 0))[:, None]], 1).astype(np.float32)


def build(vectors: np.ndarray, g: Graph) -> dict[str, np.ndarray]:
    """The flat arrays of a shard's graph: level sizes, each layer's nodes, and neighbours row by row."""
    n = len(vectors)
    x = lifted(vectors)
    u = np.random.default_rng(g.seed).random(n)
    level = np.minimum((-np.log(np.maximum(u, 1e-12)) / np.log(g.m)).astype(int), 8)
    sizes, nodes, links = [], [], []
    for k in range(int(level.max()) + 1):
        at = np.flatnonzero(level >= k).astype(np.int32)
        sizes.append(len(at))
        nodes.append(at)
        links.append(_layer(x, at, 2 * g.m if not k else g.m, g).ravel())
    return {"sizes": np.array(sizes, np.int32), "nodes": np.concatenate(nodes), "links": np.concatenate(links)}


def search(vectors: np.ndarray, index: dict[str, np.ndarray], queries: np.ndarray, k: int, g: Graph) -> np.ndarray:
    """queries x k: the best nodes found, best first; -1 pads."""
    n, q = len(vectors), queries.astype(np.float32)
    x = vectors.astype(np.float32)
    sizes = index["sizes"]
    layers, a, b = [], 0, 0
    for l, m in enumerate(sizes):
        width = 2 * g.m if not l else g.m
        layers.append((index["nodes"][a : a + m], index["links"][b : b + m * width].reshape(m, width)))
        a, b = a + m, b + m * width
    rows = np.arange(len(q))
    at = np.full(len(q), layers[-1][0][0])
    score = (x[at] * q).sum(1)
    for nodes, links in reversed(layers[1:]):
        while True:
            near = links[np.searchsorted(nodes, at)]
            s = np.where(near >= 0, np.einsum("qmd,qd->qm", x[near], q), -np.inf)
            best = s.argmax(1)
            better = s[rows, best] > score
            if not better.any():
                break
            at = np.where(better, near[rows, best], at)
            score = np.where(better, s[rows, best], score)
    ef = min(g.ef, n)
    links = layers[0][1]
    seen = np.zeros((len(q), n + 1), bool)
    seen[:, n] = True
    seen[rows, at] = True
    ids = np.full((len(q), ef), n, np.int64)
    val = np.full((len(q), ef), -np.inf, np.float32)
    done = np.ones((len(q), ef), bool)
    ids[:, 0], val[:, 0], done[:, 0] = at, score, False
    live = rows
    while len(live):
        # the four best that are not expanded yet
        open_val = np.where(done[live], -np.inf, val[live])
        w = min(4, ef)
        take = np.argpartition(-open_val, w - 1, axis=1)[:, :w]
        usable = np.take_along_axis(open_val, take, 1) > -np.inf
        done[live[:, None], take] = True
        source = np.where(usable, ids[live[:, None], take], -1)
        near = np.where(source[:, :, None] >= 0, links[source], -1).reshape(len(live), -1).astype(np.int64)
        near[near < 0] = n
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        near[seen[live[:, None], near]] = n
        seen[live[:, None], near] = True
        s = np.full(near.shape, -np.inf, np.float32)
        r, c = np.nonzero(near < n)
        s[r, c] = np.einsum("ed,ed->e", x[near[r, c]], q[live[r]])
        all_ids = np.concatenate([ids[live], near], 1)
        all_val = np.concatenate([val[live], s], 1)
        all_done = np.concatenate([done[live], s == -np.inf], 1)
        keep = np.argpartition(-all_val, ef - 1, axis=1)[:, :ef]
        ids[live], val[live], done[live] = (np.take_along_axis(z, keep, 1) for z in (all_ids, all_val, all_done))
        live = live[~done[live].all(1)]
    order = np.argsort(-val, axis=1, kind="stable")[:, : min(k, ef)]
    top, v = np.take_along_axis(ids, order, 1), np.take_along_axis(val, order, 1)
    return np.where(v > -np.inf, top, -1)


_INDEX = "dim int, shard int, ids array<array<long>>, vectors binary, sizes binary, nodes binary, links binary"


def _built(g: Graph):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("first_id", ignore_index=True)
        vectors = np.array(pdf["vec"].tolist(), float)
        flat = build(vectors, g)
        return pd.DataFrame(
            {"dim": [pdf["dim"].iloc[0]], "shard": [pdf["shard"].iloc[0]], "ids": [[list(i) for i in pdf["ids"]]], "vectors": [vectors.tobytes()], **{k: [v.tobytes()] for k, v in flat.items()}}
        )

    return run


def _found(k: int, g: Graph):
    def run(asked: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        columns = ["asked", "vec_id", "score"]
        if not len(asked) or not len(index):
            return pd.DataFrame({c: [] for c in columns})
        row = index.iloc[0]
        vectors = np.frombuffer(row["vectors"], float).reshape(-1, int(row["dim"]))
        flat = {c: np.frombuffer(row[c], np.int32) for c in ("sizes", "nodes", "links")}
        ids = row["ids"]
        out = []
        for lo in range(0, len(asked), g.step):
            part = asked.iloc[lo : lo + g.step]
            q = np.array(part["vec"].tolist(), float)
            for who, v, top in zip(part["asked"], q, search(vectors, flat, q, k, g), strict=True):
                top = top[top >= 0]
                score = (vectors[top] * v).sum(1)
                rows = [(-s, i) for t, s in zip(top.tolist(), score.tolist(), strict=True) for i in ids[t]]
                out += [(who, i, -s) for s, i in sorted(rows)[:k]]
        return pd.DataFrame(out, columns=columns)

    return run


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, vec): ids with vectors that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & fine & F.exists("vec", lambda x: x != 0)).distinct()


def nearest(vectors: DataFrame, queries, k: int = 20, g: Graph = Graph(), id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row for which the condition ``queries`` on vec_id holds; a row is no neighbour of itself."""
    spark = vectors.sparkSession
    # equal vectors are found by 128 bits of hash, so that no array is compared or sorted
    same = ["k1", "k2"]
    marked = usable(vectors, id_col, vec_col).withColumn("k1", F.xxhash64("vec")).withColumn("k2", F.xxhash64(F.lit(1), "vec"))
    all_rows = scratch.written(marked, "vectors")
    by_vec = Window.partitionBy(*same).orderBy("vec_id")
    # the limit on row_number is applied before the shuffle too, so copies do not travel
    few = all_rows.withColumn("_n", F.row_number().over(by_vec)).where(F.col("_n") <= k + 1)
    once = few.groupBy(*same).agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("vec").alias("vec")).withColumn("first_id", F.col("ids")[0]).withColumn("dim", F.size("vec"))
    once = scratch.written(once, "distinct-vectors")
    shards = max(1, -(-once.count() // g.shard_rows))
    index = scratch.written(
        once.withColumn("shard", F.pmod("k1", F.lit(shards)).cast("int")).groupBy("dim", "shard").applyInPandas(_built(g), _INDEX), "hnsw"
    )
    asked = scratch.written(all_rows.where(queries).groupBy(*same).agg(F.min("vec_id").alias("asked"), F.first("vec").alias("vec")).withColumn("dim", F.size("vec")), "asked")
    blocks = max(1, -(-asked.count() // g.block_rows))
    to_shards = asked.select("dim", "asked", "vec", F.pmod(F.xxhash64("asked"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    to_blocks = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    key = ["dim", "shard", "block"]
    found = to_shards.groupBy(*key).cogroup(to_blocks.groupBy(*key)).applyInPandas(_found(k + 1, g), "asked long, vec_id long, score double")
    best = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    merged = found.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k + 1).drop("_n")
    who = all_rows.where(queries).select(F.col("vec_id").alias("query_id"), *same).join(asked.select(*same, "asked"), same).select("query_id", "asked")
    rows = who.join(merged, "asked").where("query_id <> vec_id")
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
