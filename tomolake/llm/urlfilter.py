"""URL filters: rules first, then trust and distrust over the graph of hosts.

A URL takes the verdict of the longest rule that fits it. Others take their host's:
trust is a personalised PageRank from hosts with allowed pages along links, distrust
one from hosts with blocked pages against the links, and a host is blocked when its
distrust, times the number of blocked pages, reaches ``floor`` and its distrust
exceeds ``ratio`` times its trust. Walks go on until no more than ``residual`` of
their mass moves. Everything is
DataFrame operations; links are aggregated to weighted host edges before any join.
Mass at a host without links onward is lost, in both walks.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits
no rule and is allowed; null html has no links; a host with as much trust as distrust
(times ``ratio``) is allowed; very long urls and pages are read whole; repeated pages
count as pages; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomolake.llm import scratch

URL = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
LINK = r"""(?i)\bhref\s*=\s*["']?\s*((?:[a-z][a-z0-9+.\-]*:)?//[^"'\s<>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The registered query's rules: (verdict, rule).
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


@dataclass(frozen=True)
class Walk:
    damping: float = 0.85
    rounds: int = 12  # at least, unless nothing moves any more
    ratio: float = 1.0
    floor: float = 1e-9  # in pages of the seeds, so that it does not depend on the size of the table
    cut_every: int = 4
    residual: float = 1e-6  # of the mass, which still moves when a walk ends


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, slash, rest = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(action)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts."""
    links = pages.where("html is not null").select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("link"))
    link = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), F.col("link"))).otherwise(F.col("link"))
    return links.select("src", host_of(link).alias("dst")).where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def walk(edges: DataFrame, seeds: DataFrame, w: Walk, name: str) -> DataFrame:
    """(host, score): personalised PageRank from ``seeds`` (host, n) along ``edges`` (src, dst, n)."""
    mass = seeds.agg(F.sum("n")).first()[0] or 1
    start = scratch.written(seeds.select("host", (F.col("n") / F.lit(mass)).alias("seed")), f"{name}-seeds")
    out = edges.groupBy("src").agg(F.sum("n").alias("out"))
    steps = scratch.written(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("out")).alias("p")), f"{name}-steps")
    if steps.isEmpty():
        return start.select("host", (F.lit(1 - w.damping) * F.col("seed")).alias("score"))
    # the walk's steps one by one: what moved in step k is all that the scores still lack
    moving = start.select("host", F.col("seed").alias("moved"))
    parts, done, k = [], None, 0
    while True:
        k += 1
        parts.append(moving.select("host", (F.lit(1 - w.damping) * F.col("moved")).alias("score")))
        moving = moving.join(steps, moving.host == steps.src).groupBy("dst").agg(F.sum(F.lit(w.damping) * F.col("moved") * F.col("p")).alias("moved")).withColumnRenamed("dst", "host")
        if k % w.cut_every:
            continue
        old = done
        for part in parts:
            done = part if done is None else done.unionByName(part)
        done, parts = scratch.written(done.groupBy("host").agg(F.sum("score").alias("score")), f"{name}-{k}"), []
        moving = scratch.written(moving, f"{name}-moving-{k}")
        if old is not None:
            scratch.remove(old)
        left = moving.agg(F.sum("moved")).first()[0] or 0.0
        if left == 0 or (k >= w.rounds and left <= w.residual):
            return done.unionByName(moving.withColumnRenamed("moved", "score")).groupBy("host").agg(F.sum("score").alias("score"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, w: Walk = Walk()) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of every row of ``pages`` (page_id, url, html)."""
    raw = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = raw.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    judged = judged.withColumn("rule", rule).withColumn("ruled", verdict)
    seeds = scratch.written(judged.where("ruled is not null").groupBy("host", "ruled").agg(F.count("*").alias("n")), "seeds")
    edges = scratch.written(host_edges(raw), "edges")
    trust = walk(edges, seeds.where("ruled = 'allow'").select("host", "n"), w, "trust")
    against = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    blocked = seeds.where("ruled = 'block'").select("host", "n")
    distrust = walk(against, blocked, w, "distrust")
    floor = w.floor / (blocked.agg(F.sum("n")).first()[0] or 1)
    scores = scratch.written(
        trust.withColumnRenamed("score", "trust").join(distrust.withColumnRenamed("score", "distrust"), "host", "full_outer").select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")),
        "scores",
    )
    by_host = F.when((F.coalesce("distrust", F.lit(0.0)) >= floor) & (F.col("distrust") > F.lit(w.ratio) * F.col("trust")), F.lit("block")).otherwise(F.lit("allow"))
    return judged.join(scores, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", by_host).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")
    )
