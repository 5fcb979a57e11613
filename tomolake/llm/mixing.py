"""Mixing sources to target weights over a domain - language - source tree.

Budgets go down the tree: a node's budget is split over its children by weight.
A child takes no more than its subtree can give (its tokens times the most epochs,
without subtrees of weight 0); what it cannot take goes to its siblings by weight first, and only what no sibling
can take is offered, through the parent, to the parent's siblings. Each leaf then
takes the prefix of its documents in a seeded order, epoch after epoch, each with
an order of its own, while the tokens before a document are below its budget.

The prefix needs no leaf in one task: the order is a hash, its first bits cut each
leaf into even buckets whose totals are summed first. Buckets before the one in
which the budget runs out are taken as they are, without a shuffle; only that one
bucket of each leaf is sorted. The tree (one row a leaf) is planned on the driver;
its size is checked.

Defined cases: a null ``lang`` or ``source`` counts as the empty name; null or empty
texts hold no tokens and are never taken; very long texts are counted whole and taken
whole, also where they pass a budget's end; repeated rows are rows of their own; rows
that tie in an epoch's order go by ``doc_id``, then by a hash of the text; weights of
children that are not named are 1, those below 0 count as 0; columns with the names
of added ones give way to them, and any other names may occur; an empty table gives
an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tomolake.llm import scratch

Path = tuple[str, ...]


@dataclass(frozen=True)
class Plan:
    """Weights by path, e.g. {("web",): 2.0, ("web", "en"): 3.0}; a path that is not named weighs 1."""

    tokens: int
    weights: dict[Path, float] = field(default_factory=dict)
    epochs: int = 2
    seed: int = 17
    buckets: int = 1024
    most_leaves: int = 100_000


def domain_of(source: str) -> str:
    """The tree's first level for sources named ``src<k>``: five domains by k modulo 5; other names are a domain of their own."""
    m = re.fullmatch(r"src(\d+)", source)
    return ("web", "books", "news", "code", "forum")[int(m[1]) % 5] if m else source


def domain_column(source: Column) -> Column:
    k = F.regexp_extract(source, r"^src(\d+)$", 1)
    names = F.array(*(F.lit(x) for x in ("web", "books", "news", "code", "forum")))
    return F.when(k != "", F.element_at(names, (F.pmod(k.cast("decimal(38,0)"), F.lit(5)) + 1).cast("int"))).otherwise(source)


def word_tokens(text: Column) -> Column:
    """Tokens as words between white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def budgets(held: dict[Path, int], plan: Plan) -> dict[Path, float]:
    """Each leaf's token budget. ``held``: tokens of each leaf."""
    weight = lambda c: max(0.0, plan.weights.get(c, 1.0))
    capacity: dict[Path, float] = {}
    children: dict[Path, list[Path]] = {}
    for leaf, n in held.items():
        gives = True  # a subtree of weight 0 is no part of what stands above it
        for k in range(len(leaf), -1, -1):
            capacity[leaf[:k]] = capacity.get(leaf[:k], 0) + n * plan.epochs * gives
            gives = gives and (not k or weight(leaf[:k]) > 0)
            if k and leaf[:k] not in children.setdefault(leaf[: k - 1], []):
                children[leaf[: k - 1]].append(leaf[:k])
    out: dict[Path, float] = {}

    def spread(node: Path, budget: float) -> None:
        if node in held:
            out[node] = budget
            return
        share: dict[Path, float] = {}
        live = [c for c in sorted(children.get(node, [])) if capacity[c] > 0 and weight(c) > 0]
        left = budget
        while live:  # children that fill up leave their rest to the others, by weight
            total = sum(weight(c) for c in live)
            full = [c for c in live if left * weight(c) / total >= capacity[c]]
            if not full:
                for c in live:
                    share[c] = left * weight(c) / total
                break
            for c in full:
                share[c] = capacity[c]
            left -= sum(capacity[c] for c in full)
            live = [c for c in live if c not in full]
        for c in sorted(children.get(node, [])):
            spread(c, share.get(c, 0.0))

    if held:
        spread((), min(float(plan.tokens), capacity[()]))
    return out


def mix(docs: DataFrame, plan: Plan | Callable[[int], Plan], tokens: Callable[[Column], Column] = word_tokens) -> DataFrame:
    """The taken documents: columns of ``docs`` with domain, epoch (from 0), n_tokens and leaf_budget."""
    spark = docs.sparkSession
    docs = docs.drop(*(c for c in docs.columns if c.lower() in ("domain", "epoch", "n_tokens", "leaf_budget")))
    # inside, the columns of docs have numbers for names, so that none of them can be taken for another
    names = docs.columns
    own = [f"u{k}" for k in range(len(names))]
    at = {c.lower(): u for c, u in zip(names, own, strict=True)}
    doc, text = F.col(at["doc_id"]).cast("string"), F.col(at["text"]).cast("string")
    rows = (
        docs.toDF(*own)
        .withColumn("lang", F.coalesce(F.col(at["lang"]).cast("string"), F.lit("")))
        .withColumn("source", F.coalesce(F.col(at["source"]).cast("string"), F.lit("")))
        .withColumn("domain", domain_column(F.col("source")))
        .withColumn("doc", F.coalesce(doc, F.lit("")))
    )
    leaf = ["domain", "lang", "source"]
    # texts are counted once for the plan; what follows reads this narrow table
    narrow = scratch.written(rows.select(*leaf, "doc", tokens(text).alias("n_tokens")), "tokens").where("n_tokens > 0")
    totals = narrow.groupBy(*leaf).agg(F.sum("n_tokens").alias("held"))
    limit = plan.most_leaves if isinstance(plan, Plan) else Plan(0).most_leaves
    found = totals.limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"more than {limit} leaves: this tree is planned on the driver")
    held = {(r.domain, r.lang, r.source): r.held for r in found}
    if callable(plan):
        plan = plan(sum(held.values()))
    shares = budgets(held, plan)
    leaves = spark.createDataFrame(
        [(*k, int(shares[k]), min(plan.epochs, -(-int(shares[k]) // held[k]))) for k in sorted(held) if int(shares[k]) > 0],
        T.StructType([*(T.StructField(c, T.StringType()) for c in leaf), T.StructField("leaf_budget", T.LongType()), T.StructField("epochs", T.LongType())]),
    )

    def keyed(df: DataFrame) -> DataFrame:
        """Rows of the leaves that have a budget, once an epoch, with their place in the epoch's order."""
        every = df.join(F.broadcast(leaves), leaf).withColumn("epoch", F.explode(F.expr("sequence(0, cast(epochs as int) - 1)")))
        every = every.withColumn("key", F.md5(F.concat_ws("|", F.lit(str(plan.seed)), "epoch", "doc")))
        return every.withColumn("bucket", (F.conv(F.substring("key", 1, 6), 16, 10).cast("long") * plan.buckets / (1 << 24)).cast("int"))

    # one row a leaf: the bucket in which its budget runs out, and the tokens before that bucket
    order = Window.partitionBy(*leaf).orderBy("epoch", "bucket")
    sums = keyed(narrow).groupBy(*leaf, "leaf_budget", "epoch", "bucket").agg(F.sum("n_tokens").alias("held"))
    runs = sums.withColumn("end", F.sum("held").over(order)).withColumn("start", F.col("end") - F.col("held"))
    cuts = runs.where("start < leaf_budget and end >= leaf_budget").select(*leaf, F.col("epoch").alias("cut_epoch"), F.col("bucket").alias("cut_bucket"), "start").collect()
    shape = T.StructType([*(T.StructField(c, T.StringType()) for c in leaf), T.StructField("cut_epoch", T.IntegerType()), T.StructField("cut_bucket", T.IntegerType()), T.StructField("start", T.LongType())])
    placed = keyed(rows).join(F.broadcast(spark.createDataFrame(cuts, shape)), leaf, "left")
    cut_epoch = F.coalesce("cut_epoch", F.lit(1 << 30))
    whole = placed.where((F.col("epoch") < cut_epoch) | ((F.col("epoch") == cut_epoch) & (F.col("bucket") < F.col("cut_bucket")))).withColumn("n_tokens", tokens(text))
    part = placed.where((F.col("epoch") == cut_epoch) & (F.col("bucket") == F.col("cut_bucket"))).withColumn("n_tokens", tokens(text))
    inside = Window.partitionBy(*leaf).orderBy("key", at["doc_id"], F.xxhash64(at["text"])).rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumn("before", F.col("start") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).where("before < leaf_budget")
    out = [*(F.col(u).alias(c) for u, c in zip(own, names, strict=True)), "domain", "epoch", "n_tokens", "leaf_budget"]
    return whole.where("n_tokens > 0").select(*out).union(part.where("n_tokens > 0").select(*out))
