"""What has been read: counters of a query's scans, from Spark's own metrics, and of single reads of a collection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class ScanStats:
    files: int
    bytes: int
    rows: int
    scans: int

    @property
    def bytes_per_row(self) -> float:
        return self.bytes / self.rows if self.rows else 0.0


@dataclass(frozen=True)
class ReadStats:
    """Single reads of a collection's volumes by this driver: lookups of tiles, row groups and bytes."""

    hits: int = 0
    misses: int = 0
    reads: int = 0
    groups: int = 0
    bytes: int = 0
    parallel: int = 0

    @property
    def hit_rate(self) -> float:
        return self.hits / (self.hits + self.misses) if self.hits + self.misses else 0.0

    @property
    def miss_rate(self) -> float:
        return 1.0 - self.hit_rate

    @property
    def parallel_rate(self) -> float:
        return self.parallel / self.reads if self.reads else 0.0


class Reads:
    """``with Reads(collection) as r: ...``; ``r.stats`` holds what was read inside."""

    def __init__(self, collection):
        self.collection = collection

    def _now(self) -> dict[str, int]:
        files = self.collection.local_tiles()
        return dict(files.counters) if files is not None else {}

    def __enter__(self) -> Reads:
        self._before = self._now()
        self.stats = ReadStats()
        return self

    def __exit__(self, *_) -> None:
        self.stats = ReadStats(**{k: n - self._before.get(k, 0) for k, n in self._now().items()})


def _nodes(plan):
    stack = [plan]
    while stack:
        p = stack.pop()
        yield p
        name = p.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            stack.append(p.executedPlan())
        elif "QueryStage" in name:
            stack.append(p.plan())
        children = p.children()
        stack += [children.apply(i) for i in range(children.size())]


def scan_stats(df: DataFrame) -> ScanStats:
    """Runs ``df`` to a sink that keeps nothing and adds up the metrics of its file scans."""
    execution = df._jdf.queryExecution()

    execution.toRdd().count()
    total = {"numFiles": 0, "filesSize": 0, "numOutputRows": 0}
    scans = 0
    for p in _nodes(execution.executedPlan()):
        if "Scan" in p.nodeName():
            scans += 1
            for k in total:
                m = p.metrics().get(k)
                if m.isDefined():
                    total[k] += int(m.get().value())
    return ScanStats(total["numFiles"], total["filesSize"], total["numOutputRows"], scans)
