"""Connected components of a table of links: forests within each partition, then stars over their trees, in rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import Staging

#: Edges that a task is dealt, and numbers that it keeps at once; a partition with more gives several forests.
KEPT = 500_000


def _forests(batches: Iterator[pa.RecordBatch], kept: int = KEPT) -> Iterator[pa.RecordBatch]:
    """Union-find over the edges of a partition: (number, the smallest of its tree) for those that differ."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = root[x]
        return x

    def trees() -> pa.RecordBatch:
        pairs = [(x, r) for x in list(root) if (r := find(x)) != x]
        root.clear()
        return pa.record_batch([pa.array([p[k] for p in pairs], pa.int64()) for k in range(2)], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
            if len(root) >= kept:
                yield trees()
    yield trees()


def _contracted(edges: DataFrame, staged: Staging, name: str, kept: int) -> DataFrame:
    """Fewer edges with the same components, a > b, by forests where the edges are, and again when they are dealt anew: evenly,
    so that no number's edges are one task's."""
    within = lambda df: df.mapInArrow(lambda batches: _forests(batches, kept), "a bigint, b bigint")
    local = staged.write(within(edges.select("a", "b")), f"{name}-local")
    out = staged.write(within(local.repartition(max(1, -(-local.count() // kept)))), name)
    staged.drop(f"{name}-local")
    return out


def _are_stars(edges: DataFrame) -> bool:
    """Whether every number has one smaller neighbour, which has none."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    each = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return each.where("up > 1 OR up = 1 AND down = 1").isEmpty()


def components(links: DataFrame, staged: Staging, name: str, kept: int = KEPT) -> DataFrame:
    """(a, b) with a > b for every linked a that isn't its component's smallest number, which is b.

    links: (a, b) of 64-bit numbers, repeated or not; those with a null and of a number with itself link nothing. Each
    partition's edges become forests, whatever its size, first where the links are, then dealt anew. Until these are stars,
    a round maps neighbours to their smallest one, once for the larger neighbours and once for the smaller, and makes forests
    again; a minimum is pre-aggregated, so a number with many links is no single task's list. Rounds are written, and there
    are at most about as many as log2 of the longest shortest path.
    """
    edges, k = _contracted(links.where("a <> b"), staged, f"{name}-0", kept), 0
    while not _are_stars(edges):
        k += 1
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        edges = _contracted(small, staged, f"{name}-{k}", kept)
        staged.drop(f"{name}-{k - 1}")
    return edges
