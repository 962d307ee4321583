"""Reciprocal-rank fusion of ranked signals, and their evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The rank constant and the weights of the signals.
RANK_CONSTANT = 60
WEIGHTS = {"keyword": 1.0, "vector": 1.0, "graph": 0.75}


def fuse(signals: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """keys, fused (sum of weight / (60 + rank)), best_rank, kinds: signals are frames of keys and rk.

    Terms are added in sorted order, so that the sum is the same in any partitioning.
    """
    parts = [df.select(*keys, "rk", F.lit(kind).alias("kind"), (F.lit(WEIGHTS[kind]) / (F.col("rk") + RANK_CONSTANT)).alias("term")) for kind, df in signals.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    groups = rows.groupBy(*keys).agg(F.sort_array(F.collect_list("term")).alias("terms"), F.min("rk").alias("best_rank"), F.array_sort(F.collect_set("kind")).alias("kinds"))
    return groups.select(*keys, F.aggregate("terms", F.lit(0.0), lambda a, t: a + t).alias("fused"), "best_rank", "kinds")


def resolve(fused: DataFrame, evidence: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Candidates with their live evidence, and those that have none, for warnings."""
    return fused.join(evidence, list(keys)), fused.join(evidence, list(keys), "left_anti")
