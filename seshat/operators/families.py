"""Provenance families, and results that show each family once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stable_id
from ..plans.staging import Staging
from .components import components


def families(docs: DataFrame, links: DataFrame) -> DataFrame:
    """(vault_id, path, family_seed, family_id) for each document.

    links: (vault_id, path, target) within a vault. A family is a connected component of documents and
    targets, targets that don't exist included; its seed is the smallest path in it.
    """
    node = lambda path: F.xxhash64("vault_id", path)
    staged = Staging(docs.sparkSession, "families")
    edges = links.dropna().select(node("path").alias("a"), node("target").alias("b"))
    roots = components(edges, staged, "stars")
    names = docs.select("vault_id", "path").union(links.dropna().select("vault_id", "target")).distinct().withColumn("node", node("path"))
    joined = names.join(roots, names["node"] == roots["a"], "left").select("vault_id", "path", F.coalesce("b", "node").alias("root"))
    seeds = joined.groupBy("vault_id", "root").agg(F.min("path").alias("family_seed"))
    own = docs.select("vault_id", "path").distinct().join(joined, ["vault_id", "path"]).join(seeds, ["vault_id", "root"])
    return own.select("vault_id", "path", "family_seed", stable_id("provenance-family", F.col("vault_id"), F.col("family_seed")).alias("family_id"))


def once_a_family(results: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    """The first result of each (vault_id, family_seed), renumbered as rk, up to the limit."""
    first = results.withColumn("seshat_rn", F.row_number().over(Window.partitionBy("vault_id", "family_seed").orderBy(*order))).where("seshat_rn = 1").drop("seshat_rn")
    top = first.orderBy(*order).limit(limit)
    return top.withColumn("rk", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def support(members: DataFrame) -> DataFrame:
    """(vault_id, family_seed, supporting_n, audit_n) of (vault_id, family_seed, source_role) rows."""
    count = lambda *roles: F.count(F.when(F.col("source_role").isin(*roles), 1))
    return members.groupBy("vault_id", "family_seed").agg(count("source_manifest", "raw_evidence").alias("supporting_n"), count("generated_view", "operation_log", "audit_record").alias("audit_n"))


def duplication(results: DataFrame) -> DataFrame:
    """ratio: the share of results beyond the first of their family."""
    n, distinct = F.count("*"), F.count_distinct("vault_id", "family_seed")
    return results.agg(F.when(n > 0, (n - distinct) / n).otherwise(0.0).alias("ratio"))
