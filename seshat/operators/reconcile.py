"""Differences between two snapshots, tombstones, and new snapshots from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def plan(current: DataFrame, desired: DataFrame, keys: Sequence[str], compared: Sequence[str]) -> DataFrame:
    """keys and action: insert, update, delete or unchanged. Nulls are equal to each other, in keys too."""
    side = lambda df, name: df.select(F.struct(*keys).alias(f"k_{name}"), F.struct(*compared).alias(f"v_{name}"))
    old, new = side(current, "old"), side(desired, "new")
    both = old.join(new, F.col("k_old").eqNullSafe(F.col("k_new")), "full_outer")
    action = F.when(F.col("k_old").isNull(), "insert").when(F.col("k_new").isNull(), "delete").when(F.col("v_old").eqNullSafe(F.col("v_new")), "unchanged").otherwise("update")
    key = F.coalesce("k_new", "k_old")
    return both.select(*(key[k].alias(k) for k in keys), action.alias("action"))


def apply(current: DataFrame, desired: DataFrame, planned: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The new snapshot: unchanged rows of ``current``, inserted and updated rows of ``desired``."""
    only = lambda *actions: planned.where(F.col("action").isin(*actions)).select(*keys)
    return current.join(only("unchanged"), list(keys), "left_semi").unionByName(desired.join(only("insert", "update"), list(keys), "left_semi"))


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by the order's columns, which make it total."""
    window = Window.partitionBy(*keys).orderBy(*(F.desc_nulls_last(c) for c in order))
    return rows.withColumn("seshat_rn", F.row_number().over(window)).where("seshat_rn = 1").drop("seshat_rn")


def violations(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that more than one row has, with their number; empty for a valid plan."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def plan_scoped(current: DataFrame, desired: DataFrame, keys: Sequence[str], compared: Sequence[str], scope: str, scopes: Sequence[str]) -> DataFrame:
    """``plan`` for the rows whose ``scope`` (a key) is asked for; all other current rows are carried, wanted or not."""
    inside = F.col(scope).isin(*scopes)
    return plan(current.where(inside), desired.where(inside), keys, compared).unionByName(current.where(~inside).select(*keys, F.lit("carried").alias("action")))


def apply_scoped(current: DataFrame, desired: DataFrame, planned: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The new snapshot of ``plan_scoped``: carried and unchanged rows of ``current``, inserted and updated ones of ``desired``."""
    only = lambda *actions: planned.where(F.col("action").isin(*actions)).select(*keys)
    return current.join(only("carried", "unchanged"), list(keys), "left_semi").unionByName(desired.join(only("insert", "update"), list(keys), "left_semi"))


def replace_owned(current: DataFrame, fresh: DataFrame, planned: DataFrame, owner: Sequence[str]) -> DataFrame:
    """Rows that belong to planned owners (a document's postings or vectors, a file's symbols): those of deleted and
    updated owners go, and the fresh rows of inserted and updated ones come."""
    only = lambda *actions: planned.where(F.col("action").isin(*actions)).select(*owner)
    return current.join(only("update", "delete"), list(owner), "left_anti").unionByName(fresh.join(only("insert", "update"), list(owner), "left_semi"))


def without_ends(edges: DataFrame, nodes: DataFrame, key: str, ends: Sequence[str] = ("source", "target")) -> DataFrame:
    """Edges whose ends are all nodes that are still there."""
    for end in ends:
        edges = edges.join(nodes.select(F.col(key).alias(end)).distinct(), end, "left_semi")
    return edges


def plan_aggregates(current: DataFrame, desired: DataFrame, keys: Sequence[str], evidence: str) -> DataFrame:
    """``plan`` for rows with several pieces of evidence each: a key is updated if its set of evidence differs."""
    sets = lambda df: df.groupBy(*keys).agg(F.array_sort(F.collect_set(evidence)).alias("all"))
    return plan(sets(current), sets(desired), keys, ["all"])


def record(log: DataFrame, scope: str, spec: str, at: str, run_id: str, status: str, message: str | None = None) -> DataFrame:
    """``log`` with one more run; ``readiness.runs`` reads the last of each (scope, spec)."""
    row = log.sparkSession.range(1).select(F.lit(scope).alias("scope"), F.lit(spec).alias("spec"), F.lit(at).cast(dict(log.dtypes)["at"]).alias("at"), F.lit(run_id).alias("run_id"), F.lit(status).alias("status"), F.lit(message).cast("string").alias("message"))
    return log.unionByName(row)


def crossing(edges: DataFrame, nodes: DataFrame, key: str, scope: str) -> DataFrame:
    """Edges (source, target) whose ends are of two scopes; empty for a valid plan."""
    end = lambda c: nodes.select(F.col(key).alias(c), F.col(scope).alias(f"{c}_scope"))
    return edges.join(end("source"), "source").join(end("target"), "target").where("source_scope <> target_scope")


def uncovered(planned: DataFrame, manifest: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the manifest that no planned action names; empty for a valid plan."""
    return manifest.join(planned.select(*keys), list(keys), "left_anti")
