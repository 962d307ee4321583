"""Whether what is indexed is what is there: freshness of stores, runs, repositories and bindings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import reconcile

# States from best to worst.
SEVERITY = ("fresh", "syncing", "partial", "stale", "unavailable", "unknown")


def staleness(current: DataFrame, desired: DataFrame, keys: Sequence[str], lineage: Sequence[str], scope: str) -> DataFrame:
    """(scope, upserts, tombstones, state) for each value of the column ``scope``, which is one of the keys."""
    planned = reconcile.plan(current, desired, keys, lineage)
    n = lambda *actions: F.count(F.when(F.col("action").isin(*actions), 1))
    sums = planned.groupBy(scope).agg(n("insert", "update").alias("upserts"), n("delete").alias("tombstones"))
    return sums.withColumn("state", F.when((F.col("upserts") > 0) | (F.col("tombstones") > 0), "stale").otherwise("fresh"))


def worst(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The most severe state of all rows, or for each ``by``; unknown if it is no known state."""
    names = F.array(*map(F.lit, SEVERITY))
    place = F.array_position(names, F.col("state"))
    top = F.max(F.when(place == 0, len(SEVERITY)).otherwise(place).cast("int"))
    rows = states.groupBy(*by) if by else states
    return rows.agg(F.element_at(names, top).alias("state"))


def runs(log: DataFrame) -> DataFrame:
    """The last run of each (scope, spec): (scope, spec, status, at, message)."""
    last = F.max_by(F.struct("status", "message"), F.struct("at", "run_id"))
    return log.groupBy("scope", "spec").agg(last.alias("r"), F.max("at").alias("at")).select("scope", "spec", "r.status", "at", "r.message")


def health(states: DataFrame) -> DataFrame:
    """(kind, ready): a kind is ready if all its parts are fresh."""
    return states.groupBy("kind").agg(F.bool_and(F.col("state") == "fresh").alias("ready"))


def relations(bindings: DataFrame, code_evidence: DataFrame, vault_evidence: DataFrame) -> DataFrame:
    """(repository_id, code_path, vault_path, status): a mapping is explicit if both its ends have evidence, else unresolved."""
    rows = bindings.join(code_evidence.select("repository_id", F.col("path").alias("code_path"), F.lit(True).alias("has_code")).distinct(), ["repository_id", "code_path"], "left")
    rows = rows.join(vault_evidence.select(F.col("path").alias("vault_path"), F.lit(True).alias("has_vault")).distinct(), "vault_path", "left")
    return rows.select("repository_id", "code_path", "vault_path", F.when(F.col("has_code") & F.col("has_vault"), "explicit").otherwise("unresolved").alias("status"))


def lineage(current: DataFrame, expected: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """keys, state, differs: fresh if all lineage fields are as expected, stale with the names of those that aren't, and
    unavailable if there is no current row. Nulls are equal."""
    both = expected.select(*keys, F.struct(*fields).alias("wanted")).join(current.select(*keys, F.struct(*fields).alias("found")), list(keys), "left")
    differs = F.array_compact(F.array(*(F.when(~F.col("wanted")[f].eqNullSafe(F.col("found")[f]), f) for f in fields)))
    state = F.when(F.col("found").isNull(), "unavailable").when(F.size(differs) > 0, "stale").otherwise("fresh")
    return both.select(*keys, state.alias("state"), F.when(F.col("found").isNotNull(), differs).alias("differs"))
