"""Project context: evidence of code and of vaults for one task, with their relations, under a budget."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import code_graph, packing

#: States of an authority, the most severe one first.
SEVERITY = ("unavailable", "partial", "syncing", "unknown", "stale", "fresh")
SECTIONS = ("code", "impact", "tests", "vault")


def combined(states: DataFrame, state: str = "state") -> DataFrame:
    """One row (state): the most severe of all; unknown if there is none."""
    place = F.min(F.array_position(F.array(*map(F.lit, SEVERITY)), F.col(state)))
    return states.agg(F.coalesce(F.element_at(F.array(*map(F.lit, SEVERITY)), F.when(place > 0, place).cast("int")), F.lit("unknown")).alias("state"))


def tokens_of(*parts: Column) -> Column:
    """A quarter of the characters of a row's serialized form, rounded up, 1 at least."""
    return F.greatest(F.ceil(F.length(F.to_json(F.struct(*parts))) / 4), F.lit(1)).cast("bigint")


def evidence(symbols: DataFrame, edges: DataFrame, vault: DataFrame, query: str, limit: int, *, depth: int = 3, repositories: Sequence[str] = ()) -> DataFrame:
    """(section, evidence_id, title, rk): symbols that the query finds, what calls them up to ``depth`` away (tests apart),
    and the vault's results (evidence_id, title, rk)."""
    found = code_graph.search(symbols, query, limit, repositories=repositories)
    names = symbols.select("symbol_id", F.col("qualified_name").alias("title"), "kind")
    code = found.join(names, "symbol_id").select(F.lit("code").alias("section"), F.concat(F.lit("code:"), F.col("symbol_id").cast("string")).alias("evidence_id"), "title", "rk")
    reached = code_graph.traverse(edges, found.select(F.col("symbol_id").cast("string").alias("node")), depth, direction="in")
    near = reached.join(names.withColumn("symbol_id", F.col("symbol_id").cast("string")), reached["target"] == F.col("symbol_id"))
    section = F.when(F.col("kind") == "test", "tests").otherwise("impact")
    impact = near.select(section.alias("section"), F.concat(F.lit("code:"), F.col("target")).alias("evidence_id"), "title", F.col("level").cast("bigint").alias("rk"))
    return code.unionByName(impact).unionByName(vault.select(F.lit("vault").alias("section"), "evidence_id", "title", F.col("rk").cast("bigint").alias("rk")))


def context(rows: DataFrame, max_tokens: int) -> DataFrame:
    """The rows of ``evidence`` in order of section, rank and id, each admitted as far as the budget goes, however many they are."""
    place = F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("section"))
    cost = tokens_of(F.col("section"), F.col("evidence_id"), F.col("title"))
    return packing.admit(rows, [place, F.col("rk"), F.col("evidence_id")], cost, max_tokens, max_items=None)
