"""Hybrid search: keyword and vector signals, fused, resolved to evidence, one result a family."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import families, fusion, keyword, vector


def candidate_limit(limit: int) -> int:
    """Candidates of each signal for a search of ``limit`` results."""
    return max(4 * limit, 20)


def order() -> list[Column]:
    return [F.desc("fused"), F.col("best_rank"), F.col("doc_id")]


def candidates(corpus: DataFrame, vectors: DataFrame, query: str, query_vector: Sequence[float], limit: int, *, where: Column | None = None) -> DataFrame:
    """(doc_id, fused, best_rank, kinds) of all candidates of a search of ``limit`` results that have evidence.

    corpus: (doc_id, text, ...); vectors: (vec_id, embedding), where a vector's id is its document's. Vectors
    of no document drop out as candidates without evidence.
    """
    k = candidate_limit(limit)
    words = keyword.search(corpus, query, ["doc_id"], k, where=where)
    near = vector.search(vectors, query_vector, ["vec_id"], k).withColumnRenamed("vec_id", "doc_id")
    fused = fusion.fuse({"keyword": words, "vector": near}, ["doc_id"]).withColumn("fused", F.round("fused", 9))
    return fusion.resolve(fused, corpus.select("doc_id"), ["doc_id"])[0]


def hybrid(corpus: DataFrame, vectors: DataFrame, query: str, query_vector: Sequence[float], limit: int, *, where: Column | None = None) -> DataFrame:
    """The ``limit`` best of ``candidates``, numbered rk."""
    return keyword.ranked(candidates(corpus, vectors, query, query_vector, limit, where=where).orderBy(*order()).limit(limit), order())


def family_search(results: DataFrame, members: DataFrame, limit: int) -> DataFrame:
    """results with their families, the first of each family only. members: (vault_id, family_seed, doc_id)."""
    return families.once_a_family(results.drop("rk").join(members, "doc_id"), order(), limit)
