"""Exact cosine search over arrays, in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keyword import ranked


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length; an error where their sizes differ."""
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    same = F.size(a) == F.size(b)
    return F.when(same, F.when(norms == 0, 0.0).otherwise(_dot(a, b) / norms)).otherwise(F.raise_error(F.lit("vectors of different sizes")).cast("double"))


def search(vectors: DataFrame, query: Sequence[float], keys: Sequence[str], k: int, *, where: Column | None = None, digits: int = 6) -> DataFrame:
    """keys, score, rk: the k rows nearest to the query, by (score rounded to ``digits`` downwards, keys). ``where`` holds before the limit."""
    rows = vectors if where is None else vectors.where(where)
    target = F.array(*(F.lit(float(x)) for x in query))
    scored = rows.select(*keys, F.round(cosine(F.col("embedding"), target), digits).alias("score"))
    return ranked(scored.orderBy(F.desc("score"), *keys).limit(k), [F.desc("score"), *map(F.col, keys)])
