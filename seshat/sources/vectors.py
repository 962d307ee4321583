"""Vectors kept as key/value rows, and their manifest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def manifest(rows: DataFrame, fields: Sequence[str], key: str = "vector_id") -> DataFrame:
    """One row a vector of (vector_id, key, value) rows: a column for each field, null where a vector has no such row.

    The fields are named, so that no job looks for them. Of a field's several values the least one counts.
    """
    return rows.groupBy(key).pivot("key", list(fields)).agg(F.min("value"))


def entries(wide: DataFrame, fields: Sequence[str], key: str = "vector_id") -> DataFrame:
    """The (vector_id, key, value) rows of a manifest; nulls give none."""
    pairs = F.array(*(F.struct(F.lit(f).alias("key"), F.col(f).cast("string").alias("value")) for f in fields))
    return wide.select(key, F.inline(pairs)).where("value IS NOT NULL")
