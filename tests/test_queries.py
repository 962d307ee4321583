"""Each query with SQL against DuckDB, on the smallest tables."""

from __future__ import annotations

import math
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def rows(frame) -> list[str]:
    plain = lambda x: None if x is None or x != x else round(float(x), 6) if isinstance(x, float) else int(x) if hasattr(x, "item") and not isinstance(x, (bool, float)) and not math.isnan(x) else x
    return sorted(repr([plain(x) for x in r]) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_is_as_in_sql(spark, tables, name):
    ours, wanted = entry.queries()[name](spark, DATA).toPandas(), tables.sql(entry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(wanted.columns)
    assert rows(ours) == rows(wanted)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_partitions_do_not_matter(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        one = entry.queries()["family_collapse"](spark, DATA).toPandas()
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        assert rows(one) == rows(entry.queries()["family_collapse"](spark, DATA).toPandas())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
