from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from seshat.functions import text as T
from seshat.functions.predicates import SEARCH_MODES, document_role, in_scope, item_type


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("heading", "slug"), [("Hello, World!", "hello-world"), ("  결정 Log ", "결정-log"), ("!!!", "section"), ("Été 2", "t-2")])
def test_anchor(spark, heading, slug):
    assert one(spark, T.anchor(F.col("h")), h=heading) == slug


def test_null_parts_of_ids_count_as_empty(spark):
    assert one(spark, T.stable_id("chunk", F.col("a"), F.col("b")), a="x", b=None) == hashlib.sha256(b"chunk:x:").hexdigest()


@pytest.mark.parametrize(
    ("raw", "path"),
    [
        ("b", "b.md"), ("wiki/b.md#part", "wiki/b.md"), ("./b|name", "wiki/x/b.md"), ("../b", "wiki/b.md"), ("../../../b", None), ("/raw/c", "raw/c.md"),
        ("https://a.test/b", None), ("#part", None), ("", None), (None, None),
    ],
)
def test_link_target(spark, raw, path):
    assert one(spark, T.link_target(F.col("s"), F.col("r")), s="wiki/x/a.md", r=raw) == path


@pytest.mark.parametrize(("raw", "path"), [("[[concepts/a|A]]", "wiki/concepts/a.md"), ("raw/x.md#y", "raw/x.md"), ("raw\\x", "raw/x.md"), ("http://x/y", None), ("../x", None), ("/x", None), (" ", None), ("other/x", "other/x")])
def test_provenance_path(spark, raw, path):
    assert one(spark, T.provenance_path(F.col("r")), r=raw) == path


def test_excerpt_and_words(spark):
    assert one(spark, T.excerpt(F.col("t"), 10), t="a  b\nc d e f g h i") == "a b c d..."
    assert one(spark, T.word_count(F.col("t")), t=" a  b\nc ") == 3
    assert one(spark, T.entity_name(F.col("t")), t="  The  Graph ") == "the graph"


def test_scope_is_exact_prefix(spark):
    rows = spark.createDataFrame([(p,) for p in ("wiki", "wiki/a.md", "wikix/a.md", "Wiki/a.md", "wi_i/a.md")], "path string")
    assert [r[0] for r in rows.where(in_scope(F.col("path"), ["wiki", "wi_i/a.md"])).collect()] == ["wiki", "wiki/a.md", "wi_i/a.md"]


@pytest.mark.parametrize(
    ("path", "kind", "role"),
    [
        ("raw/a.md", "log", "raw_evidence"), ("scratch/reports/a.md", None, "audit_record"), ("docs/a.md", None, "operating_contract"), ("wiki/log.md", None, "operation_log"),
        ("wiki/a.md", " LOG ", "operation_log"), ("wiki/index.md", None, "generated_view"), ("wiki/maps/a.md", None, "generated_view"), ("wiki/sources/a.md", None, "source_manifest"),
        ("wiki/a.md", "source", "source_manifest"), ("wiki/a.md", None, "canonical_knowledge"),
    ],
)
def test_role(spark, path, kind, role):
    assert one(spark, document_role(F.col("p"), F.col("k")), p=path, k=kind) == role
    assert role in SEARCH_MODES["all"]


def test_item_type(spark):
    kinds = [("wiki/decisions/a.md", "", "", "decision"), ("wiki/a.md", "", "Policy", "constraint"), ("wiki/a.md", "Open question", "", "open_question"), ("wiki/status.md", "", "", "current_state"), ("raw/a.md", "", "", "source"), ("wiki/a.md", None, None, "page")]
    rows = spark.createDataFrame(kinds, "path string, section string, title string, wanted string")
    assert all(a == b for a, b in rows.select(item_type(F.col("path"), F.lit(None).cast("string"), F.col("section"), F.col("title")), "wanted").collect())
