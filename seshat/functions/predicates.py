"""Predicates and classifications of documents by path and frontmatter."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# The roles of documents, and which of them each search mode sees.
ROLES = ("raw_evidence", "canonical_knowledge", "source_manifest", "operating_contract", "generated_view", "operation_log", "audit_record")
SEARCH_MODES = {"knowledge": ("canonical_knowledge",), "evidence": ("source_manifest", "raw_evidence"), "operating": ("operating_contract",), "audit": ("generated_view", "operation_log", "audit_record"), "all": ROLES}

# Words by which items of a context pack are typed.
CONSTRAINT_TERMS = ("constraint", "principle", "invariant", "policy", "convention")
QUESTION_TERMS = ("question", "todo", "follow-up", "issue", "revisit")
STATE_TERMS = ("current-state", "current_state")
STATE_SUFFIXES = ("/status.md", "/current-state.md", "/current_state.md")
ITEM_PRIORITY = {"decision": 0, "constraint": 1, "open_question": 2, "current_state": 3, "page": 4, "source": 5}


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(or_, conditions, F.lit(False))


def in_scope(path: Column, scopes: Sequence[str]) -> Column:
    """The path is one of the scopes or below it; prefixes are exact and reach Parquet filters."""
    return any_of([(path == s) | path.startswith(f"{s}/") for s in scopes])


def has_any(text: Column, terms: Sequence[str]) -> Column:
    return any_of([text.contains(t) for t in terms])


def document_role(path: Column, kind: Column) -> Column:
    """One of ROLES; the first rule that fits decides. kind: the frontmatter's type, or null."""
    kind = F.lower(F.trim(F.coalesce(kind, F.lit(""))))
    return (
        F.when(path.startswith("raw/"), "raw_evidence")
        .when(path.startswith("scratch/reports/"), "audit_record")
        .when(path.startswith("docs/"), "operating_contract")
        .when((path == "wiki/log.md") | (kind == "log"), "operation_log")
        .when((path == "wiki/index.md") | path.startswith("wiki/maps/"), "generated_view")
        .when(path.startswith("wiki/sources/") | (kind == "source"), "source_manifest")
        .otherwise("canonical_knowledge")
    )


def item_type(path: Column, kind: Column, section: Column, title: Column) -> Column:
    """A context item's type: the first of the table below whose condition holds, else page."""
    path, kind, section, title = (F.lower(F.coalesce(c, F.lit(""))) for c in (path, kind, section, title))
    words, rooted = F.concat_ws(" ", kind, path, section, title), F.concat(F.lit("/"), path)
    named = {"decision": (), "constraint": CONSTRAINT_TERMS, "open_question": QUESTION_TERMS, "current_state": STATE_TERMS}
    placed = {"decision": rooted.contains("/decisions/"), "current_state": any_of([rooted.endswith(s) for s in STATE_SUFFIXES])}
    table = {name: (kind == name) | has_any(words, terms) | placed.get(name, F.lit(False)) for name, terms in named.items()} | {"source": path.startswith("raw/")}
    return F.coalesce(*(F.when(holds, name) for name, holds in table.items()), F.lit("page"))


def item_priority(kind: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in ITEM_PRIORITY.items() for x in pair)), kind)
