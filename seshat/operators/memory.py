"""Memory views over documents: decisions, open questions, project state, recent changes, audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import has_any

# Words, types and statuses by which documents are taken for a view.
DECISION_TERMS = ("decision", "alternatives", "tradeoff", "trade-off", "revisit")
ISSUE_TYPES = ("issue", "question", "follow_up")
ISSUE_TERMS = ("open questions", "question", "follow-up", "follow up", "todo", "blocker", "revisit")
ACTIVE_STATUSES = ("open", "unresolved", "todo", "blocked", "revisit")
CLOSED_STATUSES = ("closed", "resolved", "done", "accepted", "superseded", "deprecated", "cancelled")
STATE_TYPES = ("project_status", "status", "roadmap", "plan", "overview")
STATE_PATHS = ("status", "roadmap", "plan", "overview")
CONSTRAINT_KEYS = ("constraint", "policy", "boundary", "invariant")
CONSTRAINT_TERMS = ("constraint", "policy", "boundary", "invariant", "non-goal")
CONSTRAINT_PATHS = ("policy", "decision", "convention", "boundary")
PRIORITY_KEYS = ("priority", "next", "roadmap", "phase")
PRIORITY_PATHS = ("roadmap", "todo")
STALE_STATUSES = ("stale", "deprecated", "superseded")
STALE_PATHS = ("deprecated", "superseded")


def _numbered(rows: DataFrame, by: Sequence[str], order: Sequence[Column], limit: int) -> DataFrame:
    ranked = rows.withColumn("rk", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("bigint"))
    return ranked.where(F.col("rk") <= limit)


def candidate_limit(limit: int) -> int:
    """Documents that a view looks into for ``limit`` items of a vault, by path."""
    return min(max(10 * limit, 50), 250)


class _Frontmatter:
    """Columns of a document's frontmatter, a JSON object in the column ``frontmatter``."""

    def __init__(self) -> None:
        self.map = F.from_json("frontmatter", "map<string,string>")
        pairs = F.transform(F.map_entries(self.map), lambda e: F.concat_ws(" ", e["key"], e["value"]))
        self.text = F.lower(F.coalesce(F.array_join(pairs, " "), F.lit("")))
        self.type, self.status = self.value("type"), self.value("status")

    def value(self, key: str) -> Column:
        return F.lower(F.trim(F.coalesce(F.get_json_object("frontmatter", f"$.{key}"), F.lit(""))))

    def has(self, *keys: str) -> Column:
        return F.coalesce(F.arrays_overlap(F.map_keys(self.map), F.array(*map(F.lit, keys))), F.lit(False))


def _looked_into(found: DataFrame, chunks: DataFrame, terms: Sequence[str], limit: int) -> DataFrame:
    """The first candidates of each vault that have evidence, with headed: whether a heading has one of the terms."""
    first = _numbered(found, ["vault_id"], [F.col("path")], candidate_limit(limit)).drop("rk")
    headed = F.bool_or(has_any(F.lower(F.coalesce("section", F.lit(""))), terms)).alias("headed")
    return first.join(chunks.groupBy("vault_id", "path").agg(headed), ["vault_id", "path"])


def decisions(docs: DataFrame, chunks: DataFrame, limit: int) -> DataFrame:
    """(vault_id, path, claim_status, rk), by path, at most ``limit`` a vault.

    docs: (vault_id, path, frontmatter); chunks: (vault_id, path, section). Decisions in their folder, of their type or
    with such a key are stated; other documents with a decision's term in path or frontmatter are heading candidates
    if a heading has one too, else derived from metadata.
    """
    fm = _Frontmatter()
    canonical = F.col("path").startswith("wiki/decisions/") | (fm.type == "decision") | fm.has("decision")
    found = docs.where(canonical | has_any(F.lower("path"), DECISION_TERMS) | has_any(fm.text, DECISION_TERMS)).select("vault_id", "path", canonical.alias("canonical"))
    status = F.when(F.col("canonical"), "stated").when(F.col("headed"), "heading_candidate").otherwise("metadata_derived")
    items = _looked_into(found, chunks, DECISION_TERMS, limit).select("vault_id", "path", status.alias("claim_status"))
    return _numbered(items, ["vault_id"], [F.col("path")], limit)


def open_questions(docs: DataFrame, chunks: DataFrame, limit: int) -> DataFrame:
    """(vault_id, path, claim_status, rk), by path, at most ``limit`` a vault; nothing with a closed status.

    Issues with an active status are stated; documents with an active or no status and a heading that asks are heading
    candidates, if they are issues or have a question's term in path or frontmatter.
    """
    fm = _Frontmatter()
    canonical = F.col("path").startswith("wiki/issues/") | fm.type.isin(*ISSUE_TYPES)
    live = docs.where(~fm.status.isin(*CLOSED_STATUSES) & (canonical | has_any(F.lower("path"), ISSUE_TERMS) | has_any(fm.text, ISSUE_TERMS)))
    found = live.select("vault_id", "path", canonical.alias("canonical"), fm.status.alias("status"))
    active = F.col("status").isin(*ACTIVE_STATUSES)
    claim = F.when(F.col("canonical") & active, "stated").when(F.col("headed") & (active | (F.col("status") == "")), "heading_candidate")
    items = _looked_into(found, chunks, ISSUE_TERMS, limit).select("vault_id", "path", claim.alias("claim_status")).where("claim_status IS NOT NULL")
    return _numbered(items, ["vault_id"], [F.col("path")], limit)


def project_groups(docs: DataFrame, chunks: DataFrame, limit: int) -> DataFrame:
    """(vault_id, path, group, ambiguous, rk): documents in the groups that path and frontmatter name, by path, at most
    ``limit`` a vault and group. ambiguous: the document is in several groups. A README at the root is in none."""
    fm, path = _Frontmatter(), F.lower("path")
    groups = {
        "current_state": fm.type.isin(*STATE_TYPES) | has_any(path, STATE_PATHS),
        "constraints": fm.has(*CONSTRAINT_KEYS) | has_any(path, CONSTRAINT_PATHS) | has_any(fm.text, CONSTRAINT_TERMS),
        "next_priorities": fm.has(*PRIORITY_KEYS) | has_any(path, PRIORITY_PATHS) | has_any(fm.text, PRIORITY_KEYS),
        "stale_areas": fm.status.isin(*STALE_STATUSES) | has_any(path, STALE_PATHS),
    }
    named = docs.where(path != "readme.md").select("vault_id", "path", F.array_compact(F.array(*(F.when(c, g) for g, c in groups.items()))).alias("groups")).where(F.size("groups") > 0)
    each = _looked_into(named, chunks, (), limit).select("vault_id", "path", F.explode("groups").alias("group"), (F.size("groups") > 1).alias("ambiguous"))
    return _numbered(each, ["vault_id", "group"], [F.col("path")], limit)


def resource_kinds(path: Column, kind: Column) -> Column:
    """What a document can be read as: document, and page, source, decision, issue where they fit."""
    kind = F.coalesce(kind, F.lit(""))
    source = path.startswith("raw/") | path.startswith("docs/") | path.startswith("scratch/reports/") | (kind == "source")
    fits = {"document": F.lit(True), "page": path.startswith("wiki/"), "source": source, "decision": path.startswith("wiki/decisions/") | (kind == "decision"), "issue": path.startswith("wiki/issues/") | (kind == "issue")}
    return F.array_compact(F.array(*(F.when(c, k) for k, c in fits.items())))


def recent(rows: DataFrame, key: str, at: str, since: Column, limit: int, *, by: Sequence[str] = ()) -> DataFrame:
    """Rows later than ``since``, newest first and by key, numbered rk; at most ``limit``, or so many for each ``by``."""
    order = [F.desc_nulls_last(at), F.col(key)]
    later = rows.where(F.col(at) > since)
    return _numbered(later if by else later.orderBy(*order).limit(limit), by, order, limit)


def hygiene(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: documents, chunks, blob_count, blob_bytes, logical_bytes, amplification (logical by blob bytes)."""
    blobs = chunks.groupBy("content_hash").agg(F.max(F.octet_length("text")).alias("size"), F.count("*").alias("n"))
    sums = blobs.agg(F.count("*").alias("blob_count"), F.sum("size").cast("bigint").alias("blob_bytes"), F.sum(F.col("size") * F.col("n")).cast("bigint").alias("logical_bytes"), F.sum("n").cast("bigint").alias("chunks"))
    return sums.withColumn("amplification", F.round(F.col("logical_bytes") / F.col("blob_bytes"), 6))


def timeline(documents: DataFrame, statuses: DataFrame, since: Column, limit: int) -> DataFrame:
    """(vault_id, kind, item, occurred_at, rk): documents and status items (vault_id, item, occurred_at) later than ``since``,
    newest first, then by kind and item, at most ``limit`` a vault; status items without a time come after all others."""
    kinds = [df.select("vault_id", F.lit(k).alias("kind"), F.col("item").cast("string").alias("item"), "occurred_at") for k, df in (("document", documents), ("status", statuses))]
    later = kinds[0].unionByName(kinds[1]).where((F.col("occurred_at") > since) | (F.col("occurred_at").isNull() & (F.col("kind") == "status")))
    return _numbered(later, ["vault_id"], [F.desc_nulls_last("occurred_at"), F.col("kind"), F.col("item")], limit)


def dangling(stores: dict[str, DataFrame], chunks: DataFrame, keys: Sequence[str] = ("vault_id", "chunk_id")) -> DataFrame:
    """(store, n, dangling): rows of each store (keys), and how many of them name no chunk."""
    out = None
    known = chunks.select(*keys, F.lit(True).alias("known")).distinct()
    for name, df in stores.items():
        own = df.select(*keys).join(known, list(keys), "left").agg(F.lit(name).alias("store"), F.count("*").alias("n"), F.count_if(F.col("known").isNull()).alias("dangling"))
        out = own if out is None else out.unionByName(own)
    return out
