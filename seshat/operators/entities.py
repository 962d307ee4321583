"""Entities and relationships of a vault's chunks, from identity, tags, headings, frontmatter and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import entity_name
from .graph import local_links, resolve_links

# Confidence of each source of entities, and the relations that frontmatter states.
CONFIDENCE = {"document": 1.0, "heading": 0.85, "tag": 0.8, "revisit": 0.8, "unresolved": 0.7}
RELATIONS = {"related": ("related_to", 0.9), "depends_on": ("depends_on", 0.9), "blocks": ("blocks", 0.9), "implements": ("implements", 0.9), "supersedes": ("supersedes", 0.9)}
LINKS_TO, MENTIONS_FROM, REVISIT = 0.95, ("heading", "tag", "unresolved"), 0.8
GENERIC_HEADINGS = ("overview", "summary", "notes", "todo", "appendix", "references")

_KEYS = ("vault_id", "chunk_id", "path")


def values(frontmatter: Column, key: str) -> Column:
    """A frontmatter value as an array: of its strings, or of itself."""
    raw = F.get_json_object(frontmatter, f"$.{key}")
    return F.coalesce(F.from_json(raw, "array<string>"), F.when(raw.isNotNull(), F.array(raw)), F.array().cast("array<string>"))


def document_type(path: Column, kind: Column) -> Column:
    kind = F.lower(F.coalesce(kind, F.lit("")))
    return F.when((kind == "decision") | path.contains("/decisions/"), "Decision").when(path.startswith("wiki/"), "WikiPage").when(path.startswith("raw/"), "Source").otherwise("Document")


def document_name(path: Column, title: Column) -> Column:
    return F.coalesce(title, F.regexp_replace(F.element_at(F.split(path, "/"), -1), "\\.md$", ""))


def occurrences(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """(vault_id, chunk_id, path, origin, relation, type, name, canonical_path, confidence, edge_confidence), one row an
    occurrence. relation is null where the document only is, or mentions, the entity.

    chunks and docs are those of sources.markdown. Links to documents resolve by path, then by a base name that
    only one document of the vault has; others are concepts, unless they are external.
    """
    own = chunks.join(docs.select("vault_id", "path", "frontmatter", "fm_type", "title"), ["vault_id", "path"])
    row = lambda df, origin, relation, type_, name, path, confidence, edge: df.select(
        *_KEYS, F.lit(origin).alias("origin"), relation.alias("relation"), type_.alias("type"), name.alias("name"), path.alias("canonical_path"), F.lit(confidence).alias("confidence"), F.lit(edge).alias("edge_confidence")
    )
    none = F.lit(None).cast("string")
    concept = F.lit("Concept")
    identity = row(own, "document", none, document_type(F.col("path"), F.col("fm_type")), F.coalesce("title", "section", document_name(F.col("path"), F.lit(None).cast("string"))), F.col("path"), CONFIDENCE["document"], 0.0)
    heading = row(own.where(F.col("section").isNotNull() & ~F.lower("section").isin(*GENERIC_HEADINGS)), "heading", none, concept, F.col("section"), none, CONFIDENCE["heading"], CONFIDENCE["heading"])
    tags = own.select("*", F.explode(values(F.col("frontmatter"), "tags")).alias("value"))
    tag = row(tags, "tag", none, concept, F.col("value"), none, CONFIDENCE["tag"], CONFIDENCE["tag"])
    revisits = own.select("*", F.explode(values(F.col("frontmatter"), "revisit_when")).alias("value"))
    revisit = row(revisits, "revisit", F.lit("revisit_when"), concept, F.col("value"), none, CONFIDENCE["revisit"], REVISIT)
    links = resolve_links(local_links(own), docs)
    stated = own.select(*_KEYS, F.explode(F.array(*(F.struct(F.lit(r).alias("relation"), values(F.col("frontmatter"), k).alias("targets")) for k, (r, _) in RELATIONS.items()))).alias("s"))
    stated = resolve_links(stated.select(*_KEYS, F.col("s")["relation"].alias("relation"), F.explode(F.col("s")["targets"]).alias("target")), docs).where("to_path IS NOT NULL")
    named = docs.select("vault_id", F.col("path").alias("to_path"), F.col("fm_type").alias("to_type"), F.col("title").alias("to_title"))
    target = (document_type(F.col("to_path"), F.col("to_type")), document_name(F.col("to_path"), F.col("to_title")), F.col("to_path"), CONFIDENCE["document"])
    resolved = row(links.join(named, ["vault_id", "to_path"]), "link", F.lit("links_to"), *target, LINKS_TO)
    related = row(stated.join(named, ["vault_id", "to_path"]), "frontmatter", F.col("relation"), *target, 0.9)
    local = ~F.col("target").rlike("^([A-Za-z][A-Za-z0-9+.-]*:|#)")
    unresolved = row(links.where(F.col("to_path").isNull() & local), "unresolved", none, concept, F.coalesce("label", "target"), none, CONFIDENCE["unresolved"], CONFIDENCE["unresolved"])
    out = identity
    for part in (heading, tag, revisit, resolved, related, unresolved):
        out = out.unionByName(part)
    return out


def relationships(found: DataFrame) -> DataFrame:
    """(vault_id, source, type, target_type, target, target_path, confidence, chunk_id): from each chunk's document to
    what it mentions, links to or states. A document is not related to itself."""
    from_ = found.where("origin = 'document'").select("vault_id", "chunk_id", F.col("canonical_path").alias("source"))
    to = found.where("origin <> 'document'").select("vault_id", "chunk_id", F.coalesce("relation", F.lit("mentions")).alias("type"), F.col("type").alias("target_type"), entity_name(F.col("name")).alias("target"), F.col("canonical_path").alias("target_path"), F.col("edge_confidence").alias("confidence"))
    rows = from_.join(to, ["vault_id", "chunk_id"]).where(~F.col("source").eqNullSafe(F.col("target_path")))
    return rows.groupBy("vault_id", "source", "type", "target_type", "target", "target_path", "chunk_id").agg(F.max("confidence").alias("confidence"))


def unresolved_links(found: DataFrame) -> DataFrame:
    """Warnings: (vault_id, path, name) of local links that no document has, each once."""
    return found.where("origin = 'unresolved'").select("vault_id", "path", "name").distinct()
