"""Listings and point reads of documents and chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import in_scope


def documents(docs: DataFrame, vaults: Sequence[str], scopes: Sequence[str]) -> DataFrame:
    """Documents in scope, by (vault_id, path)."""
    return docs.where(F.col("vault_id").isin(*vaults) & in_scope(F.col("path"), scopes)).orderBy("vault_id", "path")


def recent(docs: DataFrame, since: Column, limit: int) -> DataFrame:
    """Documents indexed, or else seen, after ``since``, newest first."""
    at = F.coalesce("last_indexed_at", "last_seen_at")
    return docs.where(at > since).orderBy(at.desc(), "vault_id", "path").limit(limit)


def with_text(chunks: DataFrame, blobs: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks with their text, from blobs by hash, if their document is there."""
    return chunks.join(blobs.select(F.col("blob_hash").alias("content_hash"), "text"), "content_hash").join(docs.select("vault_id", "path"), ["vault_id", "path"], "left_semi")


def blobs(chunks: DataFrame) -> DataFrame:
    """(blob_hash, text, byte_count): each distinct text once."""
    return chunks.groupBy(F.col("content_hash").alias("blob_hash")).agg(F.min("text").alias("text")).withColumn("byte_count", F.octet_length("text").cast("bigint"))


def of_document(chunks: DataFrame, vault_id: str, path: str) -> DataFrame:
    return chunks.where((F.col("vault_id") == vault_id) & (F.col("path") == path)).orderBy("ordinal")


def states(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents with the number of their chunks, those without chunks too."""
    counts = chunks.groupBy("vault_id", "path").agg(F.count("*").alias("n_chunks"))
    return docs.join(counts, ["vault_id", "path"], "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)).cast("bigint"))


def excerpts(chunks: DataFrame, preferred: Column, limit: int = 3) -> DataFrame:
    """Up to ``limit`` chunks of each document, preferred ones first, numbered rk."""
    window = Window.partitionBy("vault_id", "path").orderBy(F.when(preferred, 0).otherwise(1), F.col("ordinal"))
    return chunks.withColumn("rk", F.row_number().over(window).cast("bigint")).where(F.col("rk") <= limit)


def document(docs: DataFrame, vault_id: str, path: str) -> DataFrame:
    """The document of that vault and path: one row or none."""
    return docs.where((F.col("vault_id") == vault_id) & (F.col("path") == path))


def chunk(chunks: DataFrame, vault_id: str, chunk_id: str) -> DataFrame:
    return chunks.where((F.col("vault_id") == vault_id) & (F.col("chunk_id") == chunk_id))


def export(docs: DataFrame) -> DataFrame:
    """All documents but tombstones (deleted), by (vault_id, path)."""
    return docs.where(~F.coalesce("deleted", F.lit(False))).drop("deleted").orderBy("vault_id", "path")


def revision(rows: DataFrame, column: str) -> DataFrame:
    """One row (revision): the distinct revisions of what is indexed, sorted and joined; there are few."""
    return rows.select(F.col(column).alias("r")).dropna().distinct().agg(F.array_join(F.array_sort(F.collect_list("r")), ",").alias("revision"))


def family_evidence(members: DataFrame, chunks: DataFrame) -> DataFrame:
    """(vault_id, family_seed, path, kind, chunk_id): the first chunk of each document that backs its family (supporting) or
    reports on it (audit). members: (vault_id, path, family_seed, source_role)."""
    kind = F.when(F.col("source_role").isin("source_manifest", "raw_evidence"), "supporting").when(F.col("source_role").isin("generated_view", "operation_log", "audit_record"), "audit")
    first = chunks.groupBy("vault_id", "path").agg(F.min_by("chunk_id", F.struct("ordinal", "chunk_id")).alias("chunk_id"))
    return members.select("vault_id", "path", "family_seed", kind.alias("kind")).where("kind IS NOT NULL").join(first, ["vault_id", "path"])
