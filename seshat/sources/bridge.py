"""The driver's tables seen as a knowledge base: documents, chunks, vectors, mention edges, turn edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import stable_id, word_count


#: Statuses that issues have by turns.
STATUSES = ("open", "resolved", "blocked", "closed", "todo", "accepted", "archived", "superseded", "unresolved", "rejected")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vault_id, doc_id, path, fm_type, fm_status, derived_from, section, text): the language is the vault, the id gives path and role."""
    last, id_ = F.col("doc_id") % 10, F.col("doc_id")
    folder = F.element_at(F.array(*map(F.lit, ("raw/", "scratch/reports/", "docs/", "wiki/sources/", "wiki/maps/", "wiki/notes/", "wiki/decisions/", "wiki/issues/", "wiki/concepts/", "wiki/concepts/"))), (last + 1).cast("int"))
    path = lambda folder, number: F.concat(folder if not isinstance(folder, str) else F.lit(folder), number.cast("string"), F.lit(".md"))
    return table(spark, sf_dir, "documents").select(
        F.col("lang").alias("vault_id"),
        "doc_id",
        path(folder, id_).alias("path"),
        F.when(last == 5, "log").when(last == 6, "decision").when(last == 7, "issue").when(last == 3, "source").when(id_ % 20 == 4, "roadmap").alias("fm_type"),
        F.when(last == 7, F.element_at(F.array(*map(F.lit, STATUSES)), (F.floor(id_ / 10) % 10 + 1).cast("int"))).when(id_ % 20 == 18, "superseded").alias("fm_status"),
        F.when(last == 3, path("raw/", id_ - 3)).when(last == 6, path("wiki/sources/", id_ - 3)).when(last == 8, path("wiki/decisions/", id_ - 2)).alias("derived_from"),
        F.when(id_ % 20 == 9, "Open questions").when(id_ % 30 == 8, "Alternatives").when(id_ % 30 == 7, "To do: follow-up").alias("section"),
        "text",
    )


def with_frontmatter(docs: DataFrame) -> DataFrame:
    """docs with frontmatter, a JSON object of what there is of type, status and derived_from."""
    return docs.withColumn("frontmatter", F.to_json(F.struct(F.col("fm_type").alias("type"), F.col("fm_status").alias("status"), "derived_from")))


def chunks(docs: DataFrame) -> DataFrame:
    """One row for each line that isn't blank; ordinal counts all lines from 0."""
    lines = docs.select("vault_id", "doc_id", "path", F.posexplode(F.split("text", "\n")).alias("ordinal", "text")).where(F.trim("text") != "")
    id_ = stable_id("chunk", F.col("vault_id"), F.col("path"), "body", F.col("ordinal").cast("string"))
    return lines.select("vault_id", id_.alias("chunk_id"), "doc_id", "path", "ordinal", "text", word_count(F.col("text")).alias("token_count"), F.sha2("text", 256).alias("content_hash"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.lit("v"), (F.col("label") % 4).cast("string")).alias("vault_id"), "embedding", "label")


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, href), each once: the page mentions the concept that it links to."""
    hrefs = F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(hrefs).alias("href"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target): turn t calls turn t + 1 of its conversation."""
    node = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    follow = own.select("conv_id", (F.col("turn") - 1).alias("turn"))
    return own.join(follow, ["conv_id", "turn"]).select(node(F.col("turn")).alias("source"), node(F.col("turn") + 1).alias("target"))
