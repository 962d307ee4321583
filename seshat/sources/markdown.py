"""Markdown trees as documents and chunks."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.predicates import document_role, in_scope
from ..functions.text import anchor, provenance_path, stable_id, word_count

try:
    import yaml
except ImportError:  # frontmatter is then read as plain ``key: value`` lines
    yaml = None

# Frontmatter keys that say where a document comes from.
PROVENANCE_KEYS = ("canonical_source", "derived_from", "supersedes", "redirects")
_EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # SHA-256 of nothing


def _plain(value: object) -> object:
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value.isoformat() if hasattr(value, "isoformat") else value


def frontmatter_json(raw: str | None) -> str:
    """YAML as JSON with sorted keys and ISO dates; what isn't a mapping, or can't be read, is ``{}``."""
    if not raw:
        return "{}"
    if yaml is None:
        data = {k.strip(): v.strip() for k, c, v in (line.partition(":") for line in raw.split("\n")) if c and k.strip() and not k.startswith((" ", "-", "#"))}
    else:
        try:
            data = yaml.safe_load(raw)
        except yaml.YAMLError:
            data = {}
    return json.dumps(_plain(data) if isinstance(data, dict) else {}, sort_keys=True, ensure_ascii=False, default=str)


@F.pandas_udf(StringType())
def _frontmatter(raw: pd.Series) -> pd.Series:
    return raw.map(frontmatter_json)


def read_vault(spark: SparkSession, root: str, vault_id: str, scopes: Sequence[str] | None = None) -> DataFrame:
    """(vault_id, path, raw) of all ``*.md`` files below ``root`` that aren't empty, in the scopes if there are any. Each file comes
    once, also if scopes overlap."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select("value", F.col("_metadata.file_path").alias("file"))
    base = F.regexp_replace(F.lit(root), "^[A-Za-z]+:/*|/+$", "")
    path = F.url_decode(F.replace(F.regexp_replace("file", "^[A-Za-z]+:/*", "/"), F.lit("+"), F.lit("%2B")))
    relative = F.expr("substring(p, position(b || '/' IN p) + length(b) + 1)")
    named = files.select(F.lit(vault_id).alias("vault_id"), path.alias("p"), F.regexp_replace(base, "^/+", "").alias("b"), F.col("value").alias("raw"))
    docs = named.select("vault_id", relative.alias("path"), "raw")
    return docs if scopes is None else docs.where(in_scope(F.col("path"), scopes))


def documents(files: DataFrame) -> DataFrame:
    """Documents of (vault_id, path, raw): frontmatter as JSON, body, hashes, role, provenance targets.

    Frontmatter starts the text with ``---`` and ends at the next line that is ``---``; else all is body.
    """
    end = F.locate("\n---\n", F.col("raw"), 5)
    has = F.col("raw").startswith("---\n") & (end > 0)
    split = files.select("vault_id", "path", "raw", F.when(has, F.expr("substring(raw, 5, locate('\n---\n', raw, 5) - 5)")).alias("fm"), F.when(has, F.expr("substring(raw, locate('\n---\n', raw, 5) + 5)")).otherwise(F.col("raw")).alias("body"))
    read = split.withColumn("frontmatter", _frontmatter("fm"))
    field = lambda k: F.get_json_object("frontmatter", f"$.{k}")
    listed = lambda k: F.coalesce(F.from_json(field(k), "array<string>"), F.when(field(k).isNotNull(), F.array(field(k))))
    targets = F.array_distinct(F.array_compact(F.transform(F.flatten(F.array(*(F.coalesce(listed(k), F.array().cast("array<string>")) for k in PROVENANCE_KEYS))), provenance_path)))
    kind = F.coalesce(field("type"), field("kind"))
    return read.select(
        "vault_id", stable_id("document", F.col("vault_id"), F.col("path")).alias("document_id"), "path", F.split_part("path", F.lit("/"), F.lit(1)).alias("kind"), "frontmatter",
        F.coalesce(F.sha2("fm", 256), F.lit(_EMPTY)).alias("frontmatter_hash"), F.sha2("raw", 256).alias("raw_sha256"), F.sha2("body", 256).alias("content_hash"), "body",
        kind.alias("fm_type"), field("status").alias("fm_status"), field("title").alias("title"), document_role(F.col("path"), kind).alias("source_role"), targets.alias("targets"),
    )


def sections(body: Column) -> Column:
    """Array of (heading, text): the part before the first heading and each heading's part, without empty ones.

    A heading is a line of one to six ``#``, white space and a title, in code fences too.
    """
    cut = F.split(F.regexp_replace(body, "(?m)^(#{1,6}\\s+.+)$", "\u0001$1"), "\u0001")
    heading = lambda p: F.trim(F.regexp_extract(p, "^#{1,6}\\s+(.+)", 1))
    tidy = lambda t: F.regexp_replace(t, "(?U)^\\s+|\\s+$", "")
    parts = F.transform(cut, lambda p, k: F.struct(F.when(k > 0, heading(p)).alias("heading"), F.when(k > 0, tidy(F.regexp_replace(p, "^#{1,6}\\s+.+", ""))).otherwise(tidy(p)).alias("text")))
    return F.filter(parts, lambda s: s["text"] != "")


def chunks(docs: DataFrame) -> DataFrame:
    """One row a section, with a place (ordinal) and an id from vault, path, anchor and place."""
    each = docs.select("vault_id", "document_id", "path", "source_role", F.posexplode(sections(F.col("body"))).alias("ordinal", "s"))
    named = each.select("vault_id", "document_id", "path", "source_role", "ordinal", F.col("s")["heading"].alias("section"), F.when(F.col("s")["heading"].isNotNull(), anchor(F.col("s")["heading"])).alias("anchor"), F.col("s")["text"].alias("text"))
    id_ = stable_id("chunk", F.col("vault_id"), F.col("path"), F.coalesce("anchor", F.lit("body")), F.col("ordinal").cast("string"))
    return named.select("*", id_.alias("chunk_id"), word_count(F.col("text")).alias("token_count"), stable_id("chunk-content", F.col("text")).alias("content_hash"))


def render(chunks_: DataFrame) -> DataFrame:
    """(vault_id, path, text): chunks joined in their order by blank lines."""
    rows = chunks_.groupBy("vault_id", "path").agg(F.array_sort(F.collect_list(F.struct("ordinal", "text"))).alias("all"))
    return rows.select("vault_id", "path", F.array_join(F.transform("all", lambda c: c["text"]), "\n\n").alias("text"))
