"""Evidence under a budget, answers from it, and their citations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import item_priority
from ..functions.text import stable_id

MAX_ITEMS = 50
CLAIMS = 5


def admit(rows: DataFrame, order: Sequence[Column], cost: Column, budget: int, *, max_items: int | None = MAX_ITEMS) -> DataFrame:
    """``rows`` in order, each admitted if the budget still holds its cost; a row too large is skipped and later ones
    may fit; ``max_items`` at most, if given. Adds admitted and used (budget spent after the row). At most some hundreds of ranked rows come here:
    they are folded in one array."""
    item = F.struct(*(o.alias(f"o{k}") for k, o in enumerate(order)), F.struct(*rows.columns).alias("row"), cost.cast("bigint").alias("cost"))
    folded = rows.agg(F.array_sort(F.collect_list(item)).alias("all"))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(0).alias("n"), F.array().cast("array<struct<ok:boolean,used:bigint>>").alias("marks"))

    def step(a: Column, x: Column) -> Column:
        ok = a["used"] + x["cost"] <= budget
        ok = ok if max_items is None else ok & (a["n"] < max_items)
        used = a["used"] + F.when(ok, x["cost"]).otherwise(0)
        return F.struct(used.alias("used"), (a["n"] + ok.cast("int")).alias("n"), F.concat(a["marks"], F.array(F.struct(ok.alias("ok"), used.alias("used")))).alias("marks"))

    marks = folded.select(F.arrays_zip("all", F.aggregate("all", start, step)["marks"].alias("marks")).alias("z"))
    return marks.select(F.explode("z").alias("z")).select("z.all.row.*", F.col("z")["marks"]["ok"].alias("admitted"), F.col("z")["marks"]["used"].alias("used"))


def claims(evidence: DataFrame, limit: int = CLAIMS) -> DataFrame:
    """(claim_id, status, ...) of the first ``limit`` evidence rows by rk: supported by two signals or more, else single-source."""
    status = F.when(F.size("kinds") >= 2, "supported").otherwise("single_source")
    return evidence.where(F.col("rk") <= limit).select(stable_id("claim", F.col("rk").cast("string"), F.col("doc_id").cast("string")).alias("claim_id"), "rk", "doc_id", status.alias("status"))


def uncited(claims_: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """Claims whose evidence isn't there; empty for a valid answer."""
    return claims_.join(evidence.select(key).distinct(), key, "left_anti")


def gather(parts: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """keys, kind, place: evidence of several kinds, each (keys, kind) once, kinds in the order given and rows by rk."""
    rows = None
    for k, (kind, df) in enumerate(parts.items()):
        own = df.select(*keys, F.lit(kind).alias("kind"), F.lit(k).alias("seshat_k"), "rk")
        rows = own if rows is None else rows.unionByName(own)
    once = rows.groupBy(*keys, "kind", "seshat_k").agg(F.min("rk").alias("rk"))
    return once.withColumn("place", F.row_number().over(Window.orderBy("seshat_k", "rk", *keys)).cast("bigint")).drop("seshat_k", "rk")


#: What evidence and chunk have to agree on.
CHECKED = ("vault_id", "document_id", "chunk_id", "path", "content_hash")


def resolved(refs: DataFrame, evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """refs (vault_id, document_id, chunk_id) with path, text and token_count, where evidence and chunk agree on all of CHECKED."""
    known = refs.join(evidence.select(*CHECKED), ["vault_id", "document_id", "chunk_id"])
    return known.join(chunks.select(*CHECKED, "text", "token_count"), list(CHECKED)).drop("content_hash")


def pack(items: DataFrame, budget: int, *, max_items: int = MAX_ITEMS) -> DataFrame:
    """Admitted items with section (their type) and place. items: (item_type, rk, kinds, vault_id, path, chunk_id, cost, ...).

    Order: the type's priority, rank, more kinds of signals first, raw sources last, then vault, path and chunk.
    """
    order = [item_priority(F.col("item_type")), F.col("rk"), -F.size("kinds"), F.when(F.col("path").startswith("raw/"), 1).otherwise(0), F.col("vault_id"), F.col("path"), F.col("chunk_id")]
    kept = admit(items, order, F.col("cost"), budget, max_items=max_items).where("admitted")
    return kept.withColumnRenamed("item_type", "section").withColumn("place", F.row_number().over(Window.orderBy("used")).cast("bigint"))
