"""BM25 over several fields of equal weight, with corpus statistics that ignore the search's scope."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from functools import reduce
from operator import add
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import occurrences, tokens

if TYPE_CHECKING:
    from .block_index import BlockIndex

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
FIELDS = ("path", "section", "title", "frontmatter", "text")

_WORDS = re.compile(r"[\w가-힣]+")
_TOKENS = re.compile(r"[^\W_]+")


def query_phrases(query: str) -> list[list[str]]:
    """One phrase for each word of the query; a word of several tokens (``foo_bar``) needs them in a row.

    A repeated word is a phrase again and counts twice. A query without words is an error.
    """
    phrases = [p for w in _WORDS.findall(query) if (p := _TOKENS.findall(w.lower()))]
    if not phrases:
        raise ValueError("the query has no words")
    return phrases


def counted(corpus: DataFrame, fields: Sequence[str], phrases: list[list[str]]) -> DataFrame:
    """corpus with length (tokens of all fields), f0, f1, ... (each phrase's occurrences in all fields) and hit_<field>.

    Each field is split once: counts are made in a lambda over its tokens, and come out of a generator, below which no
    later filter or projection is pushed.
    """
    per_field = F.transform(F.array(*(tokens(F.col(f)) for f in fields)), lambda t: F.struct(F.size(t).alias("n"), *(occurrences(t, p).alias(f"f{k}") for k, p in enumerate(phrases))))
    once = corpus.select("*", F.explode_outer(F.array(per_field)).alias("seshat_counts"))
    part = lambda i: F.col("seshat_counts")[i]
    total = lambda c: reduce(add, (part(i)[c] for i in range(len(fields))))
    hits = {f"hit_{f}": reduce(add, (part(i)[f"f{k}"] for k in range(len(phrases)))) > 0 for i, f in enumerate(fields)}
    return once.withColumns({f"f{k}": total(f"f{k}") for k in range(len(phrases))} | hits | {"length": total("n")}).drop("seshat_counts")


def matched_fields(fields: Sequence[str]) -> Column:
    """Of ``counted`` rows: the fields that have a phrase."""
    return F.array_compact(F.array(*(F.when(F.col(f"hit_{f}"), f) for f in fields)))


def _score(stats: dict[str, float], n_phrases: int) -> Column:
    n, average, score = stats["n"], stats["total"] / max(stats["n"], 1), F.lit(0.0)
    for k in range(n_phrases):
        found = stats[f"n{k}"]
        idf = math.log((n - found + 0.5) / (found + 0.5))
        f = F.col(f"f{k}").cast("double")
        norm = F.lit(1 - B) + F.lit(B) * F.col("length") / F.lit(average or 1.0)
        score = score + F.lit(idf if idf > 0 else IDF_FLOOR) * f * (K1 + 1) / (f + K1 * norm)
    return -score


def search(corpus: DataFrame, query: str, keys: Sequence[str], k: int, *, fields: Sequence[str] = ("text",), where: Column | None = None, digits: int = 6) -> DataFrame:
    """keys, score (lower is better), fields that matched, rk: the k best rows that have a phrase of the query.

    ``where`` (vault, scope, role) holds before the limit, and not for the statistics: number of rows, mean
    length, and rows with each phrase. Those are one row, computed first; the search is then a scan and a
    top-k without any other shuffle. Rank order is (score rounded to ``digits``, keys).
    """
    phrases = query_phrases(query)
    rows = counted(corpus, fields, phrases)
    sums = [F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(phrases))]
    row = rows.agg(F.count("*").alias("n"), F.sum("length").alias("total"), *sums).first()
    stats = {c: float(row[c] or 0) for c in row.__fields__}
    found = rows.where(" OR ".join(f"f{i} > 0" for i in range(len(phrases))))
    found = found if where is None else found.where(where)
    scored = found.select(*keys, F.round(_score(stats, len(phrases)), digits).alias("score"), matched_fields(fields).alias("fields"))
    return ranked(scored.orderBy("score", *keys).limit(k), [F.col("score"), *map(F.col, keys)])


def ranked(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``rows``, at most some thousands, with rk: their place in the order, from 1."""
    return rows.withColumn("rk", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def postings(corpus: DataFrame, keys: Sequence[str], fields: Sequence[str] = FIELDS) -> DataFrame:
    """The inverted index: (token, keys, field, positions, length); length is the number of tokens of all fields of a row."""
    split = F.transform(F.array(*(F.struct(F.lit(f).alias("field"), tokens(F.col(f)).alias("tokens")) for f in fields)), lambda x: x)
    each = corpus.select(*keys, F.explode_outer(F.array(split)).alias("all"))
    length = F.aggregate("all", F.lit(0), lambda n, f: n + F.size(f["tokens"]))
    per_field = each.select(*keys, length.alias("length"), F.explode("all").alias("f"))
    placed = per_field.select(*keys, "length", F.col("f")["field"].alias("field"), F.posexplode(F.col("f")["tokens"]).alias("pos", "token"))
    return placed.groupBy("token", *keys, "field", "length").agg(F.array_sort(F.collect_list("pos")).alias("positions"))


class Index:
    """A stored index of a corpus that is written once: blocks of postings in partitions by token (see ``block_index``).

    A search reads the partitions of its tokens, and in them the row groups that can have these tokens.
    """

    def __init__(self, blocks: BlockIndex):
        self.blocks = blocks

    @classmethod
    def write(cls, corpus: DataFrame, keys: Sequence[str], fields: Sequence[str], root: str) -> Index:
        """Writes below ``root``; keys name a row of the corpus. Rows without tokens count for the statistics."""
        from . import block_index  # which needs this module

        block_index.write(corpus, keys, fields, root)
        return cls.open(corpus.sparkSession, root, keys, fields)

    @classmethod
    def open(cls, spark: SparkSession, root: str, keys: Sequence[str], fields: Sequence[str] = FIELDS) -> Index:
        from . import block_index

        return cls(block_index.BlockIndex(spark, [block_index.Part(root)], keys, fields))

    def frequencies(self, phrases: list[list[str]]) -> DataFrame:
        """keys, length, f0, f1, ... and fields for each row that has a phrase."""
        return self.blocks.phrase_counts(phrases)

    def search(self, query: str, k: int, *, allowed: DataFrame | None = None, digits: int = 6) -> DataFrame:
        """As ``search`` of the corpus; ``allowed`` (keys) holds before the limit, and not for the statistics."""
        return self.blocks.search(query, k, allowed=allowed, digits=digits)
