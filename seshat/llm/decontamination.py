"""Benchmark decontamination: a broadcast hash set of benchmark windows, on built-in expressions only.

Documents are scanned in place: the 64-bit hash of each window of words is looked up in a broadcast set of the
benchmark's window hashes, and no text or window is shuffled. Only hits leave the scan; there each window is compared
word by word with the benchmark's, which verifies it, and names the items that have it. A set of more than SLICE hashes
is broadcast in slices, one scan for each, so that a broadcast is never larger than about 40 bytes * SLICE.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.staging import Staging
from .columns import lower_ascii

WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
WINDOW = 13
#: Hashes that are broadcast at once; about 40 bytes each.
SLICE = 4_000_000
#: Stands in the set for the row that each document sends on, hit or not.
_EACH = -1


def words(text: Column) -> Column:
    """A-Z lower-cased, then all matches of WORD; of null, none."""
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), 0)


def _starts(n: Column, size: Column | int) -> Column:
    """1-based starts of the windows of ``size`` words."""
    last = n - size + 1
    return F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))


def _window(parts: Column, start: Column, size: Column | int) -> Column:
    """The words of a window; they have no blanks, so joined ones are unique."""
    return F.array_join(F.slice(parts, start, size), " ")


@dataclass
class Windows:
    """table: (hash, win, items) for each distinct window; sizes: of its windows in words; slices: of the set of hashes."""

    table: DataFrame
    sizes: list[int]
    slices: int
    staged: Staging

    def drop(self) -> None:
        """Deletes the written table, when no plan reads it any more."""
        self.staged.drop("windows")


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, slice_hashes: int = SLICE, *, id_column: str = "item_id", text_column: str = "text") -> Windows:
    """Windows of ``window`` consecutive words of an item; an item of fewer, but not none, is one window.

    Items with null texts or no words have none; an item with a null id has windows and no name.
    """
    own = benchmark.select(benchmark[id_column].cast("string").alias("item"), words(benchmark[text_column]).alias("words"))
    cut = own.where(F.size("words") > 0).select("item", "words", F.least(F.size("words"), F.lit(window)).alias("size"))
    each = cut.select("item", "size", F.explode(F.transform(_starts(F.size("words"), F.col("size")), lambda i: F.slice("words", i, F.col("size")))).alias("parts"))
    table = each.select("item", "size", F.xxhash64("parts").alias("hash"), F.array_join("parts", " ").alias("win"))
    staged = Staging(benchmark.sparkSession, "windows")
    table = staged.write(table.groupBy("hash", "win", "size").agg(F.collect_set("item").alias("items")), "windows")
    sums = table.groupBy("size").agg(F.count("*").alias("n")).collect()  # WINDOW rows at most
    return Windows(table.select("hash", "win", "items"), sorted((r["size"] for r in sums), reverse=True), max(1, -(-sum(r["n"] for r in sums) // slice_hashes)), staged)


def _found(docs: DataFrame, windows: Windows, id_column: str, text_column: str) -> DataFrame:
    """(doc, mark, n_words, start, size, hash, win): hits by hash, and one row of start 0 for each row of ``docs``."""
    own = docs.select(docs[id_column].alias("doc"), F.xxhash64(docs[text_column]).alias("mark"), words(docs[text_column]).alias("words"))
    step = max([*windows.sizes, 1]) + 1
    n = F.size("words")
    # The windows of a size, each as start * step + size.
    placed = lambda size: F.when(n >= size, F.sequence(F.lit(step + size), (n - size + 1) * step + size, F.lit(step))).otherwise(F.array().cast("array<int>"))

    def scan(k: int) -> DataFrame:
        of = windows.table.select("hash").distinct()
        if windows.slices > 1:
            of = of.where(F.pmod("hash", F.lit(windows.slices)) == k)
        if k == 0:
            of = of.union(of.sparkSession.range(1).select(F.lit(_EACH).cast("bigint"))).distinct()
        # The outer explode, as for the inner one Spark filters by the array's size before, and so makes it twice.
        each = own.select("doc", "mark", "words", F.explode_outer(F.concat(*map(placed, windows.sizes), F.array(*([F.lit(0)] if k == 0 else [])).cast("array<int>"))).alias("at"))
        start, size = (F.col("at") / step).cast("int"), F.col("at") % step
        each = each.select("doc", "mark", "words", start.alias("start"), size.alias("size"))
        hashed = F.when(F.col("start") > 0, F.xxhash64(F.slice("words", F.greatest("start", F.lit(1)), F.col("size")))).otherwise(F.lit(_EACH))
        hits = each.withColumn("hash", hashed).join(F.broadcast(of), "hash", "left_semi")
        return hits.select("doc", "mark", F.size("words").cast("bigint").alias("n_words"), "start", "size", "hash", _window(F.col("words"), F.greatest("start", F.lit(1)), F.col("size")).alias("win"))

    return reduce(DataFrame.union, map(scan, range(windows.slices)))


def _covered(hits: Column) -> Column:
    """Words in at least one of the sorted windows (start, size)."""
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(1).alias("next"))

    def add(a: Column, h: Column) -> Column:
        end = h["start"] + h["size"]
        fresh = F.greatest(end - F.greatest(h["start"], a["next"]), F.lit(0))
        return F.struct((a["n"] + fresh).alias("n"), F.greatest(end, a["next"]).alias("next"))

    return F.aggregate(hits, start, add)["n"]


def contamination(n_hit: Column, n_words: Column) -> Column:
    """At least one word of 20 in hit windows."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def _report(docs: DataFrame, windows: Windows, id_column: str, text_column: str) -> DataFrame:
    """report, with mark (a hash of the text) and rows (how many rows of ``docs`` have this id and text)."""
    found = _found(docs, windows, id_column, text_column)
    named = found.join(windows.table, ["hash", "win"], "left").where("start = 0 OR items IS NOT NULL")
    hit = F.when(F.col("start") > 0, F.struct("start", "size"))
    groups = named.groupBy("doc", "mark", "n_words").agg(F.count_if(F.col("start") == 0).alias("rows"), F.array_sort(F.collect_set(hit)).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    return groups.select("doc", "mark", "rows", "n_words", _covered(F.col("hits")).alias("n_hit"), "items")


def report(docs: DataFrame, windows: Windows, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: the id, n_words, n_hit (words in hit windows), items (sorted ids), n_items, contaminated.

    A null text has no words. Repeated rows give a row each. Items without an id hit words and have no name. Empty
    tables on either side give no hits or no rows. Other columns of ``docs`` are not read. One shuffle, of a small row
    for each document and one for each hit window.
    """
    flat = _report(docs, windows, id_column, text_column).withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return flat.select(F.col("doc").alias(id_column), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), "items", contamination(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


def keep_clean(docs: DataFrame, windows: Windows, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, that are not contaminated. ``docs`` is read twice.

    Contaminated documents are written and left out by id and hash of the text; Spark broadcasts them only below its threshold.
    """
    bad = _report(docs, windows, id_column, text_column).where(contamination(F.col("n_hit"), F.col("n_words"))).select(F.col("doc").alias("seshat_doc"), F.col("mark").alias("seshat_mark"))
    bad = Staging(docs.sparkSession, "contaminated").write(bad, "documents")
    return docs.join(bad, docs[id_column].eqNullSafe(bad["seshat_doc"]) & (F.xxhash64(docs[text_column]) == bad["seshat_mark"]), "left_anti")
