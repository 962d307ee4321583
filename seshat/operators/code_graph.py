"""Code graph: reference resolution by tiers, breadth-first calls, symbol search, outlines."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import Staging
from . import keyword
from .graph import oriented

MAX_DEPTH = 8
MAX_RESULTS = 100

#: The kinds of symbols that a relation may find, and the relations of each set of kinds.
KINDS = {
    "inherited": ("class", "interface", "mixin"), "called": ("class", "function", "method", "property", "test"),
    "declared": ("module", "class", "interface", "mixin", "function", "method", "property", "test"), "imported": ("module",),
}
ALLOWED = {"EXTENDS": "inherited", "IMPLEMENTS": "inherited", "CALLS": "called", "TESTS": "called", "DEFINES": "declared", "CONTAINS": "declared", "IMPORTS": "imported"}
#: Marks of a call whose target only shows when it runs.
DYNAMIC = "^dynamic:|[()\\[\\]]|<dynamic>|<unknown>|lambda|=>"


def suffixes(name: Column) -> Column:
    """``a.b.c`` gives ``a.b.c``, ``b.c`` and ``c``, so that a suffix match is an equi-join."""
    parts = F.split(name, "\\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def _cleaned(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, "^\\s+|\\s+$", ""), "^['\"]+|['\"]+$", "")


def _module_name(name: Column) -> Column:
    """The dotted name of a module that is given as a name, a path or a package URI."""
    value = F.regexp_replace(F.regexp_replace(_cleaned(name), "^package:", ""), "\\\\", "/")
    dotted = F.translate(F.regexp_replace(F.regexp_replace(value, "\\.(py|dart)$", ""), "^/+|/+$", ""), "/", ".")
    return F.when(value.startswith("dart:"), value).otherwise(dotted)


def _relative(module: Column, target: Column) -> Column:
    """``..x`` seen from a module: each dot takes a part off its end."""
    rest, parts = F.ltrim(target, F.lit(".")), F.split(module, "\\.")
    base = F.slice(parts, 1, F.greatest(F.size(parts) - (F.length(target) - F.length(rest)), F.lit(0)))
    return F.array_join(F.concat(base, F.filter(F.array(_module_name(rest)), lambda x: x != "")), ".")


def _owner(name: Column) -> Column:
    return F.regexp_replace(name, "\\.[^.]*$", "")


def _index(symbols: DataFrame, by_kind: bool) -> DataFrame:
    """(repository_id, allowed, place, scope, key, seen, candidates, symbol_id): counts of what each key stands for.

    A symbol of one row has each of its keys once, so that only the keys of ids with several rows are made distinct."""
    symbols = symbols.withColumn("several", F.count("*").over(Window.partitionBy("symbol_id")) > 1)
    entry = lambda place, key, scope=F.lit(""): F.named_struct(F.lit("place"), F.lit(place), F.lit("scope"), scope, F.lit("key"), key)
    ends = F.transform(F.slice(suffixes(F.col("qualified_name")), 2, F.size(F.split("qualified_name", "\\."))), lambda x: entry("suffix", x))
    entries = F.concat(F.array(entry("qualified", F.col("qualified_name")), entry("name", F.col("name")), entry("file", F.col("name"), F.coalesce("file_id", F.lit("")))), ends)
    allowed = F.array(F.lit("any")) if not by_kind else F.array_compact(F.array(*(F.when(F.col("kind").isin(*kinds), a) for a, kinds in KINDS.items() if a != "imported")))
    keyed = symbols.select("repository_id", F.explode(allowed).alias("allowed"), "symbol_id", F.lit(True).alias("counted"), "several", F.array_distinct(entries).alias("entries"))
    if by_kind:  # imports find a module by its name, or, if nothing has that name, by its file's path
        module = F.col("kind").isin(*KINDS["imported"])
        parts = F.split(F.regexp_replace("path", "\\\\", "/"), "/")
        tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
        tails = F.array_distinct(F.concat(tails, F.transform(F.filter(tails, lambda t: t.rlike("\\.(py|dart)$")), lambda t: F.regexp_replace(t, "\\.(py|dart)$", ""))))
        paths = F.when(F.col("first") & F.col("path").isNotNull(), F.transform(tails, lambda t: entry("path", t))).otherwise(F.slice(entries, 1, 0))
        rank = F.row_number().over(Window.partitionBy("repository_id", "file_id", module).orderBy("qualified_name", "symbol_id"))
        ranked = symbols.withColumn("first", module & (rank == 1))
        keyed = keyed.union(ranked.select("repository_id", F.lit("imported"), "symbol_id", F.coalesce(module, F.lit(False)), "several", F.array_distinct(F.concat(F.array(entry("qualified", F.col("qualified_name"))), paths))))
    rows = lambda which: keyed.where(which).select("repository_id", "allowed", "symbol_id", "counted", F.explode("entries").alias("e")).select("repository_id", "allowed", "e.*", "symbol_id", "counted")
    each = rows("NOT several").union(rows("several").distinct())
    return each.groupBy("repository_id", "allowed", "place", "scope", "key").agg(F.count("*").alias("seen"), F.count_if("counted").alias("candidates"), F.min(F.when(F.col("counted"), F.col("symbol_id"))).alias("symbol_id"))


def _lookups() -> Column:
    """What to look up for a reference, by falling rank."""
    t, module, file = F.col("target"), F.col("module"), F.col("file_id")
    dotted, relative, imported = t.contains("."), t.startswith("."), F.col("allowed") == "imported"
    within = F.when(F.col("source").isNull() | (F.col("source") == module), module).otherwise(_owner(F.col("source")))
    found = lambda rank, tier, by, place, key, scope=F.lit(""): F.named_struct(F.lit("rank"), F.lit(rank), F.lit("tier"), F.lit(tier), F.lit("by"), F.lit(by), F.lit("place"), F.lit(place), F.lit("scope"), scope, F.lit("key"), key)
    members = F.transform(F.coalesce("imports", F.array().cast("array<string>")), lambda i: found(4, 1, "imported", "qualified", F.concat(i, F.lit("."), t)))
    names = F.array(
        found(1, 1, "qualified", "qualified", t), found(2, 1, "relative", "qualified", F.when(relative, _relative(within, t))), found(3, 1, "module", "qualified", F.when(dotted, F.concat(within, F.lit("."), t))),
        found(5, 2, "same_file", "file", F.when(~dotted & file.isNotNull(), t), F.coalesce(file, F.lit(""))), found(6, 2, "name", "name", F.when(~dotted, t)), found(7, 3, "suffix", "suffix", F.when(dotted, t)),
    )
    normal = _module_name(t)
    path = F.split(F.regexp_replace(F.translate(normal, ".", "/"), "^/+|/+$", ""), "/")
    tail = F.array_join(F.when(F.size(path) > 1, F.slice(path, 2, F.size(path))).otherwise(path), "/")  # what the whole path finds, it finds too
    sibling = F.when((normal != "") & ~normal.contains("."), F.concat(_owner(module), F.lit("."), normal))
    modules = F.array_distinct(F.array(*(found(1, 1, "qualified", "qualified", k) for k in (normal, F.when(relative, _relative(module, t)), sibling)), found(2, 3, "path", "path", tail)))
    return F.filter(F.when(imported, modules).when(F.col("allowed").isNotNull() & (t != ""), F.concat(names, members)), lambda x: x["key"] != "")


def resolve(references: DataFrame, symbols: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """The references, distinct, with (tier, by, candidates, symbol_id, status).

    references: (reference) alone, looked up by name in one repository, or also (file_id, source, relation), as
    ``sources.code`` gives them. symbols: (symbol_id, qualified_name), then also (file_id, kind, name). files:
    (repository_id, file_id, path), so that nothing is found in another repository and imports find paths.

    Tier 1: a qualified name, which is the reference's own, the one relative to its module, the one within the module
    or class of its source, or a member of a module that its file imports; tier 2: a name in the same file, then in
    the repository; tier 3: any other suffix. ``by`` tells them apart. Imports find modules only, by the name itself,
    relative or beside the file's module (tier 1) or by path (tier 3); other relations find the kinds in KINDS. The
    first lookup with candidates counts: one candidate is inferred, more are ambiguous, as are dynamic calls, none
    unresolved. Each lookup is an equi-join on keys that are counted before.
    """
    if files is not None:
        places = files.select("file_id", "repository_id", "path").distinct()
        references, symbols = (df.drop("repository_id", "path").join(places, "file_id", "left") for df in (references, symbols))
    own = [c for c in ("repository_id", "file_id", "source", "relation", "reference") if c in references.columns]
    filled = lambda df, **more: df.select("*", *(v.alias(c) for c, v in more.items() if c not in df.columns))
    nothing = F.lit(None).cast("string")
    refs = filled(references, repository_id=F.lit(""), file_id=nothing, source=nothing, relation=nothing, path=nothing).select("repository_id", "file_id", "source", "relation", "reference", "path").distinct()
    known = filled(symbols, repository_id=F.lit(""), file_id=nothing, kind=nothing, path=nothing, name=F.element_at(F.split("qualified_name", "\\."), -1))
    by_kind = "relation" in references.columns
    group = F.lit("any")
    if by_kind:
        modules = known.where("kind = 'module'").groupBy("repository_id", "file_id").agg(F.min("qualified_name").alias("module"))
        imports = refs.where("relation = 'IMPORTS'").groupBy("repository_id", "file_id").agg(F.array_remove(F.collect_set(_module_name(F.col("reference"))), "").alias("imports"))
        refs = refs.join(modules, ["repository_id", "file_id"], "left").join(imports, ["repository_id", "file_id"], "left")
        refs = refs.withColumn("module", F.coalesce("module", F.translate(F.regexp_replace(F.regexp_replace("path", "\\.[^./]*$", ""), "/__init__$", ""), "/", ".")))
        group = F.element_at(F.create_map(*(F.lit(x) for p in ALLOWED.items() for x in p)), F.col("relation"))
    rows = filled(refs, module=nothing, imports=F.lit(None).cast("array<string>")).withColumns({"target": _cleaned(F.col("reference")), "allowed": group})
    key = ["repository_id", "allowed", "place", "scope", "key"]
    looked = rows.select("repository_id", "file_id", "source", "relation", "reference", "allowed", F.explode_outer(_lookups()).alias("l")).select("*", "l.*").drop("l")
    ranked = looked.join(_index(known, by_kind), key, "left").groupBy("repository_id", "file_id", "source", "relation", "reference", "rank", "tier", "by").agg(*(F.sum(c).alias(c) for c in ("seen", "candidates")), F.min("symbol_id").alias("symbol_id"))
    best = F.min(F.when(F.col("seen") > 0, F.struct("rank", "tier", "by", "candidates", "symbol_id")))
    found = ranked.groupBy("repository_id", "file_id", "source", "relation", "reference").agg(best.alias("b")).withColumn("b", F.when(F.col("b.candidates") > 0, F.col("b")))
    n = F.coalesce("b.candidates", F.lit(0)).cast("bigint")
    dynamic = F.coalesce(F.col("relation").isin("CALLS", "TESTS") & F.lower("reference").rlike(DYNAMIC), F.lit(False))
    status = F.when(dynamic, "ambiguous").when(n == 0, "unresolved").when(n == 1, "inferred").otherwise("ambiguous")
    return found.select(*own, "b.tier", "b.by", n.alias("candidates"), F.when((n == 1) & ~dynamic, F.col("b.symbol_id")).alias("symbol_id"), status.alias("status"))


def traverse(edges: DataFrame, seeds: DataFrame, depth: int = 3, *, direction: str = "out", include_uncertain: bool = True, limit: int | None = None) -> DataFrame:
    """(target, level): nodes that ``depth`` steps reach, at their least level; seeds (node) are not among them.

    Edges: (source, target, status). Ambiguous and unresolved ones are not walked, inferred ones only with
    ``include_uncertain``. Each level is one join on the frontier, written, so that plans stay short.
    """
    wanted = ("stated", "extracted", "inferred") if include_uncertain else ("stated", "extracted")
    steps = oriented(edges.where(F.col("status").isin(*wanted)).select("source", "target"), direction).select("from_id", "to_id").distinct()
    staged = Staging(edges.sparkSession, "traverse")
    seen = staged.write(seeds.select(F.col("node").alias("target"), F.lit(0).alias("level")).distinct(), "level-0")
    frontier = seen
    for level in range(1, min(depth, MAX_DEPTH) + 1):
        reached = frontier.join(steps, frontier["target"] == steps["from_id"]).select(F.col("to_id").alias("target")).distinct()
        frontier = staged.write(reached.join(seen, "target", "left_anti").withColumn("level", F.lit(level)), f"level-{level}")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    found = seen.where("level > 0")
    return found if limit is None else found.orderBy("level", "target").limit(min(limit, MAX_RESULTS))


def outline(symbols: DataFrame, path: str) -> DataFrame:
    """A file's symbols in order of place."""
    return symbols.where(F.col("path") == path).orderBy("line", "qualified_name")


def named(symbols: DataFrame, wanted: str) -> DataFrame:
    """The symbol with that id, else the only one of that name or qualified name; no row if there are more."""
    rank = F.when(F.col("symbol_id") == wanted, 1).when(F.col("qualified_name") == wanted, 2).when(F.col("name") == wanted, 3)
    ranked = symbols.withColumn("rank", rank).where("rank IS NOT NULL")
    counted = ranked.withColumn("n", F.count("*").over(Window.partitionBy("rank"))).orderBy("rank").limit(1)
    return counted.where("n = 1").drop("rank", "n")


#: The fields of a symbol that a search looks in.
SYMBOL_FIELDS = ("relative_path", "name", "qualified_name", "signature", "language", "kind")


def search(symbols: DataFrame, query: str, limit: int, *, repositories: Sequence[str] = (), kinds: Sequence[str] = (), path_prefix: str = "") -> DataFrame:
    """(symbol_id, score, rk): symbols that have all words of the query in their fields, best first.

    symbols: (symbol_id, repository_id, start_line) and SYMBOL_FIELDS. Words are runs of ASCII letters, digits and ``_``,
    and ``a_b`` needs its parts in a row; a query without words finds nothing. Filters hold before the limit; a prefix is taken as
    it is, wildcards too. Order: (score, repository_id, relative_path, start_line, symbol_id).
    """
    words = re.findall(r"[A-Za-z0-9_]+", query)
    keys = ["repository_id", "relative_path", "start_line", "symbol_id"]
    if not any(w.strip("_") for w in words):
        return symbols.where("false").select("symbol_id", F.lit(0.0).alias("score"), F.lit(0).cast("bigint").alias("rk"))
    n = len(keyword.query_phrases(" ".join(words)))
    where = reduce(and_, [F.col(f"f{k}") > 0 for k in range(n)])
    if repositories:
        where = where & F.col("repository_id").isin(*repositories)
    if kinds:
        where = where & F.col("kind").isin(*kinds)
    if path_prefix:
        where = where & F.col("relative_path").startswith(path_prefix.rstrip("/"))
    return keyword.search(symbols, " ".join(words), keys, min(limit, MAX_RESULTS), fields=SYMBOL_FIELDS, where=where).select("symbol_id", "score", "rk")


def retried(pending: DataFrame, symbols: DataFrame, changed: DataFrame) -> DataFrame:
    """Pending references that changed files may resolve: of a changed file itself, or with the name, the qualified name
    or a dotted end of it of a symbol that a changed file of the same repository has now.

    pending: (repository_id, file_id, reference, ...); symbols: (repository_id, file_id, qualified_name); changed: (file_id).
    """
    own = pending.withColumn("seshat_row", F.xxhash64(*pending.columns))
    files = changed.select("file_id").distinct()
    fresh = symbols.join(files, "file_id", "left_semi").select("repository_id", F.explode(suffixes(F.col("qualified_name"))).alias("end")).distinct()
    asked = own.select("repository_id", "seshat_row", F.explode(F.array_distinct(F.array(_cleaned(F.col("reference")), F.element_at(F.split(_cleaned(F.col("reference")), "\\."), -1)))).alias("end"))
    hit = asked.join(fresh, ["repository_id", "end"], "left_semi").select("seshat_row")
    hit = hit.union(own.join(files, "file_id", "left_semi").select("seshat_row")).distinct()
    return own.join(hit, "seshat_row", "left_semi").drop("seshat_row")
