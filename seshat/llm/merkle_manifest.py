"""A Merkle tree over the rows of a table: a tree for each group, and one tree over their roots.

Levels are written as runs of at most WIDTH siblings, each with a link to its place in the run above. A recursive query
climbs from every run of leaves to the root, appends the siblings that it passes and folds the hashes of its leaves, which
may be others than those that the tree was built from.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.staging import Staging

WIDTH = 16

#: The tree over the groups' roots; a group's own tree has a name that isn't empty.
TOP = ""


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_hash(columns: Sequence[Column]) -> Column:
    """The hash of a row: each value as text, with its number of bytes before it, or ``-`` for null."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return digest(F.concat(*parts))


@dataclass
class Manifest:
    """leaves: runs of (pos, key, leaf, now) with their place above, alone where a tree has one leaf. runs: (tree, level, run, children,
    hash, next_tree, next_level, next_run, next_pos, top): a run's siblings, the hash that they make, and where that is a
    sibling itself; top says that it is its group's root, and next_tree is null for the root of all.
    """

    leaves: DataFrame
    runs: DataFrame
    staged: Staging


def _numbered(rows: DataFrame, order: Sequence[str], staged: Staging, name: str) -> DataFrame:
    """rows with idx, their place among those of their tree by ``order``, and width, how many it has.

    Rows are dealt by ranges of (tree, order); each range counts its own rows, after those of the ranges before it.
    """
    dealt = staged.write(rows.repartitionByRange("tree", *order).withColumn("part", F.spark_partition_id()), name)
    sizes = dealt.groupBy("tree", "part").agg(F.count("*").alias("own"))
    whole = Window.partitionBy("tree")
    before = F.coalesce(F.sum("own").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    sizes = sizes.select("tree", "part", before, F.sum("own").over(whole).alias("width"))
    inner = F.row_number().over(Window.partitionBy("tree", "part").orderBy(*order))
    placed = dealt.withColumn("inner", inner).join(sizes, ["tree", "part"])
    return placed.withColumn("idx", F.col("before") + F.col("inner") - 1).drop("part", "inner", "before")


def _children(pairs: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(pairs)), lambda m: m["hash"])


def _above(level: DataFrame, first: DataFrame, staged: Staging, name: str) -> DataFrame:
    """All levels of runs above ``first`` (tree, level, run, children, hash, width), itself included, until each tree has one run."""
    every, k = first, 0
    widest = first.agg(F.max("width")).first()[0] or 0
    while widest > WIDTH:
        widest, k = -(-widest // WIDTH), k + 1
        nodes = level.where(F.col("width") > WIDTH).select("tree", "level", F.col("run").alias("idx"), "hash", F.ceil(F.col("width") / WIDTH).alias("width"))
        grouped = nodes.groupBy("tree", F.floor(F.col("idx") / WIDTH).alias("run"), "width", "level").agg(_children(F.struct("idx", "hash")).alias("children"))
        level = staged.write(grouped.select("tree", (F.col("level") + 1).alias("level"), "run", "children", digest(F.array_join("children", "")).alias("hash"), "width"), f"{name}-{k}")
        every = every.unionByName(level)
    return every


def build(docs: DataFrame, *, key: str = "doc_id", group: str = "source", columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), now: Mapping[str, Column] | None = None) -> Manifest:
    """The tree of a table's rows: a tree for each value of ``group`` over its rows by (key, leaf), and one over their roots,
    by group, null first. ``now`` replaces columns for the leaves that are to be verified; they don't change the tree.

    Null keys come first. Rows that repeat a key are leaves each, by their hashes; equal rows are equal leaves side by side.
    An empty table has no runs. Only ``columns`` are read; what else ``docs`` has, and its names, does not matter. The last
    pass needs the written runs: drop ``staged`` when results have been read.
    """
    spark = docs.sparkSession
    staged = Staging(spark, "merkle")
    tree = F.coalesce(F.concat(F.lit("="), docs[group].cast("string")), F.lit("-"))
    then, later = ([(now or {}).get(c, docs[c]) if changed else docs[c] for c in columns] for changed in (False, True))
    hashed = docs.select(tree.alias("tree"), docs[key].alias("key"), leaf_hash(then).alias("leaf"), (leaf_hash(later) if now else leaf_hash(then)).alias("now"))
    placed = _numbered(hashed, ["key", "leaf", "now"], staged, "hashed")
    member = F.struct((F.col("idx") % WIDTH).cast("int").alias("pos"), "key", "leaf", "now")
    leaves = staged.write(placed.groupBy("tree", F.floor(F.col("idx") / WIDTH).alias("run"), "width").agg(F.array_sort(F.collect_list(member)).alias("members")), "leaves")
    staged.drop("hashed")
    of_leaves = F.transform("members", lambda m: m["leaf"]).alias("children")
    joined = digest(F.array_join("children", "")).alias("hash")
    several = leaves.where("width > 1").select("tree", F.lit(0).alias("level"), "run", of_leaves, "width")
    own = _above(one := several.select("*", joined).select("tree", "level", "run", "children", "hash", "width"), one, staged, "own")
    top = F.col("width") <= WIDTH
    roots = own.where(top).select(F.lit(TOP).alias("tree"), F.col("tree").alias("key"), "hash")
    roots = roots.unionByName(leaves.where("width = 1").select(F.lit(TOP).alias("tree"), F.col("tree").alias("key"), F.col("members")[0]["leaf"].alias("hash")))
    groups = staged.write(_numbered(roots, ["key"], staged, "roots"), "groups")
    staged.drop("roots")
    some = groups.where("width > 1").groupBy("tree", F.floor(F.col("idx") / WIDTH).alias("run"), "width").agg(_children(F.struct("idx", "hash")).alias("children"))
    first = staged.write(some.select("tree", F.lit(0).alias("level"), "run", "children", joined, "width"), "top-0")
    over = _above(first, first, staged, "top")
    in_top = groups.select(F.col("key").alias("tree"), F.when(F.col("width") > 1, F.lit(TOP)).alias("tree_above"), F.col("idx").alias("idx_above"))

    def linked(runs: DataFrame, inside: Column, tree: Column, idx: Column) -> DataFrame:
        """Links to the run above in the same tree where ``inside`` holds, else to place ``idx`` of ``tree``."""
        at = F.when(inside, F.col("run")).otherwise(idx)
        return runs.select("tree", "level", "run", "children", "hash", F.when(inside, F.col("tree")).otherwise(tree).alias("next_tree"), F.when(inside, F.col("level") + 1).otherwise(F.lit(0)).alias("next_level"), F.floor(at / WIDTH).alias("next_run"), (at % WIDTH).cast("int").alias("next_pos"), (~inside & (F.col("tree") != TOP)).alias("top"))

    nowhere, zero = F.lit(None).cast("string"), F.lit(0).cast("bigint")
    below = linked(own.where(~top), F.lit(True), nowhere, zero)
    tops = linked(own.where(top).join(in_top, "tree"), F.lit(False), F.col("tree_above"), F.col("idx_above"))
    runs = staged.write(below.unionByName(tops).unionByName(linked(over, ~top, nowhere, zero)), "runs")
    single = leaves.where("width = 1").join(in_top, "tree").select("tree", "run", "members", F.lit(True).alias("alone"), F.col("tree_above").alias("next_tree"), F.lit(0).alias("next_level"), F.floor(F.col("idx_above") / WIDTH).alias("next_run"), (F.col("idx_above") % WIDTH).cast("int").alias("next_pos"), F.col("members")[0]["leaf"].alias("subroot"))
    place = runs.where("level = 0").select("tree", "run", "next_tree", "next_level", "next_run", "next_pos", F.when(F.col("top"), F.col("hash")).alias("subroot"), F.col("hash").alias("root"))
    many = leaves.where("width > 1").select("tree", "run", "members", F.lit(False).alias("alone")).join(place, ["tree", "run"])
    return Manifest(staged.write(many.unionByName(single.withColumn("root", F.col("subroot"))), "places"), runs, staged)


#: From runs of leaves, each with its leaves' folded hashes, up to the root of all. Hashes are carried as bytes.
_CLIMB = """
    WITH RECURSIVE climb AS (
        SELECT tree, run, next_tree, next_level, next_run, next_pos, folded, CAST('' AS BINARY) AS passed, subroot, root FROM {start}
        UNION ALL
        SELECT c.tree, c.run, r.next_tree, r.next_level, r.next_run, r.next_pos,
            transform(c.folded, f -> unhex(sha2(CAST(array_join(slice(r.children, 1, c.next_pos), '') || lower(hex(f)) || array_join(slice(r.children, c.next_pos + 2, {width}), '') AS BINARY), 256))),
            c.passed || unhex(array_join(slice(r.children, 1, c.next_pos), '') || array_join(slice(r.children, c.next_pos + 2, {width}), '')),
            CASE WHEN r.top THEN r.hash ELSE c.subroot END, r.hash
        FROM climb c JOIN {runs} r ON r.tree = c.next_tree AND r.level = c.next_level AND r.run = c.next_run)
    SELECT tree, run, folded, passed, subroot, root FROM climb WHERE next_tree IS NULL"""

_ROWS = "spark.sql.cteRecursionRowLimit"


def _climbed(spark: SparkSession, manifest: Manifest) -> DataFrame:
    """(tree, run, folded, passed, subroot, root) of each run of leaves; written, as the recursion's limit on rows, which
    counts all steps of a whole table, is lifted for it alone."""
    beside = lambda m, left: F.array_join(F.transform(F.filter("members", lambda x: (x["pos"] < m["pos"]) if left else (x["pos"] > m["pos"])), lambda x: x["leaf"]), "")
    folded = F.transform("members", lambda m: F.unhex(F.when(F.col("alone"), m["now"]).otherwise(digest(F.concat(beside(m, True), m["now"], beside(m, False))))))
    start = manifest.leaves.withColumn("folded", folded).drop("members", "alone")
    before = spark.conf.get(_ROWS)
    spark.conf.set(_ROWS, "-1")
    try:
        return manifest.staged.write(spark.sql(_CLIMB, start=start, runs=manifest.runs, width=WIDTH), "climbed")
    finally:
        spark.conf.set(_ROWS, before)


def proofs(manifest: Manifest) -> DataFrame:
    """Per leaf: key, leaf, subroot, root, siblings (bytes, 32 each, from its own run to the root's), folded_root and verified."""
    climbed = _climbed(manifest.leaves.sparkSession, manifest)
    each = manifest.leaves.select("tree", "run", "members").join(climbed, ["tree", "run"])
    own = lambda m: F.unhex(F.array_join(F.transform(F.filter("members", lambda x: x["pos"] != m["pos"]), lambda x: x["leaf"]), ""))
    rows = F.transform(F.arrays_zip("members", "folded"), lambda z: F.struct(z["members"]["key"].alias("key"), z["members"]["leaf"].alias("leaf"), F.concat(own(z["members"]), F.col("passed")).alias("siblings"), F.lower(F.hex(z["folded"])).alias("folded_root")))
    out = each.select("subroot", "root", F.inline(rows))
    return out.select("key", "leaf", "subroot", "root", "siblings", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
