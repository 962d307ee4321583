"""Entity graph: extraction from links, lookups, bounded neighbourhoods and ranked paths.

Entities: (vault_id, entity_id, type, name, normalized_name, aliases, canonical_path, confidence, status).
Edges: (edge_id, source, target, type, status, confidence).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import entity_name, link_target, stable_id
from ..plans.staging import Staging

# Weights of statuses and of depths.
STATUS_WEIGHTS = {"stated": 1.0, "inferred": 0.75, "contested": 0.45, "deprecated": 0.0}
DEPTH_WEIGHTS = (1.0, 0.6)
MATCH_KINDS = ("id", "path", "name", "alias", "substring")
EDGE_LIMIT = 200
TYPE_PRIORITY = ("supersedes", "depends_on", "blocks", "implements", "related_to", "mentions")
#: Edges that a projection works on at most.
WORKING_EDGES = 500


def local_links(chunks: DataFrame) -> DataFrame:
    """(vault_id, chunk_id, path, target, label) for Markdown and wiki links in ``text``; images are none."""
    markdown = F.transform(F.regexp_extract_all("text", F.lit(r"(?<!!)\[[^\]\n]*\]\(([^)\s]+)\)"), 1), lambda t: F.struct(t.alias("target"), F.lit(None).cast("string").alias("label")))
    wiki = F.transform(F.regexp_extract_all("text", F.lit(r"(?<!!)\[\[([^\]\n]+)\]\]"), 1), lambda t: F.struct(F.trim(F.substring_index(t, "|", 1)).alias("target"), F.when(t.contains("|"), F.trim(F.substring_index(t, "|", -1))).alias("label")))
    return chunks.select("vault_id", "chunk_id", "path", F.explode(F.concat(markdown, wiki)).alias("l")).select("vault_id", "chunk_id", "path", "l.target", "l.label")


def resolve_links(links: DataFrame, docs: DataFrame) -> DataFrame:
    """links with to_path: the document of that path, or the only one in the vault with that base name; else null."""
    named = links.withColumn("wanted", link_target(F.col("path"), F.col("target")))
    exact = docs.select("vault_id", F.col("path").alias("wanted"), F.col("path").alias("exact")).distinct()
    base = docs.select("vault_id", F.element_at(F.split("path", "/"), -1).alias("wanted"), "path").distinct()
    single = base.groupBy("vault_id", "wanted").agg(F.count("*").alias("n"), F.min("path").alias("single")).where("n = 1").drop("n")
    joined = named.join(exact, ["vault_id", "wanted"], "left").join(single, ["vault_id", "wanted"], "left")
    return joined.select(*links.columns, F.coalesce("exact", F.when(~F.col("wanted").contains("/"), F.col("single"))).alias("to_path"))


def merge_entities(occurrences: DataFrame) -> DataFrame:
    """One entity for each (vault_id, type, normalized name, canonical_path): the name of the surest occurrence,
    all aliases and evidence. occurrences: (vault_id, type, name, canonical_path, confidence, chunk_id)."""
    rows = occurrences.withColumn("normalized_name", entity_name(F.col("name")))
    first = F.min_by("name", F.struct(-F.col("confidence"), F.col("name"), F.col("chunk_id")))
    keys = ("vault_id", "type", "normalized_name", "canonical_path")
    groups = rows.groupBy(*keys).agg(first.alias("name"), F.array_sort(F.collect_set("name")).alias("aliases"), F.max("confidence").alias("confidence"), F.array_sort(F.collect_set("chunk_id")).alias("evidence"), F.count("*").alias("mentions"))
    return groups.select("*", stable_id("entity", F.col("vault_id"), F.col("type"), F.col("normalized_name"), F.col("canonical_path")).alias("entity_id"))


def merge_relationships(occurrences: DataFrame, entities: DataFrame) -> DataFrame:
    """One edge for each (source, type, target): greatest confidence, number of distinct evidence chunks. Ends that
    are no entity drop out. occurrences: (source, type, target, confidence, chunk_id)."""
    known = entities.select("entity_id").distinct()
    rows = occurrences.join(known.withColumnRenamed("entity_id", "source"), "source", "left_semi").join(known.withColumnRenamed("entity_id", "target"), "target", "left_semi")
    groups = rows.groupBy("source", "type", "target").agg(F.max("confidence").alias("confidence"), F.count_distinct("chunk_id").alias("evidence_n"))
    return groups.select("*", F.lit("stated").alias("status"), stable_id("relationship", F.col("source"), F.col("type"), F.col("target")).alias("edge_id"))


def find(entities: DataFrame, wanted: str, limit: int, *, statuses: Sequence[str] = ("active",)) -> DataFrame:
    """Entities that match by id (1), path (2), name (3), alias (4) or part of a name or alias (5), best first."""
    name = entity_name(F.lit(wanted))
    alias = F.coalesce(F.exists("aliases", lambda a: entity_name(a) == name), F.lit(False))
    part = F.col("normalized_name").contains(name) | F.coalesce(F.exists("aliases", lambda a: entity_name(a).contains(name)), F.lit(False))
    rank = F.when(F.col("entity_id") == wanted, 1).when(F.col("canonical_path") == wanted, 2).when(F.col("normalized_name") == name, 3).when(alias, 4).when(part, 5)
    found = entities.where(F.col("status").isin(*statuses)).withColumn("match_rank", rank).where("match_rank IS NOT NULL")
    return found.orderBy("match_rank", "vault_id", "normalized_name", "entity_id").limit(limit)


def oriented(edges: DataFrame, direction: str = "both") -> DataFrame:
    """edges with from_id and to_id as they are walked; ``both`` walks each edge both ways."""
    out = edges.withColumns({"from_id": F.col("source"), "to_id": F.col("target")})
    back = edges.withColumns({"from_id": F.col("target"), "to_id": F.col("source")})
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction]


def adjacent(edges: DataFrame, seeds: DataFrame, direction: str = "both") -> DataFrame:
    """Edges at seeds (node), as two equi-joins and not one with OR."""
    keyed = seeds.select(F.col("node").alias("from_id")).distinct()
    return oriented(edges, direction).join(keyed, "from_id", "left_semi").drop("from_id", "to_id").distinct()


def paths(edges: DataFrame, seeds: DataFrame, depth: int, *, direction: str = "both") -> DataFrame:
    """Simple paths of one or two edges from seeds: (start, nodes, edge_ids, target, depth, score, status).

    score: the least confidence * status weight on the path, times the weight of its depth.
    """
    weight = F.col("confidence") * F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in STATUS_WEIGHTS.items() for x in p)), F.col("status")), F.lit(0.0))
    steps = oriented(edges, direction).select("from_id", "to_id", "edge_id", weight.alias("weight"), "status").where("from_id <> to_id")
    start = seeds.select(F.col("node").alias("from_id")).distinct()
    one = start.join(steps, "from_id").select(F.col("from_id").alias("start"), F.array("from_id", "to_id").alias("nodes"), F.array("edge_id").alias("edge_ids"), F.col("to_id").alias("target"), F.lit(1).alias("depth"), "weight", F.array("status").alias("statuses"))
    every = one
    if depth > 1:
        two = one.join(steps.withColumnsRenamed({"weight": "w2", "from_id": "target", "edge_id": "e2", "status": "s2"}), "target").where("NOT array_contains(nodes, to_id)")
        every = one.unionByName(two.select("start", F.concat("nodes", F.array("to_id")).alias("nodes"), F.concat("edge_ids", F.array("e2")).alias("edge_ids"), F.col("to_id").alias("target"), F.lit(2).alias("depth"), F.least("weight", "w2").alias("weight"), F.concat("statuses", F.array("s2")).alias("statuses")))
    score = F.col("weight") * F.when(F.col("depth") == 1, DEPTH_WEIGHTS[0]).otherwise(DEPTH_WEIGHTS[1])
    return every.select("start", "nodes", "edge_ids", "target", "depth", score.alias("score"), "statuses")


def working_edges(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, depth: int, *, direction: str = "both", types: Sequence[str] = (), statuses: Sequence[str] = ("stated",), cross_vault: bool = False) -> DataFrame:
    """Edges that paths of ``depth`` steps from seeds can use: of the types (all, if none is named) and statuses, within a
    vault unless ``cross_vault``, both ends among nodes, and at a seed or, for two steps, at what one step reaches.

    edges: (edge_id, source_vault, source, target_vault, target, type, status, confidence); nodes and seeds: (vault_id, entity_id).
    """
    if depth not in (1, 2):
        raise ValueError("paths have one or two steps")
    own = edges.where(F.col("status").isin(*statuses))
    own = own.where(F.col("type").isin(*types)) if types else own
    own = own if cross_vault else own.where("source_vault = target_vault")
    ends = {"source": ("source_vault", "source"), "target": ("target_vault", "target")}
    named = lambda df, end: df.select(F.col("vault_id").alias(ends[end][0]), F.col("entity_id").alias(ends[end][1])).distinct()
    sides = {"out": ("source",), "in": ("target",), "both": ("source", "target")}[direction]
    staged = Staging(edges.sparkSession, "paths")

    def at(points: DataFrame, name: str) -> DataFrame:
        """Edges that leave the points, written: each step starts from a table and not from the plan of the one before."""
        found = reduce(DataFrame.unionByName, (own.join(named(points, side), list(ends[side]), "left_semi") for side in sides)).distinct()
        for end in ends:
            found = found.join(named(nodes, end), list(ends[end]), "left_semi")
        return staged.write(found, name)

    near = at(seeds, "one")
    if depth == 1:
        return near
    reached = reduce(DataFrame.union, (near.select(F.col(v).alias("vault_id"), F.col(i).alias("entity_id")) for v, i in ends.values())).distinct()
    return at(reached, "two")


def projection(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, depth: int, limit: int, *, edge_limit: int = WORKING_EDGES, direction: str = "both", types: Sequence[str] = (), statuses: Sequence[str] = ("stated",), cross_vault: bool = False) -> tuple[DataFrame, DataFrame]:
    """The ``limit`` best simple paths from seeds to other nodes, and one row (edge_count, truncated).

    Of ``working_edges`` the first ``edge_limit`` are used, by vaults, type, id and target; each partition keeps no more, so
    that a hub's edges meet in no task. Seeds are no targets; paths may lead through them. Paths: (seed_vault, seed,
    target_vault, target, edge_ids, types, depth, score, explanation, rk), by score, depth, the first edge's type, by
    priority and name, the target's vault and name, and the first edge's id; equals by all edge ids and the seed.
    nodes: (vault_id, entity_id, normalized_name). edges, seeds: as ``working_edges`` has them.
    """
    found = working_edges(edges, nodes, seeds, depth, direction=direction, types=types, statuses=statuses, cross_vault=cross_vault)
    order = ["source_vault", "target_vault", "type", "edge_id", "target"]
    staged = Staging(edges.sparkSession, "paths")
    used = staged.write(found.orderBy(*order).limit(edge_limit + 1).withColumn("seshat_rn", F.row_number().over(Window.orderBy(*order))), "used")
    kept = used.where(F.col("seshat_rn") <= edge_limit)
    weight = F.col("confidence") * F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in STATUS_WEIGHTS.items() for x in p)), F.col("status")), F.lit(0.0))
    step = lambda a, b: kept.select(F.struct(F.col(f"{a}_vault").alias("vault"), F.col(a).alias("id")).alias("from"), F.struct(F.col(f"{b}_vault").alias("vault"), F.col(b).alias("id")).alias("to"), F.struct("edge_id", "type", weight.alias("weight")).alias("edge")).where("from <> to")
    steps = {"out": lambda: step("source", "target"), "in": lambda: step("target", "source"), "both": lambda: step("source", "target").union(step("target", "source"))}[direction]()
    start = seeds.select(F.struct(F.col("vault_id").alias("vault"), F.col("entity_id").alias("id")).alias("from")).distinct()
    one = steps.join(start, "from").select(F.col("from").alias("seed"), F.col("to"), F.array("edge").alias("edges"))
    every = one
    if depth == 2:
        more = one.select("seed", F.col("to").alias("via"), "edges").join(steps.withColumnRenamed("from", "via"), "via").where("to <> seed")
        every = one.union(more.select("seed", "to", F.concat("edges", F.array("edge")).alias("edges")))
    names = nodes.select(F.struct(F.col("vault_id").alias("vault"), F.col("entity_id").alias("id")).alias("to"), "normalized_name").groupBy("to").agg(F.min("normalized_name").alias("name"))
    targets = every.distinct().join(start.select(F.col("from").alias("to")), "to", "left_anti")
    named = staged.write(targets, "paths")
    named = named.join(names.join(named.select("to").distinct(), "to", "left_semi"), "to")
    each = lambda c: F.transform("edges", lambda e: e[c])
    score = F.array_min(each("weight")) * F.when(F.size("edges") == 1, DEPTH_WEIGHTS[0]).otherwise(DEPTH_WEIGHTS[1])
    rank = F.array_position(F.array(*map(F.lit, TYPE_PRIORITY)), F.element_at(each("type"), 1))
    paths_ = named.select(
        F.col("seed.vault").alias("seed_vault"), F.col("seed.id").alias("seed"), F.col("to.vault").alias("target_vault"), F.col("to.id").alias("target"), each("edge_id").alias("edge_ids"), each("type").alias("types"), F.size("edges").alias("depth"), score.alias("score"),
        F.concat(F.size("edges").cast("string"), F.lit("-edge graph path via "), F.array_join(each("type"), " -> ")).alias("explanation"), F.when(rank == 0, len(TYPE_PRIORITY) + 1).otherwise(rank).alias("seshat_rank"), "name",
    )
    by = [F.desc("score"), F.col("depth"), F.col("seshat_rank"), F.element_at("types", 1), F.col("target_vault"), F.col("name"), F.element_at("edge_ids", 1), F.col("edge_ids"), F.col("seed_vault"), F.col("seed")]
    top = paths_.orderBy(*by).limit(limit + 1).withColumn("rk", F.row_number().over(Window.orderBy(*by)).cast("bigint"))
    counts = used.agg(F.least(F.count("*"), F.lit(edge_limit)).alias("edge_count"), (F.count("*") > edge_limit).alias("cut"))
    more_paths = top.agg((F.count("*") > limit).alias("more"))
    return top.where(F.col("rk") <= limit).drop("seshat_rank", "name"), counts.join(more_paths).select("edge_count", (F.col("cut") | F.col("more")).alias("truncated"))


def related(edges: DataFrame, seeds: DataFrame, depth: int, limit: int, *, direction: str = "both", digits: int = 6) -> DataFrame:
    """(target, depth, score, rk): the best path to each other node, by (score downwards, depth, target)."""
    best = paths(edges, seeds, depth, direction=direction).groupBy("target").agg(F.max(F.struct("score", (-F.col("depth")).alias("d"))).alias("b"))
    top = best.select("target", (-F.col("b")["d"]).alias("depth"), F.round(F.col("b")["score"], digits).alias("score")).orderBy(F.desc("score"), "depth", "target").limit(limit)
    return top.withColumn("rk", F.row_number().over(Window.orderBy(F.desc("score"), "depth", "target")).cast("bigint"))


def trace(steps: DataFrame, priority: Column, keys: Sequence[str], limit: int) -> DataFrame:
    """steps by (priority of their role, keys), numbered rk."""
    order = [priority, *map(F.col, keys)]
    return steps.orderBy(*order).limit(limit).withColumn("rk", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def with_evidence(edges: DataFrame, evidence: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges that have live evidence, and evidence that points to no chunk. evidence: (edge_id, chunk_id)."""
    live = evidence.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi")
    return edges.join(live, "edge_id", "left_semi"), evidence.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_anti")


def signals(related_: DataFrame, evidence: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys and rk: evidence of related nodes as a search signal, at the rank of its best node. evidence: (node, keys)."""
    best = related_.select(F.col("target").alias("node"), "rk").join(evidence, "node").groupBy(*keys).agg(F.min("rk").alias("best"))
    return best.withColumn("rk", F.row_number().over(Window.orderBy("best", *keys)).cast("bigint")).drop("best")


def adjacent_page(edges: DataFrame, seeds: DataFrame, direction: str = "both", *, types: Sequence[str] | None = None, statuses: Sequence[str] | None = None, limit: int = EDGE_LIMIT) -> tuple[DataFrame, DataFrame]:
    """The first ``limit`` edges at seeds by edge_id, of the types and statuses asked for; and one row (matched, omitted, truncated)."""
    found = adjacent(edges, seeds, direction)
    for column, wanted in (("type", types), ("status", statuses)):
        found = found if wanted is None else found.where(F.col(column).isin(*wanted))
    matched = F.count("*")
    omitted = F.greatest(matched - limit, F.lit(0))
    return found.orderBy("edge_id").limit(limit), found.agg(matched.alias("matched"), omitted.alias("omitted"), (matched > limit).alias("truncated"))


def admitted(edges: DataFrame, evidence: DataFrame, vaults: Sequence[str], *, cross_vault: bool = False) -> DataFrame:
    """Edges (edge_id, source_vault, target_vault, ...) that a scope of vaults may show: both ends are in it, and no
    evidence (edge_id, vault_id) is from elsewhere. Without ``cross_vault`` ends and evidence are in one vault."""
    inside = edges.where(F.col("source_vault").isin(*vaults) & F.col("target_vault").isin(*vaults))
    if cross_vault:
        return inside.join(evidence.where(~F.col("vault_id").isin(*vaults)).select("edge_id"), "edge_id", "left_anti")
    one = inside.where("source_vault = target_vault")
    return one.join(evidence.select("edge_id", F.col("vault_id").alias("v")), (one["edge_id"] == evidence["edge_id"]) & (F.col("v") != one["source_vault"]), "left_anti")


def resource(entities: DataFrame, edges: DataFrame, vault_id: str, entity_id: str) -> DataFrame:
    """An entity by its id, whatever its status, with n_out and n_in, the numbers of its edges."""
    own = entities.where((F.col("vault_id") == vault_id) & (F.col("entity_id") == entity_id))
    count = lambda end, name: edges.where(F.col(end) == entity_id).groupBy(F.col(end).alias("entity_id")).agg(F.count("*").alias(name))
    joined = own.join(count("source", "n_out"), "entity_id", "left").join(count("target", "n_in"), "entity_id", "left")
    return joined.fillna(0, ["n_out", "n_in"])


def first_occurrences(rows: DataFrame, keys: Sequence[str], methods: Sequence[str], method: str = "origin", order: Sequence[str] = ()) -> DataFrame:
    """One row of each key: that of the method that comes first, then by ``order``; unknown methods come last."""
    place = F.array_position(F.array(*map(F.lit, methods)), F.col(method))
    window = Window.partitionBy(*keys).orderBy(F.when(place == 0, len(methods) + 1).otherwise(place), *(F.col(c) for c in (method, *order)))
    return rows.withColumn("seshat_rn", F.row_number().over(window)).where("seshat_rn = 1").drop("seshat_rn")


def build_id(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row (build_id): the same for the same rows in any order and partitioning, repeated rows counted.

    A digest of counts and of two sums of 60 bits each of a row's sha256, which are added up where the rows are.
    """
    def sums(df: DataFrame, name: str) -> DataFrame:
        text = F.concat(*(F.coalesce(F.concat(F.length(F.col(c).cast("string")), F.lit(":"), F.col(c)), F.lit("-")) for c in df.columns))
        bits = lambda at: F.coalesce(F.sum(F.conv(F.substring("seshat_h", at, 15), 16, 10).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
        return df.select(F.sha2(text, 256).alias("seshat_h")).agg(F.concat_ws(":", F.lit(name), F.count("*"), bits(1), bits(16)).alias("part"))

    both = sums(nodes, "nodes").union(sums(edges, "edges"))
    return both.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("part")), "|"), 256).alias("build_id"))


def weakest(statuses: Column) -> Column:
    """Of the statuses of a path's edges the one that weighs least, the first by name of equals."""
    weigh = lambda x: F.struct(F.coalesce(F.element_at(F.create_map(*(F.lit(v) for p in STATUS_WEIGHTS.items() for v in p)), x), F.lit(0.0)).alias("w"), x.alias("s"))
    return F.array_min(F.transform(statuses, weigh))["s"]


def edge_signals(found: DataFrame, evidence: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """keys and rk: the evidence of the last edge of each path, at the rank of its best path. evidence: (edge_id, keys)."""
    order = [F.desc("score"), F.col("depth"), F.col("target"), F.array_join("edge_ids", "|")]
    top = found.orderBy(*order).limit(limit).withColumn("rk", F.row_number().over(Window.orderBy(*order)))
    best = top.select(F.element_at("edge_ids", -1).alias("edge_id"), "rk").join(evidence, "edge_id").groupBy(*keys).agg(F.min("rk").alias("best"))
    return best.withColumn("rk", F.row_number().over(Window.orderBy("best", *keys)).cast("bigint")).drop("best")


def resolve_target(entities: DataFrame, wanted: str, limit: int = 20) -> DataFrame:
    """(entity_id, match_rank, ambiguous): the entities that match best by ``find``; ambiguous if there are several."""
    found = find(entities, wanted, limit)
    least = found.agg(F.min("match_rank").alias("match_rank"), F.lit(1).alias("one"))
    best = found.join(least.select("match_rank"), "match_rank")
    many = best.agg((F.count("*") > 1).alias("ambiguous"), F.lit(1).alias("one"))
    return best.select("entity_id", "match_rank", F.lit(1).alias("one")).join(many, "one").drop("one")
