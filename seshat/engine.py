"""One class over a folder of published tables: index vaults, then ask."""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .functions.predicates import SEARCH_MODES, in_scope, item_priority, item_type
from .functions.text import excerpt
from .operators import block_index, embedding, entities, families, fusion, graph, keyword, listing, memory, packing, reconcile, render, vector
from .plans.hybrid import candidate_limit
from .plans.staging import Staging, few
from .sources import markdown
from .sources.catalog import Catalog
from .sources.segments import SegmentStore
from .streaming.watch import watch

OWNER = ["vault_id", "path"]
KEYS = ["vault_id", "chunk_id"]
EXPLAINED = 256

#: A result's total order.
ORDER = ("vault_id", "path", "ordinal")


class Engine:
    """Queries read the active generation; ``index`` publishes a new one, of the changed documents' segments in each store."""

    def __init__(self, spark: SparkSession, root: str, catalog: Catalog, model: Callable[[Sequence[str]], list[list[float]]] = embedding.hash_embedding):
        self.spark, self.store, self.catalog, self.model = spark, SegmentStore(spark, root, OWNER), catalog, model
        self._explained: OrderedDict[str, dict] = OrderedDict()

    def _documents(self) -> DataFrame:
        roots = {v.vault_id: v.root_path for v in self.catalog.vaults}
        found = [markdown.documents(markdown.read_vault(self.spark, roots[v], v, scopes)) for v, scopes in self.catalog.resolve().items()]
        if not found:
            raise ValueError("the catalog has no enabled vault")
        return reduce(DataFrame.unionByName, found)

    def index(self, *, dry_run: bool = False) -> dict[str, int]:
        """Reads all vaults of the catalog and publishes what has changed; returns how many documents did. A dry run writes
        nothing.

        Documents, chunks and the keyword index are published together or not at all. Vectors, and the graph, are compared
        with the documents on their own: if a stage fails, what it had stays, with the error (see ``status``), the others are
        published, and the next run makes up for it.
        """
        docs = self._documents()
        owned = lambda df, hash_: df.select(*OWNER, F.col(hash_).alias("hash"))
        plan = lambda name, now: reconcile.plan(now.where("false") if (old := self.store.owners(name)) is None else old, now, OWNER, ["hash"])
        count = lambda df: {r["action"]: r["count"] for r in df.groupBy("action").count().collect()}
        if dry_run:
            return count(plan("documents", owned(docs, "raw_sha256")))
        staged, source = Staging(self.spark, "index"), uuid.uuid4().hex
        new: dict[str, list[dict]] = {}
        only = lambda df, of: df.join(of, OWNER, "left_semi")

        def planned(name: str, now: DataFrame) -> tuple[dict[str, int], DataFrame, DataFrame]:
            """How many owners of a store change, which get fresh rows, and which lose what they have."""
            actions = staged.write(plan(name, now), f"plan-{name}")
            counts = count(actions)
            of = lambda *names: few(actions.where(F.col("action").isin(*names)).select(*OWNER), sum(counts.get(n, 0) for n in names))
            return counts, of("insert", "update"), of("update", "delete")

        def add(name: str, rows: DataFrame, owners: DataFrame, gone: DataFrame, **more: object) -> list[dict]:
            new[name] = [*self.store.segments(name), self.store.write(name, rows, owners, gone, **more)]
            if name != "keyword" and self.store.is_due(new[name]):
                new[name] = self.store.folded(name, new[name])
            return new[name]

        def current(name: str, part: str = "rows") -> DataFrame:
            return self.store.merged(name, new.get(name) or self.store.segments(name), part)

        counts, fresh, gone = planned("documents", owned(docs, "raw_sha256"))
        changed = set(counts) != {"unchanged"}
        if changed:
            before = None if self.store.active() is None else self._named(only(self.store.read("chunks"), gone), self.store.read("documents"))
            add("documents", only(docs, fresh), only(owned(docs, "raw_sha256"), fresh), gone)
            now = current("documents", "owners")
            add("chunks", markdown.chunks(only(current("documents"), fresh)), only(now, fresh), gone)
            self._add_keyword(add, only(current("chunks"), fresh), current("documents"), only(now, fresh), gone, before)
            if self.store.is_due(new["keyword"]):
                new["keyword"] = [self._folded_keyword(new["keyword"], current("chunks"), current("documents"))]
            seeds = staged.write(families.families(current("documents"), current("documents").select(*OWNER, F.explode("targets").alias("target"))), "families")
            kin, fresh_kin, gone_kin = planned("families", owned(seeds, "family_seed"))
            if set(kin) != {"unchanged"}:
                add("families", only(seeds, fresh_kin), only(owned(seeds, "family_seed"), fresh_kin), gone_kin)
        failed: dict[str, str] = {}
        for stores, stage in ((("vectors",), self._vectors), (("links", "entities", "edges"), self._graph)):
            try:
                stage(planned, add, current, only)
            except Exception as e:  # whatever a model or a stage raises; the run goes on without it
                for name in stores:
                    new.pop(name, None)
                said = [line for line in str(e).split("\n") if line.strip() and not line.startswith(("\t", " ", "JVM"))]
                failed |= {name: f"{type(e).__name__}: {said[-1] if said else ''}"[:500] for name in stores}
        if new or failed:
            self.store.publish(source, new, failed=failed)
        staged.drop("")
        return counts

    @staticmethod
    def _named(chunks: DataFrame, docs: DataFrame) -> DataFrame:
        """Chunks with all fields that are searched."""
        return chunks.join(docs.select(*OWNER, "title", "frontmatter"), OWNER)

    def _add_keyword(self, add: Callable, chunks: DataFrame, docs: DataFrame, owners: DataFrame, gone: DataFrame, before: DataFrame | None) -> None:
        path = self.store.folder("keyword")
        block_index.write(self._named(chunks, docs), KEYS, keyword.FIELDS, f"{self.store.root}/{path}", owner=OWNER, removed=before)
        add("keyword", chunks.select(*OWNER, "chunk_id"), owners, gone, path=path, others=("blocks", "minus", "statistics"))

    def _folded_keyword(self, segments: list[dict], chunks: DataFrame, docs: DataFrame) -> dict:
        path = self.store.folder("keyword")
        block_index.write(self._named(chunks, docs), KEYS, keyword.FIELDS, f"{self.store.root}/{path}", owner=OWNER)
        return self.store.write("keyword", self.store.merged("keyword", segments), self.store.merged("keyword", segments, "owners"), path=path, others=("blocks", "minus", "statistics"))

    def _vectors(self, planned: Callable, add: Callable, current: Callable, only: Callable) -> None:
        now = current("documents", "owners")
        counts, fresh, gone = planned("vectors", now)
        if set(counts) != {"unchanged"}:
            add("vectors", embedding.embed(only(current("chunks"), fresh), [*OWNER, "chunk_id"], self.model), only(now, fresh), gone)

    def _graph(self, planned: Callable, add: Callable, current: Callable, only: Callable) -> None:
        """Entities and edges of changed documents, and of those with a link to a name that a changed document has."""
        now, docs, chunks = current("documents", "owners"), current("documents"), current("chunks")
        counts, fresh, gone = planned("links", now)
        if set(counts) == {"unchanged"}:
            return
        base = lambda path: F.regexp_replace(F.element_at(F.split(path, "/"), -1), "[#?].*$", "")
        own = only(chunks, fresh)
        stated = only(docs, fresh).select(*OWNER, F.explode(F.flatten(F.array(*(entities.values(F.col("frontmatter"), k) for k in entities.RELATIONS)))).alias("target"))
        links = graph.local_links(own).select(*OWNER, "target").union(stated)
        names = links.select(*OWNER, F.regexp_replace(base(F.col("target")), "\\.md$", "").alias("base")).distinct()
        add("links", names, only(now, fresh), gone)
        touched = fresh.union(gone).select("vault_id", F.regexp_replace(base(F.col("path")), "\\.md$", "").alias("base")).distinct()
        near = current("links").join(touched, ["vault_id", "base"], "left_semi").select(*OWNER)
        again = only(near.union(fresh).distinct(), now)
        away = near.union(gone).distinct()
        found = entities.occurrences(only(chunks, again), docs)
        add("entities", found, only(now, again), away)
        edges = entities.relationships(current("entities").join(again, OWNER, "left_semi")).withColumn("path", F.col("source"))
        add("edges", edges, only(now, again), away)

    def status(self) -> list[dict]:
        """One dict a store: store, state (ready, stale: it failed in the last run, or unavailable), error, segments and rows."""
        out = []
        for name, store in sorted(self.store.stores().items()):
            state = "unavailable" if not store["segments"] else "stale" if store["error"] else "ready"
            out.append({"store": name, "state": state, "error": store["error"], "segments": len(store["segments"]), "rows": sum(s["manifest"]["rows"]["rows"] for s in store["segments"])})
        return out

    def warnings(self) -> list[str]:
        """Why a search may lack results: stores that aren't ready."""
        return [f"{s['store']} {s['state']}: {s['error']}" for s in self.status() if s["state"] != "ready"]

    def _keyword(self) -> block_index.BlockIndex:
        segments = self.store.segments("keyword")
        parts = [block_index.Part(f"{self.store.root}/{s['path']}", self.store._part(s, "gone") if k and s["manifest"]["gone"]["rows"] else None) for k, s in enumerate(segments)]
        return block_index.BlockIndex(self.spark, parts, KEYS, keyword.FIELDS, OWNER)

    def edges(self) -> DataFrame:
        """(vault_id, source, type, target, target_path, confidence, evidence_n, edge_id, status) of all documents' relationships."""
        found = self.store.read("edges").groupBy("vault_id", "source", "type", "target", "target_path").agg(F.max("confidence").alias("confidence"), F.count("*").alias("evidence_n"))
        return found.withColumn("edge_id", F.concat_ws(">", "vault_id", "source", "type", "target")).withColumn("status", F.lit("stated"))

    def entities(self) -> DataFrame:
        """One row an entity, with the evidence of all documents."""
        return graph.merge_entities(self.store.read("entities").select("vault_id", "type", "name", "canonical_path", "confidence", "chunk_id"))

    def watch(self, vault_id: str, checkpoint: str, *, interval: str | None = None) -> StreamingQuery:
        """Indexes again whenever a vault has new files; a generation is published only if its run ends well. Without an
        interval it takes what is there and ends. Each run lists the vaults anew, so deleted files go with the next one."""
        roots = {v.vault_id: v.root_path for v in self.catalog.vaults}
        return watch(self.spark, roots[vault_id], checkpoint, lambda changed, batch: self.index() and None, interval=interval)

    def _scope(self, df: DataFrame, vaults: Sequence[str], scopes: Sequence[str]) -> DataFrame:
        allowed = self.catalog.resolve(tuple(vaults), tuple(scopes))
        fits = F.lit(False)
        for vault_id, own in allowed.items():
            fits = fits | (F.col("vault_id") == vault_id) & in_scope(F.col("path"), own)
        return df.where(fits)

    def search(self, query: str, limit: int = 10, *, mode: str = "knowledge", vaults: Sequence[str] = (), scopes: Sequence[str] = ()) -> DataFrame:
        """(vault_id, path, section, chunk_id, excerpt, fused, best_rank, kinds, family_seed, rk), best first.

        Without vectors it is by keywords alone; ``warnings`` says so."""
        k, keys = candidate_limit(limit), KEYS
        chunks = self.store.read("chunks")
        allowed = self._scope(chunks, vaults, scopes).where(F.col("source_role").isin(*SEARCH_MODES[mode])).select(*keys, "path", "ordinal", "section", "text", "source_role")
        signals = {"keyword": self._keyword().search(query, k, allowed=allowed)}
        if self.store.segments("vectors"):
            target = self.model([query])[0]
            signals["vector"] = vector.search(self.store.read("vectors").join(allowed.select(*keys), keys, "left_semi"), target, keys, k)
        fused = fusion.fuse(signals, keys)
        rows = fused.join(allowed, keys).join(self.store.read("families").select("vault_id", "path", "family_seed"), ["vault_id", "path"])
        order = [F.desc("fused"), F.col("best_rank"), *map(F.col, ORDER)]
        top = families.once_a_family(rows, order, limit) if mode == "knowledge" else keyword.ranked(rows.orderBy(*order).limit(limit), order)
        return top.select("vault_id", "path", "section", "chunk_id", excerpt(F.col("text")).alias("excerpt"), "fused", "best_rank", "kinds", "family_seed", "rk")

    def related(self, path: str, *, depth: int = 2, limit: int = 20) -> DataFrame:
        """What a document reaches in the entity graph."""
        edges = self.edges().withColumn("target", F.coalesce("target_path", "target"))
        return graph.related(edges, self.spark.range(1).select(F.lit(path).alias("node")), depth, limit)

    def context_pack(self, query: str, *, max_tokens: int = 1200, limit: int = 20) -> DataFrame:
        """Search results by the priority of their type, as far as the budget of words goes."""
        found = self.search(query, limit, mode="all")
        full = found.join(self.store.read("chunks").select("vault_id", "chunk_id", "text", "token_count"), ["vault_id", "chunk_id"])
        docs = self.store.read("documents").select("vault_id", "path", "title", F.coalesce("fm_type", "kind").alias("kind"))
        typed = full.join(docs, ["vault_id", "path"]).withColumn("item_type", item_type(F.col("path"), F.col("kind"), F.col("section"), F.col("title")))
        order = [item_priority(F.col("item_type")), F.col("rk"), F.col("vault_id"), F.col("path"), F.col("chunk_id")]
        return packing.admit(typed, order, F.col("token_count"), max_tokens).where("admitted")

    def ask(self, query: str, limit: int = 5) -> DataFrame:
        """Claims, each an excerpt with its evidence; claims without live evidence are an error."""
        found = self.search(query, limit, mode="all")
        claims = packing.claims(found.withColumnRenamed("chunk_id", "doc_id"), limit).join(found.select("rk", "path", "excerpt"), "rk")
        if not packing.uncited(claims.withColumnRenamed("doc_id", "chunk_id"), self.store.read("chunks"), "chunk_id").isEmpty():
            raise ValueError("a claim has no evidence")
        return claims.orderBy("rk")

    def decisions(self, limit: int = 10) -> DataFrame:
        return memory.decisions(self.store.read("documents"), self.store.read("chunks"), limit)

    def open_questions(self, limit: int = 10) -> DataFrame:
        return memory.open_questions(self.store.read("documents"), self.store.read("chunks"), limit)

    def project_summary(self, limit: int = 10) -> DataFrame:
        return memory.project_groups(self.store.read("documents"), self.store.read("chunks"), limit)

    def audit(self) -> DataFrame:
        return memory.hygiene(self.store.read("documents"), self.store.read("chunks"))

    def outline(self, vault_id: str, path: str) -> DataFrame:
        return listing.of_document(self.store.read("chunks"), vault_id, path)

    def explain(self, results: DataFrame) -> list[str]:
        """Keeps the signals of a few results for ``explanation`` and returns their ids."""
        ids = []
        for r in render.rows(results):
            id_ = f"{r['vault_id']}:{r['chunk_id']}:rank-{r['rk']}"
            self._explained[id_] = {"path": r["path"], "kinds": list(r["kinds"]), "fused": r["fused"], "best_rank": r["best_rank"]}
            ids.append(id_)
        while len(self._explained) > EXPLAINED:
            self._explained.popitem(last=False)
        return ids

    def explanation(self, result_id: str) -> dict:
        return self._explained[result_id]
