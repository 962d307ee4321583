from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from seshat.operators import code_graph, fusion, graph, keyword, packing, project, vector
from seshat.operators.components import components
from seshat.plans.staging import Staging, shared_folder

ROWS = [
    (1, "wiki/a.md", "Intro", "Alpha", "{}", "graph search graph engine"), (2, "wiki/b.md", "", "Beta", "{}", "search foo bar"), (3, "raw/c.md", "x", "Gamma", "{}", "foo baz bar nothing here"),
    (4, "wiki/d.md", "y", "Delta", "{}", "résumé graph_node"), (5, "wiki/e.md", "z", "Eps", "{}", "other words entirely long text with many many terms"),
]


@pytest.mark.parametrize(
    ("query", "wanted"),
    [
        ("graph search", {1: -0.816228, 2: -0.378397, 4: -0.361092}), ("foo_bar", {2: -1.2355}), ("graph graph", {1: -0.941855, 4: -0.722184}),
        ("wiki", {2: -1.125e-06, 4: -1.073e-06, 1: -1.026e-06, 5: -8.42e-07}),
    ],
)
def test_bm25_golden(spark, query, wanted):
    corpus = spark.createDataFrame(ROWS, "rowid int, path string, section string, title string, frontmatter string, text string")
    found = keyword.search(corpus, query, ["rowid"], 10, fields=keyword.FIELDS, digits=9).collect()
    assert [r["rowid"] for r in found] == list(wanted)
    assert all(abs(r["score"] - wanted[r["rowid"]]) < 2e-6 for r in found)


def test_bm25_filters_before_limit_and_counts_all(spark):
    corpus = spark.createDataFrame([(k, "x" if k < 50 else "y", "term other" if k % 2 else "term") for k in range(100)], "id int, vault string, text string")
    found = keyword.search(corpus, "term", ["id"], 3, where=F.col("vault") == "y", digits=12).collect()
    assert [r["id"] for r in found] == [50, 52, 54]
    with pytest.raises(ValueError):
        keyword.search(corpus, " ... ", ["id"], 3)


def test_postings(spark):
    corpus = spark.createDataFrame([(1, "a b a")], "id int, text string")
    rows = {r["token"]: r["positions"] for r in keyword.postings(corpus, ["id"], ["text"]).collect()}
    assert rows == {"a": [0, 2], "b": [1]}


def test_cosine(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0])], "id int, embedding array<float>")
    assert [(r["id"], r["score"]) for r in vector.search(rows, [1.0, 0.0], ["id"], 5).collect()] == [(1, 1.0), (3, 0.707107), (2, 0.0)]
    with pytest.raises(Exception, match="different sizes"):
        vector.search(rows, [1.0], ["id"], 5).collect()


def test_fusion(spark):
    a, b = (spark.createDataFrame(r, "doc_id int, rk long") for r in ([(1, 1), (2, 2)], [(2, 1)]))
    rows = {r["doc_id"]: r for r in fusion.fuse({"keyword": a, "graph": b}, ["doc_id"]).collect()}
    assert rows[2]["fused"] == pytest.approx(1 / 62 + 0.75 / 61) and rows[2]["best_rank"] == 1 and rows[2]["kinds"] == ["graph", "keyword"]


def edges(spark, rows):
    return spark.createDataFrame([(f"e{k}", *r) for k, r in enumerate(rows)], "edge_id string, source string, target string, type string, status string, confidence double")


def test_paths_are_simple_and_bounded(spark):
    e = edges(spark, [("a", "b", "t", "stated", 0.9), ("b", "c", "t", "stated", 0.5), ("c", "a", "t", "deprecated", 1.0), ("a", "a", "t", "stated", 1.0)])
    seed = spark.createDataFrame([("a",)], "node string")
    rows = {(tuple(r["nodes"]), round(r["score"], 3)) for r in graph.paths(e, seed, 2).collect()}
    assert rows == {(("a", "b"), 0.9), (("a", "c"), 0.0), (("a", "b", "c"), 0.3), (("a", "c", "b"), 0.0)}
    assert [r["target"] for r in graph.related(e, seed, 2, 5).collect()] == ["b", "c"]
    assert graph.adjacent(e, seed, "in").count() == 2


def test_entities_find_ranks(spark):
    rows = [("v", "Concept", n, p, c, k) for n, p, c, k in (("Graph", None, 0.7, "c1"), ("graph ", None, 0.9, "c2"), ("Graph Search", "wiki/g.md", 1.0, "c3"))]
    found = graph.merge_entities(spark.createDataFrame(rows, "vault_id string, type string, name string, canonical_path string, confidence double, chunk_id string"))
    ranked = graph.find(found.withColumn("status", F.lit("active")), "graph", 5).collect()
    assert [(r["normalized_name"], r["match_rank"], r["mentions"]) for r in ranked] == [("graph", 3, 2), ("graph search", 5, 1)]
    assert ranked[0]["name"] == "graph " and ranked[0]["confidence"] == 0.9


def test_references_and_traversal(spark):
    symbols = spark.createDataFrame([("1", "p.a.run"), ("2", "p.b.run"), ("3", "p.b.stop")], "symbol_id string, qualified_name string")
    wanted = spark.createDataFrame([("p.a.run",), ("run",), ("b.stop",), ("none",)], "reference string")
    rows = {r["reference"]: (r["tier"], r["candidates"], r["status"]) for r in code_graph.resolve(wanted, symbols).collect()}
    assert rows == {"p.a.run": (1, 1, "inferred"), "run": (2, 2, "ambiguous"), "b.stop": (3, 1, "inferred"), "none": (None, 0, "unresolved")}
    calls = spark.createDataFrame([("a", "b", "inferred"), ("b", "c", "extracted"), ("c", "a", "inferred"), ("a", "d", "ambiguous")], "source string, target string, status string")
    seed = spark.createDataFrame([("a",)], "node string")
    assert sorted(map(tuple, code_graph.traverse(calls, seed, 8).collect())) == [("b", 1), ("c", 2)]
    assert code_graph.traverse(calls, seed, 8, include_uncertain=False).isEmpty()


def test_references_in_files(spark):
    files = [(r, f"{r}/{p}", p) for r, p in (("r", "pkg/a.py"), ("r", "pkg/b.py"), ("r", "lib/src/c.py"), ("q", "pkg/a.py"))]
    declared = [
        ("r/pkg/a.py", "module", "pkg.a"), ("r/pkg/a.py", "function", "pkg.a.run"), ("r/pkg/a.py", "class", "pkg.a.Box"), ("r/pkg/a.py", "method", "pkg.a.Box.put"), ("r/pkg/b.py", "module", "pkg.b"),
        ("r/pkg/b.py", "function", "pkg.b.run"), ("r/pkg/b.py", "function", "pkg.b.Box"), ("r/lib/src/c.py", "module", "c"), ("r/lib/src/c.py", "function", "c.only"), ("q/pkg/a.py", "function", "pkg.a.only"),
        ("q/pkg/a.py", "module", "pkg.a"),
    ]
    wanted = {
        ("r/pkg/a.py", "pkg.a", "CALLS", "run"): ("same_file", "r pkg.a.run"), ("r/pkg/b.py", "pkg.b", "CALLS", "run"): ("same_file", "r pkg.b.run"), ("r/lib/src/c.py", "c.only", "CALLS", "run"): ("imported", "r pkg.b.run"),
        ("r/lib/src/c.py", "c", "IMPORTS", "pkg.b"): ("qualified", "r pkg.b"), ("r/lib/src/c.py", "c", "EXTENDS", "Box"): ("name", "r pkg.a.Box"), ("r/pkg/a.py", "pkg.a.run", "CALLS", "Box.put"): ("module", "r pkg.a.Box.put"),
        ("r/pkg/b.py", "pkg.b", "CALLS", ".a.run"): ("relative", "r pkg.a.run"), ("r/pkg/b.py", "pkg.b", "IMPORTS", ".a"): ("qualified", "r pkg.a"), ("r/pkg/b.py", "pkg.b", "IMPORTS", "a"): ("qualified", "r pkg.a"),
        ("r/pkg/b.py", "pkg.b", "IMPORTS", "package:x/src/c.dart"): ("path", "r c"), ("r/pkg/b.py", "pkg.b", "IMPORTS", "package:x/src/c.py"): ("path", "r c"), ("r/pkg/b.py", "pkg.b", "IMPORTS", "pkg.a.run"): (None, None),
        ("q/pkg/a.py", "pkg.a", "CALLS", "only"): ("same_file", "q pkg.a.only"), ("q/pkg/a.py", "pkg.a", "CALLS", "put"): (None, None), ("r/pkg/a.py", "pkg.a", "CALLS", "a.Box"): ("suffix", "r pkg.a.Box"),
        ("r/pkg/a.py", "pkg.a", "CALLS", "only"): ("name", "r c.only"), ("r/pkg/a.py", "pkg.a", "READS", "run"): (None, None), ("r/pkg/a.py", "pkg.a", "CALLS", " 'run' "): ("same_file", "r pkg.a.run"),
    }
    symbols = spark.createDataFrame([(f, f"{f[0]} {q}", k, q.rsplit(".", 1)[-1], q) for f, k, q in declared], "file_id string, symbol_id string, kind string, name string, qualified_name string")
    references = spark.createDataFrame([*wanted, ("r/lib/src/c.py", "c", "CALLS", "dynamic:x.run"), ("r/lib/src/c.py", "c", "DEFINES", "put")], "file_id string, source string, relation string, reference string")
    found = code_graph.resolve(references, symbols, spark.createDataFrame(files, "repository_id string, file_id string, path string")).collect()
    rows = {(r["file_id"], r["source"], r["relation"], r["reference"]): r for r in found}
    assert {k: (rows[k]["by"], rows[k]["symbol_id"]) for k in wanted} == wanted and len(found) == len(wanted) + 2
    assert all(rows[k]["status"] == ("inferred" if by else "unresolved") for k, (by, _) in wanted.items())
    assert rows[("r/lib/src/c.py", "c", "CALLS", "dynamic:x.run")]["status"] == "ambiguous" and rows[("r/lib/src/c.py", "c", "DEFINES", "put")]["status"] == "inferred"


def test_budget_skips_what_does_not_fit(spark):
    rows = spark.createDataFrame([(1, 5), (2, 9), (3, 4), (4, 1), (5, 1)], "rk long, cost long")
    assert [(r["rk"], r["admitted"], r["used"]) for r in packing.admit(rows, [F.col("rk")], F.col("cost"), 10).orderBy("rk").collect()] == [(1, True, 5), (2, False, 5), (3, True, 9), (4, True, 10), (5, False, 10)]


def test_symbols_of_one_row_are_counted_without_a_table_of_all_keys(spark):
    rows = [(k, f"a{k % 3}.b{k % 5}.c{k % 7}") for k in range(1050)] + [(1, "a1.b1.c1"), (2, "z.b2.c2"), (3, "z.b3.c3.c3")]
    symbols = spark.createDataFrame(rows, "symbol_id int, qualified_name string")
    asked = ["c1", "b2.c2", "z.b2.c2", "c3", "c3.c3", "a1.b1.c1"]
    found = code_graph.resolve(spark.createDataFrame([(a,) for a in asked], "reference string"), symbols)
    ids = lambda a: {k for k, n in rows if n == a} or {k for k, n in rows if n.split(".")[-1] == a} or {k for k, n in rows if n.endswith(f".{a}")}
    assert {r["reference"]: r["candidates"] for r in found.collect()} == {a: len(ids(a)) for a in asked}
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    distinct = [k for k, line in enumerate(plan) if "Aggregate [" in line and "symbol_id" in line.split("], [")[0]]
    assert len(distinct) == 1 and any("Filter" in line and "> 1)" in line for line in plan[distinct[0] :])


def test_only_the_budget_bounds_a_project_context(spark):
    rows = spark.createDataFrame([("code" if k < 30 else "vault", f"e{k:03}", "t", k) for k in range(70)], "section string, evidence_id string, title string, rk long")
    assert project.context(rows, 10_000).where("admitted").count() == 70


def test_components_of_whole_forests_and_in_rounds(spark):
    rnd = random.Random(3)
    links = [(rnd.randrange(900), rnd.randrange(900)) for _ in range(600)] + [(k, k + 1) for k in range(2000, 2100)] + [(5000, 5000)]
    root = list(range(6000))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    wanted = {(x, find(x)) for x in range(6000) if find(x) != x}
    df = spark.createDataFrame(links, "a long, b long")
    for kept in (100, 10_000):
        found = components(df.repartition(5), Staging(spark, "test"), f"c{kept}", kept).collect()
        assert len(found) == len(wanted) and {tuple(r) for r in found} == wanted
    odd = spark.createDataFrame([(None, 1), (2, None), (3, 3), (-5, 4), (4, -5)], "a long, b long")
    assert [tuple(r) for r in components(odd, Staging(spark, "test"), "odd").collect()] == [(4, -5)]
    assert components(odd.where("false"), Staging(spark, "test"), "none").isEmpty()
    # a hub and a long path, over more partitions than either has ends in
    far = spark.range(0, 4000, 1, 7).selectExpr("id + 1 AS a", "id AS b").union(spark.range(10_000, 14_000).selectExpr("id AS a", "9999 AS b"))
    assert {(r["b"], r["count"]) for r in components(far, Staging(spark, "test"), "far", 1500).groupBy("b").count().collect()} == {(0, 4000), (9999, 4000)}


def test_staged_tables_can_be_dropped(spark):
    staged = Staging(spark, "test")
    staged.write(spark.range(3), "one")
    folder = Path(staged.root)
    assert (folder / "one").exists()
    Staging.drop_all(spark)
    assert not folder.exists()


def test_staging_needs_a_shared_folder():
    class Session:
        """What shared_folder asks of a session on a cluster without a folder."""

        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)  # noqa: N815

    with pytest.raises(ValueError, match="checkpoint"):
        shared_folder(Session)
    Session.sparkContext.getCheckpointDir = staticmethod(lambda: "hdfs://x/c/")
    assert shared_folder(Session) == "hdfs://x/c"


def test_stored_index_is_as_a_search_of_the_corpus(spark, tmp_path):
    corpus = spark.createDataFrame([*ROWS, (6, "raw/f.md", "foo", "bar foo", None, "bar foo bar graph"), (7, "x.md", "", "", "", "")], "rowid int, path string, section string, title string, frontmatter string, text string")
    index = keyword.Index.write(corpus, ["rowid"], keyword.FIELDS, str(tmp_path / "index"))
    for query in ("graph search", "foo_bar", "graph graph", "wiki", "nothing_here bar", "absent"):
        wanted = keyword.search(corpus, query, ["rowid"], 10, fields=keyword.FIELDS).select("rowid", "score", "fields", "rk").collect()
        found = index.search(query, 10).collect()
        assert [(r["rowid"], r["score"], r["rk"], sorted(r["fields"])) for r in found] == [(r["rowid"], r["score"], r["rk"], sorted(r["fields"])) for r in wanted], query
    only = index.search("graph", 10, allowed=corpus.where("rowid > 3")).collect()
    assert [r["rowid"] for r in only] == [6, 4] or [r["rowid"] for r in only] == [4, 6]


def test_a_stored_index_shuffles_no_single_postings(spark, tmp_path):
    keyword.Index.write(spark.createDataFrame([(k, "a b a c") for k in range(200)], "id int, text string"), ["id"], ["text"], str(tmp_path / "index"))
    stored = spark.read.parquet(f"{tmp_path}/index/blocks")
    assert stored.agg(F.sum("n"), F.sum("total")).first() == (600, 800) and stored.count() < 400


def test_a_search_splits_each_field_once(spark):
    corpus = spark.createDataFrame(ROWS, "rowid int, path string, section string, title string, frontmatter string, text string")
    plan = keyword.counted(corpus, ["text"], keyword.query_phrases("graph foo_bar search")).where("f0 > 0 OR f1 > 0 OR f2 > 0")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1


def test_projection(spark):
    """Three linked seeds, a hub of many edges, an order by seven keys; seeds are no targets but may be passed."""
    edge = lambda id_, s, t, type_="mentions", status="stated", confidence=0.9, tv="a": (id_, "a", s, tv, t, type_, status, confidence)
    rows = [edge("s1", "x", "y", "related_to"), edge("s2", "y", "z", "related_to"), edge("c1", "y", "end", "blocks"), edge("c2", "x", "end", "odd", "contested"), edge("c3", "x", "far", tv="b"), edge("loop", "x", "x")]
    rows += [edge(f"h{k:04d}", "z", f"n{k}") for k in range(700)] + [edge("next", "n5", "deep", "supersedes", confidence=0.95), edge("lost", "n5", "nowhere")]
    ids = sorted({(r[1], r[2]) for r in rows} | {(r[3], r[4]) for r in rows if r[4] != "nowhere"})
    edges = spark.createDataFrame(rows, "edge_id string, source_vault string, source string, target_vault string, target string, type string, status string, confidence double").repartition(4)
    nodes = spark.createDataFrame([(v, i, i) for v, i in ids], "vault_id string, entity_id string, normalized_name string")
    seeds = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "z")], "vault_id string, entity_id string")

    def plain(depth, limit, edge_limit, statuses):
        use = sorted((r for r in rows if r[6] in statuses and r[1] == r[3] and (r[1], r[2]) in ids and (r[3], r[4]) in ids), key=lambda r: (r[1], r[3], r[5], r[0], r[4]))
        near, reach = set("xyz"), set("xyz")
        for _ in range(depth):
            kept = {r for r in use if r[2] in reach or r[4] in reach}
            reach = reach | {r[k] for r in kept for k in (2, 4)}
        use = [r for r in use if r in kept][:edge_limit]
        out = []

        def walk(path, nodes_):
            for r in use if len(path) < depth else ():
                for a, b in ((r[2], r[4]), (r[4], r[2])):
                    if a == nodes_[-1] and b not in nodes_:
                        walk([*path, r], [*nodes_, b])
            if path and nodes_[-1] not in near:
                weight = {"stated": 1.0, "contested": 0.45}
                score = min(r[7] * weight[r[6]] for r in path) * (1.0 if len(path) == 1 else 0.6)
                rank = graph.TYPE_PRIORITY.index(path[0][5]) if path[0][5] in graph.TYPE_PRIORITY else 6
                out.append(((-score, len(path), rank, path[0][5], "a", nodes_[-1], path[0][0], [r[0] for r in path], nodes_[0]), (nodes_[0], nodes_[-1], [r[0] for r in path])))

        for seed in "xyz":
            walk([], [seed])
        return [p for _, p in sorted(out)][:limit], len(use)

    for depth, limit, edge_limit, statuses in ((1, 20, 500, ("stated",)), (2, 40, 500, ("stated", "contested")), (2, 5000, 5000, ("stated",)), (2, 10, 3, ("stated",))):
        found, counts = graph.projection(edges, nodes, seeds, depth, limit, edge_limit=edge_limit, statuses=statuses)
        wanted, used = plain(depth, limit, edge_limit, statuses)
        assert [(r["seed"], r["target"], r["edge_ids"]) for r in found.orderBy("rk").collect()] == wanted
        assert counts.first()["edge_count"] == used
    assert counts.first()["truncated"]
    with pytest.raises(ValueError):
        graph.projection(edges, nodes, seeds, 3, 5)
