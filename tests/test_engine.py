from __future__ import annotations

import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seshat.engine import Engine
from seshat.operators import block_index, embedding, inverted_file, keyword, listing, readiness, render, vector
from seshat.sources import segments
from seshat.sources.catalog import Catalog, Vault

from .test_sources import vault


def test_index_then_ask(spark, tmp_path):
    root = vault(tmp_path / "v")
    engine = Engine(spark, str(tmp_path / "store"), Catalog((Vault("a", root),)))
    assert engine.index(dry_run=True) == {"insert": 5} and engine.store.active() is None
    assert engine.index() == {"insert": 5}
    (tmp_path / "v/raw/x.md").write_text("Raw text, changed.")
    (tmp_path / "v/docs/guide.md").unlink()
    assert engine.index() == {"unchanged": 3, "update": 1, "delete": 1}
    (tmp_path / "v/wiki/new.md").write_text("Something new.")
    engine.watch("a", str(tmp_path / "checkpoint")).awaitTermination(60)
    assert engine.store.read("documents").where("path = 'wiki/new.md'").count() == 1
    (tmp_path / "v/wiki/new.md").unlink()
    assert engine.index() == {"unchanged": 4, "delete": 1}
    found = engine.search("open again", 5).collect()
    assert found[0]["rk"] == 1 and {"wiki/issues/open.md", "wiki/decisions/x.md"} == {r["path"] for r in found}
    assert len({r["family_seed"] for r in found}) == len(found)
    assert {r["path"] for r in engine.search("changed", 5, mode="evidence").collect()} == {"raw/x.md", "wiki/sources/x.md"}
    assert engine.search("open", 5, scopes=("wiki/issues",)).select("path").distinct().collect() == [("wiki/issues/open.md",)]
    assert {"wiki/issues/open.md", "wiki/sources/x.md", "storage"} <= {r["target"] for r in engine.related("wiki/decisions/x.md").collect()}
    packed = engine.context_pack("open again text", max_tokens=12).collect()
    assert packed and sum(r["token_count"] for r in packed) <= 12
    assert engine.ask("open").count() > 0
    assert [r["path"] for r in engine.decisions().collect()] == ["wiki/decisions/x.md"] and [r["path"] for r in engine.open_questions().collect()] == ["wiki/issues/open.md"]
    ids = engine.explain(engine.search("open", 2))
    assert engine.explanation(ids[0])["kinds"]
    assert json.loads(render.to_json(engine.audit()))[0]["amplification"] >= 1
    assert engine.outline("a", "wiki/decisions/x.md").count() == 3


def test_embeddings_and_approximate_search(spark, tmp_path):
    rnd = np.random.default_rng(5)
    centers = rnd.standard_normal((20, 16))
    rows = [(k, (centers[k % 20] + 0.1 * rnd.standard_normal(16)).tolist()) for k in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    exact = {r["vec_id"] for r in vector.search(df, rows[0][1], ["vec_id"], 20).collect()}
    index = inverted_file.InvertedFile.write(df, "vec_id", str(tmp_path / "index"))
    assert index.fitted.probes < len(index.fitted.centroids) / 4  # clusters are told apart
    near = index.search(rows[0][1], 20).collect()
    assert len(exact & {r["vec_id"] for r in near}) >= 18 and [r["rk"] for r in near] == list(range(1, 21))
    assert {r["vec_id"] % 2 for r in index.search(rows[0][1], 5, allowed=df.where("vec_id % 2 = 1")).collect()} == {1}
    asked = df.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query")
    wanted = inverted_file.exact(df, asked, "vec_id", 10)
    one = [r["vec_id"] for r in wanted.where("query = 0").orderBy("rk").collect()]
    assert one == [r["vec_id"] for r in vector.search(df.where("vec_id <> 0"), rows[0][1], ["vec_id"], 10).orderBy("rk").collect()]
    assert inverted_file.recall(index.search_all(asked, 10), wanted, "vec_id").first()["recall"] >= 0.9
    own = embedding.embed(spark.createDataFrame([(1, "a"), (2, None), (3, "a")], "id int, text string"), ["id"]).collect()
    assert own[0]["embedding"] == own[2]["embedding"] != own[1]["embedding"] and len(own[0]["embedding"]) == 384


def test_listings(spark):
    docs = spark.createDataFrame([("a", "wiki/x.md"), ("a", "raw/y.md"), ("b", "wiki/x.md")], "vault_id string, path string")
    chunks = spark.createDataFrame([("a", "wiki/x.md", 0, "h1", "t"), ("a", "wiki/x.md", 1, "h1", "t"), ("a", "wiki/x.md", 2, "h2", "u")], "vault_id string, path string, ordinal int, content_hash string, text string")
    assert [r["path"] for r in listing.documents(docs, ["a"], ["wiki", "raw"]).collect()] == ["raw/y.md", "wiki/x.md"]
    assert listing.blobs(chunks).count() == 2 and listing.with_text(chunks.drop("text"), listing.blobs(chunks), docs).count() == 3
    assert {(r["vault_id"], r["path"]): r["n_chunks"] for r in listing.states(docs, chunks).collect()} == {("a", "wiki/x.md"): 3, ("a", "raw/y.md"): 0, ("b", "wiki/x.md"): 0}
    assert [r["ordinal"] for r in listing.excerpts(chunks, F.col("ordinal") == 2, 2).orderBy("rk").collect()] == [2, 0]


def test_readiness(spark):
    old = spark.createDataFrame([("s", 1, "a"), ("s", 2, "b"), ("t", 1, "c")], "scope string, k int, h string")
    new = spark.createDataFrame([("s", 1, "x"), ("t", 1, "c")], "scope string, k int, h string")
    states = readiness.staleness(old, new, ["scope", "k"], ["h"], "scope")
    assert {r["scope"]: (r["upserts"], r["tombstones"], r["state"]) for r in states.collect()} == {"s": (1, 1, "stale"), "t": (0, 0, "fresh")}
    assert readiness.worst(states).first()[0] == "stale"
    log = spark.createDataFrame([("s", "v", 1, "r1", "failed", "x"), ("s", "v", 2, "r2", "ok", None)], "scope string, spec string, at int, run_id string, status string, message string")
    assert readiness.runs(log).first()["status"] == "ok"
    kinds = spark.createDataFrame([("store", "fresh"), ("store", "stale"), ("graph", "fresh")], "kind string, state string")
    assert {r["kind"]: r["ready"] for r in readiness.health(kinds).collect()} == {"store": False, "graph": True}
    bound = spark.createDataFrame([("r", "a.py", "wiki/a.md"), ("r", "b.py", "wiki/a.md")], "repository_id string, code_path string, vault_path string")
    code, wiki = spark.createDataFrame([("r", "a.py")], "repository_id string, path string"), spark.createDataFrame([("wiki/a.md",)], "path string")
    assert {r["code_path"]: r["status"] for r in readiness.relations(bound, code, wiki).collect()} == {"a.py": "explicit", "b.py": "unresolved"}
    with pytest.raises(ValueError):
        render.rows(spark.range(2000))


def test_a_run_writes_what_has_changed(spark, tmp_path):
    """One of many documents changes: under a hundredth of the bytes; a failing model leaves keyword search published."""
    root = tmp_path / "v"
    (root / "wiki").mkdir(parents=True)
    words, rnd = [f"w{k}" for k in range(400)], random.Random(2)
    for k in range(300):
        own = " ".join(rnd.randbytes(5).hex() for _ in range(1000))
        (root / f"wiki/d{k}.md").write_text(f"# Title {k}\n\n" + " ".join(words[(k * 7 + i * i) % 400] for i in range(300)) + f" {own} [[d{(k + 1) % 300}]]")
    fails = {"on": False}

    def model(texts):
        if fails["on"]:
            raise RuntimeError("no model")
        return embedding.hash_embedding(texts, 64)

    engine = Engine(spark, str(tmp_path / "store"), Catalog((Vault("a", str(root)),)), model)
    assert engine.index() == {"insert": 300}
    base = sum(engine.store.written_bytes(engine.store.segments(n)) for n in engine.store.stores())
    (root / "wiki/d7.md").write_text("# Title 7\n\nentirely fresh words [[d8]]")
    fails["on"] = True
    assert engine.index() == {"unchanged": 299, "update": 1}
    assert [w.split(":")[0] for w in engine.warnings()] == ["vectors stale"] and "no model" in engine.warnings()[0]
    assert [r["path"] for r in engine._keyword().search("entirely fresh", 5).join(engine.store.read("chunks"), ["vault_id", "chunk_id"]).collect()] == ["wiki/d7.md"]
    fails["on"] = False
    assert engine.index() == {"unchanged": 300} and not engine.warnings()
    assert engine.store.read("vectors").count() == engine.store.read("chunks").count()
    later = sum(engine.store.written_bytes(engine.store.segments(n)[1:]) for n in engine.store.stores())
    assert all(len(engine.store.segments(n)) <= 2 for n in engine.store.stores()) and later < 0.01 * base
    rows = {n: sum(s["manifest"]["rows"]["rows"] for s in engine.store.segments(n)[1:]) for n in engine.store.stores()}
    assert rows["documents"] == rows["chunks"] == rows["vectors"] == 1 and rows["entities"] < 10
    rebuilt = Engine(spark, str(tmp_path / "again"), Catalog((Vault("a", str(root)),)), model)
    rebuilt.index()
    for name in ("documents", "chunks", "vectors", "edges", "families", "entities"):
        a, b = (e.store.read(name) for e in (engine, rebuilt))
        assert len(set(segments.digests({"a": a, "b": b.select(*a.columns)}).values())) == 1, name
    same = lambda e: [tuple(r) for r in e._keyword().search("w3 w5 entirely", 20).collect()]
    assert same(engine) == same(rebuilt)


def test_segments(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "o int, v string")
    owners = lambda df: df.select("o", F.sha2("v", 256).alias("hash")).distinct()
    store = segments.SegmentStore(spark, str(tmp_path / "s"), ["o"])
    first = store.write("t", make([(k, f"a{k}") for k in range(100)] + [(None, "n")]), owners(make([(k, f"a{k}") for k in range(100)])))
    store.publish("one", {"t": [first]})
    parts = [first]
    for k in range(10):  # owner k changes twice, and goes in the end
        parts.append(store.write("t", make([(k, f"b{k}"), (k, f"c{k}")]), owners(make([(k, f"b{k}")])), make([(k, "")])))
    parts.append(store.write("t", make([]), owners(make([])), make([(3, ""), (None, "")])))
    wanted = {(k, f"a{k}") for k in range(10, 100)} | {(k, f"{c}{k}") for k in range(10) if k != 3 for c in "bc"}
    assert {tuple(r) for r in store.merged("t", parts).collect()} == wanted
    assert store.is_due(parts) and not store.is_due(parts[:2])
    folded = store.folded("t", parts)
    assert len(folded) == 1 and {tuple(r) for r in store.merged("t", folded).collect()} == wanted
    few = store.folded("t", parts[:4])
    assert len(few) == 2 and {tuple(r) for r in store.merged("t", few).collect()} == {tuple(r) for r in store.merged("t", parts[:4]).collect()}
    store.publish("two", {"t": folded})
    assert store.read("t").count() == len(wanted) and store.owners("t").count() == 99
    with pytest.raises(ValueError, match="other sources"):
        store.publish("three", {}, sources={"t": "two"})
    store.rollback()
    assert store.active()["source"] == "one" and store.read("t").count() == 101
    make([(1, "other")]).write.mode("append").parquet(f"{store.root}/{first['path']}/rows")
    with pytest.raises(segments.TamperedError):
        store.verify("t")
    with pytest.raises(segments.TamperedError):
        segments.SegmentStore(spark, str(tmp_path / "s"), ["o"]).read("t")


def test_block_index(spark, tmp_path):
    rows = [(k, f"v{k % 3}", " ".join(["the"] * (k % 7) + ["red"] * (k % 11 == 0) + ["blue_green"] * (k % 13 == 0) + [f"x{k}"] * (k % 5)), "red note" if k % 40 == 0 else None) for k in range(400)]
    make = lambda r: spark.createDataFrame(r, "id int, o string, text string, title string")
    roots = [str(tmp_path / n) for n in "abcd"]
    block_index.write(make(rows), ["id"], ["text", "title"], roots[0], owner=["o"], range_rows=16)
    queries = ("red", "the red", "blue_green the", "blue red red", "x17", "none", "green")
    check = lambda index, now, k: [(q, [(r["id"], r["score"], sorted(r["fields"]), r["rk"]) for r in index.search(q, k).collect()], [(r["id"], r["score"], sorted(r["fields"]), r["rk"]) for r in keyword.search(make(now), q, ["id"], k, fields=["text", "title"]).collect()]) for q in queries]
    index = block_index.BlockIndex(spark, [block_index.Part(roots[0])], ["id"], ["text", "title"], ["o"])
    for q, found, wanted in check(index, rows, 5):
        assert found == wanted, q
    allowed = make(rows).where("id % 2 = 1").select("id")
    assert [r["id"] for r in index.search("red", 4, allowed=allowed).collect()] == [r["id"] for r in keyword.search(make(rows), "red", ["id"], 4, fields=["text", "title"], where=F.col("id") % 2 == 1).collect()]
    read = {r["token"]: (r["blocks"], r["read"]) for r in index.reading("x17 the", 1).collect()}
    assert read["the"][1] < read["the"][0] / 2
    # a later part replaces an owner's rows, the next one drops another's; then the two later ones are folded
    fresh = [(1000 + k, "v1", f"red the x{k}", None) for k in range(30)]
    gone = lambda o: make([(0, o, "", "")]).select("o")
    block_index.write(make(fresh), ["id"], ["text", "title"], roots[1], owner=["o"], removed=make([r for r in rows if r[1] == "v1"]))
    block_index.write(make([]), ["id"], ["text", "title"], roots[2], owner=["o"], removed=make([r for r in rows if r[1] == "v2"]))
    now = [r for r in rows if r[1] == "v0"] + fresh
    block_index.write(make(fresh), ["id"], ["text", "title"], roots[3], owner=["o"], folds=roots[1:3])
    later = [block_index.Part(roots[1], gone("v1")), block_index.Part(roots[2], gone("v2"))]
    for parts in (later, [block_index.Part(roots[3], gone("v1").union(gone("v2")))]):
        index = block_index.BlockIndex(spark, [block_index.Part(roots[0]), *parts], ["id"], ["text", "title"], ["o"])
        assert (index.n, index.total) == (len(now), sum(len(f"{r[2]} {r[3] or ''}".replace("_", " ").split()) for r in now))
        for q, found, wanted in check(index, now, 6):
            assert found == wanted, q


def test_a_token_that_cannot_lift_a_row_is_read_last(spark, tmp_path):
    # every range has both rare tokens, so that all reach by their bounds, but only row 1 has them together
    rows = [(k, "the ra ra rb" if k == 1 else "the the the ra" if k % 4 == 0 else "the the the rb" if k % 4 == 1 else "the y y y") for k in range(640)]
    corpus = spark.createDataFrame(rows, "id int, text string").coalesce(1)
    block_index.write(corpus, ["id"], ["text"], str(tmp_path / "i"), range_rows=4)
    index = block_index.BlockIndex(spark, [block_index.Part(str(tmp_path / "i"))], ["id"], ["text"])
    columns = lambda df: [(r["id"], r["score"], r["fields"], r["rk"]) for r in df.collect()]
    for query, k in (("ra rb the", 1), ("ra rb the", 3), ("the the", 4), ("rb the", 700)):
        assert columns(index.search(query, k)) == columns(keyword.search(corpus, query, ["id"], k)), query
    read = {r["token"]: (r["blocks"], r["read"]) for r in index.reading("ra rb the", 1).collect()}
    assert read["the"][0] == 160 and read["the"][1] < 40


def test_rare_tokens_of_many_ranges_share_a_stored_block(spark, tmp_path):
    rows = [(k, f"v{k % 4}", " ".join(["the"] * (1 + k % 3) + [f"odd{k % 50}"] * (1 + k % 2) + [f"mid{k % 3}", f"own{k}", "near by"])) for k in range(600)]
    make = lambda r: spark.createDataFrame(r, "id int, o string, text string").coalesce(1)
    roots = [str(tmp_path / n) for n in "ab"]
    block_index.write(make(rows), ["id"], ["text"], roots[0], owner=["o"], range_rows=4)
    stored = spark.read.parquet(f"{roots[0]}/blocks")
    kept = {r["token"]: (r["rows"], r["ranges"]) for r in stored.groupBy("token").agg(F.count("*").alias("rows"), F.sum(F.size("ranges")).alias("ranges")).collect()}
    assert kept["odd7"] == (1, 12) and kept["own9"] == (1, 1) and kept["the"][1] == 150 and kept["the"][0] <= 600 / block_index.FULL + 1
    removed = [r for r in rows if r[1] == "v1"]
    fresh = [(1000 + k, "v1", f"odd7 the own{k}") for k in range(20)]
    block_index.write(make(fresh), ["id"], ["text"], roots[1], owner=["o"], removed=make(removed))
    minus = {r["token"]: (r["n"], r["total"]) for r in spark.read.parquet(f"{roots[1]}/minus").collect()}
    assert minus["the"] == (150, 0) and minus["own1"] == (1, 0) and minus[None] == (150, sum(len(r[2].split()) for r in removed))
    gone = make(fresh[:1]).select("o")
    columns = lambda df: [(r["id"], r["score"], r["fields"], r["rk"]) for r in df.collect()]
    for parts, now in (([], rows), ([block_index.Part(roots[1], gone)], [r for r in rows if r[1] != "v1"] + fresh)):
        index = block_index.BlockIndex(spark, [block_index.Part(roots[0]), *parts], ["id"], ["text"], ["o"])
        for query, k in (("odd7", 5), ("odd7 own9 the", 3), ("odd7 odd8 mid1", 40), ("near_by odd3", 7), ("the mid2", 700), ("own1", 2)):
            assert columns(index.search(query, k)) == columns(keyword.search(make(now), query, ["id"], k)), query
    found = [(r["token"], r["blocks"]) for r in block_index.BlockIndex(spark, [block_index.Part(roots[0])], ["id"], ["text"]).reading("odd7 the", 2).orderBy("token").collect()]
    assert found == [("odd7", 12), ("the", 150)]


def test_packed_ranges_hold_what_was_put_in():
    rng, words = np.random.default_rng(5), [f"w{k}" for k in range(500)]
    lists = [[words[w] for w in rng.integers(0, 500, rng.integers(0, 90))] for _ in range(64)]
    whole = block_index.Postings.of([pa.array(range(64)), pa.array([f"r{k}" for k in range(64)])], [pa.array(lists, pa.list_(pa.string()))])
    bucket = np.array([sum(map(ord, t)) % 7 for t in whole.tokens.to_pylist()])
    packed = whole.pack(bucket, 3)
    assert packed.column("bucket").to_pylist() == sorted(set(bucket.tolist()))
    found = {}
    for row in zip(*packed.columns, strict=True):
        own, number = block_index.Postings.unpack([dict(zip(packed.schema.names, row, strict=True))])
        assert set(number) == {3} and own.tokens.to_pylist() == sorted(own.tokens.to_pylist())
        entry = place = 0
        for token, n in zip(own.tokens.to_pylist(), own.n, strict=True):
            for who, count in zip(own.who[entry : entry + n], own.count[entry : entry + n], strict=True):
                found[own.kept[0][who].as_py(), token] = (own.kept[1][who].as_py(), own.length[who], own.place[place : place + count].tolist())
                place += count
            entry += n
    wanted = {(k, t): (f"r{k}", len(words_), [i * block_index.MOST_FIELDS for i, w in enumerate(words_) if w == t]) for k, words_ in enumerate(lists) for t in words_}
    assert found == wanted
