from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seshat.operators import entities, families, reconcile
from seshat.sources import code, dart, markdown
from seshat.sources.catalog import Binding, Catalog, Projects, Repository, Vault
from seshat.sources.generations import Generations
from seshat.streaming.watch import watch

DECISION = """---
title: Use Parquet
type: decision
tags: [storage]
depends_on: wiki/sources/x.md
derived_from: "[[sources/x]]"
when: 2024-05-01
---
Before all.

# Why
See [[open]] and [raw](../../raw/x.md) and [[gone|Gone Page]], not ![[picture.png]] or [site](https://a.test/).

## Empty

# Why
Again.
"""


def vault(tmp_path):
    files = {
        "wiki/decisions/x.md": DECISION,
        "wiki/sources/x.md": "---\ncanonical_source: raw/x.md\n---\nSource.\n",
        "raw/x.md": "Raw text, no heading.",
        "docs/guide.md": "---\nnot closed\n# Guide\nText",
        "wiki/issues/open.md": "---\nstatus: open\n---\n# 결정\nOpen.",
        "wiki/empty.md": "",
        "wiki/skip.txt": "no",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    return str(tmp_path)


def test_vault_to_chunks_and_entities(spark, tmp_path):
    docs = markdown.documents(markdown.read_vault(spark, vault(tmp_path), "a")).cache()
    by = {r["path"]: r for r in docs.collect()}
    assert set(by) == {"wiki/decisions/x.md", "wiki/sources/x.md", "raw/x.md", "docs/guide.md", "wiki/issues/open.md"}  # Spark lists no empty files
    assert by["wiki/decisions/x.md"]["targets"] == ["wiki/sources/x.md"]
    assert '"when": "2024-05-01"' in by["wiki/decisions/x.md"]["frontmatter"]
    assert by["docs/guide.md"]["frontmatter"] == "{}" and by["docs/guide.md"]["source_role"] == "operating_contract"
    chunks = markdown.chunks(docs).cache()
    own = sorted((r["ordinal"], r["section"], r["anchor"], r["text"]) for r in chunks.where("path = 'wiki/decisions/x.md'").collect())
    assert [o[:3] for o in own] == [(0, None, None), (1, "Why", "why"), (2, "Why", "why")] and own[0][3] == "Before all." and own[2][3] == "Again."
    assert chunks.count() == chunks.select("chunk_id").distinct().count()
    assert chunks.where("path = 'wiki/issues/open.md'").first()["anchor"] == "결정"
    found = entities.occurrences(chunks, docs)
    edges = {(r["source"], r["type"], r["target"]) for r in entities.relationships(found).collect()}
    assert {("wiki/decisions/x.md", "links_to", "open"), ("wiki/decisions/x.md", "depends_on", "x"), ("wiki/decisions/x.md", "mentions", "gone page"), ("wiki/decisions/x.md", "mentions", "storage"), ("wiki/decisions/x.md", "mentions", "why")} <= edges
    assert [r["name"] for r in entities.unresolved_links(found).collect()] == ["Gone Page"]
    links = docs.select("vault_id", "path", F.explode("targets").alias("target"))
    seeds = {r["path"]: r["family_seed"] for r in families.families(docs, links).collect()}
    assert seeds["wiki/decisions/x.md"] == seeds["wiki/sources/x.md"] == seeds["raw/x.md"] == "raw/x.md" and seeds["docs/guide.md"] == "docs/guide.md"


def test_python_source(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg/service.py").write_text("import os\nclass Base:\n    pass\nclass Service(Base):\n    @property\n    def name(self):\n        return helper()\n    def run(self):\n        self.stop()\ndef helper():\n    return os.getcwd()\ndef test_it():\n    helper()\n")
    (tmp_path / "pkg/broken.py").write_text("def (:\n")
    (tmp_path / "venv").mkdir()
    (tmp_path / "venv/x.py").write_text("x = 1\n")
    files = code.read_repository(spark, str(tmp_path), "r").cache()
    assert sorted(r[0] for r in files.select("path").collect()) == ["pkg/broken.py", "pkg/service.py"]
    kinds = {(r["qualified_name"], r["kind"]) for r in code.symbols(files).collect()}
    assert {("pkg.service", "module"), ("pkg.service.Service", "class"), ("pkg.service.Service.name", "property"), ("pkg.service.Service.run", "method"), ("pkg.service.test_it", "test"), ("pkg.service.helper", "function")} <= kinds
    found = {(r["source"], r["relation"], r["reference"]) for r in code.references(files).collect()}
    assert {("pkg.service.Service", "EXTENDS", "Base"), ("pkg.service.Service.name", "CALLS", "helper"), ("pkg.service.Service.run", "CALLS", "stop"), ("pkg.service.test_it", "TESTS", "helper"), ("pkg.service", "IMPORTS", "os")} <= found
    assert code.diagnostics(files).count() == 1
    assert [tuple(r) for r in code.lines(files, "pkg/service.py", 2, 3).collect()] == [(2, "class Base:"), (3, "    pass")]
    assert code.lines(files, "pkg/service.py", 2, 3, "other").isEmpty()


def test_imports_of_members_name_their_module():
    found = code.parse("pkg/a.py", "from pkg.b import run, stop\nfrom . import c\n")[1]
    assert [r[2] for r in found if r[1] == "IMPORTS"] == ["pkg.b", "pkg.b.run", "pkg.b.stop", ".", ".c"]


def test_catalog(tmp_path):
    catalog = Catalog((Vault("a", "/a", content_scopes=("wiki", "raw")), Vault("b", "/b", enabled=False)))
    catalog.save(str(tmp_path / "c.json"))
    again = Catalog.load(str(tmp_path / "c.json"))
    assert again.vaults == catalog.vaults
    assert again.resolve() == {"a": ("wiki", "raw")} and again.resolve(scopes=("wiki/x", "docs", "raw")) == {"a": ("wiki/x", "raw")}


def test_generations_and_reconcile(spark, tmp_path):
    store = Generations(spark, str(tmp_path / "store"))
    old = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k long, v string")
    new = spark.createDataFrame([(1, "a"), (2, None), (3, "d"), (None, "n")], "k long, v string")
    assert store.active() is None
    store.stage("g1", {"t": old})
    store.activate("g1", ["t"], "s1")
    planned = reconcile.plan(store.read("t"), new, ["k"], ["v"])
    assert {r["k"]: r["action"] for r in planned.collect()} == {1: "unchanged", 2: "unchanged", 3: "update", None: "insert"}
    store.stage("g2", {"t": reconcile.apply(store.read("t"), new.where("k IS NOT NULL"), planned, ["k"])})
    store.activate("g2", ["t"], "s2")
    assert sorted(store.read("t").collect(), key=repr) == sorted(new.where("k IS NOT NULL").collect(), key=repr)
    store.rollback()
    assert store.read("t").where("k = 3").first()["v"] == "c"


def test_watch(spark, tmp_path):
    root, seen = vault(tmp_path / "v"), []
    watch(spark, root, str(tmp_path / "ck"), lambda df, k: seen.append(df.count())).awaitTermination(60)
    (tmp_path / "v/wiki/new.md").write_text("new")
    watch(spark, root, str(tmp_path / "ck"), lambda df, k: seen.append(df.count())).awaitTermination(60)
    assert seen == [5, 1]


def test_projects(tmp_path):
    one = Projects().add(Repository("r", "/r")).bind(Binding("p", "r", ("a",), (("code:1", "vault:2"),)))
    one.save(str(tmp_path / "projects.json"))
    again = Projects.load(str(tmp_path / "projects.json"))
    assert again.resolve("p") == (Repository("r", "/r"), Binding("p", "r", ("a",), (("code:1", "vault:2"),)))
    for wrong in (lambda: again.remove("r"), lambda: again.remove("x"), lambda: again.add(Repository("r", "/s")), lambda: again.resolve("q"), lambda: Repository(" ", "/x"), lambda: again.bind(Binding("q", "x", ()))):
        with pytest.raises(ValueError):
            wrong()
    assert not again.bind(Binding("p", "r", ("b",))).resolve("p")[1].mappings


def test_globs_of_repositories(spark, tmp_path):
    for path in ("a.py", "pkg/b.py", "pkg/sub/c.py", "pkg/sub/x+1.py", "docs/d.md"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("x = 1\n")
    read = lambda *globs: {r["path"] for r in code.read_repository(spark, str(tmp_path), "r", *globs).collect()}
    assert read() == {"a.py", "pkg/b.py", "pkg/sub/c.py", "pkg/sub/x+1.py"} and read(["*.py"]) == {"a.py"} and read(["pkg/**"], ["**/c.*"]) == {"pkg/b.py", "pkg/sub/x+1.py"}
    assert read(["**/?.py"]) == {"a.py", "pkg/b.py", "pkg/sub/c.py"} and read(["pkg/sub/x+1.py"]) == {"pkg/sub/x+1.py"}


def test_revisions_of_repositories(spark):
    files = [("r", f"p{k}.py", f"h{k}") for k in range(20)]
    read = lambda rows: spark.createDataFrame(rows, "repository_id string, path string, content_hash string").repartition(3)
    one, again, other = (code.revision(read(rows)).first()["revision"] for rows in (files, files[::-1], [*files[:-1], ("r", "p19.py", "h0")]))
    assert one == again != other


DART = """library my.zoo;
import 'dart:io' show File;
export "other.dart";
class Cat<T extends Animal> extends Animal<T> with Purrs, Runs implements pkg.Pet, Comparable<Cat> {
  static const int legs = 4, tails = count(1, 2);
  final void Function(int) onMeow;
  Cat(this.onMeow) : super(make()) { wake(); }
  Cat._();
  factory Cat.wild({required int age}) => Cat(age);
  @override
  bool operator ==(Object o) => identical(this, o);
  Map<String, List<int>> get friends => cache.load<String>();
  set name(String v) { _name = v.trim(); }
  Future<R> play<R>(R Function() f) async* { void inner() { deep(); } yield f(); await for (final x in xs) { x?.go(); } }
}
extension on Cat { void hiss() => Sound.loud(); }
mixin class Helper on Object {}
abstract interface class Shape { double area(); }
enum Color { red, green }
typedef F = void Function();
var top = start();
int add(int a, int b) { if (a > b) { return add(b, a); } return 'n${a}'.length; }
void testAdd() { expect(add(1, 2), 3); }
"""


def test_dart():
    symbols, refs, messages = dart.parse("lib/zoo.dart", DART)
    assert {(k, q) for k, _, q, *_ in symbols} == {
        ("module", "my.zoo"), ("class", "my.zoo.Cat"), ("property", "my.zoo.Cat.legs"), ("property", "my.zoo.Cat.tails"), ("property", "my.zoo.Cat.onMeow"), ("method", "my.zoo.Cat.Cat"), ("method", "my.zoo.Cat._"), ("method", "my.zoo.Cat.wild"),
        ("method", "my.zoo.Cat.operator =="), ("property", "my.zoo.Cat.friends"), ("property", "my.zoo.Cat.name"), ("method", "my.zoo.Cat.play"), ("interface", "my.zoo.extension"), ("method", "my.zoo.extension.hiss"), ("class", "my.zoo.Helper"), ("class", "my.zoo.Shape"),
        ("method", "my.zoo.Shape.area"), ("function", "my.zoo.add"), ("test", "my.zoo.testAdd"),
    }
    found = {(s.removeprefix("my.zoo."), r, n) for s, r, n in refs if r not in ("DEFINES", "CONTAINS")}
    assert found == {
        ("my.zoo", "IMPORTS", "dart:io"), ("Cat", "EXTENDS", "Animal"), ("Cat", "IMPLEMENTS", "Purrs"), ("Cat", "IMPLEMENTS", "Runs"), ("Cat", "IMPLEMENTS", "pkg.Pet"), ("Cat", "IMPLEMENTS", "Comparable"), ("Cat.tails", "CALLS", "count"), ("Cat.Cat", "CALLS", "make"), ("Cat.Cat", "CALLS", "wake"),
        ("Cat.wild", "CALLS", "Cat"), ("Cat.operator ==", "CALLS", "identical"), ("Cat.name", "CALLS", "dynamic:v.trim"), ("Cat.play", "CALLS", "deep"), ("Cat.play", "CALLS", "f"), ("Cat.play", "CALLS", "dynamic:x.go"), ("extension", "IMPLEMENTS", "Cat"), ("extension.hiss", "CALLS", "Sound.loud"),
        ("Helper", "IMPLEMENTS", "Object"), ("my.zoo", "CALLS", "start"), ("add", "CALLS", "add"), ("testAdd", "CALLS", "expect"), ("testAdd", "TESTS", "expect"), ("testAdd", "CALLS", "add"), ("testAdd", "TESTS", "add"),
    } | ({("Cat.Cat", "CALLS", "super")} & found)
    assert messages == ["unsupported_construct:19:enum", "unsupported_construct:20:typedef", "unsupported_construct:21:variable"]
    assert next((line, end) for _, n, _, _, line, end in symbols if n == "play") == (14, 14) and symbols[1][3].startswith("class Cat<T extends Animal> extends Animal<T>")
    assert dart.parse("lib/a/b.dart", "")[0] == [("module", "b", "b", None, 1, 1)]
    assert dart.parse("x.dart", "class A { void f() { g(; }")[2] == ["syntax_error:1:unbalanced {"] or dart.parse("x.dart", "class A { void f() { g(; }")[2]
    assert {k for k, *_ in dart.parse("x_test.dart", "void f() {}", True)[0]} == {"module", "test"}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*DART.split(), "{", "}", "(", ")", "<", ">", ";", "@", ".", "=", "'", "/*", "operator", "get", "class", "on", "mixin", "é"]), max_size=60).map(" ".join))
def test_dart_of_any_text(text):
    symbols, refs, _ = dart.parse("a.dart", text)
    assert symbols[0][0] == "module" and all(s[4] <= max(s[5], s[4]) for s in symbols)


def test_revisions_from_refs_as_files(spark, tmp_path):
    (tmp_path / ".git/refs/heads").mkdir(parents=True)
    (tmp_path / "a.py").write_text("x = 1")
    root, files = str(tmp_path), lambda: code.read_repository(spark, str(tmp_path), "r")
    plain = code.source_revision(files(), root)
    assert code.head(spark, root) is None and plain.startswith("content-hash:")
    (tmp_path / ".git/HEAD").write_text("ref: refs/heads/main\n")
    assert code.head(spark, root) is None
    (tmp_path / ".git/packed-refs").write_text("# pack-refs with: peeled\n" + "1" * 40 + " refs/heads/other\n" + "2" * 40 + " refs/heads/main\n^" + "3" * 40 + "\n")
    assert code.head(spark, root) == "2" * 40
    (tmp_path / ".git/refs/heads/main").write_text("4" * 40 + "\n")
    assert code.source_revision(files(), root, "head") == "git:" + "4" * 40
    before = code.source_revision(files(), root)
    (tmp_path / "a.py").write_text("x = 2")
    assert before.startswith("git:" + "4" * 40 + "+wt:") and before != code.source_revision(files(), root) and code.source_revision(files(), root, "content-hash") != plain
    (tmp_path / ".git/HEAD").write_text("5" * 40)
    assert code.head(spark, root) == "5" * 40
    (tmp_path / "w").mkdir()
    (tmp_path / "w/.git").write_text("gitdir: ../.git\n")
    assert code.head(spark, str(tmp_path / "w")) == "5" * 40
    with pytest.raises(ValueError):
        code.source_revision(files(), root, "tags")
