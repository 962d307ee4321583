"""Source trees as files, symbols and references; Python is parsed with the standard library, Dart by a reader of its own."""

from __future__ import annotations

import ast
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import any_of
from ..functions.text import stable_id
from . import dart

# Folders that are no source, languages by suffix, and how long what is shown may be.
EXCLUDED = (".git", ".hg", ".svn", ".bzr", ".venv", "venv", "env", "node_modules", "vendor", "build", "dist", "out", "coverage", "generated", ".dart_tool", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache")
LANGUAGES = {"py": "python", "dart": "dart"}
SIGNATURE = 512
DIAGNOSTICS = 32

_SYMBOLS = "file_id string, symbol_id string, kind string, name string, qualified_name string, signature string, line int, end_line int"


def glob_pattern(glob: str) -> str:
    """A path glob as a regular expression: ``**/`` any folders, ``*`` and ``?`` within a name, all else itself."""
    out, k = "", 0
    while k < len(glob):
        if glob.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif glob.startswith("**", k):
            out, k = out + ".*", k + 2
        else:
            out, k = out + {"*": "[^/]*", "?": "[^/]"}.get(glob[k], "\\Q" + glob[k] + "\\E"), k + 1
    return f"^{out}$"


def read_repository(spark: SparkSession, root: str, repository_id: str, include: Sequence[str] = ("**",), exclude: Sequence[str] = ()) -> DataFrame:
    """(repository_id, file_id, path, language, is_test, content_hash, text) of the source files below ``root`` whose path
    fits a glob of ``include`` and none of ``exclude``."""
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    relative = F.substring_index(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), f"{base}/", -1)
    rows = files.select(F.lit(repository_id).alias("repository_id"), relative.alias("path"), F.decode("content", "UTF-8").alias("text"), F.sha2("content", 256).alias("content_hash"))
    suffix, parts = F.element_at(F.split("path", "\\."), -1), F.split("path", "/")
    name = F.element_at(parts, -1)
    test = F.arrays_overlap(parts, F.array(F.lit("test"), F.lit("tests"))) | name.rlike("^test_.*\\.py$|_test\\.(py|dart)$")
    fits = lambda globs: any_of([F.col("path").rlike(glob_pattern(g)) for g in globs])
    kept = rows.where(suffix.isin(*LANGUAGES) & ~F.arrays_overlap(parts, F.array(*map(F.lit, EXCLUDED))) & fits(include) & ~fits(exclude))
    language = F.element_at(F.create_map(*(F.lit(x) for p in LANGUAGES.items() for x in p)), suffix)
    return kept.select("repository_id", stable_id("code-file", F.col("repository_id"), F.col("path")).alias("file_id"), "path", language.alias("language"), test.alias("is_test"), "content_hash", "text")


def revision(files: DataFrame) -> DataFrame:
    """(repository_id, revision): the same for the same set of (path, content_hash), whatever their order; from their number
    and sums of two hashes of each, so that no list of files is collected."""
    sums = (F.sum(F.xxhash64(F.lit(k), "path", "content_hash").cast("decimal(38,0)")) for k in (1, 2))
    return files.groupBy("repository_id").agg(F.sha2(F.concat_ws(":", F.count("*"), *sums), 256).alias("revision"))


def _small(spark: SparkSession, path: str) -> list[str] | None:
    """The lines of a small file, None if there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not (fs.exists(p) and fs.getFileStatus(p).isFile()):
        return None
    stream = fs.open(p)  # readers of Spark skip files whose names begin with a dot
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()
    finally:
        stream.close()


def head(spark: SparkSession, root: str) -> str | None:
    """The commit that HEAD names, from HEAD, its ref or the packed refs as files; None where ``root`` is no repository, or
    HEAD names a branch without commits."""
    git = f"{root.rstrip('/')}/.git"
    if (link := _small(spark, git)) and link[0].startswith("gitdir:"):  # a worktree
        to = link[0].removeprefix("gitdir:").strip()
        git = to if to.startswith("/") or "://" in to else f"{root.rstrip('/')}/{to}"
    lines_ = _small(spark, f"{git}/HEAD")
    if not lines_:
        return None
    if not lines_[0].startswith("ref:"):
        return lines_[0].strip()
    ref = lines_[0].removeprefix("ref:").strip()
    common = _small(spark, f"{git}/commondir")
    for folder in dict.fromkeys((git, f"{git}/{common[0]}" if common and not common[0].startswith("/") else common[0] if common else git)):
        if own := _small(spark, f"{folder}/{ref}"):
            return own[0].strip()
        packed = [line.split(" ")[0] for line in _small(spark, f"{folder}/packed-refs") or [] if line.endswith(f" {ref}") and not line.startswith(("#", "^"))]
        if packed:
            return packed[0]
    return None


POLICIES = ("head", "head-and-working-tree", "content-hash")


def source_revision(files: DataFrame, root: str, policy: str = "head-and-working-tree") -> str:
    """What a repository's files are a state of: ``git:<commit>``, with ``+wt:<digest>`` of the selected files if the working
    tree counts, or ``content-hash:<digest>``, also where there is no commit.

    Whether a working tree is clean isn't known without the commit's objects, so the digest is always there.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy}")
    commit = None if policy == "content-hash" else head(files.sparkSession, root)
    if commit and policy == "head":
        return f"git:{commit}"
    found = revision(files).first()
    digest = found["revision"] if found else "none"
    return f"git:{commit}+wt:{digest}" if commit else f"content-hash:{digest}"


def _module(path: str) -> str:
    parts = path.removesuffix(".py").split("/")
    parts = parts[1:] if parts[0] == "src" and len(parts) > 1 else parts
    return ".".join(parts[:-1] if parts[-1] == "__init__" and len(parts) > 1 else parts)


def _dotted(node: ast.AST) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute) and (head := _dotted(node.value)):
        return f"{head}.{node.attr}"
    return None


def parse(path: str, text: str) -> tuple[list[tuple], list[tuple], list[str]]:
    """Symbols (kind, name, qualified name, signature, line, end line), references (from, relation, name), diagnostics."""
    module = _module(path)
    lines = text.split("\n")
    symbols = [("module", module.rsplit(".", 1)[-1], module, None, 1, max(1, len(lines)))]
    references: list[tuple] = []
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError) as e:
        return symbols, [], [f"syntax_error:{getattr(e, 'lineno', 0)}:{getattr(e, 'msg', e)}"]

    def walk(node: ast.AST, owner: str, in_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                name, is_class = f"{owner}.{child.name}", isinstance(child, ast.ClassDef)
                property_ = any((_dotted(d) or "").endswith(("property", "setter")) for d in child.decorator_list)
                kind = "class" if is_class else "test" if child.name.startswith("test") else "property" if in_class and property_ else "method" if in_class else "function"
                symbols.append((kind, child.name, name, lines[child.lineno - 1].strip()[:SIGNATURE], child.lineno, child.end_lineno))
                references.append((owner, "CONTAINS" if in_class else "DEFINES", name))
                if is_class:
                    references.extend((name, "EXTENDS", b) for b in map(_dotted, child.bases) if b)
                walk(child, name, is_class)
                continue
            if isinstance(child, ast.Import):
                references.extend((owner, "IMPORTS", a.name) for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                base = "." * child.level + (child.module or "")
                references.append((owner, "IMPORTS", base))
                references.extend((owner, "IMPORTS", f"{base}.{a.name}" if base.strip(".") else f"{base}{a.name}") for a in child.names)
            elif isinstance(child, ast.Call) and (called := _dotted(child.func)):
                test = owner.rsplit(".", 1)[-1].startswith("test")
                references.append((owner, "TESTS" if test else "CALLS", called.removeprefix("self.")))
            walk(child, owner, in_class)

    walk(tree, module, False)
    return symbols, references, []


_PARSED = f"symbols array<struct<{', '.join(f.replace(' ', ':', 1) for f in _SYMBOLS.split(', ')[2:])}>>, references array<struct<source:string,relation:string,reference:string>>, diagnostics array<string>"


def parsed(files: DataFrame) -> DataFrame:
    """(file_id, symbols, references, diagnostics): each file is parsed once. ``symbols``, ``references`` and ``diagnostics``
    take this table, written, where more than one of them is wanted, or the files."""
    names = [f.split(" ")[0] for f in _SYMBOLS.split(", ")[2:]]
    kinds = [pa.list_(pa.struct([(n, pa.int32() if n in ("line", "end_line") else pa.string()) for n in names])), pa.list_(pa.struct([(n, pa.string()) for n in ("source", "relation", "reference")])), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [dart.parse(f["path"], f["text"] or "", f["is_test"]) if f["language"] == "dart" else parse(f["path"], f["text"] or "") for f in batch.to_pylist()]
            rows = [[dict(zip(names, x, strict=True)) for x in f[0]] for f in found], [[dict(zip(("source", "relation", "reference"), x, strict=True)) for x in f[1]] for f in found], [f[2][:DIAGNOSTICS] for f in found]
            yield pa.record_batch([batch.column("file_id"), *(pa.array(r, k) for r, k in zip(rows, kinds, strict=True))], names=["file_id", "symbols", "references", "diagnostics"])

    test = F.col("is_test") if "is_test" in files.columns else F.lit(False)
    return files.where(F.col("language").isin(*LANGUAGES.values())).select("file_id", "path", "language", test.alias("is_test"), "text").mapInArrow(run, f"file_id string, {_PARSED}")


def _parsed(files: DataFrame) -> DataFrame:
    return files if "symbols" in files.columns else parsed(files)


def symbols(files: DataFrame) -> DataFrame:
    """The symbols of files, with ids from file, kind and qualified name; equal ones are told apart by their lines."""
    rows = _parsed(files).select("file_id", F.inline("symbols"))
    return rows.withColumn("symbol_id", stable_id("code-symbol", F.col("file_id"), F.col("kind"), F.col("qualified_name"), F.col("line").cast("string")))


def references(files: DataFrame) -> DataFrame:
    """(file_id, source, relation, reference): what symbols define, contain, import, call, test, extend and implement."""
    return _parsed(files).select("file_id", F.inline("references"))


def diagnostics(files: DataFrame) -> DataFrame:
    """(file_id, message) for files that can't be parsed in full, at most DIAGNOSTICS a file."""
    return _parsed(files).select("file_id", F.explode("diagnostics").alias("message"))


def lines(files: DataFrame, path: str, first: int, last: int, content_hash: str | None = None, limit: int = 12) -> DataFrame:
    """(line, text) of a file, at most ``limit`` lines; none if the file is no longer the one with that hash."""
    rows = files.where(F.col("path") == path)
    rows = rows if content_hash is None else rows.where(F.col("content_hash") == content_hash)
    each = rows.select(F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)
    return each.where(F.col("line").between(first, min(last, first + limit - 1))).orderBy("line")
