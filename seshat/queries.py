"""Registered queries over the driver's tables, each with the same result in DuckDB's SQL.

"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.predicates import document_role, item_type
from .functions.text import anchor, entity_name, excerpt, first_words, hard_excerpt, result_id, result_title, tokens
from .operators import block_index, code_graph, entities, families, fusion, graph, inverted_file, keyword, listing, memory, packing, project, readiness, reconcile, vector
from .plans import hybrid
from .plans.staging import Staging, few
from .sources import bridge, code, markdown, vectors
from .sources.catalog import Catalog, Vault
from .sources.segments import SegmentStore

QUERY = "hention erbly thing the"
PHRASE = "of_the"
LIMIT = 20
BUDGET = 1200
SINCE = "2024-01-20 00:00:00"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# Views of the bridge, as common table expressions.
_DOCS = """d AS (SELECT lang AS vault_id, doc_id,
    CASE doc_id % 10 WHEN 0 THEN 'raw/' WHEN 1 THEN 'scratch/reports/' WHEN 2 THEN 'docs/' WHEN 3 THEN 'wiki/sources/' WHEN 4 THEN 'wiki/maps/'
      WHEN 5 THEN 'wiki/notes/' WHEN 6 THEN 'wiki/decisions/' WHEN 7 THEN 'wiki/issues/' ELSE 'wiki/concepts/' END || CAST(doc_id AS VARCHAR) || '.md' AS path,
    CASE doc_id % 10 WHEN 5 THEN 'log' WHEN 6 THEN 'decision' WHEN 7 THEN 'issue' WHEN 3 THEN 'source' ELSE CASE WHEN doc_id % 20 = 4 THEN 'roadmap' END END AS fm_type,
    CASE WHEN doc_id % 10 = 7 THEN ['open', 'resolved', 'blocked', 'closed', 'todo', 'accepted', 'archived', 'superseded', 'unresolved', 'rejected'][(doc_id // 10) % 10 + 1] WHEN doc_id % 20 = 18 THEN 'superseded' END AS fm_status,
    CASE WHEN doc_id % 20 = 9 THEN 'Open questions' WHEN doc_id % 30 = 8 THEN 'Alternatives' WHEN doc_id % 30 = 7 THEN 'To do: follow-up' END AS section,
    CASE doc_id % 10 WHEN 3 THEN 'raw/' || CAST(doc_id - 3 AS VARCHAR) || '.md' WHEN 6 THEN 'wiki/sources/' || CAST(doc_id - 3 AS VARCHAR) || '.md'
      WHEN 8 THEN 'wiki/decisions/' || CAST(doc_id - 2 AS VARCHAR) || '.md' END AS derived_from, text FROM documents),
  roles AS (SELECT *, CASE WHEN path LIKE 'raw/%' THEN 'raw_evidence' WHEN path LIKE 'scratch/reports/%' THEN 'audit_record' WHEN path LIKE 'docs/%' THEN 'operating_contract'
      WHEN fm_type = 'log' THEN 'operation_log' WHEN path LIKE 'wiki/maps/%' THEN 'generated_view' WHEN path LIKE 'wiki/sources/%' OR fm_type = 'source' THEN 'source_manifest'
      ELSE 'canonical_knowledge' END AS source_role FROM d)"""
_CHUNKS = _DOCS + """,
  lines AS (SELECT vault_id, doc_id, path, source_role, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ordinal FROM roles),
  c AS (SELECT vault_id, sha256('chunk:' || vault_id || ':' || path || ':body:' || CAST(ordinal AS VARCHAR)) AS chunk_id, doc_id, path, source_role, CAST(ordinal AS INTEGER) AS ordinal, text,
      len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS token_count, sha256(text) AS content_hash FROM lines WHERE trim(text, ' ') <> '')"""
_EDGES = """e AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS href FROM pages)"""


def _register(sql: str | None) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _bm25_sql(source: str, keys: str, phrases: list[str], where: str = "TRUE", limit: int = LIMIT) -> str:
    """source: a common table expression's name with keys and text."""
    count = ", ".join(f"len(list_filter(t, lambda x: x = '{p}')) AS f{k}" for k, p in enumerate(phrases))
    stats = ", ".join(f"count(*) FILTER (WHERE f{k} > 0) AS n{k}" for k in range(len(phrases)))
    idf = lambda k: f"CASE WHEN ln((n - n{k} + 0.5) / (n{k} + 0.5)) > 0 THEN ln((n - n{k} + 0.5) / (n{k} + 0.5)) ELSE 1e-6 END"
    score = " + ".join(f"({idf(k)}) * f{k}::DOUBLE * 2.2 / (f{k}::DOUBLE + 1.2 * (0.25 + 0.75 * length / average))" for k in range(len(phrases)))
    some = " OR ".join(f"f{k} > 0" for k in range(len(phrases)))
    return f""",
  tk AS (SELECT *, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS t FROM {source}),
  fr AS (SELECT *, len(t) AS length, {count} FROM tk),
  st AS (SELECT count(*)::DOUBLE AS n, avg(length)::DOUBLE AS average, {stats} FROM fr),
  bm AS (SELECT {keys}, round(-({score}), 6) AS score FROM fr, st WHERE ({some}) AND ({where})),
  top AS (SELECT *, row_number() OVER (ORDER BY score, {keys}) AS rk FROM bm QUALIFY rk <= {limit})"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.chunks(bridge.documents(spark, sf_dir))


def _with_role(docs: DataFrame) -> DataFrame:
    return docs.withColumn("source_role", document_role(F.col("path"), F.col("fm_type")))


@_register(f"WITH {_DOCS} SELECT source_role, count(*)::BIGINT AS n FROM roles GROUP BY 1")
def doc_role_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ4, AUD1."""
    return _with_role(bridge.documents(spark, sf_dir)).groupBy("source_role").agg(F.count("*").alias("n"))


@_register(f"WITH {_CHUNKS} SELECT vault_id, chunk_id, doc_id, ordinal, token_count::BIGINT AS token_count, content_hash FROM c")
def chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ1, PRJ3."""
    return _chunks(spark, sf_dir).select("vault_id", "chunk_id", "doc_id", "ordinal", F.col("token_count").cast("bigint").alias("token_count"), "content_hash")


@_register(f"WITH {_CHUNKS} SELECT vault_id, path, ordinal, sha256(text) AS text_sha256 FROM c WHERE path LIKE 'wiki/%'")
def stored_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LST3: chunks of the documents in a scope, with their texts from a store of distinct ones."""
    docs = bridge.documents(spark, sf_dir)
    chunks = _chunks(spark, sf_dir)
    found = listing.with_text(chunks.drop("text"), listing.blobs(chunks), docs.where(F.col("path").startswith("wiki/")))
    return found.select("vault_id", "path", "ordinal", F.sha2("text", 256).alias("text_sha256"))


@_register(f"""WITH {_CHUNKS}, b AS (SELECT content_hash, max(strlen(text)) AS size, count(*) AS n FROM c GROUP BY 1)
    SELECT count(*)::BIGINT AS blob_count, sum(size)::BIGINT AS blob_bytes, sum(size * n)::BIGINT AS logical_bytes, sum(n)::BIGINT AS chunks, round(sum(size * n)::DOUBLE / sum(size)::DOUBLE, 6) AS amplification FROM b""")
def blob_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK1, AUD1."""
    docs = bridge.documents(spark, sf_dir)
    return memory.hygiene(docs, bridge.chunks(docs))


@_register(f"WITH {_DOCS} SELECT vault_id, path FROM d WHERE vault_id IN ('en', 'fr') AND (path LIKE 'wiki/notes/%' OR path LIKE 'raw/%')")
def scoped_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ6, PRJ7, LST1."""
    scopes = Catalog(tuple(Vault(v, f"/{v}", content_scopes=("wiki", "raw")) for v in ("en", "fr", "de"))).resolve(("en", "fr"), ("wiki/notes", "raw", "docs"))
    rows = [listing.documents(bridge.documents(spark, sf_dir), [vault], own) for vault, own in scopes.items()]
    return reduce(DataFrame.union, rows).select("vault_id", "path")


@_register("""WITH t AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS heading FROM pages)
    SELECT page_id, heading, coalesce(nullif(trim(regexp_replace(lower(trim(heading)), '[^a-z0-9가-힣]+', '-', 'g'), '-'), ''), 'section') AS anchor FROM t""")
def heading_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ2."""
    heading = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return bridge.table(spark, sf_dir, "pages").select("page_id", heading.alias("heading")).select("page_id", "heading", anchor(F.col("heading")).alias("anchor"))


@_register(f"WITH {_CHUNKS} {_bm25_sql('c', 'doc_id, ordinal', QUERY.split())} SELECT doc_id, ordinal, score, rk FROM top")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET1, RET2."""
    return keyword.search(_chunks(spark, sf_dir), QUERY, ["doc_id", "ordinal"], LIMIT).drop("fields")


@_register(f"""WITH {_CHUNKS} {_bm25_sql('c', 'doc_id, ordinal', QUERY.split(), "vault_id = 'en' AND source_role = 'canonical_knowledge'")} SELECT doc_id, ordinal, score, rk FROM top""")
def bm25_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET2, PRJ5: filters hold before the limit, statistics are of all chunks."""
    rows = _chunks(spark, sf_dir).withColumn("source_role", _role_of_path())
    where = (F.col("vault_id") == "en") & (F.col("source_role") == "canonical_knowledge")
    return keyword.search(rows, QUERY, ["doc_id", "ordinal"], LIMIT, where=where).drop("fields")


def _role_of_path() -> Column:
    """In the bridge the frontmatter's type follows from the path."""
    kind = F.when(F.col("path").startswith("wiki/notes/"), "log")
    return document_role(F.col("path"), kind)


@_register(f"""WITH {_DOCS}, t AS (SELECT doc_id, regexp_extract_all(lower(path), '[\\p{{L}}\\p{{N}}]+') AS p, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS x FROM d)
    SELECT doc_id, array_to_string(list_filter([CASE WHEN list_has_any(p, ['wiki', 'thing']) THEN 'path' END, CASE WHEN list_has_any(x, ['wiki', 'thing']) THEN 'text' END], lambda f: f IS NOT NULL), ',') AS fields
    FROM t WHERE list_has_any(p, ['wiki', 'thing']) OR list_has_any(x, ['wiki', 'thing'])""")
def bm25_matched_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET3: for all documents that match, which fields do."""
    fields = ["path", "text"]
    found = keyword.counted(bridge.documents(spark, sf_dir), fields, keyword.query_phrases("wiki thing"))
    return found.where("f0 > 0 OR f1 > 0").select("doc_id", F.array_join(keyword.matched_fields(fields), ",").alias("fields"))


@_register(f"""WITH {_CHUNKS}, t AS (SELECT doc_id, ordinal, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS t FROM c),
    p AS (SELECT doc_id, ordinal, len(list_filter(range(1, len(t)), lambda i: t[i] = 'of' AND t[i + 1] = 'the')) AS n FROM t) SELECT doc_id, ordinal, n::BIGINT AS n FROM p WHERE n > 0""")
def phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET2, words of several tokens."""
    found = keyword.counted(_chunks(spark, sf_dir), ["text"], keyword.query_phrases(PHRASE))
    return found.where("f0 > 0").select("doc_id", "ordinal", F.col("f0").cast("bigint").alias("n"))


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    row = bridge.vectors(spark, sf_dir).where("vec_id = 0").select("embedding").first()
    return list(row[0]) if row else []


_COSINE = """v AS (SELECT vec_id, 'v' || CAST(label % 4 AS VARCHAR) AS vault_id, embedding::DOUBLE[] AS x FROM embeddings),
  q AS (SELECT x AS y FROM v WHERE vec_id = 0),
  s AS (SELECT vec_id, vault_id, round(list_cosine_similarity(x, y), 6) AS score FROM v, q)"""


@_register(f"WITH {_COSINE} SELECT vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id) AS rk FROM s QUALIFY rk <= {LIMIT}")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET5, SRC8."""
    return vector.search(bridge.vectors(spark, sf_dir), _query_vector(spark, sf_dir), ["vec_id"], LIMIT)


@_register(f"WITH {_COSINE} SELECT vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id) AS rk FROM s WHERE vault_id = 'v1' QUALIFY rk <= {LIMIT}")
def cosine_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET5 in one vault."""
    return vector.search(bridge.vectors(spark, sf_dir), _query_vector(spark, sf_dir), ["vec_id"], LIMIT, where=F.col("vault_id") == "v1")


_HYBRID = f"""{_DOCS} {_bm25_sql('d', 'doc_id', QUERY.split(), limit=4 * LIMIT)}, {_COSINE},
  near AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY score DESC, vec_id) AS rk FROM s QUALIFY rk <= {4 * LIMIT}),
  sig AS (SELECT doc_id, rk, 'keyword' AS kind FROM top UNION ALL SELECT doc_id, rk, 'vector' FROM near),
  fu AS (SELECT doc_id, round(sum(1.0::DOUBLE / (60 + rk)), 9) AS fused, min(rk) AS best_rank, count(*) AS kinds FROM sig JOIN d USING (doc_id) GROUP BY doc_id),
  hy AS (SELECT *, row_number() OVER (ORDER BY fused DESC, best_rank, doc_id) AS rk FROM fu QUALIFY rk <= {LIMIT})"""


def _hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid.hybrid(bridge.documents(spark, sf_dir), bridge.vectors(spark, sf_dir), QUERY, _query_vector(spark, sf_dir), LIMIT)


@_register(f"WITH {_HYBRID} SELECT doc_id, fused, best_rank, rk FROM hy")
def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET8, RET9, RET13."""
    return _hybrid(spark, sf_dir).drop("kinds")


def _families(docs: DataFrame) -> DataFrame:
    return families.families(docs, docs.select("vault_id", "path", F.col("derived_from").alias("target")))


_FAMILIES = """nodes AS (SELECT vault_id, path FROM d UNION SELECT vault_id, derived_from FROM d WHERE derived_from IS NOT NULL),
  ends AS (SELECT vault_id, path AS x, derived_from AS y FROM d WHERE derived_from IS NOT NULL UNION SELECT vault_id, derived_from, path FROM d WHERE derived_from IS NOT NULL),
  reach AS (SELECT vault_id, path AS x, path AS y FROM nodes UNION SELECT r.vault_id, r.x, n.y FROM reach r JOIN ends n ON n.vault_id = r.vault_id AND n.x = r.y),
  fam AS (SELECT vault_id, x AS path, min(y) AS family_seed FROM reach GROUP BY 1, 2)"""


@_register(f"WITH RECURSIVE {_HYBRID}, {_FAMILIES}, j AS (SELECT hy.*, d.vault_id, fam.family_seed FROM hy JOIN d USING (doc_id) JOIN fam ON fam.vault_id = d.vault_id AND fam.path = d.path), o AS (SELECT *, row_number() OVER (PARTITION BY vault_id, family_seed ORDER BY fused DESC, best_rank, doc_id) AS k FROM j) SELECT vault_id, family_seed, doc_id, row_number() OVER (ORDER BY fused DESC, best_rank, doc_id) AS rk FROM o WHERE k = 1")
def family_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET10, RET12."""
    docs = bridge.documents(spark, sf_dir)
    members = docs.select("vault_id", "path", "doc_id").join(_families(docs), ["vault_id", "path"]).select("vault_id", "family_seed", "doc_id")
    return hybrid.family_search(_hybrid(spark, sf_dir), members, LIMIT).select("vault_id", "family_seed", "doc_id", "rk")


@_register(f"""WITH RECURSIVE {_DOCS}, {_FAMILIES} SELECT fam.vault_id, family_seed, count(*) FILTER (WHERE source_role IN ('source_manifest', 'raw_evidence'))::BIGINT AS supporting_n,
    count(*) FILTER (WHERE source_role IN ('generated_view', 'operation_log', 'audit_record'))::BIGINT AS audit_n FROM roles JOIN fam ON fam.vault_id = roles.vault_id AND fam.path = roles.path GROUP BY 1, 2""")
def family_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET11."""
    docs = bridge.documents(spark, sf_dir)
    return families.support(_with_role(docs).join(_families(docs), ["vault_id", "path"]))


@_register(f"WITH RECURSIVE {_DOCS}, {_FAMILIES} SELECT d.vault_id, d.path, family_seed, sha256('provenance-family:' || d.vault_id || ':' || family_seed) AS family_id FROM d JOIN fam ON fam.vault_id = d.vault_id AND fam.path = d.path")
def provenance_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEX11."""
    return _families(bridge.documents(spark, sf_dir)).select("vault_id", "path", "family_seed", "family_id")


@_register(f"""WITH {_EDGES} SELECT page_id, href, CAST(NULL AS VARCHAR) AS label FROM e WHERE regexp_full_match(href, '[^)\\s]+') UNION ALL SELECT page_id, trim(href) AS href, 'b' AS label FROM e WHERE regexp_full_match(href, '[^|\\]\\n]+')""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEX3: hrefs as Markdown links, wiki links and images, which are no links."""
    link = F.format_string("[a](%s) [[%s|b]] ![c](%s)", "href", "href", "href")
    chunks = bridge.mentions(spark, sf_dir).select(F.lit("web").alias("vault_id"), F.col("page_id").alias("chunk_id"), F.lit("p.md").alias("path"), link.alias("text"))
    return graph.local_links(chunks).select(F.col("chunk_id").alias("page_id"), F.col("target").alias("href"), F.col("label"))


@_register(f"""WITH {_EDGES}, docs AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'wiki/' ELSE 'raw/' || CAST(p_partkey % 2 AS VARCHAR) || '/' END || regexp_replace(p_name, '^.* ', '') || '.md' AS path FROM part WHERE p_partkey % 7 < 3),
    l AS (SELECT page_id, word AS target, word || '.md' AS wanted FROM (SELECT DISTINCT page_id, unnest(['ring', 'widget', 'bolt', 'gear', 'gizmo', 'plate', 'anvil', 'rod', 'nothing']) AS word FROM e)),
    base AS (SELECT regexp_extract(path, '[^/]*$') AS b, count(*) AS n, min(path) AS only_path FROM docs GROUP BY 1)
    SELECT page_id, target, coalesce(d.path, CASE WHEN n = 1 THEN only_path END) AS to_path FROM l LEFT JOIN docs d ON d.path = l.wanted LEFT JOIN base ON b = l.wanted""")
def link_resolve_basename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEX4: by path, else by a base name that one document has."""
    key = F.col("p_partkey")
    folder = F.when(key % 3 == 0, "").when(key % 3 == 1, "wiki/").otherwise(F.concat(F.lit("raw/"), (key % 2).cast("string"), F.lit("/")))
    docs = bridge.table(spark, sf_dir, "part").where(key % 7 < 3).select(F.lit("web").alias("vault_id"), F.concat(folder, F.regexp_replace("p_name", "^.* ", ""), F.lit(".md")).alias("path")).distinct()
    words = F.explode(F.array(*map(F.lit, ("ring", "widget", "bolt", "gear", "gizmo", "plate", "anvil", "rod", "nothing"))))
    links = bridge.mentions(spark, sf_dir).select("page_id").distinct().select(F.lit("web").alias("vault_id"), "page_id", F.lit("wiki/x.md").alias("path"), words.alias("target"))
    return graph.resolve_links(links, docs).select("page_id", "target", "to_path")


def _concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bridge.mentions(spark, sf_dir).select(F.lit("web").alias("vault_id"), F.lit("Concept").alias("type"), F.regexp_replace("href", "^/", "").alias("name"), F.lit(None).cast("string").alias("canonical_path"), F.lit(0.7).alias("confidence"), F.col("page_id").cast("string").alias("chunk_id"))
    return graph.merge_entities(rows)


@_register(f"""WITH {_EDGES}, n AS (SELECT lower(trim(regexp_replace(href, '^/', ''))) AS normalized_name FROM e) SELECT normalized_name, count(*)::BIGINT AS mentions, 0.7::DOUBLE AS max_confidence FROM n GROUP BY 1""")
def concept_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEX1, GEX7, GEX9."""
    return _concepts(spark, sf_dir).select("normalized_name", "mentions", F.col("confidence").alias("max_confidence"))


def _mention_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bridge.mentions(spark, sf_dir)
    return rows.select(F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("source"), F.col("href").alias("target"), F.lit("mentions").alias("type"), F.lit("stated").alias("status"), F.lit(0.7).alias("confidence")).withColumn("edge_id", F.concat_ws(">", "source", "target"))


@_register(f"""WITH {_EDGES}, h AS (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS source, page_id FROM pages) SELECT source, lower(trim(regexp_replace(href, '^/', ''))) AS target, count(DISTINCT page_id)::BIGINT AS evidence_n FROM e JOIN h USING (page_id) GROUP BY 1, 2""")
def mention_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEX5, GEX8: hosts and the concepts that their pages mention."""
    host = bridge.table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("source"))
    rows = bridge.mentions(spark, sf_dir).join(host, "page_id").select("source", F.lit("mentions").alias("type"), entity_name(F.regexp_replace("href", "^/", "")).alias("target"), F.lit(0.7).alias("confidence"), F.col("page_id").alias("chunk_id"))
    known = rows.select(F.col("source").alias("entity_id")).union(rows.select("target"))
    return graph.merge_relationships(rows, known).select("source", "target", "evidence_n")


@_register(f"""WITH {_EDGES}, n AS (SELECT DISTINCT lower(trim(regexp_replace(href, '^/', ''))) AS entity FROM e), m AS (SELECT entity, CASE WHEN entity = 'the' THEN 3 WHEN contains(entity, 'the') THEN 5 END AS match_rank FROM n)
    SELECT entity, match_rank FROM m WHERE match_rank IS NOT NULL ORDER BY match_rank, entity LIMIT {LIMIT}""")
def entity_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRA1."""
    found = graph.find(_concepts(spark, sf_dir).withColumn("status", F.lit("active")), "the", LIMIT)
    return found.select(F.col("normalized_name").alias("entity"), "match_rank")


def _seed(spark: SparkSession, node: str) -> DataFrame:
    return spark.range(1).select(F.lit(node).alias("node"))


@_register(f"WITH {_EDGES}, t AS (SELECT href AS target, 1 AS depth, 0.7::DOUBLE AS score FROM e WHERE page_id = 0) SELECT *, row_number() OVER (ORDER BY score DESC, depth, target) AS rk FROM t QUALIFY rk <= {LIMIT}")
def related_one_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRA2, GRA6."""
    return graph.related(_mention_edges(spark, sf_dir), _seed(spark, "page:0"), 1, LIMIT)


@_register(f"""WITH {_EDGES}, one AS (SELECT href AS target, 1 AS depth, 0.7::DOUBLE AS score FROM e WHERE page_id = 0),
    two AS (SELECT DISTINCT 'page:' || CAST(b.page_id AS VARCHAR) AS target, 2 AS depth, round(0.7::DOUBLE * 0.6, 6) AS score FROM e a JOIN e b ON a.href = b.href WHERE a.page_id = 0 AND b.page_id <> 0),
    t AS (SELECT * FROM one UNION ALL SELECT * FROM two) SELECT *, row_number() OVER (ORDER BY score DESC, depth, target) AS rk FROM t QUALIFY rk <= {LIMIT}""")
def related_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRA5, GRA6, GRA7."""
    return graph.related(_mention_edges(spark, sf_dir), _seed(spark, "page:0"), 2, LIMIT)


@_register(f"""WITH {_EDGES}, w AS (SELECT page_id, href, 0.7::DOUBLE * CASE page_id % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.75 WHEN 2 THEN 0.45 ELSE 0.0 END AS w FROM e),
    one AS (SELECT href AS target, 1 AS depth, w AS score FROM w WHERE page_id = 1), two AS (SELECT 'page:' || CAST(b.page_id AS VARCHAR) AS target, 2 AS depth, max(least(a.w, b.w) * 0.6) AS score FROM w a JOIN w b ON a.href = b.href WHERE a.page_id = 1 AND b.page_id <> 1 GROUP BY 1),
    t AS (SELECT target, depth, round(score, 6) AS score FROM (SELECT * FROM one UNION ALL SELECT * FROM two)) SELECT *, row_number() OVER (ORDER BY score DESC, depth, target) AS rk FROM t QUALIFY rk <= 1000""")
def related_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRA6: edges of all statuses, and of one that has no weight."""
    page = F.regexp_extract("source", "[0-9]+$", 0).cast("bigint") % 5
    status = F.element_at(F.array(*map(F.lit, ("stated", "inferred", "contested", "deprecated", "unheard"))), (page + 1).cast("int"))
    return graph.related(_mention_edges(spark, sf_dir).withColumn("status", status), _seed(spark, "page:1"), 2, 1000)


_ROLE_PRIORITY = ("canonical_knowledge", "source_manifest", "raw_evidence", "operating_contract", "generated_view", "operation_log", "audit_record")


@_register(f"""WITH {_DOCS}, s AS (SELECT vault_id, derived_from AS target, path, CASE WHEN derived_from LIKE 'raw/%' THEN 'raw_evidence' WHEN derived_from LIKE 'wiki/sources/%' THEN 'source_manifest' ELSE 'canonical_knowledge' END AS role FROM d WHERE derived_from IS NOT NULL)
    SELECT vault_id, path, target, role, row_number() OVER (ORDER BY CASE role WHEN 'canonical_knowledge' THEN 0 WHEN 'source_manifest' THEN 1 ELSE 2 END, vault_id, path, target) AS rk FROM s QUALIFY rk <= 100""")
def decision_trace_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRA9."""
    steps = bridge.documents(spark, sf_dir).where("derived_from IS NOT NULL").select("vault_id", "path", F.col("derived_from").alias("target"), document_role(F.col("derived_from"), F.lit(None).cast("string")).alias("role"))
    return graph.trace(steps, F.array_position(F.array(*map(F.lit, _ROLE_PRIORITY)), F.col("role")), ["vault_id", "path", "target"], 100)


@_register(f"WITH {_DOCS} SELECT count(*)::BIGINT AS missing_n FROM d a WHERE derived_from IS NOT NULL AND NOT EXISTS (SELECT 1 FROM d b WHERE b.vault_id = a.vault_id AND b.path = a.derived_from)")
def evidence_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRA8, AUD1: references to documents that the vault doesn't have."""
    docs = bridge.documents(spark, sf_dir)
    key = lambda path: F.concat_ws(":", "vault_id", path).alias("chunk_id")
    edges = docs.where("derived_from IS NOT NULL").select(F.col("path").alias("edge_id"), key("derived_from"))
    _, missing = graph.with_evidence(edges, edges, docs.select(key("path")))
    return missing.agg(F.count("*").alias("missing_n"))


_SNAPSHOTS = """o AS (SELECT doc_id, sha256(text) AS h FROM documents),
  n AS (SELECT doc_id, sha256(CASE WHEN doc_id % 10 = 3 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 10 <> 7 UNION ALL SELECT doc_id + 1000000000, sha256(text) FROM documents WHERE doc_id % 10 = 1)"""


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = bridge.table(spark, sf_dir, "documents")
    last = F.col("doc_id") % 10
    changed = docs.where(last != 7).select("doc_id", F.sha2(F.when(last == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("h"))
    added = docs.where(last == 1).select((F.col("doc_id") + 1_000_000_000).alias("doc_id"), F.sha2("text", 256).alias("h"))
    return docs.select("doc_id", F.sha2("text", 256).alias("h")), changed.union(added)


@_register(f"WITH {_SNAPSHOTS} SELECT CASE WHEN o.doc_id IS NULL THEN 'insert' WHEN n.doc_id IS NULL THEN 'delete' WHEN o.h IS NOT DISTINCT FROM n.h THEN 'unchanged' ELSE 'update' END AS action, count(*)::BIGINT AS n FROM o FULL JOIN n ON o.doc_id = n.doc_id GROUP BY 1")
def reconcile_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REC1, REC2, REC3."""
    old, new = _snapshots(spark, sf_dir)
    return reconcile.plan(old, new, ["doc_id"], ["h"]).groupBy("action").agg(F.count("*").alias("n"))


@_register(f"WITH {_SNAPSHOTS} SELECT doc_id, h FROM n")
def reconcile_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK1 to SNK5: the snapshot after the plan is the wanted one."""
    old, new = _snapshots(spark, sf_dir)
    return reconcile.apply(old, new, reconcile.plan(old, new, ["doc_id"], ["h"]), ["doc_id"])


@_register("SELECT event_type AS key, user_id, event_id AS revision FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK7, RET4."""
    return reconcile.latest(bridge.table(spark, sf_dir, "events"), ["event_type", "user_id"], ["ts", "event_id"]).select(F.col("event_type").alias("key"), "user_id", F.col("event_id").alias("revision"))


_TURNS = """t AS (SELECT DISTINCT conv_id, turn FROM conversations), g AS (SELECT CAST(a.conv_id AS VARCHAR) || ':' || CAST(a.turn AS VARCHAR) AS s, CAST(a.conv_id AS VARCHAR) || ':' || CAST(a.turn + 1 AS VARCHAR) AS x FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""


def _walk(first: str, a: str, b: str) -> str:
    return f"""WITH RECURSIVE {_TURNS}, w AS (SELECT {first} AS target, 0 AS level UNION SELECT g.{b}, w.level + 1 FROM w JOIN g ON g.{a} = w.target WHERE w.level < 8)
    SELECT target, min(level) AS level FROM w WHERE target <> {first} GROUP BY 1"""


def _turn_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.turns(spark, sf_dir).withColumn("status", F.lit("inferred"))


@_register(_walk("'0:0'", "s", "x"))
def bfs_callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """COD7, COD8."""
    return code_graph.traverse(_turn_edges(spark, sf_dir), _seed(spark, "0:0"), 8)


@_register(_walk("'0:3'", "x", "s"))
def bfs_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """COD7, COD8, inbound."""
    return code_graph.traverse(_turn_edges(spark, sf_dir), _seed(spark, "0:3"), 8, direction="in")


def _symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("symbol_id"), F.concat_ws(".", "p_brand", "p_type", F.replace("p_name", F.lit(" "), F.lit("_"))).alias("qualified_name"))


@_register("""WITH sy AS (SELECT p_partkey AS id, p_brand AS b, p_type AS t, replace(p_name, ' ', '_') AS n FROM part),
    r AS (SELECT DISTINCT n AS reference FROM sy UNION SELECT DISTINCT t || '.' || n FROM sy UNION SELECT DISTINCT b || '.' || t || '.' || n FROM sy UNION SELECT 'no.such'),
    k AS (SELECT b || '.' || t || '.' || n AS reference, 1 AS tier, id FROM sy UNION SELECT n, 2, id FROM sy UNION SELECT t || '.' || n, 3, id FROM sy),
    c AS (SELECT reference, tier, count(*) AS n, min(id) AS id FROM k GROUP BY 1, 2 QUALIFY tier = min(tier) OVER (PARTITION BY reference))
    SELECT r.reference, coalesce(c.tier, 0) AS tier, coalesce(c.n, 0)::BIGINT AS candidates, CASE WHEN c.n = 1 THEN CAST(c.id AS VARCHAR) END AS symbol_id, CASE WHEN c.n IS NULL THEN 'unresolved' WHEN c.n = 1 THEN 'inferred' ELSE 'ambiguous' END AS status FROM r LEFT JOIN c USING (reference)""")
def reference_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """COD4."""
    symbols = _symbols(spark, sf_dir)
    name = lambda n: F.array_join(F.slice(F.split("qualified_name", "\\."), -n, n), ".").alias("reference")
    references = symbols.select(name(1)).union(symbols.select(name(2))).union(symbols.select(name(3))).union(_seed(spark, "no.such"))
    found = code_graph.resolve(references, symbols)
    return found.select("reference", F.coalesce("tier", F.lit(0)).alias("tier"), "candidates", F.col("symbol_id").cast("string").alias("symbol_id"), "status")


@_register(f"""WITH s AS (SELECT p_partkey, p_brand || ' ' || p_type || ' ' || p_name AS text FROM part) {_bm25_sql('s', 'p_partkey', ['red', 'widget'], 'f0 > 0 AND f1 > 0')} SELECT p_partkey, score, rk FROM top""")
def symbol_search_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    """COD6: all words are needed."""
    rows = bridge.table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_brand", "p_type", "p_name").alias("text"))
    return keyword.search(rows, "red widget", ["p_partkey"], LIMIT, where=(F.col("f0") > 0) & (F.col("f1") > 0)).drop("fields")


def _costed(spark: SparkSession, sf_dir: str) -> DataFrame:
    cost = bridge.documents(spark, sf_dir).select("doc_id", F.size(tokens(F.col("text"))).cast("bigint").alias("cost"))
    return _hybrid(spark, sf_dir).join(cost, "doc_id")


_FOLD = f"""{_HYBRID}, k AS (SELECT hy.doc_id, hy.rk, len(regexp_extract_all(lower(d.text), '[\\p{{L}}\\p{{N}}]+'))::BIGINT AS cost FROM hy JOIN d USING (doc_id)),
    f AS (SELECT doc_id, rk, cost <= {BUDGET} AS admitted, CASE WHEN cost <= {BUDGET} THEN cost ELSE 0 END AS used FROM k WHERE rk = 1
      UNION ALL SELECT k.doc_id, k.rk, f.used + k.cost <= {BUDGET}, f.used + CASE WHEN f.used + k.cost <= {BUDGET} THEN k.cost ELSE 0 END FROM f JOIN k ON k.rk = f.rk + 1)"""


@_register(f"WITH RECURSIVE {_FOLD} SELECT doc_id, rk, admitted, used::BIGINT AS used FROM f")
def budget_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PCK1, PCK4."""
    return packing.admit(_costed(spark, sf_dir), [F.col("rk")], F.col("cost"), BUDGET).select("doc_id", "rk", "admitted", "used")


@_register(f"WITH {_HYBRID} SELECT sha256('claim:' || CAST(rk AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)) AS claim_id, rk, doc_id, CASE WHEN kinds >= 2 THEN 'supported' ELSE 'single_source' END AS status FROM hy WHERE rk <= 5")
def claims_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PCK5."""
    return packing.claims(_hybrid(spark, sf_dir))


@_register(f"WITH RECURSIVE {_FOLD} SELECT sha256('claim:' || CAST(rk AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)) AS claim_id, doc_id FROM f WHERE NOT admitted")
def uncited_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PCK6: claims of all results whose evidence the budget has left out."""
    rows = packing.admit(_costed(spark, sf_dir), [F.col("rk")], F.col("cost"), BUDGET)
    return packing.uncited(packing.claims(rows, LIMIT), rows.where("admitted"), "doc_id").select("claim_id", "doc_id")


_LOOKED = f"""{_DOCS}, f AS (SELECT *, lower(concat_ws(' ', 'type ' || fm_type, 'status ' || fm_status, 'derived_from ' || derived_from)) AS fm_text, coalesce(fm_status, '') AS status, lower(coalesce(section, '')) AS head FROM d),
  ev AS (SELECT doc_id FROM d WHERE regexp_matches(text, '[^ \\n]'))"""


def _any(column: str, terms: str) -> str:
    return "(" + " OR ".join(f"contains({column}, '{t}')" for t in terms.split(",")) + ")"


_DECIDES, _ASKS = "decision,alternatives,tradeoff,trade-off,revisit", "open questions,question,follow-up,follow up,todo,blocker,revisit"


def _memory_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = bridge.with_frontmatter(bridge.documents(spark, sf_dir))
    return docs, bridge.chunks(docs).join(docs.select("doc_id", "section"), "doc_id")


def _first_by_vault(where: str) -> str:
    """The candidates that a view looks into: 200 a vault for 20 items."""
    return f"c AS (SELECT * FROM f WHERE {where} QUALIFY row_number() OVER (PARTITION BY vault_id ORDER BY path) <= 200)"


@_register(f"""WITH {_LOOKED}, {_first_by_vault(f"path LIKE 'wiki/decisions/%' OR fm_type = 'decision' OR {_any('path', _DECIDES)} OR {_any('fm_text', _DECIDES)}")},
    m AS (SELECT vault_id, path, CASE WHEN path LIKE 'wiki/decisions/%' OR fm_type = 'decision' THEN 'stated' WHEN {_any('head', _DECIDES)} THEN 'heading_candidate' ELSE 'metadata_derived' END AS claim_status FROM c SEMI JOIN ev USING (doc_id))
    SELECT *, row_number() OVER (PARTITION BY vault_id ORDER BY path) AS rk FROM m QUALIFY rk <= {LIMIT}""")
def decisions_by_vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MEM1, PRJ12."""
    return memory.decisions(*_memory_rows(spark, sf_dir), LIMIT)


@_register(f"""WITH {_LOOKED}, {_first_by_vault(f"status NOT IN ('closed', 'resolved', 'done', 'accepted', 'superseded', 'deprecated', 'cancelled') AND (path LIKE 'wiki/issues/%' OR fm_type IN ('issue', 'question', 'follow_up') OR {_any('path', _ASKS)} OR {_any('fm_text', _ASKS)})")},
    m AS (SELECT vault_id, path, CASE WHEN path LIKE 'wiki/issues/%' AND status IN ('open', 'unresolved', 'todo', 'blocked', 'revisit') THEN 'stated' WHEN status IN ('', 'open', 'unresolved', 'todo', 'blocked', 'revisit') AND {_any('head', _ASKS)} THEN 'heading_candidate' END AS claim_status FROM c SEMI JOIN ev USING (doc_id))
    SELECT *, row_number() OVER (PARTITION BY vault_id ORDER BY path) AS rk FROM m WHERE claim_status IS NOT NULL QUALIFY rk <= {LIMIT}""")
def open_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MEM2, PRJ12."""
    return memory.open_questions(*_memory_rows(spark, sf_dir), LIMIT)


@_register(f"""WITH {_LOOKED}, g AS (SELECT *, list_filter([CASE WHEN fm_type IN ('project_status', 'status', 'roadmap', 'plan', 'overview') OR {_any('path', 'status,roadmap,plan,overview')} THEN 'current_state' END,
      CASE WHEN {_any('path', 'policy,decision,convention,boundary')} OR {_any('fm_text', 'constraint,policy,boundary,invariant,non-goal')} THEN 'constraints' END,
      CASE WHEN {_any('path', 'roadmap,todo')} OR {_any('fm_text', 'priority,next,roadmap,phase')} THEN 'next_priorities' END,
      CASE WHEN status IN ('stale', 'deprecated', 'superseded') OR {_any('path', 'deprecated,superseded')} THEN 'stale_areas' END], lambda x: x IS NOT NULL) AS groups FROM f),
    c AS (SELECT * FROM g WHERE len(groups) > 0 QUALIFY row_number() OVER (PARTITION BY vault_id ORDER BY path) <= 200),
    m AS (SELECT vault_id, path, unnest(groups) AS "group", len(groups) > 1 AS ambiguous FROM c SEMI JOIN ev USING (doc_id))
    SELECT *, row_number() OVER (PARTITION BY vault_id, "group" ORDER BY path) AS rk FROM m QUALIFY rk <= {LIMIT}""")
def project_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MEM3, PRJ12."""
    return memory.project_groups(*_memory_rows(spark, sf_dir), LIMIT)


@_register(f"""WITH {_DOCS}, k AS (SELECT doc_id, list_filter(['document', CASE WHEN path LIKE 'wiki/%' THEN 'page' END, CASE WHEN path LIKE 'raw/%' OR path LIKE 'docs/%' OR path LIKE 'scratch/reports/%' OR fm_type = 'source' THEN 'source' END,
      CASE WHEN path LIKE 'wiki/decisions/%' OR fm_type = 'decision' THEN 'decision' END, CASE WHEN path LIKE 'wiki/issues/%' OR fm_type = 'issue' THEN 'issue' END], lambda x: x IS NOT NULL) AS kinds FROM d)
    SELECT array_to_string(kinds, ',') AS kinds, count(*)::BIGINT AS n FROM k GROUP BY 1""")
def resource_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ13."""
    kinds = memory.resource_kinds(F.col("path"), F.col("fm_type"))
    return bridge.documents(spark, sf_dir).groupBy(F.array_join(kinds, ",").alias("kinds")).agg(F.count("*").alias("n"))


@_register(f"SELECT event_id, ts AS occurred_at, row_number() OVER (ORDER BY ts DESC, event_id) AS rk FROM events WHERE ts > TIMESTAMP '{SINCE}' QUALIFY rk <= 50")
def recent_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MEM5, LST2."""
    rows = bridge.table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("occurred_at"))
    return memory.recent(rows, "event_id", "occurred_at", F.lit(SINCE).cast("timestamp_ntz"), 50)


@_register(f"WITH {_CHUNKS} SELECT d.vault_id, d.path, count(c.chunk_id)::BIGINT AS n_chunks FROM d LEFT JOIN c ON c.vault_id = d.vault_id AND c.path = d.path GROUP BY 1, 2")
def document_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LST5."""
    docs = bridge.documents(spark, sf_dir)
    return listing.states(docs.select("vault_id", "path"), bridge.chunks(docs))


@_register(f"WITH {_CHUNKS} SELECT vault_id, path, sha256(string_agg(text, chr(10) || chr(10) ORDER BY ordinal)) AS text_sha256 FROM c GROUP BY 1, 2")
def render_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ14, LST4."""
    return markdown.render(_chunks(spark, sf_dir)).select("vault_id", "path", F.sha2("text", 256).alias("text_sha256"))


@_register(f"WITH {_CHUNKS} SELECT vault_id, path, ordinal, row_number() OVER (PARTITION BY vault_id, path ORDER BY CASE WHEN token_count >= 10 THEN 0 ELSE 1 END, ordinal) AS rk FROM c QUALIFY rk <= 3")
def document_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MEM4: up to three chunks of each document, longer ones first."""
    return listing.excerpts(_chunks(spark, sf_dir), F.col("token_count") >= 10).select("vault_id", "path", "ordinal", "rk")


@_register(f"WITH RECURSIVE {_HYBRID}, {_FAMILIES}, j AS (SELECT d.vault_id, fam.family_seed FROM fu JOIN d USING (doc_id) JOIN fam ON fam.vault_id = d.vault_id AND fam.path = d.path) SELECT CASE WHEN count(*) > 0 THEN (count(*) - count(DISTINCT vault_id || ':' || family_seed))::DOUBLE / count(*) ELSE 0 END AS ratio FROM j")
def family_duplication(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET12: of all resolved candidates, before the limit."""
    docs = bridge.documents(spark, sf_dir)
    members = docs.select("vault_id", "path", "doc_id").join(_families(docs), ["vault_id", "path"]).select("vault_id", "family_seed", "doc_id")
    found = hybrid.candidates(docs, bridge.vectors(spark, sf_dir), QUERY, _query_vector(spark, sf_dir), LIMIT)
    return families.duplication(found.join(members, "doc_id"))


@_register("SELECT array_to_string(list_sort(list(DISTINCT event_type)), ',') AS revision FROM events")
def index_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET4: distinct revisions, sorted and joined."""
    return listing.revision(bridge.table(spark, sf_dir, "events"), "event_type")


@_register(f"""WITH {_SNAPSHOTS}, p AS (SELECT coalesce(n.doc_id, o.doc_id) % 4 AS scope, CASE WHEN o.doc_id IS NULL OR (n.doc_id IS NOT NULL AND o.h IS DISTINCT FROM n.h) THEN 1 ELSE 0 END AS up, CASE WHEN n.doc_id IS NULL THEN 1 ELSE 0 END AS gone FROM o FULL JOIN n ON o.doc_id = n.doc_id)
    SELECT scope, sum(up)::BIGINT AS upserts, sum(gone)::BIGINT AS tombstones, CASE WHEN sum(up) > 0 OR sum(gone) > 0 THEN 'stale' ELSE 'fresh' END AS state FROM p GROUP BY 1""")
def stale_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET14, REC2, COD10."""
    old, new = (df.withColumn("scope", F.col("doc_id") % 4) for df in _snapshots(spark, sf_dir))
    return readiness.staleness(old, new, ["scope", "doc_id"], ["h"], "scope")


_GRAPH_SIGNAL = """two AS (SELECT DISTINCT b.page_id FROM e a JOIN e b ON a.href = b.href WHERE a.page_id = 0 AND b.page_id <> 0),
  gr AS (SELECT page_id AS doc_id, row_number() OVER (ORDER BY 'page:' || CAST(page_id AS VARCHAR)) AS rk FROM two QUALIFY rk <= 20)"""


def _graph_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    reached = graph.paths(_mention_edges(spark, sf_dir), _seed(spark, "page:0"), 2).where("depth = 2").select("target").distinct()
    pages = keyword.ranked(reached.orderBy("target").limit(LIMIT), [F.col("target")])
    evidence = bridge.table(spark, sf_dir, "pages").select(F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("node"), F.col("page_id").alias("doc_id"))
    return graph.signals(pages, evidence, ["doc_id"])


@_register(f"""WITH {_EDGES}, {_GRAPH_SIGNAL}, {_DOCS} {_bm25_sql('d', 'doc_id', QUERY.split(), limit=4 * LIMIT)},
    sig AS (SELECT doc_id, 1.0::DOUBLE / (60 + rk) AS term, rk FROM top UNION ALL SELECT doc_id, 0.75::DOUBLE / (60 + rk), rk FROM gr),
    fu AS (SELECT doc_id, round(sum(term), 9) AS fused, min(rk) AS best_rank FROM sig JOIN d USING (doc_id) GROUP BY 1)
    SELECT *, row_number() OVER (ORDER BY fused DESC, best_rank, doc_id) AS rk FROM fu QUALIFY rk <= {LIMIT}""")
def graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRA10, RET8: the keyword signal fused with pages that share a link with page 0."""
    docs = bridge.documents(spark, sf_dir)
    words = keyword.search(docs, QUERY, ["doc_id"], hybrid.candidate_limit(LIMIT))
    fused = fusion.fuse({"keyword": words, "graph": _graph_signal(spark, sf_dir)}, ["doc_id"]).withColumn("fused", F.round("fused", 9))
    live, _ = fusion.resolve(fused, docs.select("doc_id"), ["doc_id"])
    return keyword.ranked(live.orderBy(*hybrid.order()).limit(LIMIT), hybrid.order()).drop("kinds")


@_register(f"""WITH {_HYBRID}, {_EDGES}, {_GRAPH_SIGNAL}, a AS (SELECT doc_id, 'search' AS kind, 0 AS k, rk FROM hy UNION ALL SELECT doc_id, 'graph', 1, rk FROM gr)
    SELECT doc_id, kind, row_number() OVER (ORDER BY k, rk, doc_id) AS place FROM a""")
def evidence_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PCK3."""
    return packing.gather({"search": _hybrid(spark, sf_dir), "graph": _graph_signal(spark, sf_dir)}, ["doc_id"])


@_register("""WITH t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS k FROM conversations)
    SELECT 'c' || CAST(conv_id AS VARCHAR) || '.md' AS path, (k + 1)::INTEGER AS ordinal, role || ' ' || CAST(k AS VARCHAR) AS section, role || '-' || CAST(k AS VARCHAR) AS anchor, sha256('x' || replace(text, '#', '')) AS text_sha256 FROM t
    UNION ALL SELECT 'c' || CAST(conv_id AS VARCHAR) || '.md', 0, NULL, NULL, sha256('before') FROM conversations GROUP BY conv_id""")
def heading_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ1, PRJ2, SRC2: conversations as Markdown with frontmatter, a part before the first heading, and a heading a turn."""
    part = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t, k: F.concat(F.lit("\n## "), t["role"], F.lit(" "), k.cast("string"), F.lit("\n\nx"), F.replace(t["text"], F.lit("#"), F.lit("")), F.lit("x\n"))), "")
    raw = bridge.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.concat(F.lit("---\ntype: log\n---\nbefore"), part).alias("raw"))
    files = raw.select(F.lit("v").alias("vault_id"), F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit(".md")).alias("path"), "raw")
    found = markdown.chunks(markdown.documents(files))
    return found.select("path", "ordinal", "section", "anchor", F.sha2(F.regexp_replace("text", "x$", ""), 256).alias("text_sha256"))


@_register(f"""WITH {_CHUNKS} {_bm25_sql('d', 'doc_id', QUERY.split())} SELECT doc_id, score, rk FROM top""")
def bm25_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET1, RET2, SNK2: a stored index of postings is written, and searched by its tokens' partitions."""
    index = keyword.Index.write(bridge.documents(spark, sf_dir), ["doc_id"], ["text"], Staging(spark, "index").root)
    return index.search(QUERY, LIMIT).select("doc_id", "score", "rk")


@_register(f"""WITH {_CHUNKS}, t AS (SELECT doc_id, ordinal, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS t FROM c), p AS (SELECT doc_id, len(list_filter(range(1, len(t)), lambda i: t[i] = 'of' AND t[i + 1] = 'the')) AS n FROM t)
    SELECT doc_id, sum(n)::BIGINT AS n FROM p WHERE n > 0 GROUP BY 1""")
def phrase_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET2: a phrase from positions in a stored index; a phrase doesn't go on over the end of a chunk."""
    index = keyword.Index.write(_chunks(spark, sf_dir), ["doc_id", "ordinal"], ["text"], Staging(spark, "index").root)
    return index.frequencies(keyword.query_phrases(PHRASE)).groupBy("doc_id").agg(F.sum("f0").cast("bigint").alias("n"))


RARE = "rights apache the"


@_register(f"""WITH {_CHUNKS} {_bm25_sql('d', 'doc_id', RARE.split(), limit=3)} SELECT doc_id, score, rk, TRUE AS few_blocks FROM top""")
def blockmax_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET2: the full score's best rows from a stored index in blocks, and whether under a fifth of a hot token's were read."""
    root = Staging(spark, "blocks").root
    block_index.write(bridge.documents(spark, sf_dir), ["doc_id"], ["text"], root)
    index = block_index.BlockIndex(spark, [block_index.Part(root)], ["doc_id"], ["text"])
    few = index.reading(RARE, 3).where("token = 'the'").select((F.col("read") < 0.2 * F.col("blocks")).alias("few_blocks"))
    return index.search(RARE, 3).select("doc_id", "score", "rk").join(F.broadcast(few))  # one row


_CHANGED = """t AS (SELECT doc_id, text FROM documents WHERE doc_id % 10 <> 7), d AS (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN text || ' hention' ELSE text END AS text FROM t UNION ALL SELECT doc_id + 1000000000, text FROM documents WHERE doc_id % 10 = 1)"""


def _changes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What ``_CHANGED`` changes: rows before it that it takes away, fresh rows, and the owners that lose what they have."""
    docs, last = bridge.table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("doc_id") % 10
    new = docs.where(last != 7).withColumn("text", F.when(last == 3, F.concat("text", F.lit(" hention"))).otherwise(F.col("text"))).union(docs.where(last == 1).select(F.col("doc_id") + 1_000_000_000, "text"))
    planned = Staging(spark, "plan").write(reconcile.plan(_owned(docs), _owned(new), ["doc_id"], ["hash"]), "plan")
    gone = few(planned.where("action IN ('update', 'delete')").select("doc_id"))
    return docs.join(gone, "doc_id", "left_semi"), new.join(few(planned.where("action IN ('insert', 'update')").select("doc_id")), "doc_id", "left_semi"), gone


def _owned(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.sha2("text", 256).alias("hash"))


@_register(f"WITH {_CHANGED} SELECT doc_id, sha256(text) AS text_sha256 FROM d")
def segment_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REC5, SNK1: a snapshot read from a first segment and one of changes is what a rebuild would be."""
    store, docs = SegmentStore(spark, Staging(spark, "segments").root, ["doc_id"]), bridge.table(spark, sf_dir, "documents").select("doc_id", "text")
    _, fresh, gone = _changes(spark, sf_dir)
    base = store.write("documents", docs, _owned(docs))
    store.publish("base", {"documents": [base]})
    store.publish("delta", {"documents": [base, store.write("documents", fresh, _owned(fresh), gone)]})
    return store.read("documents").select("doc_id", F.sha2("text", 256).alias("text_sha256"))


@_register(f"""WITH {_CHANGED} {_bm25_sql('d', 'doc_id', ['hention', 'rights', 'the'])} SELECT doc_id, score, rk FROM top""")
def segment_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REC5, SNK2, SNK3: keywords in an index of two parts, with the changed documents' postings in the second, by the exact
    statistics of the new snapshot."""
    removed, fresh, gone = _changes(spark, sf_dir)
    roots = [f"{Staging(spark, 'parts').root}/{k}" for k in range(2)]
    block_index.write(bridge.table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], ["text"], roots[0], owner=["doc_id"])
    block_index.write(fresh, ["doc_id"], ["text"], roots[1], owner=["doc_id"], removed=removed)
    index = block_index.BlockIndex(spark, [block_index.Part(roots[0]), block_index.Part(roots[1], gone)], ["doc_id"], ["text"], ["doc_id"])
    return index.search("hention rights the", LIMIT).select("doc_id", "score", "rk")


@_register("""SELECT vec_id, CAST(label AS VARCHAR) AS label, 'v' || CAST(label % 4 AS VARCHAR) AS scope, CASE WHEN vec_id % 3 > 0 THEN CAST(len(embedding) AS VARCHAR) END AS dimensions FROM embeddings""")
def vector_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC8: key/value rows and back."""
    wide = bridge.vectors(spark, sf_dir).select("vec_id", F.col("label"), F.col("vault_id").alias("scope"), F.when(F.col("vec_id") % 3 > 0, F.size("embedding")).alias("dimensions"))
    fields = ("label", "scope", "dimensions")
    return vectors.manifest(vectors.entries(wide, fields, "vec_id"), fields, "vec_id")


@_register(f"WITH {_DOCS} SELECT vault_id, path, source_role FROM roles WHERE doc_id % 7 <> 0")
def document_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC7."""
    docs = _with_role(bridge.documents(spark, sf_dir)).withColumn("deleted", F.when(F.col("doc_id") % 7 == 0, True))
    return listing.export(docs).select("vault_id", "path", "source_role")


@_register(f"WITH {_CHUNKS} SELECT 'document' AS kind, count(*)::BIGINT AS n FROM d WHERE vault_id = 'en' AND path = 'raw/10.md' UNION ALL SELECT 'chunk', count(*) FROM c WHERE vault_id = 'en' AND chunk_id = sha256('chunk:en:raw/10.md:body:0')")
def point_resolves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LST6."""
    docs = bridge.documents(spark, sf_dir)
    wanted = hashlib.sha256(b"chunk:en:raw/10.md:body:0").hexdigest()
    found = {"document": listing.document(docs, "en", "raw/10.md"), "chunk": listing.chunk(bridge.chunks(docs), "en", wanted)}
    return reduce(DataFrame.union, (df.agg(F.lit(k).alias("kind"), F.count("*").alias("n")) for k, df in found.items()))


@_register(f"""WITH RECURSIVE {_CHUNKS}, {_FAMILIES}, o AS (SELECT vault_id, path, min_by(chunk_id, ordinal) AS chunk_id FROM c GROUP BY 1, 2)
    SELECT r.vault_id, family_seed, r.path, CASE WHEN source_role IN ('source_manifest', 'raw_evidence') THEN 'supporting' ELSE 'audit' END AS kind, chunk_id
    FROM roles r JOIN fam ON fam.vault_id = r.vault_id AND fam.path = r.path JOIN o ON o.vault_id = r.vault_id AND o.path = r.path WHERE source_role IN ('source_manifest', 'raw_evidence', 'generated_view', 'operation_log', 'audit_record')""")
def family_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET11."""
    docs = bridge.documents(spark, sf_dir)
    return listing.family_evidence(_with_role(docs).join(_families(docs), ["vault_id", "path"]), bridge.chunks(docs)).select("vault_id", "family_seed", "path", "kind", "chunk_id")


@_register(f"""WITH {_EDGES}, a AS (SELECT 'page:' || CAST(page_id AS VARCHAR) || '>' || href AS edge_id FROM e WHERE href IN ('/the', '/de') AND page_id % 4 IN (0, 1)) SELECT edge_id FROM a ORDER BY edge_id LIMIT 12""")
def adjacent_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRA2."""
    return _adjacent_page(spark, sf_dir)[0].select("edge_id")


@_register(f"""WITH {_EDGES}, a AS (SELECT count(*)::BIGINT AS matched FROM e WHERE href IN ('/the', '/de') AND page_id % 4 IN (0, 1)) SELECT matched, greatest(matched - 12, 0)::BIGINT AS omitted, matched > 12 AS truncated FROM a""")
def adjacent_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRA2: what the limit leaves out."""
    return _adjacent_page(spark, sf_dir)[1]


def _adjacent_page(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    page = F.regexp_extract("source", "[0-9]+$", 0).cast("bigint") % 4
    edges = _mention_edges(spark, sf_dir).withColumn("status", F.element_at(F.array(*map(F.lit, ("stated", "inferred", "contested", "deprecated"))), (page + 1).cast("int")))
    return graph.adjacent_page(edges, _seed(spark, "/the").union(_seed(spark, "/de")), "in", types=["mentions"], statuses=["stated", "inferred"], limit=12)


_ADMIT = """x AS (SELECT l_orderkey * 10 + l_linenumber AS edge_id, 'v' || CAST(l_partkey % 4 AS VARCHAR) AS source_vault, 'v' || CAST(l_suppkey % 4 AS VARCHAR) AS target_vault, l_linenumber, l_quantity FROM lineitem),
  ev AS (SELECT edge_id, 'v' || CAST(CAST(l_quantity AS BIGINT) % 5 AS VARCHAR) AS vault_id FROM x WHERE l_linenumber % 2 = 0)"""


def _admission(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vault = lambda c, n: F.concat(F.lit("v"), (F.col(c).cast("bigint") % n).cast("string"))
    edges = bridge.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge_id"), vault("l_partkey", 4).alias("source_vault"), vault("l_suppkey", 4).alias("target_vault"), vault("l_quantity", 5).alias("evidence"), "l_linenumber")
    return edges, edges.where("l_linenumber % 2 = 0").select("edge_id", F.col("evidence").alias("vault_id"))


@_register(f"""WITH {_ADMIT} SELECT source_vault, count(*)::BIGINT AS n FROM x WHERE source_vault IN ('v0', 'v1') AND target_vault = source_vault AND NOT EXISTS (SELECT 1 FROM ev WHERE ev.edge_id = x.edge_id AND ev.vault_id <> x.source_vault) GROUP BY 1""")
def admitted_in_vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRA3."""
    return graph.admitted(*_admission(spark, sf_dir), ["v0", "v1"]).groupBy("source_vault").agg(F.count("*").alias("n"))


@_register(f"""WITH {_ADMIT} SELECT source_vault, target_vault, count(*)::BIGINT AS n FROM x WHERE source_vault IN ('v0', 'v1') AND target_vault IN ('v0', 'v1') AND NOT EXISTS (SELECT 1 FROM ev WHERE ev.edge_id = x.edge_id AND ev.vault_id NOT IN ('v0', 'v1')) GROUP BY 1, 2""")
def admitted_across_vaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRA3, with edges between vaults."""
    return graph.admitted(*_admission(spark, sf_dir), ["v0", "v1"], cross_vault=True).groupBy("source_vault", "target_vault").agg(F.count("*").alias("n"))


@_register(f"""WITH {_EDGES} SELECT '/the' AS entity_id, 'deprecated' AS status, 0::BIGINT AS n_out, count(*)::BIGINT AS n_in FROM e WHERE href = '/the' HAVING count(*) > 0""")
def entity_resource(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRA4, GRA12: an entity that is no longer active, by its id."""
    edges = _mention_edges(spark, sf_dir)
    entities = edges.select(F.lit("web").alias("vault_id"), F.col("target").alias("entity_id"), F.lit("deprecated").alias("status")).distinct()
    return graph.resource(entities, edges, "web", "/the").select("entity_id", "status", "n_out", "n_in")


@_register("""SELECT user_id, event_type AS origin, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 9 END, event_type, event_id) = 1""")
def first_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEX6."""
    rows = bridge.table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("origin"), "event_id")
    return graph.first_occurrences(rows, ["user_id"], ["purchase", "click", "view"], order=["event_id"])


def _digest_sql(table: str, *columns: str) -> str:
    row = " || ".join(f"coalesce(length({c})::VARCHAR || ':' || {c}, '-')" for c in columns)
    return f"(SELECT '{table}:' || count(*)::VARCHAR || ':' || coalesce(sum(('0x' || substr(sha256({row}), 1, 15))::BIGINT), 0)::VARCHAR || ':' || coalesce(sum(('0x' || substr(sha256({row}), 16, 15))::BIGINT), 0)::VARCHAR FROM {table})"


@_register(f"""WITH {_EDGES}, edges AS (SELECT 'page:' || CAST(page_id AS VARCHAR) AS source, href AS target, 'mentions' AS type FROM e), nodes AS (SELECT DISTINCT source AS node FROM edges)
    SELECT sha256({_digest_sql("edges", "source", "target", "type")} || '|' || {_digest_sql("nodes", "node")}) AS build_id, TRUE AS same_in_any_order, TRUE AS other_rows_differ""")
def graph_build_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRA11: an id of nodes and edges, equal for other partitions and orders, and not for other rows."""
    edges = _mention_edges(spark, sf_dir).select("source", "target", "type")
    nodes = edges.select(F.col("source").alias("node")).distinct()
    ids = [graph.build_id(n, e).select(F.col("build_id").alias(f"b{k}"), F.lit(1).alias("one")) for k, (n, e) in enumerate(((nodes, edges), (nodes.orderBy(F.desc("node")), edges.repartition(7)), (nodes, edges.where("target <> '/de'"))))]
    both = ids[0].join(ids[1], "one").join(ids[2], "one")
    return both.select(F.col("b0").alias("build_id"), (F.col("b0") == F.col("b1")).alias("same_in_any_order"), (F.col("b0") != F.col("b2")).alias("other_rows_differ"))


@_register(f"""WITH {_CHUNKS}, r AS (SELECT vault_id, doc_id, chunk_id FROM c WHERE doc_id % 3 = 0), e AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN content_hash ELSE 'stale' END AS h FROM c)
    SELECT r.vault_id, e.path, count(*)::BIGINT AS n FROM r JOIN e ON e.chunk_id = r.chunk_id AND e.vault_id = r.vault_id WHERE h = content_hash GROUP BY 1, 2""")
def evidence_cross_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PCK2: evidence with an old hash doesn't resolve."""
    chunks = _chunks(spark, sf_dir).withColumn("document_id", F.col("doc_id"))
    old = chunks.withColumn("content_hash", F.when(F.col("doc_id") % 2 == 0, F.col("content_hash")).otherwise("stale"))
    refs = chunks.where("doc_id % 3 = 0").select("vault_id", "document_id", "chunk_id")
    return packing.resolved(refs, old, chunks).groupBy("vault_id", "path").agg(F.count("*").alias("n"))


_FILES = """o AS (SELECT p_brand AS repository_id, p_partkey AS file_id, p_name AS h FROM part WHERE p_partkey % 10 <> 1), n AS (SELECT p_brand AS repository_id, p_partkey AS file_id, CASE WHEN p_partkey % 10 = 3 THEN p_name || '!' ELSE p_name END AS h FROM part WHERE p_partkey % 10 <> 7)"""


def _files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = bridge.table(spark, sf_dir, "part").select(F.col("p_brand").alias("repository_id"), F.col("p_partkey").alias("file_id"), F.col("p_name").alias("h"))
    last = F.col("file_id") % 10
    return part.where(last != 1), part.where(last != 7).withColumn("h", F.when(last == 3, F.concat("h", F.lit("!"))).otherwise(F.col("h")))


@_register(f"""WITH {_FILES}, p AS (SELECT coalesce(n.repository_id, o.repository_id) AS repository_id, CASE WHEN o.file_id IS NULL THEN 'insert' WHEN n.file_id IS NULL THEN 'delete' WHEN o.h = n.h THEN 'unchanged' ELSE 'update' END AS action
      FROM (SELECT * FROM o WHERE repository_id IN ('Brand#4', 'Brand#7')) o FULL JOIN (SELECT * FROM n WHERE repository_id IN ('Brand#4', 'Brand#7')) n ON o.file_id = n.file_id UNION ALL SELECT repository_id, 'carried' FROM o WHERE repository_id NOT IN ('Brand#4', 'Brand#7'))
    SELECT repository_id, action, count(*)::BIGINT AS n FROM p GROUP BY 1, 2""")
def code_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REC4: two repositories are planned, the others carried."""
    keys = ["repository_id", "file_id"]
    return reconcile.plan_scoped(*_files(spark, sf_dir), keys, ["h"], "repository_id", ["Brand#4", "Brand#7"]).groupBy("repository_id", "action").agg(F.count("*").alias("n"))


@_register(f"""WITH {_FILES} SELECT repository_id, count(*)::BIGINT AS n, count(*) FILTER (WHERE ends_with(h, '!'))::BIGINT AS fresh FROM (SELECT * FROM n WHERE repository_id IN ('Brand#4', 'Brand#7') UNION ALL SELECT * FROM o WHERE repository_id NOT IN ('Brand#4', 'Brand#7')) GROUP BY 1""")
def code_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REC4, SNK5: the snapshot of files after the plan."""
    keys, (old, new) = ["repository_id", "file_id"], _files(spark, sf_dir)
    planned = reconcile.plan_scoped(old, new, keys, ["h"], "repository_id", ["Brand#4", "Brand#7"])
    return reconcile.apply_scoped(old, new, planned, keys).groupBy("repository_id").agg(F.count("*").alias("n"), F.count_if(F.col("h").endswith("!")).alias("fresh"))


@_register(f"""WITH {_FILES}, s AS (SELECT file_id, file_id * 10 + k AS symbol_id, h FROM n, range(3) AS t(k)), e AS (SELECT file_id * 10 AS source, (file_id + 1) * 10 + 2 AS target FROM n)
    SELECT 'symbols' AS what, count(*)::BIGINT AS n, count(*) FILTER (WHERE ends_with(h, '!'))::BIGINT AS fresh FROM s UNION ALL SELECT 'edges', count(*), 0 FROM e WHERE target IN (SELECT symbol_id FROM s)""")
def code_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK5: symbols of changed files are replaced, and edges go with their ends."""
    (old, new), keys = _files(spark, sf_dir), ["repository_id", "file_id"]
    owned = lambda files: files.select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")).select(*keys, "h", (F.col("file_id") * 10 + F.col("k")).alias("symbol_id"))
    symbols = reconcile.replace_owned(owned(old), owned(new), reconcile.plan(old, new, keys, ["h"]), keys)
    edges = reconcile.without_ends(old.unionByName(new).select((F.col("file_id") * 10).alias("source"), ((F.col("file_id") + 1) * 10 + 2).alias("target")).distinct(), symbols, "symbol_id")
    return symbols.agg(F.lit("symbols").alias("what"), F.count("*").alias("n"), F.count_if(F.col("h").endswith("!")).alias("fresh")).union(edges.agg(F.lit("edges"), F.count("*"), F.lit(0).cast("bigint")))


@_register(f"""WITH {_SNAPSHOTS}, t AS (SELECT doc_id, text FROM documents WHERE doc_id % 10 <> 7), p AS (SELECT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS token FROM (SELECT CASE WHEN doc_id % 10 = 3 THEN text || '!' ELSE text END AS text FROM t UNION ALL SELECT text FROM documents WHERE doc_id % 10 = 1))
    SELECT token, count(*)::BIGINT AS n FROM p WHERE token IN ('the', 'of', 'thing', 'de') GROUP BY 1""")
def keyword_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK2: postings of changed documents are replaced; occurrences in the new snapshot."""
    docs, last = bridge.table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("doc_id") % 10
    new = docs.where(last != 7).withColumn("text", F.when(last == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).union(docs.where(last == 1).select(F.col("doc_id") + 1_000_000_000, "text"))
    planned = reconcile.plan(*_snapshots(spark, sf_dir), ["doc_id"], ["h"])
    found = reconcile.replace_owned(keyword.postings(docs, ["doc_id"], ["text"]), keyword.postings(new, ["doc_id"], ["text"]), planned, ["doc_id"])
    return found.where(F.col("token").isin("the", "of", "thing", "de")).groupBy("token").agg(F.sum(F.size("positions")).cast("bigint").alias("n"))


@_register(f"""WITH {_EDGES}, o AS (SELECT href AS entity, list_sort(list(page_id)) AS pages FROM e WHERE page_id % 5 <> 0 GROUP BY 1), n AS (SELECT href AS entity, list_sort(list(page_id)) AS pages FROM e WHERE page_id % 7 <> 0 GROUP BY 1)
    SELECT CASE WHEN o.entity IS NULL THEN 'insert' WHEN n.entity IS NULL THEN 'delete' WHEN o.pages = n.pages THEN 'unchanged' ELSE 'update' END AS action, count(*)::BIGINT AS n FROM o FULL JOIN n ON o.entity = n.entity GROUP BY 1""")
def graph_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REC3: entities by their sets of evidence."""
    rows = bridge.mentions(spark, sf_dir)
    return reconcile.plan_aggregates(rows.where("page_id % 5 <> 0"), rows.where("page_id % 7 <> 0"), ["href"], "page_id").groupBy("action").agg(F.count("*").alias("n"))


@_register(f"WITH {_EDGES} SELECT href AS entity, count(*)::BIGINT AS evidence_n, min(page_id) AS first_page FROM e WHERE page_id % 7 <> 0 GROUP BY 1")
def graph_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK4, REC3: the evidence of entities whose sets of it differ is replaced; what the new snapshot holds."""
    rows = bridge.mentions(spark, sf_dir)
    old, new = rows.where("page_id % 5 <> 0"), rows.where("page_id % 7 <> 0")
    planned = Staging(spark, "plan").write(reconcile.plan_aggregates(old, new, ["href"], "page_id"), "plan")
    found = reconcile.replace_owned(old, new, planned, ["href"])
    return found.groupBy(F.col("href").alias("entity")).agg(F.count("*").alias("evidence_n"), F.min("page_id").alias("first_page"))


@_register("""SELECT label, count(*)::BIGINT AS n, sum(list_sum(list_transform(embedding, lambda x: floor(64 * CASE WHEN vec_id % 10 = 3 THEN -(x::DOUBLE) ELSE x::DOUBLE END)::BIGINT)))::BIGINT AS total FROM embeddings WHERE vec_id % 10 <> 7 GROUP BY 1""")
def vector_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK3: vectors of changed rows are replaced, those of deleted ones go; sums of the new snapshot by label."""
    old, last = bridge.table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"), F.col("vec_id") % 10
    new = old.where(last != 7).withColumn("embedding", F.when(last == 3, F.transform("embedding", lambda x: -x)).otherwise(F.col("embedding")))
    owned = lambda df: df.select("vec_id", F.sha2(F.to_json("embedding"), 256).alias("h"))
    planned = Staging(spark, "plan").write(reconcile.plan(owned(old), owned(new), ["vec_id"], ["h"]), "plan")
    found = reconcile.replace_owned(old, new, planned, ["vec_id"])
    total = F.aggregate("embedding", F.lit(0).cast("bigint"), lambda a, x: a + F.floor(64 * x.cast("double")))
    return found.groupBy("label").agg(F.count("*").alias("n"), F.sum(total).alias("total"))


_SYMBOL_ROWS = """sy AS (SELECT p_partkey AS symbol_id, p_brand AS repository_id, lower(p_type) || '/' || replace(p_name, ' ', '_') || '.py' AS relative_path, replace(p_name, ' ', '_') AS name, p_brand || '.' || p_type || '.' || replace(p_name, ' ', '_') AS qualified_name,
    'def ' || replace(p_name, ' ', '_') || '()' AS signature, 'python' AS language, CASE p_size % 3 WHEN 0 THEN 'class' WHEN 1 THEN 'function' ELSE 'test' END AS kind, p_size AS start_line FROM part)"""


def _symbol_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    kind = F.when(F.col("p_size") % 3 == 0, "class").when(F.col("p_size") % 3 == 1, "function").otherwise("test")
    return bridge.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("symbol_id"), F.col("p_brand").alias("repository_id"), F.concat(F.lower("p_type"), F.lit("/"), name, F.lit(".py")).alias("relative_path"), name.alias("name"), F.concat_ws(".", "p_brand", "p_type", name).alias("qualified_name"),
        F.concat(F.lit("def "), name, F.lit("()")).alias("signature"), F.lit("python").alias("language"), kind.alias("kind"), F.col("p_size").alias("start_line"),
    )


def _symbol_sql(where: str) -> str:
    return f"""{_SYMBOL_ROWS}, tk AS (SELECT *, list_transform([relative_path, name, qualified_name, signature, language, kind], lambda x: regexp_extract_all(lower(x), '[\\p{{L}}\\p{{N}}]+')) AS t FROM sy),
  fr AS (SELECT *, list_sum(list_transform(t, lambda x: len(x))) AS length, list_sum(list_transform(t, lambda x: len(list_filter(x, lambda y: y = 'red')))) AS f0, list_sum(list_transform(t, lambda x: len(list_filter(range(1, len(x)), lambda i: x[i] = 'widget' AND x[i + 1] = 'py')))) AS f1 FROM tk),
  st AS (SELECT count(*)::DOUBLE AS n, avg(length)::DOUBLE AS average, count(*) FILTER (WHERE f0 > 0) AS n0, count(*) FILTER (WHERE f1 > 0) AS n1 FROM fr),
  sc AS (SELECT symbol_id, repository_id, relative_path, start_line, round(-(greatest(ln((n - n0 + 0.5) / (n0 + 0.5)), 0) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * length / average)) + greatest(ln((n - n1 + 0.5) / (n1 + 0.5)), 0) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * length / average))), 6) AS score FROM fr, st WHERE f0 > 0 AND f1 > 0 AND {where}),
  found AS (SELECT symbol_id, score, row_number() OVER (ORDER BY score, repository_id, relative_path, start_line, symbol_id) AS rk FROM sc QUALIFY rk <= {LIMIT})"""


@_register(f"""WITH {_symbol_sql("kind IN ('class', 'function') AND starts_with(relative_path, 'economy')")} SELECT * FROM found""")
def symbol_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """COD6: six fields, a word of two tokens, filters by kind and path."""
    return code_graph.search(_symbol_rows(spark, sf_dir), "red widget_py", LIMIT, kinds=["class", "function"], path_prefix="economy/")


@_register("""WITH p AS (SELECT p_partkey AS pending_id, p_brand AS repository_id, p_partkey AS file_id, CASE p_partkey % 3 WHEN 0 THEN replace(p_name, ' ', '_') WHEN 1 THEN p_type || '.' || replace(p_name, ' ', '_') ELSE 'no.such' END AS reference FROM part),
    s AS (SELECT p_brand AS repository_id, replace(p_name, ' ', '_') AS n, p_type || '.' || replace(p_name, ' ', '_') AS tn FROM part WHERE p_partkey % 50 = 1)
    SELECT pending_id FROM p WHERE file_id % 50 = 1 OR EXISTS (SELECT 1 FROM s WHERE s.repository_id = p.repository_id AND (reference = n OR reference = tn OR regexp_extract(reference, '[^.]*$') = n))""")
def pending_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """COD5: one file of 50 has changed."""
    part = bridge.table(spark, sf_dir, "part")
    name, key = F.replace("p_name", F.lit(" "), F.lit("_")), F.col("p_partkey")
    reference = F.when(key % 3 == 0, name).when(key % 3 == 1, F.concat_ws(".", "p_type", name)).otherwise("no.such")
    pending = part.select(key.alias("pending_id"), F.col("p_brand").alias("repository_id"), key.alias("file_id"), reference.alias("reference"))
    symbols = part.select(F.col("p_brand").alias("repository_id"), key.alias("file_id"), F.concat_ws(".", "p_type", name).alias("qualified_name"))
    return code_graph.retried(pending, symbols, pending.where("file_id % 50 = 1").select("file_id")).select("pending_id")


_PROJECT = f"""WITH RECURSIVE {_symbol_sql("TRUE")}, call AS (SELECT symbol_id + 1 AS source, symbol_id AS target FROM sy WHERE symbol_id + 1 IN (SELECT symbol_id FROM sy)),
    w AS (SELECT symbol_id AS node, 0 AS level FROM found UNION SELECT call.source, level + 1 FROM w JOIN call ON call.target = w.node WHERE level < 2),
    near AS (SELECT node, min(level) AS level FROM w GROUP BY 1 HAVING min(level) > 0)
    SELECT 'code' AS section, 'code:' || CAST(found.symbol_id AS VARCHAR) AS evidence_id, qualified_name AS title, rk::BIGINT AS rk FROM found JOIN sy ON sy.symbol_id = found.symbol_id
    UNION ALL SELECT CASE kind WHEN 'test' THEN 'tests' ELSE 'impact' END, 'code:' || CAST(node AS VARCHAR), qualified_name, level::BIGINT FROM near JOIN sy ON sy.symbol_id = node
    UNION ALL SELECT 'vault', 'doc:' || CAST(doc_id AS VARCHAR), path, rk FROM (WITH {_HYBRID} SELECT doc_id, d.path, hy.rk FROM hy JOIN d USING (doc_id))"""


@_register(_PROJECT)
def project_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRX1: what a task finds in code, what calls that, and what the vaults' hybrid search finds."""
    symbols = _symbol_rows(spark, sf_dir)
    edges = symbols.select((F.col("symbol_id") + 1).cast("string").alias("source"), F.col("symbol_id").cast("string").alias("target"), F.lit("inferred").alias("status"))
    found = _hybrid(spark, sf_dir).join(bridge.documents(spark, sf_dir).select("doc_id", "path"), "doc_id")
    vault = found.select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("evidence_id"), F.col("path").alias("title"), "rk")
    return project.evidence(symbols, edges, vault, "red widget_py", LIMIT, depth=2)


@_register(f"""WITH RECURSIVE r AS ({_PROJECT}),
    k AS (SELECT *, greatest(ceil(length('{{"section":"' || section || '","evidence_id":"' || evidence_id || '","title":"' || title || '"}}') / 4), 1)::BIGINT AS cost, row_number() OVER (ORDER BY section, rk, evidence_id) AS place FROM r),
    f AS (SELECT evidence_id, place, cost <= {BUDGET} AS admitted, CASE WHEN cost <= {BUDGET} THEN cost ELSE 0 END AS used FROM k WHERE place = 1 UNION ALL SELECT k.evidence_id, k.place, f.used + k.cost <= {BUDGET}, f.used + CASE WHEN f.used + k.cost <= {BUDGET} THEN k.cost ELSE 0 END FROM f JOIN k ON k.place = f.place + 1)
    SELECT evidence_id, admitted, used::BIGINT AS used FROM f""")
def project_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRX1: that evidence in order of section under a budget of serialized size."""
    return project.context(project_evidence(spark, sf_dir), BUDGET).select("evidence_id", "admitted", "used")


@_register("SELECT CASE WHEN count(*) FILTER (WHERE event_type = 'error') > 0 THEN 'unavailable' ELSE 'fresh' END AS state FROM events")
def project_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRX1: the most severe state of all authorities."""
    states = bridge.table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "error", "unavailable").when(F.col("event_type") == "view", "unknown").otherwise("fresh").alias("state"))
    return project.combined(states)


@_register(f"""WITH {_DOCS}, h AS (SELECT doc_id, section FROM d WHERE section IS NOT NULL UNION ALL SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'Overview' WHEN 1 THEN 'Appendix' WHEN 2 THEN 'Introduction' WHEN 3 THEN 'Links' ELSE 'TODO' END FROM d)
    SELECT section AS name, count(*)::BIGINT AS n FROM h WHERE lower(section) NOT IN ('overview', 'summary', 'notes', 'todo', 'appendix', 'references') GROUP BY 1""")
def heading_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEX1: headings are concepts, unless they are generic."""
    docs = bridge.with_frontmatter(bridge.documents(spark, sf_dir)).withColumn("title", F.lit(None).cast("string"))
    other = F.element_at(F.array(*map(F.lit, ("Overview", "Appendix", "Introduction", "Links", "TODO", "TODO", "TODO"))), (F.col("doc_id") % 7 + 1).cast("int"))
    chunk = lambda df, section, n: df.select("vault_id", F.concat_ws(":", F.lit(n), F.col("doc_id").cast("string")).alias("chunk_id"), "path", section.alias("section"), F.lit("none").alias("text"))
    chunks = chunk(docs.where("section IS NOT NULL"), F.col("section"), "a").unionByName(chunk(docs, other, "b"))
    return entities.occurrences(chunks, docs).where("origin = 'heading'").groupBy("name").agg(F.count("*").alias("n"))


@_register(f"""WITH {_DOCS}, t AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM d)
    SELECT doc_id, sha256(CASE WHEN length(flat) > 240 THEN rtrim(substr(flat, 1, 237)) || '...' ELSE flat END) AS excerpt, sha256(substr(flat, 1, 240)) AS hard, sha256(array_to_string(list_filter(string_split(flat, ' '), lambda w: w <> '')[:30], ' ')) AS words FROM t""")
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ10: with dots, hard, and by words."""
    sha = lambda c, name: F.sha2(c, 256).alias(name)
    text = F.col("text")
    return bridge.documents(spark, sf_dir).select("doc_id", sha(excerpt(text), "excerpt"), sha(hard_excerpt(text), "hard"), sha(first_words(text, 30), "words"))


_TYPES = """ty AS (SELECT *, lower(concat_ws(' ', coalesce(fm_type, ''), path, coalesce(section, ''), '')) AS tx, coalesce(fm_type, '') AS k FROM d),
  it AS (SELECT *, CASE WHEN k = 'decision' OR contains('/' || path, '/decisions/') THEN 'decision' WHEN k = 'constraint' OR regexp_matches(tx, 'constraint|principle|invariant|policy|convention') THEN 'constraint'
    WHEN k = 'open_question' OR regexp_matches(tx, 'question|todo|follow-up|issue|revisit') THEN 'open_question' WHEN k = 'current_state' OR regexp_matches(tx, 'current-state|current_state') THEN 'current_state' WHEN path LIKE 'raw/%' THEN 'source' ELSE 'page' END AS item_type FROM ty)"""
_TYPED = f"{_DOCS}, {_TYPES}"


@_register(f"WITH {_TYPED} SELECT item_type, count(*)::BIGINT AS n FROM it GROUP BY 1")
def item_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ11."""
    kind = item_type(F.col("path"), F.col("fm_type"), F.col("section"), F.lit(None).cast("string"))
    return bridge.documents(spark, sf_dir).groupBy(kind.alias("item_type")).agg(F.count("*").alias("n"))


@_register(f"""WITH RECURSIVE {_HYBRID}, {_TYPES}, r AS (SELECT it.doc_id, item_type, hy.rk, kinds, vault_id, path, len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'))::BIGINT AS cost FROM hy JOIN it USING (doc_id)),
    o AS (SELECT *, row_number() OVER (ORDER BY CASE item_type WHEN 'decision' THEN 0 WHEN 'constraint' THEN 1 WHEN 'open_question' THEN 2 WHEN 'current_state' THEN 3 WHEN 'page' THEN 4 ELSE 5 END, rk, -kinds, CASE WHEN path LIKE 'raw/%' THEN 1 ELSE 0 END, vault_id, path, CAST(doc_id AS VARCHAR)) AS k FROM r),
    f AS (SELECT doc_id, item_type, k, cost > 0 OR TRUE AS x, cost <= 1200 AS ok, CASE WHEN cost <= 1200 THEN cost ELSE 0 END AS used FROM o WHERE k = 1 UNION ALL SELECT o.doc_id, o.item_type, o.k, TRUE, f.used + o.cost <= 1200, f.used + CASE WHEN f.used + o.cost <= 1200 THEN o.cost ELSE 0 END FROM f JOIN o ON o.k = f.k + 1)
    SELECT doc_id, item_type AS section, used::BIGINT AS used FROM f WHERE ok""")
def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PCK1: search results in order of type, rank, signals and source, a budget with skips, sections by type."""
    docs = bridge.documents(spark, sf_dir).withColumn("item_type", item_type(F.col("path"), F.col("fm_type"), F.col("section"), F.lit(None).cast("string")))
    items = _costed(spark, sf_dir).join(docs, "doc_id").select("doc_id", "item_type", "rk", "kinds", "vault_id", "path", F.col("doc_id").cast("string").alias("chunk_id"), "cost")
    return packing.pack(items, 1200, max_items=1000).select("doc_id", "section", "used")


_STATUSES = "CASE page_id % 4 WHEN 0 THEN 'stated' WHEN 1 THEN 'inferred' WHEN 2 THEN 'contested' ELSE 'deprecated' END"


def _status_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.regexp_extract("source", "[0-9]+$", 0).cast("bigint") % 4
    return _mention_edges(spark, sf_dir).withColumn("status", F.element_at(F.array(*map(F.lit, ("stated", "inferred", "contested", "deprecated"))), (page + 1).cast("int")))


@_register(f"""WITH {_EDGES}, w AS (SELECT page_id, href, {_STATUSES} AS status, CASE page_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.75 WHEN 2 THEN 0.45 ELSE 0.0 END AS weight FROM e)
    SELECT a.href AS via, 'page:' || CAST(b.page_id AS VARCHAR) AS target, CASE WHEN a.weight <= b.weight THEN a.status ELSE b.status END AS status FROM w a JOIN w b ON a.href = b.href WHERE a.page_id = 5 AND b.page_id <> 5""")
def path_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRA9: a path is as sure as its weakest edge."""
    found = graph.paths(_status_edges(spark, sf_dir), _seed(spark, "page:5"), 2).where("depth = 2")
    return found.select(F.element_at("nodes", 2).alias("via"), "target", graph.weakest(F.col("statuses")).alias("status"))


@_register(f"""WITH {_EDGES}, w AS (SELECT page_id, href, 'page:' || CAST(page_id AS VARCHAR) || '>' || href AS id, 0.7::DOUBLE * CASE page_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.75 WHEN 2 THEN 0.45 ELSE 0.0 END AS w FROM e),
    p AS (SELECT id AS ids, id AS last, page_id AS page, href AS target, 1 AS depth, w AS score FROM w WHERE page_id = 5
      UNION ALL SELECT a.id || '|' || b.id, b.id, b.page_id, 'page:' || CAST(b.page_id AS VARCHAR), 2, least(a.w, b.w) * 0.6 FROM w a JOIN w b ON a.href = b.href WHERE a.page_id = 5 AND b.page_id <> 5),
    t AS (SELECT *, row_number() OVER (ORDER BY score DESC, depth, target, ids) AS rk FROM p QUALIFY rk <= 20), s AS (SELECT page AS doc_id, min(rk) AS best FROM t GROUP BY 1)
    SELECT doc_id, row_number() OVER (ORDER BY best, doc_id) AS rk FROM s""")
def path_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRA10: the evidence of each path's last edge, which is the page that the edge is from."""
    edges = _status_edges(spark, sf_dir)
    evidence = edges.select("edge_id", F.regexp_extract("source", "[0-9]+$", 0).cast("bigint").alias("doc_id"))
    return graph.edge_signals(graph.paths(edges, _seed(spark, "page:5"), 2), evidence, ["doc_id"], 20)


_PROJECTED = """b AS (SELECT doc_id, lang, source, 'v' || (doc_id % 2) AS v, CASE n_chars % 3 WHEN 0 THEN 'blocks' WHEN 1 THEN 'depends_on' ELSE 'noted' END AS type, CASE WHEN doc_id % 4 = 0 THEN 'inferred' ELSE 'stated' END AS status, (1 + doc_id % 7)::DOUBLE / 10 AS confidence FROM documents),
    x AS (SELECT * FROM (SELECT 's:' || doc_id AS edge_id, v AS sv, 's:' || source AS s, v AS tv, 'd:' || doc_id AS t, type, status, confidence FROM b UNION ALL SELECT 'g:' || doc_id, 'v0', 'g:' || lang, v, 'd:' || doc_id, type, status, confidence FROM b) WHERE sv = tv),
    seed AS (SELECT 'v0' AS v, 's:src0' AS id UNION ALL SELECT 'v0', 'g:en' UNION ALL SELECT 'v0', 'd:' || min(doc_id) FROM documents WHERE source = 'src0' AND doc_id % 2 = 0),
    sides AS (SELECT *, sv AS fv, s AS f, tv AS gv, t AS g FROM x UNION ALL SELECT *, tv, t, sv, s FROM x),
    one AS (SELECT q.* FROM sides q JOIN seed ON q.fv = seed.v AND q.f = seed.id), two AS (SELECT q.* FROM sides q WHERE (q.fv, q.f) IN (SELECT (gv, g) FROM one)),
    used AS (SELECT * FROM (SELECT DISTINCT edge_id, sv, s, tv, t, type, status, confidence FROM (SELECT * FROM one UNION ALL SELECT * FROM two)) ORDER BY sv, tv, type, edge_id, t LIMIT 500),
    st AS (SELECT edge_id, type, confidence * CASE status WHEN 'stated' THEN 1.0 ELSE 0.75 END AS w, sv AS fv, s AS f, tv AS gv, t AS g FROM used UNION ALL SELECT edge_id, type, confidence * CASE status WHEN 'stated' THEN 1.0 ELSE 0.75 END, tv, t, sv, s FROM used),
    p1 AS (SELECT seed.v AS sdv, seed.id AS sd, gv, g, [edge_id] AS ids, [type] AS types, w, 1 AS depth FROM st JOIN seed ON fv = seed.v AND f = seed.id),
    p2 AS (SELECT a.sdv, a.sd, st.gv, st.g, list_append(a.ids, st.edge_id), list_append(a.types, st.type), least(a.w, st.w), 2 FROM p1 a JOIN st ON st.fv = a.gv AND st.f = a.g WHERE st.g <> a.sd),
    p AS (SELECT *, w * CASE depth WHEN 1 THEN 1.0 ELSE 0.6 END AS score FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2) q WHERE NOT EXISTS (SELECT 1 FROM seed WHERE seed.v = q.gv AND seed.id = q.g)),
    pr AS (SELECT *, row_number() OVER (ORDER BY score DESC, depth, CASE types[1] WHEN 'depends_on' THEN 2 WHEN 'blocks' THEN 3 ELSE 7 END, types[1], gv, 'n' || g, ids[1], ids, sdv, sd) AS rk FROM p)"""


def _projected(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents, their sources and languages as nodes; three seeds that edges link, two of them hubs."""
    docs = bridge.table(spark, sf_dir, "documents")
    vault = F.concat(F.lit("v"), (F.col("doc_id") % 2).cast("string"))
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    kind = F.when(F.col("n_chars") % 3 == 0, "blocks").when(F.col("n_chars") % 3 == 1, "depends_on").otherwise("noted")
    said = (kind.alias("type"), F.when(F.col("doc_id") % 4 == 0, "inferred").otherwise("stated").alias("status"), ((1 + F.col("doc_id") % 7).cast("double") / 10).alias("confidence"))
    edge = lambda p, v, c: docs.select(name(p, "doc_id").alias("edge_id"), v.alias("source_vault"), name(p, c).alias("source"), vault.alias("target_vault"), name("d:", "doc_id").alias("target"), *said)
    edges = edge("s:", vault, "source").union(edge("g:", F.lit("v0"), "lang"))
    ids = edges.select(F.col("source_vault").alias("vault_id"), F.col("source").alias("entity_id")).union(edges.select("target_vault", "target")).distinct()
    nodes = Staging(spark, "nodes").write(ids.withColumn("normalized_name", F.concat(F.lit("n"), F.col("entity_id"))), "nodes")
    first = docs.where("source = 'src0' AND doc_id % 2 = 0").agg(F.concat(F.lit("d:"), F.min("doc_id").cast("string")).alias("entity_id"))
    seeds = spark.range(1).select(F.explode(F.array(F.lit("s:src0"), F.lit("g:en"))).alias("entity_id")).union(first).withColumn("vault_id", F.lit("v0"))
    return graph.projection(edges, nodes, seeds, 2, 50, statuses=("stated", "inferred"))


@_register(f"""WITH {_PROJECTED} SELECT sd AS seed, g AS target, array_to_string(ids, '|') AS edge_ids, depth, round(score, 9) AS score, depth || '-edge graph path via ' || array_to_string(types, ' -> ') AS explanation, rk FROM pr WHERE rk <= 50""")
def bounded_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRA6: the best paths over the first 500 edges around three seeds, in the order of seven keys."""
    found = _projected(spark, sf_dir)[0]
    return found.select("seed", "target", F.array_join("edge_ids", "|").alias("edge_ids"), "depth", F.round("score", 9).alias("score"), "explanation", "rk")


@_register(f"""WITH {_PROJECTED} SELECT (SELECT count(*) FROM used)::BIGINT AS edge_count, (SELECT count(*) FROM used) >= 500 OR (SELECT count(*) FROM pr) > 50 AS truncated""")
def bounded_paths_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRA6: how many edges the search worked on, and whether it left out edges or paths."""
    return _projected(spark, sf_dir)[1]


@_register(f"""WITH {_EDGES}, n AS (SELECT lower(trim(regexp_replace(href, '^/', ''))) AS name, count(*) AS c FROM e GROUP BY 1), m AS (SELECT name, CASE WHEN name = 'the,' THEN 3 WHEN contains(name, 'the,') THEN 5 END AS match_rank FROM n), b AS (SELECT * FROM m WHERE match_rank IS NOT NULL QUALIFY match_rank = min(match_rank) OVER ())
    SELECT name, match_rank, count(*) OVER () > 1 AS ambiguous FROM b""")
def target_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRA7: what a related query starts from, and whether that is one entity."""
    known = _concepts(spark, sf_dir).withColumn("status", F.lit("active"))
    return graph.resolve_target(known, "the,").join(known.select("entity_id", F.col("normalized_name").alias("name")), "entity_id").select("name", "match_rank", "ambiguous")


@_register(f"""WITH {_DOCS}, c AS (SELECT vault_id, doc_id % 50 AS part, count(*) AS n, count(fm_type) AS typed, max(source_role) AS role FROM roles WHERE doc_id % 11 <> 0 GROUP BY 1, 2), x AS (SELECT vault_id, doc_id % 50 AS part, count(*) AS n, count(fm_type) AS typed, max(source_role) AS role FROM roles GROUP BY 1, 2)
    SELECT x.vault_id, x.part, CASE WHEN c.n IS NULL THEN 'unavailable' WHEN x.n = c.n AND x.typed = c.typed AND x.role = c.role THEN 'fresh' ELSE 'stale' END AS state,
      CASE WHEN c.n IS NOT NULL THEN array_to_string(list_filter([CASE WHEN x.n <> c.n THEN 'n' END, CASE WHEN x.typed <> c.typed THEN 'typed' END, CASE WHEN x.role <> c.role THEN 'role' END], lambda f: f IS NOT NULL), ',') END AS differs
    FROM x LEFT JOIN c ON c.vault_id = x.vault_id AND c.part = x.part""")
def lineage_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRA13."""
    docs = _with_role(bridge.documents(spark, sf_dir))
    sums = lambda df: df.groupBy("vault_id", (F.col("doc_id") % 50).alias("part")).agg(F.count("*").alias("n"), F.count("fm_type").alias("typed"), F.max("source_role").alias("role"))
    return readiness.lineage(sums(docs.where("doc_id % 11 <> 0")), sums(docs), ["vault_id", "part"], ["n", "typed", "role"]).withColumn("differs", F.array_join("differs", ","))


@_register(f"""WITH u AS (SELECT event_type AS vault_id, 'document' AS kind, CAST(event_id AS VARCHAR) AS item, ts AS occurred_at FROM events WHERE event_id % 3 > 0 UNION ALL SELECT event_type, 'status', CAST(event_id AS VARCHAR), CASE WHEN event_id % 6 > 0 THEN ts END FROM events WHERE event_id % 3 = 0)
    SELECT *, row_number() OVER (PARTITION BY vault_id ORDER BY occurred_at DESC NULLS LAST, kind, item) AS rk FROM u WHERE occurred_at > TIMESTAMP '{SINCE}' OR (occurred_at IS NULL AND kind = 'status') QUALIFY rk <= 2000""")
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MEM5: documents and status items, those without a time last."""
    rows = bridge.table(spark, sf_dir, "events").select(F.col("event_type").alias("vault_id"), F.col("event_id").alias("item"), F.col("ts").alias("occurred_at"))
    statuses = rows.where("item % 3 = 0").withColumn("occurred_at", F.when(F.col("item") % 6 > 0, F.col("occurred_at")))
    return memory.timeline(rows.where("item % 3 > 0"), statuses, F.lit(SINCE).cast("timestamp_ntz"), 2000)


@_register(f"""WITH {_CHUNKS}, k AS (SELECT vault_id, chunk_id FROM c WHERE doc_id % 9 <> 4) SELECT 'keyword' AS store, count(*)::BIGINT AS n, count(*) FILTER (WHERE chunk_id NOT IN (SELECT chunk_id FROM k))::BIGINT AS dangling FROM c
    UNION ALL SELECT 'vector', count(*), count(*) FILTER (WHERE chunk_id NOT IN (SELECT chunk_id FROM k)) FROM c WHERE doc_id % 2 = 0""")
def dangling_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUD1."""
    chunks = _chunks(spark, sf_dir)
    return memory.dangling({"keyword": chunks, "vector": chunks.where("doc_id % 2 = 0")}, chunks.where("doc_id % 9 <> 4"))


@_register("""WITH n AS (SELECT p_partkey AS id, p_brand AS scope FROM part), e AS (SELECT l_partkey AS source, l_suppkey AS target FROM lineitem)
    SELECT 'repeated' AS fault, count(*)::BIGINT AS n FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'crossing', count(*) FROM e JOIN n a ON a.id = source JOIN n b ON b.id = target WHERE a.scope <> b.scope
    UNION ALL SELECT 'uncovered', count(*) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)""")
def plan_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REC6: what has to be empty for a valid plan."""
    line, part = bridge.table(spark, sf_dir, "lineitem"), bridge.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("scope"))
    faults = {
        "repeated": reconcile.violations(line, ["l_orderkey"]), "crossing": reconcile.crossing(line.select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target")), part, "id", "scope"),
        "uncovered": reconcile.uncovered(line.select(F.col("l_partkey").alias("id")), part, ["id"]),
    }
    return reduce(DataFrame.union, (df.agg(F.lit(k).alias("fault"), F.count("*").alias("n")) for k, df in faults.items()))


@_register("""WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS size FROM embeddings),
    s AS (SELECT q.vec_id AS query_id, n.vec_id, round(coalesce(list_inner_product(q.v, n.v) / nullif(q.size * n.size, 0), 0), 6) AS score FROM n q JOIN n ON n.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
    SELECT query_id, string_agg(vec_id, ',' ORDER BY score DESC, vec_id) AS nearest, TRUE AS recall_is_enough, TRUE AS reads_are_few FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10) GROUP BY 1""")
def approximate_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET6: the ten nearest of every hundredth vector, and whether the index at its defaults finds nine of ten of all of
    them and reads a fifth of the vectors' bytes at most."""
    rows = bridge.vectors(spark, sf_dir).select("vec_id", "embedding")
    index = inverted_file.InvertedFile.write(rows, "vec_id", Staging(spark, "vectors").root)
    asked = rows.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query")
    wanted = Staging(spark, "nearest").write(inverted_file.exact(rows, asked, "vec_id", 10), "exact")
    found = inverted_file.recall(index.search_all(asked, 10), wanted, "vec_id")
    nearest = wanted.groupBy(F.col("query").alias("query_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rk", "vec_id"))), lambda r: r["vec_id"].cast("string")), ",").alias("nearest"))
    flags = found.select((F.col("recall") >= 0.9).alias("recall_is_enough"), F.lit(index.read_share(10) <= 0.2).alias("reads_are_few"))
    return nearest.join(F.broadcast(flags))  # one row


@_register("""WITH p AS (SELECT doc_id AS k, 'lib' || doc_id AS m, 'C' || doc_id AS c, source AS b, CASE WHEN n_chars % 2 = 0 THEN 'mixin' ELSE 'class' END AS kind, n_chars AS z FROM documents)
    SELECT k AS doc_id, 'symbol' AS what, x[1] AS owner, x[2] AS name FROM (SELECT k, unnest([['module', m], [kind, m || '.' || c], ['property', m || '.' || c || '.size'], ['method', m || '.' || c || '.run'], ['test', m || '.test' || k]]) AS x FROM p)
    UNION ALL SELECT k, x[1], x[2], x[3] FROM (SELECT k, unnest([['IMPORTS', m, 'package:x/' || b || '.dart'], ['IMPLEMENTS', m || '.' || c, b], ['CALLS', m || '.' || c || '.size', 'make'], ['CALLS', m || '.' || c || '.run', 'helper'], ['CALLS', m || '.' || c || '.run', 'dynamic:other.m' || z], ['CALLS', m || '.' || c || '.run', 'Base.named'],
      ['CALLS', m || '.test' || k, c], ['TESTS', m || '.test' || k, c], ['DEFINES', m, m || '.' || c], ['DEFINES', m, m || '.test' || k], ['CONTAINS', m || '.' || c, m || '.' || c || '.size'], ['CONTAINS', m || '.' || c, m || '.' || c || '.run']]) AS x FROM p)
    UNION ALL SELECT k, 'diagnostic', NULL, 'unsupported_construct:10:enum' FROM p WHERE z % 3 = 0""")
def dart_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """COD2: symbols, references and diagnostics of a Dart file made from each document's source and size."""
    key, size, brand = F.col("doc_id").cast("string"), F.col("n_chars").cast("string"), F.col("source")
    head = F.when(F.col("n_chars") % 2 == 0, F.concat(F.lit("mixin C"), key, F.lit(" on "), brand)).otherwise(F.concat(F.lit("abstract class C"), key, F.lit("<T> implements "), brand, F.lit("<T>")))
    text = F.concat(
        F.lit("library lib"), key, F.lit(";\nimport 'package:x/"), brand, F.lit(".dart' as x; // class No {}\n@deprecated\n"), head, F.lit(" {\n  final int size = make("), size, F.lit(");\n  Future<void> run(String s) async { helper('}$s{'); other.m"), size, F.lit("(1); if (s.isEmpty) { const Base.named(); } }\n}\n/* { */\nvoid test"), key, F.lit("() => C"), key, F.lit("();\n"), F.when(F.col("n_chars") % 3 == 0, "enum E { a, b }\n").otherwise(""),
    )
    files = bridge.table(spark, sf_dir, "documents").select(key.alias("file_id"), F.concat(F.lit("lib/"), key, F.lit(".dart")).alias("path"), F.lit("dart").alias("language"), text.alias("text"))
    read = code.parsed(files).select("file_id", F.explode(F.concat(
        F.transform("symbols", lambda x: F.struct(F.lit("symbol").alias("what"), x["kind"].alias("owner"), x["qualified_name"].alias("name"))),
        F.transform("references", lambda x: F.struct(x["relation"].alias("what"), x["source"].alias("owner"), x["reference"].alias("name"))),
        F.transform("diagnostics", lambda x: F.struct(F.lit("diagnostic").alias("what"), F.lit(None).cast("string").alias("owner"), x.alias("name"))),
    )).alias("x"))
    return read.select(F.col("file_id").cast("bigint").alias("doc_id"), "x.what", "x.owner", "x.name")


@_register(f"WITH {_symbol_sql('TRUE')} SELECT symbol_id, name FROM sy WHERE relative_path = 'economy/red_widget.py'")
def file_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """COD9."""
    return code_graph.outline(_symbol_rows(spark, sf_dir).withColumnsRenamed({"relative_path": "path", "start_line": "line"}), "economy/red_widget.py").select("symbol_id", "name")


@_register(f"""WITH {_SYMBOL_ROWS}, w AS (SELECT unnest(['7', 'red_widget', 'none']) AS wanted), f AS (SELECT wanted, symbol_id, CASE WHEN CAST(symbol_id AS VARCHAR) = wanted THEN 1 WHEN qualified_name = wanted THEN 2 WHEN name = wanted THEN 3 END AS r FROM w, sy),
    b AS (SELECT * FROM f WHERE r IS NOT NULL QUALIFY r = min(r) OVER (PARTITION BY wanted)) SELECT wanted, min(symbol_id)::BIGINT AS symbol_id FROM b GROUP BY 1 HAVING count(*) = 1""")
def symbol_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """COD9: by id, else by a name that one symbol has."""
    symbols = _symbol_rows(spark, sf_dir).withColumn("symbol_id", F.col("symbol_id").cast("string"))
    found = [code_graph.named(symbols, w).select(F.lit(w).alias("wanted"), F.col("symbol_id").cast("bigint").alias("symbol_id")) for w in ("7", "red_widget", "none")]
    return reduce(DataFrame.union, found)


@_register(f"WITH {_CHUNKS} SELECT c.doc_id, ordinal, c.vault_id || ':' || chunk_id || ':rank-' || CAST(ordinal + 1 AS VARCHAR) AS result_id, coalesce(d.section, regexp_replace(regexp_extract(c.path, '[^/]*$'), '\\.md$', '')) AS title FROM c JOIN d ON d.doc_id = c.doc_id")
def result_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET15."""
    docs = bridge.documents(spark, sf_dir)
    rows = bridge.chunks(docs).join(docs.select("doc_id", "section"), "doc_id")
    return rows.select("doc_id", "ordinal", result_id(F.col("vault_id"), F.col("chunk_id"), F.col("ordinal") + 1).alias("result_id"), result_title(F.lit(" "), F.col("section"), F.col("path")).alias("title"))


@_register(f"""WITH {_DOCS} SELECT a.vault_id, a.path AS source, 'depends_on' AS type, b.path AS target_path, 0.9::DOUBLE AS confidence FROM d a JOIN d b ON b.vault_id = a.vault_id AND b.path = a.derived_from
    UNION ALL SELECT vault_id, path, 'mentions', NULL, 0.8 FROM d UNION ALL SELECT vault_id, path, 'revisit_when', NULL, 0.8 FROM d WHERE fm_status IS NOT NULL""")
def entity_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEX5: relations that frontmatter states, tags, and what to revisit."""
    front = F.to_json(F.struct(F.col("derived_from").alias("depends_on"), F.array(F.lit("a tag")).alias("tags"), F.col("fm_status").alias("revisit_when")))
    docs = bridge.documents(spark, sf_dir).select("vault_id", "doc_id", "path", front.alias("frontmatter"), "fm_type", F.lit(None).cast("string").alias("title"))
    chunks = docs.select("vault_id", F.col("doc_id").cast("string").alias("chunk_id"), "path", F.lit(None).cast("string").alias("section"), F.lit("no links").alias("text"))
    return entities.relationships(entities.occurrences(chunks, docs)).select("vault_id", "source", "type", "target_path", "confidence")
