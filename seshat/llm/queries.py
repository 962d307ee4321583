"""The operators over whole tables with production parameters, as ``opN_<name>`` queries.

Digest columns are derived here; the operators return texts, spans, ids and lists.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontamination, jaccard_join, license_scan, line_dedup, merkle_manifest, period_runs, pivot_search, quality_classifier, quality_rules, secrets, token_counts, url_filter
from .columns import lower_ascii

TOKEN_LIMIT = 1024


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = decontamination.benchmark_windows(_table(spark, sf_dir, "benchmark"))
    found = decontamination.report(_table(spark, sf_dir, "documents"), windows)
    return found.select("doc_id", "n_words", "n_hit", "n_items", _sha256(F.array_join("items", ",")).alias("items_sha256"), "contaminated")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(_table(spark, sf_dir, "documents"))
    families = F.array_sort(F.array_distinct(F.transform("notices", lambda n: n["family"])))
    return found.select("doc_id", "n_paragraphs", F.size("notices").cast("bigint").alias("n_notices"), F.array_join(families, ",").alias("families"), "n_unknown", F.round(F.array_min(F.transform("notices", lambda n: n["chance"])), 6).alias("least_chance"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.select("*", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = byte_bpe.encode_and_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.train(docs, _table(spark, sf_dir, "labels")))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    ratings = labels.select("doc_id", quality_classifier.grade(F.col("quality"), F.col("toxic")).alias("grade"))
    return quality_classifier.rate(docs, quality_classifier.train(docs, ratings))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link(_table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(_table(spark, sf_dir, "documents"))
    spelled = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "lexed")
    return found.select("doc_id", *map(count, ("assign", "access", "hex", "lexed")), _sha256(spelled(base)).alias("base_sha256"), spelled("spans").alias("spans"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", _sha256(F.col("text")).alias("kept_sha256"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    tampered = F.when(F.crc32(docs["doc_id"].cast("string").cast("binary")) % 5 == 0, lower_ascii(docs["text"])).otherwise(docs["text"])
    proved = merkle_manifest.proofs(merkle_manifest.build(docs, now={"text": tampered}))
    return proved.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", _sha256(F.lower(F.hex("siblings"))).alias("proof_sha256"), "folded_root", "verified")


def _periodic(doc_id: Column, text: Column) -> Column:
    """The text, or for a tenth of the ids its words with a periodic end."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def spread(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = F.floor((n - a) / (3 + g % 8)) + 1
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), 1)
    return F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), F.transform(F.array(words), spread)[0]).otherwise(text)


def op12_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = period_runs.find(docs.select("doc_id", _periodic(F.col("doc_id"), F.col("text")).alias("text")))
    more = lambda a, b: (a["length"] * b["period"] > b["length"] * a["period"])  # noqa: E731  runs come by start and period: the first of equals stays
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda b, r: F.when(more(r, b), r).otherwise(b))
    spelled = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    each = found.select("*", best.alias("best"), F.when(F.size("runs") > 0, F.concat(spelled, F.lit("\n"))).otherwise("").alias("spelled"))
    return each.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), _sha256(F.col("spelled")).alias("runs_sha256"), _sha256(F.col("collapsed")).alias("collapsed_sha256"))


def op13_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_search.search(_table(spark, sf_dir, "embeddings"), every=20, k=20, scale=64)


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op8 that SQL can express."""
    return op8_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op5 that SQL can express."""
    return op5_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op10 that SQL can express: all but the verdicts of the model."""
    verdict = F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("rule_verdict")
    return op10_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule", verdict)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_decontamination, op2_license_scan, op3_token_counts, op4_byte_bpe, op5_quality_rules, op6_quality_classifier, op7_jaccard_join, op8_secrets, op9_line_dedup, op10_url_filter, op11_merkle_manifest, op12_period_runs, op13_pivot_search, secrets_base, quality_counts, url_rules)}

#: For DuckDB, over the same tables. Operators with fitted models, tokenizers or lexers have none.
ORACLE_SQL: dict[str, str] = {
    "secrets_base": r"""
        WITH p AS (SELECT * FROM (VALUES ('assign', 0, '(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+'),
            ('access', 1, 'AKIA[A-Z0-9]+'), ('hex', 2, '[0-9a-f]+')) AS t(kind, rank, pattern)),
        m AS (SELECT doc_id, kind, rank, unnest(ms) AS match, unnest(ps) AS before, generate_subscripts(ms, 1) AS k FROM (
            SELECT doc_id, kind, rank, regexp_extract_all(text, pattern) AS ms, string_split_regex(text, pattern)[:len(regexp_extract_all(text, pattern))] AS ps FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents), p)),
        s AS (SELECT doc_id, kind, rank, match, sum(length(before) + length(match)) OVER (PARTITION BY doc_id, kind ORDER BY k) AS stop FROM m),
        f AS (SELECT doc_id, kind, rank, stop - length(match) AS start, stop FROM s WHERE CASE kind WHEN 'access' THEN length(match) >= 20 WHEN 'hex' THEN length(match) >= 24 ELSE length(regexp_extract(match, '[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 6 END)
        SELECT d.doc_id, count(*) FILTER (WHERE kind = 'assign')::BIGINT AS n_assign, count(*) FILTER (WHERE kind = 'access')::BIGINT AS n_access, count(*) FILTER (WHERE kind = 'hex')::BIGINT AS n_hex,
            sha256(coalesce(string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, rank), '')) AS base_sha256
        FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY d.doc_id""",
    "quality_counts": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
        rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
        r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY 1),
        l AS (SELECT doc_id, line, count(*) - 1 AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1, 2),
        u AS (SELECT doc_id, sum(n) AS n FROM l GROUP BY 1)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
            coalesce(u.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(w) < 20 OR 100 * coalesce(r.n, 0) > 30 * len(w) AS base_failed
        FROM d LEFT JOIN u ON u.doc_id = d.doc_id LEFT JOIN r ON r.doc_id = d.doc_id""",
    "url_rules": r"""
        WITH c AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
        h AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM c),
        r AS (SELECT * FROM (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')) AS t(rh, rp, rv)),
        f AS (SELECT page_id, rh || rp AS rule, rv FROM h, r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC) = 1)
        SELECT h.page_id, host, path, rule, rv AS rule_verdict FROM h LEFT JOIN f ON f.page_id = h.page_id""",
    "op1_decontamination": r"""
        WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        d AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
        bl AS (SELECT item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM benchmark),
        b AS (SELECT item_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM bl),
        bs AS (SELECT item_id, w, least(len(w), 13) AS k FROM b WHERE len(w) > 0),
        bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM bs)),
        ks AS (SELECT DISTINCT k FROM bw),
        dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks)),
        hit AS (SELECT doc_id, dw.k AS k, i, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.k = bw.k),
        covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY 1),
        items AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM hit GROUP BY 1)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(i.n, 0)::BIGINT AS n_items,
            sha256(coalesce(i.s, '')) AS items_sha256, coalesce(c.n, 0) > 0 AND 20 * coalesce(c.n, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN items i ON i.doc_id = d.doc_id""",
    "op11_merkle_manifest": r"""
        WITH RECURSIVE crc(b, k, c) AS (SELECT b, 0, b::BIGINT FROM range(256) AS t(b) UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END FROM crc WHERE k < 8),
        byte AS (SELECT b, c FROM crc WHERE k = 8),
        step(doc_id, s, i, c) AS (SELECT DISTINCT doc_id, doc_id::VARCHAR, 0, 4294967295::BIGINT FROM documents WHERE doc_id IS NOT NULL
            UNION ALL SELECT doc_id, s, i + 1, xor(byte.c, step.c >> 8) FROM step JOIN byte ON byte.b = xor(step.c, ascii(s[i + 1])::BIGINT) & 255 WHERE i < length(s)),
        h AS (SELECT doc_id, xor(c, 4294967295::BIGINT) AS crc FROM step WHERE i = length(s)),
        t AS (SELECT d.*, CASE WHEN crc % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS later FROM documents d LEFT JOIN h ON h.doc_id = d.doc_id),
        p AS (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM t),
        f AS (SELECT doc_id, coalesce('=' || source, '-') AS tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(later) || ':' || later, '-')) AS now FROM p),
        l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, now) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS width FROM f),
        own(tree, level, idx, hash, width) AS (SELECT tree, 0, idx, leaf, width FROM l UNION ALL SELECT tree, level + 1, idx // 16, sha256(string_agg(hash, '' ORDER BY idx)), (width + 15) // 16 FROM own WHERE width > 1 GROUP BY tree, level, idx // 16, width),
        subs AS MATERIALIZED (SELECT tree, hash, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS width FROM own WHERE width = 1),
        over_(tree, level, idx, hash, width) AS (SELECT '', 0, idx, hash, width FROM subs UNION ALL SELECT tree, level + 1, idx // 16, sha256(string_agg(hash, '' ORDER BY idx)), (width + 15) // 16 FROM over_ WHERE width > 1 GROUP BY tree, level, idx // 16, width),
        nodes AS MATERIALIZED (SELECT * FROM own UNION ALL SELECT * FROM over_),
        sib AS MATERIALIZED (SELECT a.tree, a.level, a.idx, coalesce(string_agg(b.hash, '' ORDER BY b.idx) FILTER (WHERE b.idx < a.idx), '') AS l, coalesce(string_agg(b.hash, '' ORDER BY b.idx) FILTER (WHERE b.idx > a.idx), '') AS r
            FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.level = b.level AND a.idx // 16 = b.idx // 16 WHERE a.width > 1 GROUP BY 1, 2, 3),
        climb(tree, here, level, idx, width, start, folded, proof) AS (SELECT tree, tree, 0, idx, width, idx, now, '' FROM l
            UNION ALL SELECT c.tree, c.here, c.level + 1, c.idx // 16, (c.width + 15) // 16, c.start, sha256(s.l || c.folded || s.r), c.proof || s.l || s.r FROM climb c JOIN sib s ON s.tree = c.here AND s.level = c.level AND s.idx = c.idx WHERE c.width > 1),
        up(tree, here, level, idx, width, start, folded, proof) AS (SELECT c.tree, '', 0, u.idx, u.width, c.start, c.folded, c.proof FROM climb c JOIN subs u ON u.tree = c.tree WHERE c.width = 1
            UNION ALL SELECT c.tree, c.here, c.level + 1, c.idx // 16, (c.width + 15) // 16, c.start, sha256(s.l || c.folded || s.r), c.proof || s.l || s.r FROM up c JOIN sib s ON s.tree = c.here AND s.level = c.level AND s.idx = c.idx WHERE c.width > 1)
        SELECT l.doc_id, l.leaf, u.hash AS subroot, o.hash AS root, sha256(p.proof) AS proof_sha256, p.folded AS folded_root, p.folded = o.hash AS verified
        FROM l JOIN subs u ON u.tree = l.tree JOIN up p ON p.tree = l.tree AND p.start = l.idx AND p.width = 1 JOIN over_ o ON o.width = 1""",
    "op13_pivot_search": r"""
        WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS z FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, v.vec_id, coalesce(list_sum(list_transform(list_zip(q.z, v.z), lambda p: coalesce(p[1] * p[2], 0))), 0)::BIGINT AS score FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
        SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 20""",
    "op9_line_dedup": r"""
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
        k AS (SELECT doc_id, pos, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
        SELECT k.doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE c.key IS NOT NULL AND k.doc_id <> keeper)::BIGINT AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL OR k.doc_id = keeper), '')) AS kept_sha256
        FROM k LEFT JOIN c ON c.key = k.key GROUP BY k.doc_id""",
    "op7_jaccard_join": r"""
        WITH RECURSIVE low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        d AS (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM low),
        s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
        n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        both_in AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        link AS MATERIALIZED (SELECT x, y FROM both_in JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 75 * (p.n + q.n - k)),
        edge AS MATERIALIZED (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
        reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM reach r JOIN edge e ON e.x = r.y)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.y) AS component_id
        FROM d JOIN reach r ON r.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY 1, 2""",
}
