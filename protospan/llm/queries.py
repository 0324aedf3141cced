"""One query per numbered operator, over its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from protospan.llm import bpe, fingerprint, hardneg, langid, lattice, linededup, merkle, neardup, ngramjoin, packing, quality, urlfilter, warc
from protospan.llm.sample import remainder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_edits(_table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_deleted")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def op4_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_vectors(_table(spark, sf_dir, "embeddings"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), added=True)


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ngramjoin.ngram_classes(_table(spark, sf_dir, "documents"), words=4, least=85, parts=100)
    return rows.select("doc_id", "n_shingles", "component_id")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rows = langid.predict(docs.select("doc_id", "text"), langid.learn(docs))
    return rows.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    rows = quality.predict(docs, quality.learn(docs, _table(spark, sf_dir, "labels")))
    return rows.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge(pages, urlfilter.rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.hard_negatives(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    columns = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    # Every second document is tampered with: its line feeds go.
    other = merkle.leaf_of((columns | {"text": F.replace("text", F.lit("\n"), F.lit(""))}).values())
    tampered = F.when((remainder("doc_id", 2) == 0) & F.contains("text", F.lit("\n")), other)
    rows = merkle.manifest(docs, merkle.leaf_of(columns.values()), "source", "doc_id", carry={"tampered": tampered})
    folded = merkle.folded(F.coalesce("tampered", "leaf"), F.col("proof"))
    return rows.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), folded.alias("folded_root"), (folded == F.col("root")).alias("verified"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    rows = warc.read_archives(spark, warc.write_archives(pages, warc.new_folder(spark)))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_line_dedup": op2_line_dedup,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_embedding_neardup": op4_embedding_neardup,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_language_id": op7_language_id,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_url_filters": op9_url_filters,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_warc": op13_warc,
}

_CRC = """
        crc AS (
            -- Unsigned crc32 of the decimal id, bit by bit.
            SELECT doc_id, xor(list_reduce(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii((doc_id::VARCHAR)[i])::BIGINT),
                lambda c, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, _: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)),
                4294967295::BIGINT), 4294967295) AS crc
            FROM (SELECT DISTINCT doc_id FROM documents))
"""

#: Least node reachable by links e(a, b) in either direction.
_REACH = """
        reach AS (
            SELECT id AS node, id AS c FROM ids
            UNION
            SELECT x.b AS node, r.c FROM reach r JOIN (SELECT a, b FROM e UNION ALL SELECT b, a FROM e) x ON x.a = r.node WHERE r.c < x.b),
        least AS (SELECT node, min(c) AS component_id FROM reach GROUP BY node)
"""

ORACLE_SQL = {
    "op4_embedding_neardup": f"""
        WITH RECURSIVE v AS (
            SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings),
        ok AS (
            SELECT id, x, sqrt(list_dot_product(x, x)) AS n FROM v
            WHERE x IS NOT NULL AND len(list_filter(x, lambda t: t IS NULL OR NOT isfinite(t))) = 0 AND list_dot_product(x, x) > 0),
        e AS MATERIALIZED (
            SELECT p.id AS a, q.id AS b FROM ok p JOIN ok q ON p.id < q.id WHERE list_dot_product(p.x, q.x) / (p.n * q.n) >= 0.95),
        ids AS (SELECT id FROM v), {_REACH},
        links AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM e UNION ALL SELECT b FROM e) GROUP BY id)
        SELECT v.id AS vec_id, coalesce(links.n, 0) AS n_links, least.component_id, v.id = least.component_id AS kept
        FROM v JOIN least ON node = v.id LEFT JOIN links ON links.id = v.id
    """,
    "op6_ngram_jaccard": rf"""
        WITH RECURSIVE w AS (
            SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        s AS MATERIALIZED (
            SELECT id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))
                                          WHEN len(w) > 0 THEN [array_to_string(w, ' ') || ' '] ELSE [] END) AS s FROM w),
        g AS MATERIALIZED (SELECT id, len(s) AS n, unnest(s) AS g FROM s),
        e AS MATERIALIZED (
            SELECT p.id AS a, q.id AS b FROM g p JOIN g q ON p.g = q.g AND p.id < q.id
            GROUP BY p.id, q.id, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))),
        ids AS (SELECT id FROM s), {_REACH}
        SELECT s.id AS doc_id, len(s.s) AS n_shingles, component_id FROM s JOIN least ON node = s.id
    """,
    "op2_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                   unnest(range(len(string_split(text, chr(10))))) AS pos
            FROM documents WHERE text IS NOT NULL),
        nexts AS (
            SELECT *, lead(line, 1) OVER w AS l1, lead(line, 2) OVER w AS l2, lead(line, 3) OVER w AS l3
            FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
        copies AS (
            SELECT doc_id, pos, line,
                   row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) > 1
                       AND len(regexp_split_to_array(trim(line), '\s+')) >= 10 AS line_copy,
                   l3 IS NOT NULL AND row_number() OVER (PARTITION BY line, l1, l2, l3 ORDER BY doc_id, pos) > 1 AS run_copy
            FROM nexts),
        marked AS (
            SELECT doc_id, pos, line,
                   line_copy OR max(run_copy) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS gone
            FROM copies),
        texts AS (
            SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text,
                   CAST(count(*) AS INTEGER) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS INTEGER) AS n_deleted
            FROM marked GROUP BY doc_id)
        SELECT d.doc_id, t.text, coalesce(t.n_lines, 0) AS n_lines, coalesce(t.n_deleted, 0) AS n_deleted
        FROM documents d LEFT JOIN texts t USING (doc_id)
    """,
    "op9_url_filters": r"""
        WITH parts AS (
            SELECT page_id,
                   translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages),
        rules(rhost, rpath, action) AS (
            VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
        fits AS (
            SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(action, length(rhost || rpath)) AS verdict
            FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
            GROUP BY page_id)
        SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
        FROM parts p LEFT JOIN fits f USING (page_id)
    """,
    "op11_hard_negatives": """
        WITH v AS MATERIALIZED (
            SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
            FROM embeddings
            WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS MATERIALIZED (
            SELECT a.id AS a, b.id AS b, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS s
            FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id),
        p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
        SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER w AS rank, n.b AS negative_id, p.s AS positive_score, n.s AS negative_score
        FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 100 * n.s BETWEEN 30 * p.s AND 90 * p.s
        WINDOW w AS (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b)
        QUALIFY row_number() OVER w <= 10
    """,
    "op12_merkle_manifest": f"""
        WITH RECURSIVE {_CRC},
        kept AS (SELECT DISTINCT doc_id FROM crc WHERE crc % 2 = 1),
        parts AS (
            SELECT doc_id, source, text, replace(text, chr(10), '') AS other,
                   concat({', '.join(f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars"))}) AS head
            FROM documents),
        leaves AS MATERIALIZED (
            SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos,
                   sha256(head || coalesce(octet_length(encode(text))::VARCHAR || ':' || text, '-')) AS leaf,
                   sha256(head || coalesce(octet_length(encode(t))::VARCHAR || ':' || t, '-')) AS tampered
            FROM (SELECT *, CASE WHEN doc_id IN (SELECT doc_id FROM kept) THEN text ELSE other END AS t FROM parts)),
        tree AS (
            SELECT source, 0 AS level, pos, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM leaves
            UNION ALL
            SELECT source, level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3
            FROM tree WHERE n > 1 GROUP BY source, level, pos // 3, n),
        nodes AS MATERIALIZED (SELECT * FROM tree),
        subroots AS MATERIALIZED (
            SELECT source, h AS subroot, level, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos FROM nodes WHERE n = 1),
        top AS (
            SELECT 0 AS level, pos, subroot AS h, count(*) OVER () AS n FROM subroots
            UNION ALL
            SELECT level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM top WHERE n > 1 GROUP BY level, pos // 3, n),
        tops AS MATERIALIZED (SELECT * FROM top),
        steps AS (
            SELECT l.source, l.pos, t.level, coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (WHERE t.pos < l.pos // (3**t.level)::BIGINT), '') AS before,
                   coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (WHERE t.pos > l.pos // (3**t.level)::BIGINT), '') AS after
            FROM leaves l JOIN nodes t ON t.source IS NOT DISTINCT FROM l.source AND t.n > 1 AND t.pos // 3 = l.pos // (3**(t.level + 1))::BIGINT
            GROUP BY l.source, l.pos, t.level
            UNION ALL
            SELECT l.source, l.pos, r.level + t.level, coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (WHERE t.pos < r.pos // (3**t.level)::BIGINT), ''),
                   coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (WHERE t.pos > r.pos // (3**t.level)::BIGINT), '')
            FROM leaves l JOIN subroots r ON r.source IS NOT DISTINCT FROM l.source JOIN tops t ON t.n > 1 AND t.pos // 3 = r.pos // (3**(t.level + 1))::BIGINT
            GROUP BY l.source, l.pos, r.level, t.level),
        proofs AS (
            SELECT source, pos, list(struct_pack(before := before, after := after) ORDER BY level) AS proof FROM steps GROUP BY source, pos),
        folds AS (
            SELECT l.*, coalesce(p.proof, []) AS proof FROM leaves l LEFT JOIN proofs p ON p.source IS NOT DISTINCT FROM l.source AND p.pos = l.pos),
        fold AS (
            SELECT source, pos, proof, 0 AS step, tampered AS h FROM folds
            UNION ALL
            SELECT source, pos, proof, step + 1, sha256(proof[step + 1].before || h || proof[step + 1].after) FROM fold WHERE step < len(proof))
        SELECT f.doc_id, f.leaf, r.subroot, (SELECT h FROM tops WHERE n = 1) AS root,
               sha256(array_to_string(list_transform(f.proof, lambda s: s.before || s.after), '')) AS proof_sha256,
               e.h AS folded_root, e.h = (SELECT h FROM tops WHERE n = 1) AS verified
        FROM folds f JOIN subroots r ON r.source IS NOT DISTINCT FROM f.source
        JOIN fold e ON e.source IS NOT DISTINCT FROM f.source AND e.pos = f.pos AND e.step = len(f.proof)
    """,
    "op13_warc": """
        WITH p AS (
            SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        g AS (
            SELECT *, CASE WHEN octet_length(b) >= 1000 THEN max(page_id) OVER (PARTITION BY b) END AS last FROM p)
        SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest,
               CASE WHEN last IS DISTINCT FROM page_id AND last IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN last IS DISTINCT FROM page_id THEN last END AS refers_to
        FROM g
    """,
}
