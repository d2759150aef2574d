"""Registered queries of the corpus operators and the DuckDB statement for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeledger.llm import chat, decontam, html_consensus, nearest, ngram_join, packing, pii, sharding, toxicity, warc
from treeledger.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(spark, table(spark, sf_dir, "pages")).drop("url")


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_consensus.extract_pages(spark, table(spark, sf_dir, "pages"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_documents(spark, table(spark, sf_dir, "documents"), n=3, percent=90)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(spark, table(spark, sf_dir, "documents"), shards=8)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(spark, table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_warc": op2_warc,
    "op3_main_text": op3_main_text,
    "op4_personal_data": op4_personal_data,
    "op5_decontamination": op5_decontamination,
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op7_ngram_join": op7_ngram_join,
    "op8_sharding": op8_sharding,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_chat_formatting": op10_chat_formatting,
}

ORACLE_SQL = {
    "op2_warc": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
            FROM pages),
        q AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS latest FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM latest THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM latest THEN latest END AS refers_to
        FROM q
    """,
    "op5_decontamination": r"""
        WITH words AS (SELECT 1 AS benchmark, item_id AS id, text FROM benchmark UNION SELECT 0, doc_id, text FROM documents),
        t AS (
            SELECT benchmark, id, text,
                   regexp_extract_all(regexp_replace(lower(text), '([\x{0e00}-\x{0eff}\x{1000}-\x{109f}\x{1780}-\x{17ff}\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{323af}])', ' \1 ', 'g'), '[\p{L}\p{N}]+') AS w
            FROM words),
        d AS MATERIALIZED (SELECT row_number() OVER () AS d, id AS doc_id, w FROM t WHERE benchmark = 0),
        i AS MATERIALIZED (SELECT row_number() OVER () AS i, item_id, w FROM (SELECT DISTINCT id AS item_id, w FROM t WHERE benchmark = 1 AND len(w) >= 5)),
        dt AS (SELECT d, unnest(w) AS t, generate_subscripts(w, 1) - 1 AS p FROM d),
        it AS (SELECT i, len(w) AS n, CASE WHEN len(w) >= 13 THEN 11 WHEN len(w) >= 8 THEN len(w) - 1 ELSE len(w) END AS need, unnest(w) AS t, generate_subscripts(w, 1) - 1 AS p FROM i),
        agree AS (
            SELECT d, i, n, need, it.p AS p, dt.p - it.p AS s FROM dt JOIN it USING (t)
            QUALIFY count(*) OVER (PARTITION BY d, i, dt.p - it.p) >= need),
        windows AS (
            SELECT *, count(*) OVER (PARTITION BY d, i, s ORDER BY p RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS k,
                   count(*) OVER (PARTITION BY d, i, s) AS m
            FROM agree),
        diagonals AS (SELECT d, i, n, s, max(k) AS k, max(m) AS m FROM windows GROUP BY d, i, n, s, need HAVING max(k) >= need)
        SELECT doc_id, item_id, s AS doc_start, m AS matched, n AS item_tokens, k AS best_window FROM diagonals JOIN d USING (d) JOIN i USING (i)
        QUALIFY row_number() OVER (PARTITION BY d, i ORDER BY k DESC, m DESC, s) = 1
    """,
    "op6_nearest_neighbours": """
        WITH good AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        scored AS (
            SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
            FROM good q JOIN good c ON q.vec_id % 20 = 0 AND c.r <> q.r),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank FROM scored)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
    """,
    "op7_ngram_join": r"""
        WITH RECURSIVE w AS MATERIALIZED (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
            FROM documents),
        s AS MATERIALIZED (
            SELECT r, unnest(list_distinct(CASE
                WHEN len(words) = 0 THEN []
                WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
                ELSE list_transform(generate_series(1, len(words) - 2), lambda i: array_to_string(words[i:i + 2], ' ')) END)) AS g
            FROM w),
        n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
        pair AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY 1, 2),
        link AS MATERIALIZED (SELECT a, b FROM pair JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
        reach AS (SELECT r, r AS seen FROM w UNION SELECT reach.r, link.b FROM reach JOIN link ON link.a = reach.seen)
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
        FROM w LEFT JOIN n USING (r) JOIN (SELECT reach.r, min(w.doc_id) AS component_id FROM reach JOIN w ON w.r = reach.seen GROUP BY reach.r) c USING (r)
    """,
    "op10_chat_formatting": """
        WITH t AS (
            SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () ELSE 0 END AS own, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
        numbered AS (
            SELECT dense_rank() OVER (ORDER BY conv_id, own) AS c, conv_id, role, text,
                   row_number() OVER (PARTITION BY conv_id, own ORDER BY turn NULLS FIRST, role, md5(role || chr(10) || text)) AS position
            FROM t),
        lines AS MATERIALIZED (SELECT c, conv_id, position, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS line FROM numbered),
        whole AS (SELECT c, any_value(conv_id) AS conv_id, count(*) AS n_turns, string_agg(line, '' ORDER BY position) AS rendered FROM lines GROUP BY c),
        proper AS (
            SELECT DISTINCT a.c, a.position AS n, string_agg(b.line, '' ORDER BY b.position) AS rendered
            FROM lines a JOIN lines b ON a.c = b.c AND b.position <= a.position
            JOIN whole w ON w.c = a.c AND a.position < w.n_turns
            GROUP BY a.c, a.position)
        SELECT min(conv_id) AS conv_id, n_turns, count(*) AS n_copies, length(rendered) AS n_chars, rendered
        FROM whole
        WHERE NOT EXISTS (SELECT 1 FROM proper p WHERE p.n = whole.n_turns AND p.rendered = whole.rendered)
        GROUP BY n_turns, rendered
    """,
}
