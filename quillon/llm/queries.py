"""The registered queries of this subpackage and their SQL: name by (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import bpe, exact_dedup, html_extract, line_dedup, media, minhash, nearest, packing, token_counts, toxicity, vector_codes, warc, whitening
from quillon.llm._common import table

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
CATEGORIES = {"low_quality": "1 - quality", "toxic": "toxic"}


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def op3_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), WORD_TOKENIZER, targets=packing.EQUAL, with_ids=False).drop("ids")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=("n_lines", "n_dropped"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_warc_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(table(spark, sf_dir, "pages"), with_payload=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_page").alias("refers_to"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(spark, f"{sf_dir}/documents.parquet").drop("n_bytes")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN).select("doc_id", "n_tokens")


def op9_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), CATEGORIES))


def op10_png_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode(table(spark, sf_dir, "embeddings"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("bigint"))


def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES = {f.__name__: f for f in (op1_html_extract, op2_minhash_dedup, op3_mixture_packing, op4_line_dedup, op5_warc_write, op6_exact_dedup, op7_byte_bpe, op8_token_counts, op9_toxicity_chain, op10_png_media, op11_vector_codes, op12_whitening, op13_nearest)}

SQL = {
    "op1_html_extract": r"""
        WITH article AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1) AS a FROM pages),
        blocks AS (SELECT page_id, url, list_transform(regexp_split_to_array(a, '</?(?:p|h1)>'), lambda x: trim(regexp_replace(
            replace(replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&#x27;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))) AS b FROM article),
        texts AS (SELECT page_id, url, coalesce(array_to_string(list_filter(b, lambda x: x <> ''), chr(10)), '') AS text FROM blocks)
        SELECT page_id, url, text, length(text) AS n_chars FROM texts""",
    "op4_line_dedup": r"""
        WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
        keyed AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
        owners AS (SELECT k, min(doc_id) AS owner FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
        marked AS (SELECT doc_id, pos, line, coalesce(owner <> doc_id, false) AS gone FROM keyed LEFT JOIN owners USING (k))
        SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op5_warc_write": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        s AS (SELECT page_id, html, strlen(html) AS payload_bytes, CASE WHEN strlen(html) >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS last FROM p)
        SELECT page_id, payload_bytes, sha1(html) AS payload_digest, CASE WHEN last = page_id THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN last <> page_id THEN last END AS refers_to FROM s""",
    "op6_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS text FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(text) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY text)""",
    "op11_vector_codes": """
        WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS v, len(embedding) // 16 AS w FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
        parts AS (SELECT vec_id, label, p, v[p * w + 1 : (p + 1) * w] AS x FROM kept, range(16) t(p)),
        b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts QUALIFY e < 64),
        a0 AS (SELECT vec_id, p, x, min(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 64 + e) AS m FROM parts JOIN b0 USING (p) GROUP BY vec_id, p, x),
        s0 AS (SELECT p, m % 64 AS e, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS c FROM (SELECT p, m % 64 AS m, i, sum(x[i]) AS s, count(*) AS n FROM a0, range(1, 1 + len(x)) t(i) GROUP BY p, m % 64, i) GROUP BY p, m % 64),
        b1 AS (SELECT p, e, coalesce(s0.c, b0.c) AS c FROM b0 LEFT JOIN s0 USING (p, e)),
        a1 AS (SELECT vec_id, p, x, min(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 64 + e) AS m FROM parts JOIN b1 USING (p) GROUP BY vec_id, p, x),
        s1 AS (SELECT p, m % 64 AS e, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS c FROM (SELECT p, m % 64 AS m, i, sum(x[i]) AS s, count(*) AS n FROM a1, range(1, 1 + len(x)) t(i) GROUP BY p, m % 64, i) GROUP BY p, m % 64),
        b2 AS (SELECT p, e, coalesce(s1.c, b1.c) AS c FROM b1 LEFT JOIN s1 USING (p, e)),
        a2 AS (SELECT vec_id, label, p, min(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 64 + e) AS m FROM parts JOIN b2 USING (p) GROUP BY vec_id, label, p),
        coded AS (SELECT vec_id, label, string_agg(printf('%02x', CAST(m % 64 AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(m // 64) AS BIGINT) AS error FROM a2 GROUP BY vec_id, label)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
            (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b2) AS codebooks_sha256 FROM coded""",
    "op13_nearest": """
        WITH kept AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL
            AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
        scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.v, c.v) AS score FROM kept q JOIN kept c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored QUALIFY rank <= 10""",
}
