"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Queries, table
from . import chat_format, langid, order_minhash, packing, pii, quality, spm_lattice, url_filters, vector_dedup, warc

URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.rotate(table(spark, sf_dir, "conversations"))


OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text, count(*) AS copies
  FROM conversations GROUP BY ALL),
p AS (SELECT DISTINCT conv_id AS c, speaker AS perspective FROM t),
s AS (
  SELECT conv_id, perspective, turn, speaker, copies, text,
    CASE WHEN speaker = perspective THEN '<|im_start|>assistant' || chr(10)
         ELSE '<|im_start|>user name=' || regexp_replace(speaker, '[\s<>|]+', '_', 'g') || chr(10) END AS head,
    text || '<|im_end|>' AS body
  FROM t JOIN p ON conv_id IS NOT DISTINCT FROM c),
o AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (
      PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM s)
SELECT conv_id, perspective, turn, speaker, copies, head || body || chr(10) AS segment, start,
  (length(head) + length(body) + 1)::BIGINT AS length, (start + length(head))::BIGINT AS mask_start,
  (CASE WHEN speaker = perspective THEN length(body) ELSE 0 END)::BIGINT AS mask_length
FROM o
"""


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.archive_pages(table(spark, sf_dir, "pages"))
    return back.select(
        F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


#: Base32 of a digest: each five hexadecimal digits give four characters.
OP2_SQL = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h, payload_bytes) AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, (1 + 5 * (i // 4))::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filters.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


#: Links and the smallest verdict of their components; ``.`` and ``..`` segments of a target are left as they are here.
OP3_SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html,
    CASE WHEN url LIKE '%://%' THEN translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') ELSE '' END AS path
  FROM pages),
r(h, p, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
best AS (
  SELECT page_id, url, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.verdict, length(r.h || r.p)) AS verdict
  FROM p JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p)
  GROUP BY page_id, url),
tags AS (SELECT url, unnest(regexp_extract_all(html, '<(?:link|meta)\s[^>]*>', 0, 'is')) AS tag FROM p WHERE url LIKE '%://%'),
attrs AS (
  SELECT url, tag,
    trim(regexp_extract(tag, '\srel\s*=\s*("[^"]*"|''[^'']*''|[^\s>]+)', 1, 'is'), chr(34) || chr(39)) AS rel,
    trim(regexp_extract(tag, '\shref\s*=\s*("[^"]*"|''[^'']*''|[^\s>]+)', 1, 'is'), chr(34) || chr(39)) AS href,
    trim(regexp_extract(tag, '\shttp-equiv\s*=\s*("[^"]*"|''[^'']*''|[^\s>]+)', 1, 'is'), chr(34) || chr(39)) AS equiv,
    trim(regexp_extract(tag, '\scontent\s*=\s*("[^"]*"|''[^'']*''|[^\s>]+)', 1, 'is'), chr(34) || chr(39)) AS content
  FROM tags),
hrefs AS (
  SELECT url, replace(CASE WHEN tag ILIKE '<link%' AND regexp_matches(rel, '(^|\s)canonical(\s|$)', 'i') THEN href
         WHEN tag ILIKE '<meta%' AND lower(equiv) = 'refresh' THEN regexp_extract(content, 'url\s*=\s*["'']?([^"''\s>]+)', 1, 'is')
         ELSE '' END, '&amp;', '&') AS href
  FROM attrs),
full_urls AS (
  SELECT url AS a, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN href
      WHEN starts_with(href, '//') THEN regexp_extract(url, '^(.*?)://', 1, 's') || ':' || href
      WHEN starts_with(href, '/') THEN regexp_extract(url, '^(.*?://[^/?#]*)', 1, 's') || href
      WHEN href <> '' AND NOT regexp_matches(href, '^([A-Za-z][A-Za-z0-9+.-]*:|#)') THEN
        rtrim(regexp_extract(url, '^(.*?://[^/?#]*(?:[^?#]*/)?)', 1, 's'), '/') || '/' || href END AS b
  FROM hrefs WHERE href <> ''),
keys AS (
  SELECT u, translate(regexp_extract(u, '^(.*?://[^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
      || regexp_extract(u, '^.*?://[^/?#]*([^#]*)', 1, 's') AS k
  FROM (SELECT a AS u FROM full_urls UNION SELECT b FROM full_urls UNION SELECT url FROM p) WHERE u LIKE '%://%'),
edges AS (
  SELECT ka.k AS a, kb.k AS b FROM full_urls f JOIN keys ka ON ka.u = f.a JOIN keys kb ON kb.u = f.b WHERE ka.k <> kb.k
  UNION SELECT kb.k, ka.k FROM full_urls f JOIN keys ka ON ka.u = f.a JOIN keys kb ON kb.u = f.b WHERE ka.k <> kb.k),
reach(node, other) AS (SELECT a, a FROM edges UNION SELECT reach.node, edges.b FROM reach JOIN edges ON reach.other = edges.a),
ruled AS (
  SELECT k, min_by(r.verdict, -length(r.h || r.p)) AS verdict FROM (SELECT DISTINCT k FROM keys WHERE k IN (SELECT a FROM edges)) n
  JOIN r ON (regexp_extract(k, '^.*?://([^/?#]*)', 1, 's') = r.h OR ends_with(regexp_extract(k, '^.*?://([^/?#]*)', 1, 's'), '.' || r.h))
    AND starts_with(regexp_extract(k, '^.*?://[^/?#]*([^?#]*)', 1, 's'), r.p)
  GROUP BY k),
shared AS (SELECT node, min(verdict) AS verdict FROM reach JOIN ruled ON ruled.k = reach.other GROUP BY node)
SELECT p.page_id, p.host, p.path, best.rule, coalesce(best.verdict, shared.verdict, 'allow') AS verdict
FROM p LEFT JOIN best ON best.page_id IS NOT DISTINCT FROM p.page_id AND best.url = p.url
LEFT JOIN keys ON keys.u = p.url LEFT JOIN shared ON shared.node = keys.k
"""


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & F.col("rejected_by").isNull()).alias("kept"),
    )


OP4_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
pos AS (SELECT doc_id, i, w[i] || chr(10) || w[i+1] || chr(10) || w[i+2] AS k
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM pos) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i+1, i+2]) AS j FROM rep) GROUP BY 1),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN cov USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 10 * n_symbols > 5 * word_chars
       OR (n_lines >= 4 AND 2 * n_dup_lines > n_lines)) AS kept
FROM f
"""

def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = docs.select("doc_id", pii.found(F.col("text")).alias("f"))
    return got.select(
        "doc_id",
        *[f"f.n_{k}" for k in pii.KINDS],
        F.sha2(F.col("f.base").cast("binary"), 256).alias("base_sha256"),
        "f.spans",
        "f.n_added",
    )


def piece_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return spm_lattice.encode(docs, spm_lattice.load(piece_model_path()), with_ids=False)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = docs.select(
        "doc_id",
        langid.held_out(F.col("doc_id")).alias("held_out"),
        langid.predicted(docs, langid.train(docs), docs["text"]).alias("p"),
    )
    return got.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.languages")


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.classes(table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES: Queries = {
    "op1_chat_format": op1_chat_format,
    "op2_warc": op2_warc,
    "op3_url_filters": op3_url_filters,
    "op4_quality_rules": op4_quality_rules,
    "op5_pii": op5_pii,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_language_id": op7_language_id,
    "op8_order_minhash": op8_order_minhash,
    "op9_packing": op9_packing,
    "op10_vector_dedup": op10_vector_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op1_chat_format": OP1_SQL,
    "op2_warc": OP2_SQL,
    "op3_url_filters": OP3_SQL,
    "op4_quality_rules": OP4_SQL,
}
