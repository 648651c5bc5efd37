"""The queries of this package: name to function, and name to DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bytebpe, bytecnn, fertility, licenses, linededup, minhash, secrets, toxicity, warc, winnowing


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licences(table(spark, sf_dir, "documents"))


def op2_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path
    return fertility.quality_rules(table(spark, sf_dir, "documents"), path("byte_bpe_multi_50k.tiktoken"), path("piece_bpe_32k.model"))


def op3_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bytebpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(spark, table(spark, sf_dir, "pages")).drop("url")


def op6_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


def op8_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op10_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bytecnn.score_documents(docs, bytecnn.train(docs, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_license_compression, op2_tokeniser_fertility, op3_secret_ownership, op4_benchmark_decontamination, op5_warc_index, op6_fuzzy_lines, op7_minhash_near_dedup, op8_toxicity_chain, op9_byte_bpe, op10_byte_cnn)}

SQL_OP4 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS k FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS k FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN lens WHERE len(w) >= n)),
hit AS (SELECT DISTINCT r, dw.n, i, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.k = bw.k),
words AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS x FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

SQL_OP3 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, '') AS owner, coalesce('=' || source, '') || '/' || coalesce('=' || lang, '') AS repo, coalesce(text, '') AS text FROM documents),
m AS (SELECT r, 0 AS kind, regexp_extract_all(text, P0) AS whole, regexp_extract_all(text, P0, 2) AS val, string_split_regex(text, P0) AS pieces FROM d
UNION ALL SELECT r, 1, regexp_extract_all(text, P1), regexp_extract_all(text, P1), string_split_regex(text, P1) FROM d
UNION ALL SELECT r, 2, regexp_extract_all(text, P2), regexp_extract_all(text, P2), string_split_regex(text, P2) FROM d
UNION ALL SELECT r, 3, regexp_extract_all(text, P3), regexp_extract_all(text, P3), string_split_regex(text, P3) FROM d),
e AS (SELECT r, kind, unnest(range(1, len(whole) + 1)) AS i, unnest(whole) AS w, unnest(val) AS v, unnest(list_slice(pieces, 1, len(whole))) AS b FROM m WHERE len(whole) > 0),
s AS (SELECT r, kind, v, length(w) AS n, sum(length(b) + length(w)) OVER (PARTITION BY r, kind ORDER BY i) AS stop FROM e),
c AS (SELECT s.*, stop - n AS start, owner, repo FROM s JOIN d USING (r) WHERE kind = 0 AND length(v) >= 12 OR kind = 1 AND n >= 18 OR kind = 2 AND n >= 16 OR kind = 3 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')),
o AS (SELECT v, count(DISTINCT owner) > 2 OR count(DISTINCT repo) > 3 AS copied FROM c GROUP BY v),
j AS (SELECT c.*, copied, NOT copied AND regexp_matches(v, '[0-9]') AND len(list_distinct(string_split(v, ''))) >= 8 AS live FROM c JOIN o USING (v)),
k AS (SELECT *, ['assign', 'access', 'hex', 'opaque'][kind + 1] || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT) AS span FROM j WHERE kind < 3 OR live),
g AS (SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (copied) AS n_copied, count(*) FILTER (live) AS n_live,
string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(span, ',' ORDER BY start, kind) AS spans FROM k GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_copied, 0) AS n_copied, coalesce(n_live, 0) AS n_live
FROM d LEFT JOIN g USING (r)
"""
for _mark, _pattern in (
    ("P0", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""),
    ("P1", "AKIA[A-Z0-9]+"), ("P2", "[0-9a-f]+"), ("P3", "[A-Za-z0-9+/_=-]{20,}"),
):
    SQL_OP3 = SQL_OP3.replace(_mark, f"'{_pattern}'")

SQL_OP5 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT html, max(page_id) AS chosen FROM p GROUP BY html),
b AS (SELECT h, array_to_string(list_transform(string_split(h, ''), lambda c: lpad(bin(instr('0123456789abcdef', c) - 1), 4, '0')), '') AS bits FROM (SELECT DISTINCT h FROM p)),
d AS (SELECT h, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT) AS BIGINT), 1)), '') AS payload_digest FROM b)
SELECT page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id IS DISTINCT FROM chosen AND chosen IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN page_id IS DISTINCT FROM chosen THEN chosen END AS refers_to FROM p JOIN m ON p.html = m.html JOIN d USING (h)
"""

ORACLES: dict[str, str] = {"op3_secret_ownership": SQL_OP3, "op5_warc_index": SQL_OP5, "op4_benchmark_decontamination": SQL_OP4}
