"""The operators as queries over the whole tables, and SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, fingerprints, line_dedup, packing, quality, revisits, simhash, token_counts, topk, toxicity
from tessera.llm.common import held_out, read_table

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_recurring(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    model = toxicity.train(documents, read_table(spark, sf_dir, "labels"))
    out = toxicity.scores(documents, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(read_table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op7_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = revisits.resolve(revisits.captures(read_table(spark, sf_dir, "pages")))
    entries = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws(": ", e["key"], e["value"])))
    return out.select("record_id", "url_key", "status", F.coalesce("original_id", F.lit(-1).cast("long")).alias("original_id"), F.coalesce(F.array_join(entries, "\n"), F.lit("")).alias("headers"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.quantised(read_table(spark, sf_dir, "embeddings"))
    return topk.search(rows, rows.where("vec_id % 100 = 0"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_toxicity, op3_simhash, op4_fingerprints, op5_quality, op6_token_counts, op7_revisits, op8_bpe, op9_topk, op10_packing)}


OP9 = """
WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

_KEY = r"""
regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '')
|| CASE WHEN regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') = '' THEN '/' ELSE regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') END
|| CASE WHEN kept = '' THEN '' ELSE '?' || kept END"""

OP7 = rf"""
WITH captures AS (
  SELECT page_id * 2 AS record_id, url, page_id * 3600 AS ts, 200 AS status, '"' || md5(html) || '"' AS etag, 'day ' || (page_id % 365) AS since, length(html) AS size, page_id FROM pages
  UNION ALL
  SELECT page_id * 2 + 1, url || '#again', CASE WHEN page_id % 11 = 0 THEN page_id * 3600 - 1 ELSE page_id * 5400 + 1 END, 304,
    CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 7 = 0 THEN '"other"' ELSE '"' || md5(html) || '"' END,
    CASE WHEN page_id % 5 = 0 THEN 'day ' || (page_id % 365) END, 0, page_id FROM pages),
bared AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^https?://', '', 'i') AS bare FROM captures),
parted AS (SELECT *, coalesce(list_aggregate(list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'),
  lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)'))), 'string_agg', '&'), '') AS kept FROM bared),
keyed AS (SELECT *, {_KEY} AS url_key FROM parted),
firsts AS (SELECT r.record_id, r.url_key, r.etag, r.since, r.page_id, max(struct_pack(ts := f.ts, record_id := f.record_id, etag := f.etag, since := f.since, size := f.size)) AS f
  FROM keyed r LEFT JOIN keyed f ON f.status = 200 AND f.url_key = r.url_key AND (f.ts < r.ts OR (f.ts = r.ts AND f.record_id < r.record_id))
  WHERE r.status = 304 GROUP BY ALL),
judged AS (SELECT *, CASE WHEN f IS NULL OR f.record_id IS NULL THEN 'missing' WHEN CASE WHEN etag IS NOT NULL THEN etag <> f.etag ELSE since <> f.since END THEN 'mismatch' ELSE 'resolved' END AS status FROM firsts)
SELECT record_id, url_key, status, CASE WHEN status = 'resolved' THEN f.record_id ELSE -1 END AS original_id,
  CASE WHEN status = 'resolved' THEN
    CASE WHEN etag IS NOT NULL THEN 'age: 1' || chr(10) ELSE '' END || 'content-length: ' || f.size || chr(10) || 'content-type: text/html' || chr(10)
    || 'etag: ' || CASE WHEN etag IS NOT NULL THEN 'W/' || etag ELSE f.etag END || chr(10) || 'last-modified: ' || f.since || chr(10) || 'server: second' ELSE '' END AS headers
FROM judged
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_revisits": OP7, "op9_topk": OP9}
