"""Registered queries of the operators (production parameters, whole tables) and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urlatlas.llm.chunk_recipes import exact_duplicates
from urlatlas.llm.common import ship_code, table, work_dir
from urlatlas.llm.language_id import identify
from urlatlas.llm.line_chunks import drop_repeated_chunks
from urlatlas.llm.merkle import proofs
from urlatlas.llm.merkle_sql import proofs_sql
from urlatlas.llm.packing import pack
from urlatlas.llm.secret_links import secrets, spans_text
from urlatlas.llm.simhash import near_duplicates
from urlatlas.llm.tag_paths import page_text
from urlatlas.llm.token_records import read_records, write_records
from urlatlas.llm.toxicity import THRESHOLD, fit, toxicity
from urlatlas.llm.warc import read_archives, write_archives
from urlatlas.llm.whitening import whiten
from urlatlas.llm.wu_manber import contaminated, contamination, hit_words


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def op3_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    found = found.withColumn("n_hit", hit_words(F.col("hits")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


def op4_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_code(spark)
    pages = table(spark, sf_dir, "pages")
    text = pages.select("page_id", "url", page_text()(F.col("html")).alias("text"))
    return text.withColumn("n_chars", F.length("text").cast("long"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_archives(table(spark, sf_dir, "pages"), work_dir(spark))
    return read_archives(spark, files)


def op6_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, text`` without repeated passages, ``removed_lines``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeated_chunks(docs)


def held_out() -> Column:
    """Rows whose labels are for testing: crc32 of the id as text, mod 3, is 1 (not so for a null id)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def op8_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, held_out, score, predicted`` and the offending ``spans``."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), ~held_out())
    scored = docs.select("doc_id", toxicity(model, spark)(F.col("text")).alias("t"))
    return scored.select("doc_id", held_out().alias("held_out"), "t.score",
                         (F.col("t.score") >= THRESHOLD).cast("int").alias("predicted"), "t.spans")


def op9_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op10_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_records(table(spark, sf_dir, "documents"), work_dir(spark), public_tokenizers.path("byte_bpe_50k.json"))
    return read_records(spark, files)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proofs(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held out: crc32 of the id as text, mod 4, is 2 (not so for a null id)."""
    kept_back = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return identify(table(spark, sf_dir, "documents"), kept_back)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_secret_links": op2_secret_links,
    "op3_wu_manber": op3_wu_manber,
    "op4_tag_paths": op4_tag_paths,
    "op5_warc": op5_warc,
    "op6_best_fit": op6_best_fit,
    "op7_line_chunks": op7_line_chunks,
    "op8_crf": op8_crf,
    "op9_chunk_recipes": op9_chunk_recipes,
    "op10_token_records": op10_token_records,
    "op11_merkle": op11_merkle,
    "op12_whitening": op12_whitening,
    "op13_language": op13_language,
}

SQL: dict[str, str] = {
    "op11_merkle": proofs_sql(),
    "op5_warc": r"""
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n,
                  sha256(coalesce(html, '')) AS d, url FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, url, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to FROM f""",
    "op3_wu_manber": r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
w AS (SELECT DISTINCT item_id, least(13, len(ws)) AS n,
             array_to_string(list_slice(ws, a, a + least(13, len(ws)) - 1), ' ') AS win
      FROM (SELECT *, unnest(range(1, greatest(0, len(ws) - 12) + 1 + CASE WHEN len(ws) BETWEEN 1 AND 12 THEN 1 ELSE 0 END)) AS a
            FROM iw)),
dp AS (SELECT doc_id, n, a, array_to_string(list_slice(ws, a, a + n - 1), ' ') AS win
       FROM (SELECT doc_id, ws, n, unnest(range(1, greatest(0, len(ws) - n + 1) + 1)) AS a
             FROM dw, (SELECT DISTINCT n FROM w))),
occ AS (SELECT doc_id, dp.n, a, item_id FROM dp JOIN w USING (win) WHERE dp.n = w.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT doc_id, unnest(range(a, a + n)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM occ) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op9_chunk_recipes": r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w = 1 AS kept,
             count(*) OVER (PARTITION BY norm) AS group_size
      FROM d WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, kept, sha256(norm) AS text_sha256 FROM g""",
}
