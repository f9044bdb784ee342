"""The ten operators over their whole tables, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import brown, decontaminate, exact, langid, packing, pii, quality, simhash, tokens, urls

#: Domains whose pages and subdomains' pages are blocked. The query's list also has an eighth of the pages' URLs, by their digest, and as many that don't occur.
BLOCKLIST = ("spam-farm.example.org", "free-bets.example.com", "cheap-pills.example.com", "malware.example.net", "phishing.example.com")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.duplicates(_table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return brown.score(docs, brown.train(docs))


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.tokenized(_table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    some = pages.where(F.substring(F.sha2("url", 256), 1, 1).isin("0", "1")).select(F.explode(F.array("url", F.concat(F.lit("https://elsewhere.example/"), F.sha2("url", 256)))).alias("key"))
    return urls.blocked(pages, some.union(spark.createDataFrame([(d,) for d in BLOCKLIST], "key string")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_exact_dedup, op2_pii, op3_packing, op4_quality, op5_lm_scoring, op6_token_output, op7_language_id, op8_decontamination, op9_simhash, op10_url_filter)}


def oracle_sql() -> dict[str, str]:
    listed = ", ".join(f"('{d}')" for d in BLOCKLIST)
    return {
        "op1_exact_dedup": """
            SELECT doc_id, owner AS duplicate_of FROM (
                SELECT doc_id, first_value(doc_id) OVER w AS owner, row_number() OVER w AS place FROM documents WHERE text IS NOT NULL
                WINDOW w AS (PARTITION BY text ORDER BY doc_id NULLS LAST)) WHERE place > 1""",
        "op8_decontamination": r"""
            WITH words AS (
                SELECT 'd' AS side, doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents
                UNION ALL SELECT 'b', item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') FROM benchmark),
            tests AS (SELECT id, w, least(8, len(w)) AS k FROM words WHERE side = 'b' AND (len(w) >= 5 OR length(array_to_string(w, '')) >= 24)),
            grams AS (SELECT DISTINCT id, array_to_string(w[i:i + k - 1], ' ') AS gram FROM (SELECT id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM tests)),
            sizes AS (SELECT DISTINCT k FROM tests),
            runs AS (SELECT DISTINCT id, array_to_string(w[i:i + k - 1], ' ') AS gram FROM (SELECT id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, sizes WHERE side = 'd' AND len(w) >= k))
            SELECT runs.id AS doc_id, grams.id AS item_id, count(DISTINCT gram) AS passages FROM runs JOIN grams USING (gram) GROUP BY ALL""",
        "op10_url_filter": rf"""
            WITH p AS (
                SELECT page_id, url, nullif(regexp_extract(lower(url), '^\s*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:\s]+)', 1), '') AS host,
                    regexp_replace(regexp_extract(lower(url), '^\s*[a-z][a-z0-9+.-]*://[^/?#\s]+([^#\s]*)', 1), '/$', '') AS rest FROM pages),
            c AS (SELECT *, string_split(host, '.') AS parts, regexp_replace(host, '^www\.', '') || rest AS canonical FROM p),
            listed AS (
                SELECT CASE WHEN rest = '' THEN host ELSE canonical END AS key FROM c WHERE host IS NOT NULL AND substr(sha256(url), 1, 1) IN ('0', '1')
                UNION SELECT * FROM (VALUES {listed})),
            keys AS (SELECT page_id, url, unnest(list_append([array_to_string(parts[i:], '.') FOR i IN range(1, len(parts) + 1)], canonical)) AS key FROM c WHERE host IS NOT NULL),
            hits AS (SELECT DISTINCT page_id, url, true AS hit FROM keys SEMI JOIN listed ON keys.key = listed.key)
            SELECT c.page_id, c.url, host, coalesce(hit, false) AS blocked FROM c LEFT JOIN hits ON c.page_id IS NOT DISTINCT FROM hits.page_id AND c.url = hits.url""",
    }
