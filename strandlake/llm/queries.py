"""The queries of this subpackage: name -> function of (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anisotropic, decontaminate, html_extract, language_id, lm_score, order_minhash, packing, sharding, suffix_dedup, warc
from .shared import documents


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    out = language_id.predict_languages(documents(spark, sf_dir), train=~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_anisotropic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anisotropic.nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(documents(spark, sf_dir))


def crawl_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WARC records of a crawl of ``pages``: every page is answered in full at second
    page_id of the log, with its checksum as entity tag; pages of one canonical URL are
    versions of it.  Each URL is asked for again 40 days after each of its versions
    with the tag of that version; every seventh tag is one that was never issued."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.md5(F.coalesce("html", F.lit("")).cast("binary")).alias("tag"))
    time = lambda days: F.timestamp_seconds(F.lit(1_600_000_000) + F.col("page_id") + days * 86_400)
    quoted = F.concat(F.lit('"'), "tag", F.lit('"'))
    text = F.col("page_id").cast("string")
    full = pages.select(
        F.concat(F.lit("r"), text).alias("record_id"), F.lit("response").alias("type"), "url", time(0).alias("time"), F.lit(200).alias("status"),
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("date"), text, F.lit("etag"), quoted).alias("headers"),
    )
    asked = F.when(F.col("page_id") % 7 == 3, F.lit('"none"')).otherwise(F.concat(F.lit("W/"), quoted))
    again = pages.select(
        F.concat(F.lit("v"), text).alias("record_id"), F.lit("revisit").alias("type"), "url", time(40).alias("time"), F.lit(304).alias("status"),
        F.create_map(F.lit("content-type"), F.lit("text/plain"), F.lit("date"), F.concat(text, F.lit("+40")), F.lit("etag"), asked).alias("headers"),
    )
    return full.unionByName(again)


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(crawl_log(spark, sf_dir))
    pick = lambda name: F.element_at("headers", name)
    return found.select(
        F.substring("record_id", 2, 20).cast("long").alias("page_id"), "canonical", F.substring("source_id", 2, 20).cast("long").alias("source_page_id"),
        pick("content-type").alias("content_type"), pick("date").alias("date"), pick("etag").alias("etag"),
    )


OP7_SQL = r"""
WITH u AS (
  SELECT page_id, url, md5(coalesce(html, '')) AS tag,
    regexp_replace(trim(url), '#.*$', '') AS s FROM pages
), p AS (
  SELECT *, regexp_extract(s, '^[A-Za-z]+://(?:[^@/?]*@)?([^?]*)', 1) AS rest,
    list_aggregate(list_sort(list_filter(string_split(regexp_extract(s, '\?(.*)$', 1), '&'),
      lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[a-z]+|fbclid|gclid|ref|sessionid|sid)='))), 'string_agg', '&') AS query FROM u
), h AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/]*)', 1)), '^www\.', ''), ':(80|443)$', '') AS host,
    regexp_replace(regexp_replace(regexp_extract(rest, '^[^/]*(/.*)?$', 1), '/(index\.html?)?$', ''), '/{2,}', '/', 'g') AS path FROM p
), c AS (
  SELECT page_id, tag, CASE WHEN host <> '' THEN 'https://' || host || path || CASE WHEN coalesce(query, '') <> '' THEN '?' || query ELSE '' END ELSE trim(url) END AS canonical FROM h
), a AS (
  SELECT page_id, canonical, CASE WHEN page_id % 7 = 3 THEN 'none' ELSE tag END AS tag, page_id + 40 * 86400 AS t FROM c
), hit AS (
  SELECT a.page_id, max(c.page_id) AS source_page_id FROM a JOIN c ON a.canonical = c.canonical AND a.tag = c.tag AND c.page_id < a.t GROUP BY a.page_id
)
SELECT a.page_id, a.canonical, hit.source_page_id,
  CASE WHEN source_page_id IS NOT NULL THEN 'text/html' END AS content_type,
  CASE WHEN source_page_id IS NOT NULL THEN a.page_id || '+40' END AS date,
  CASE WHEN source_page_id IS NOT NULL THEN 'W/"' || a.tag || '"' END AS etag
FROM a LEFT JOIN hit ON a.page_id = hit.page_id
"""


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(documents(spark, sf_dir)).select("doc_id", "class_id", "n_links")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.benchmark_hits(documents(spark, sf_dir).select("doc_id", "text"), benchmark)
    return found.select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.*")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1
    return lm_score.score_texts(documents(spark, sf_dir), train)


QUERIES = {
    f.__name__: f
    for f in (op1_packing, op2_language_id, op3_anisotropic_search, op4_suffix_dedup, op5_html_extraction, op6_sharding, op7_warc_revisits, op8_order_minhash, op9_decontamination, op10_lm_scoring)
}
ORACLES: dict[str, str] = {"op7_warc_revisits": OP7_SQL}
