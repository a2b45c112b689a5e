"""The items of the tables at hand, in the shape of feed items; and the same as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.functions import dates, url

NOW_TEXT = "2024-01-31 00:00:00"
CLUSTERS = 50


def now() -> Column:
    return dates.literal(NOW_TEXT)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the event and the page of the same number: title, summary, content, times, URL, domain, cluster."""
    d = table(spark, sf_dir, "documents")
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.col("ts").cast("timestamp_ntz").alias("fetched_at"))
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url")
    joined = d.join(e, "doc_id", "left").join(p, "doc_id", "left")
    return joined.select(
        F.col("doc_id").alias("item_id"),
        F.col("source").alias("source_id"),
        F.col("source").alias("source_url"),
        F.get(F.split("text", "\n"), F.lit(0)).alias("title"),
        F.col("text").alias("summary"),
        F.col("text").alias("content"),
        "lang",
        "fetched_at",
        F.col("fetched_at").alias("published_at"),
        "url",
        F.when(F.col("url").isNotNull(), url.domain(F.col("url"))).alias("domain"),
        (F.col("doc_id") % CLUSTERS).alias("cluster_id"),
    )


ITEMS = f"""items AS (
    SELECT d.doc_id AS item_id, d.source AS source_id, d.source AS source_url, string_split(d.text, chr(10))[1] AS title,
           d.text AS summary, d.text AS content, d.lang, e.ts AS fetched_at, e.ts AS published_at, p.url,
           CASE WHEN p.url IS NOT NULL THEN lower(regexp_extract(p.url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) END AS domain,
           d.doc_id % {CLUSTERS} AS cluster_id
    FROM documents d LEFT JOIN events e ON e.event_id = d.doc_id LEFT JOIN pages p ON p.page_id = d.doc_id)"""
NOW = f"TIMESTAMP '{NOW_TEXT}'"
AGE = f"(epoch_us({NOW}) - epoch_us(published_at)) / 3.6e9"
