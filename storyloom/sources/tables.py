"""The stored tables: their columns, and making or removing them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "sources": "id long, name string, type string, url string, lang string, active boolean, etag string, last_modified timestamp_ntz, last_checked_at timestamp_ntz, error_count int",
    "items": "item_id long, source_id long, title string, url string, url_sha1 string, summary string, lang string, h long, payload string, published_at timestamp_ntz, fetched_at timestamp_ntz",
    "clusters": "cluster_id long, topic_key string, status string, centroid array<double>, first_seen timestamp_ntz, last_seen timestamp_ntz, items_count long, domains_count long, domains map<string,bigint>, score_trend double, score_diversity double, score_fresh double, score_total double, updated_at timestamp_ntz",
    "cluster_items": "cluster_id long, raw_item_id long, source_domain string, similarity double, created_at timestamp_ntz",
    "topics": "topic_key string, name string, enabled boolean, priority double, cadence_minutes int, max_posts_per_run int, last_run timestamp_ntz",
    "history": "cluster_id long, run_ts timestamp_ntz, n long",
}


def create_all(spark: SparkSession, at: str) -> None:
    """Empty tables in a folder; those that are there stay."""
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{at}/{name}")


def read(spark: SparkSession, at: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{at}/{name}")


def drop_all(spark: SparkSession, at: str) -> None:
    """Remove the tables, and nothing else."""
    for name in SCHEMAS:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/{name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def seed(spark: SparkSession, at: str, sources: DataFrame) -> int:
    """Sources of a catalogue that aren't stored by URL yet are added; how many."""
    stored = read(spark, at, "sources")
    new = sources.join(stored.select("url"), "url", "left_anti").dropDuplicates(["url"])
    from pyspark.sql import functions as F

    schema = stored.schema
    rows = new.select(*[(F.xxhash64("url") if c == "id" else F.lit(0) if c == "error_count" else F.col(c) if c in new.columns else F.lit(None)).cast(schema[c].dataType).alias(c) for c in stored.columns])
    count = rows.count()
    rows.write.mode("append").parquet(f"{at}/sources")
    return count
