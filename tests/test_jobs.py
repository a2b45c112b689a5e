"""Jobs from end to end, the places for a user's functions, and the stored tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyloom.operators import slots
from storyloom.plans import jobs
from storyloom.plans.items import items, now, table
from storyloom.plans.selection import TOPICS
from storyloom.sources import tables

DIR = "/root/testdata/sf0.001"


def test_ingest_job(spark):
    docs = table(spark, DIR, "documents")
    entries = docs.select(F.col("doc_id").alias("entry_id"), F.get(F.split("text", "\n"), F.lit(0)).alias("title"), F.when(F.col("doc_id") % 9 != 0, F.concat(F.lit("http://x.org/"), F.col("doc_id") % 150)).alias("link"), F.col("text").alias("summary"), F.lit("2024-01-02T03:04:05Z").alias("published"))
    none = spark.createDataFrame([], "h long, url_sha1 string")
    run = jobs.run_ingest(entries, none, none, now())
    rejects = run.tables["rejects"].count()
    c = run.tables["counters"].first()
    assert rejects >= docs.filter("doc_id % 9 = 0").count() and c.items_total == docs.count() - rejects
    assert c.items_inserted == run.tables["inserted"].count() > 50 and c.items_duplicated > 0
    assert set(run.seconds) == {"normal", "rejects", "outcomes", "inserted", "counters"}
    again = jobs.run_ingest(entries, run.tables["inserted"], run.tables["inserted"], now())
    assert again.tables["counters"].first().items_inserted == 0


def test_jobs_within_a_window(spark):
    """Near texts outside the window don't filter; clusters are scored on the window's items."""
    entries = spark.createDataFrame([(1, "a long title of some words", "http://a/1", "body"), (2, "quite another title here", "http://a/2", "text")], "entry_id long, title string, link string, summary string")
    normal = jobs.run_ingest(entries, none := spark.createDataFrame([], "h long, url_sha1 string"), none, now()).tables["normal"]
    old = normal.filter("entry_id = 1").select("h", (now() - F.expr("interval 30 hours")).alias("fetched_at"))
    told = lambda hours: {r.item_id: r.outcome for r in jobs.run_ingest(entries, none, old, now(), hours).tables["outcomes"].collect()}
    assert told(48) == told(None) == {1: "filtered", 2: "inserted"} and told(24) == {1: "inserted", 2: "inserted"}
    held = items(spark, DIR)
    some = held.filter(F.col("fetched_at") >= now() - F.expr("interval 720 hours"))
    assert jobs.run_trending(held, now(), 5, 720).tables["metrics"].count() == some.select("cluster_id").distinct().count() > 0


def test_trending_and_topics_together(spark, tmp_path):
    last = spark.createDataFrame([("sea", None)], "topic_key string, last_run timestamp_ntz")
    centroids = table(spark, DIR, "embeddings").select(F.col("vec_id").alias("cluster_id"), F.col("embedding").alias("centroid"))
    run = jobs.run_all(items(spark, DIR), TOPICS, last, centroids, now(), 10)
    stats, checks = run.tables["stats"].first(), run.tables["checks"].first()
    assert stats.total_picks == run.tables["picks"].count() and stats.topics_represented >= 1
    assert checks.enough_picks and checks.clustered and checks.in_time and 0.75 <= checks.score <= 1
    assert jobs.persist(run, str(tmp_path), ["picks", "stats"]) == {"picks": stats.total_picks, "stats": 1}
    assert spark.read.parquet(f"{tmp_path}/picks").count() == stats.total_picks


def test_an_embedder_and_a_provider_of_ones_own(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, None)], "item_id long, t string")
    got = {r.id: r.v for r in slots.embed(rows, F.col("t"), lambda texts: np.array([[len(t), 1.0] for t in texts])).collect()}
    assert got == {1: [2.0, 1.0], 2: [0.0, 1.0]}
    assert slots.embed(rows, F.col("t")).select(F.size("v")).distinct().collect() == [(384,)]

    def longer(b):
        return b.assign(t=b["t"] + "x" * 30)

    slots.register("longer", longer)
    drafts = spark.createDataFrame([(1, "a" * 80), (2, "a" * 10), (3, "a" * 50)], "id long, t string")
    best = slots.improve(drafts, "id", slots.provider("longer"), lambda d: F.length("t"), rounds=2)
    assert {r.id: (r.score, r.iterations) for r in best.collect()} == {1: (80, 0), 2: (70, 2), 3: (80, 1)}
    with pytest.raises(ValueError, match="nobody"):
        slots.provider("nobody")
    assert slots.generate(spark.createDataFrame([(1, " a  b ")], "id long, t string"), slots.provider("plain")).first().t == "a b"


def test_tables_are_made_once_and_removed(spark, tmp_path):
    at = str(tmp_path / "store")
    tables.create_all(spark, at)
    feeds = spark.createDataFrame([("A", "http://a.org"), ("B", "http://b.org"), ("B2", "http://b.org")], "name string, url string")
    assert tables.seed(spark, at, feeds) == 2
    tables.create_all(spark, at)
    assert tables.read(spark, at, "sources").count() == 2 and tables.seed(spark, at, feeds) == 0
    tables.drop_all(spark, at)
    assert not any((tmp_path / "store" / n).exists() for n in tables.SCHEMAS)
