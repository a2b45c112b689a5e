"""Stored tables without MERGE: each function returns the table's next state, which the caller writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyloom.operators.dedup import first_by
from storyloom.sources.shared import cut


def upsert(stored: DataFrame, new: DataFrame, key: str, changed: list[str], defaults: dict[str, Column] | None = None) -> DataFrame:
    """Rows of ``new`` replace the ``changed`` columns of the row with their key, where they aren't null; others are added.

    In an added row a null column takes its default.
    """
    defaults = defaults or {}
    s, n = stored.alias("s"), new.alias("n")
    joined = s.join(n, F.col(f"s.{key}") == F.col(f"n.{key}"), "full")
    old = F.col(f"s.{key}").isNotNull()
    out = []
    for c in stored.columns:
        given = F.col(f"n.{c}") if c in new.columns else F.lit(None)
        if c == key:
            value = F.coalesce(f"s.{key}", f"n.{key}")
        elif c in changed:
            value = F.coalesce(given, F.when(old, F.col(f"s.{c}")), defaults.get(c, F.lit(None)))
        else:
            value = F.when(old, F.col(f"s.{c}")).otherwise(F.coalesce(given, defaults.get(c, F.lit(None))))
        out.append(value.cast(stored.schema[c].dataType).alias(c))
    return joined.select(*out)


def replace(stored: DataFrame, new: DataFrame, key: str, defaults: dict[str, Column]) -> DataFrame:
    """Rows of ``new`` replace the whole row with their key: a column that they don't give falls back to its default."""
    full = new.select(*[(F.coalesce(F.col(c), defaults.get(c, F.lit(None))) if c in new.columns else defaults.get(c, F.lit(None))).cast(stored.schema[c].dataType).alias(c) for c in stored.columns])
    return stored.join(full.select(key), key, "left_anti").select(stored.columns).unionByName(full)


def attach(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Memberships (cluster_id, raw_item_id, ..., created_at): the latest of each pair stays."""
    return first_by(stored.unionByName(new), ["cluster_id", "raw_item_id"], [F.desc("created_at")])


def retain(stored: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """What is at most ``days`` old."""
    return stored.filter(F.col("fetched_at") >= now - F.expr(f"interval {days} days"))


def delete_old(stored: DataFrame, now: Column, days: int = 30) -> tuple[DataFrame, int]:
    """The rows at most ``days`` old as a written table, and how many others there were, counted as that is written.

    A row without a time goes with the old ones."""
    seen = Observation()
    old = F.coalesce(F.col("fetched_at") < now - F.expr(f"interval {days} days"), F.lit(True))
    table = cut(retain(stored.observe(seen, F.count_if(old).alias("deleted")), now, days), "retained")
    return table, int(seen.get["deleted"])


def history(counts: DataFrame, now: Column, most: int = 30, days: int = 30) -> DataFrame:
    """Of (cluster_id, run_ts, n) the last ``most`` of each cluster that aren't older than ``days``."""
    young = counts.filter(F.col("run_ts") >= now - F.expr(f"interval {days} days"))
    k = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("run_ts")))
    return young.withColumn("age_rank", k).filter(F.col("age_rank") <= most)


def update(stored: DataFrame, changes: DataFrame, key: str, stamps: dict[str, Column] | None = None) -> DataFrame:
    """The rows whose key is in ``changes`` (once each) take its values that aren't null, and the stamps; others stay."""
    given = [c for c in changes.columns if c != key]
    side = changes.select(F.col(key), *[F.col(c).alias(f"_new_{c}") for c in given], F.lit(True).alias("_hit"))
    joined = stored.join(side, key, "left")
    out = []
    for c in stored.columns:
        value = F.coalesce(F.col(f"_new_{c}"), F.col(c)) if c in given else F.col(c)
        if stamps and c in stamps:
            value = F.when(F.col("_hit"), stamps[c]).otherwise(value)
        out.append(value.cast(stored.schema[c].dataType).alias(c))
    return joined.select(*out)


def set_centroids(clusters: DataFrame, centroids: DataFrame, now: Column) -> DataFrame:
    """New centroids (cluster_id, centroid), and when they came."""
    return update(clusters, centroids, "cluster_id", {"updated_at": now})


def set_scores(clusters: DataFrame, scores: DataFrame, now: Column) -> DataFrame:
    """New scores by cluster_id: a component that is null keeps its old value."""
    return update(clusters, scores, "cluster_id", {"updated_at": now, "last_scored_at": now})


def mark_runs(topics: DataFrame, ran: DataFrame, now: Column) -> DataFrame:
    """The topics (topic_key, last_run) that ran: now."""
    return update(topics, ran.select("topic_key"), "topic_key", {"last_run": now})


def insert_batch(batch: DataFrame, stored: DataFrame, order: list[Column]) -> DataFrame:
    """The batch with ``created``: whether its row is the first of its ``url_sha1`` and isn't stored. Their count is exact."""
    known = stored.select("url_sha1").distinct().withColumn("_known", F.lit(True))
    ranked = batch.withColumn("_k", F.row_number().over(Window.partitionBy("url_sha1").orderBy(*order)))
    return ranked.join(known, "url_sha1", "left").withColumn("created", (F.col("_k") == 1) & F.col("_known").isNull()).drop("_k", "_known")


def append_history(stored: DataFrame, counts: DataFrame, now: Column, most: int = 30, days: int = 30) -> DataFrame:
    """The history (cluster_id, run_ts, n) with the counts (cluster_id, n) of now, cut to the last ``most`` of the last days."""
    return history(stored.select("cluster_id", "run_ts", "n").unionByName(counts.select("cluster_id", now.alias("run_ts"), "n")), now, most, days).drop("age_rank")


def create_cluster(clusters: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Clusters with new ones (cluster_id, centroid, ...) appended: open, seen first and last now."""
    seen = {"status": F.lit("open"), "first_seen": now, "last_seen": now, "items_count": F.lit(0)}
    full = [(F.coalesce(F.col(c), seen.get(c, F.lit(None))) if c in new.columns else seen.get(c, F.lit(None))).cast(clusters.schema[c].dataType).alias(c) for c in clusters.columns]
    return clusters.unionByName(new.select(*full))
