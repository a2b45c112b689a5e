"""Selection of stories: global and per topic, without overlap."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyloom.functions.text import occurrences, shorten
from storyloom.operators.dedup import top_by
from storyloom.operators.leaders import unit_rows
from storyloom.sources.shared import cut

#: Picks in a block: two blocks are compared at a time.
BLOCK = 1024


def global_picks(metrics: DataFrame, k: int = 50) -> DataFrame:
    """The k clusters of highest composite, with ranks from 1."""
    top = metrics.select("cluster_id", F.col("composite").alias("score_total"), F.col("composite").alias("adjusted")).orderBy(F.desc("score_total"), "cluster_id").limit(k)
    rank = F.row_number().over(Window.orderBy(F.desc("adjusted"), "cluster_id"))  # k rows
    return top.select("cluster_id", "score_total", "adjusted", F.lit("global").alias("kind"), F.lit(None).cast("string").alias("topic_key"), F.lit(None).cast("double").alias("priority"), rank.alias("rank"))


def topic_picks(metrics: DataFrame, mapped: DataFrame, topics: DataFrame) -> DataFrame:
    """Per enabled topic its best clusters by priority times composite.

    ``mapped`` is (cluster_id, topic_key); ``topics`` (topic_key, priority, enabled, cap) is configuration, a row per topic.
    """
    on = F.broadcast(topics.filter("enabled"))
    found = metrics.join(mapped, "cluster_id").join(on, "topic_key").withColumn("adjusted", F.col("priority") * F.col("composite"))
    rank = F.row_number().over(Window.partitionBy("topic_key").orderBy(F.desc("adjusted"), "cluster_id"))
    kept = found.withColumn("rank", rank).filter(F.col("rank") <= F.col("cap"))
    return kept.select("cluster_id", F.col("composite").alias("score_total"), "adjusted", F.lit("topic").alias("kind"), "topic_key", "priority", "rank")


def _losers(a: pd.DataFrame, b: pd.DataFrame, limit: float, within: bool) -> list[pd.DataFrame]:
    """The rows of either that overlap with one of the other and lose: topics beat global picks, then priority, then the
    adjusted score decides; the one that stands later wins a draw."""
    x, y = unit_rows(a["centroid"]), unit_rows(b["centroid"])
    same = a["cluster_id"].to_numpy()[:, None] == b["cluster_id"].to_numpy()[None, :]
    near = same | (x @ y.T >= limit)
    earlier = a["place"].to_numpy()[:, None] < b["place"].to_numpy()[None, :]
    near &= earlier if within else True
    column = lambda name: (a[name].to_numpy()[:, None], b[name].to_numpy()[None, :])
    (topic_a, topic_b), (p, q), (s, t) = column("is_topic"), column("priority"), column("adjusted")
    more = np.where(earlier, s > t, s >= t)
    first = np.where(topic_a != topic_b, topic_a, np.where(topic_a & topic_b & (p != q), p > q, more))
    return [a[(near & ~first).any(axis=1)], b[(near & first).any(axis=0)]]


def without_overlap(picks: DataFrame, centroids: DataFrame, limit: float = 0.9, size: int = BLOCK) -> DataFrame:
    """The picks that lose to no other of cosine ``limit`` or more, global ones first, then topics by key, each by rank.

    A pick that loses still beats others. Picks are compared in pairs of blocks, each of which tells its losers alone; a
    pick without a centroid overlaps with none.
    """
    key = ["kind", "topic_key", "cluster_id"]
    held = cut(picks.join(centroids.select("cluster_id", F.col("centroid").cast("array<double>").alias("centroid")), "cluster_id").filter("centroid is not null"), "picks")
    n = max(1, -(-held.count() // size))
    block = F.pmod(F.xxhash64("kind", "topic_key", "cluster_id"), F.lit(n)).cast("int")
    told = held.select(*key, "rank", "adjusted", "centroid", (F.col("kind") == "topic").alias("is_topic"), F.coalesce("priority", F.lit(1.0)).alias("priority"), block.alias("own"))
    met = told.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})

    def compared(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["is_topic", "topic_key", "rank", "cluster_id"], na_position="first").assign(place=range(len(pdf)))
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        a, b = pdf[pdf["own"] == i], pdf[pdf["own"] == j]
        found = _losers(a, b, limit, i == j) if len(a) and len(b) else [a.iloc[:0]]
        return pd.concat(found)[key].drop_duplicates()

    kinds = ", ".join(f"{c} {t}" for c, t in held.select(key).dtypes)
    losers = met.groupBy("i", "j").applyInPandas(compared, kinds).distinct()
    on = [picks[c].eqNullSafe(losers[c]) for c in key]
    return picks.join(losers, on, "left_anti")


def freshness_boost() -> Column:
    age = F.col("avg_age_hours")
    return F.when(age <= 6, F.least(F.lit(1.2), 1 + (6 - age) / 6 * 0.2)).otherwise(1.0)


def trends(metrics: DataFrame, k: int, least: float = 0.1) -> DataFrame:
    """The k best of at least ``least``, ranked again after the boost for fresh ones."""
    top = metrics.filter(F.col("composite") >= least).orderBy(F.desc("composite"), "cluster_id").limit(k)
    boosted = top.withColumn("adjusted", F.col("composite") * freshness_boost())
    return boosted.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("adjusted"), "cluster_id")))  # k rows


def topic_trends(metrics: DataFrame, relevance: DataFrame, k: int, least: float = 0.1) -> DataFrame:
    """The k best by composite * (1 + relevance) of the clusters relevant enough."""
    found = metrics.join(relevance, "cluster_id").filter(F.col("relevance") > least).withColumn("adjusted", F.col("composite") * (1 + F.col("relevance")))
    return found.orderBy(F.desc("adjusted"), "cluster_id").limit(k)


def selection_stats(picks: DataFrame) -> DataFrame:
    """One row: picks in all, of each kind, and the topics that have some."""
    topic = F.col("kind") == "topic"
    return picks.agg(F.count("*").alias("total_picks"), F.count_if(~topic).alias("global_count"), F.count_if(topic).alias("topic_count"), F.count_distinct(F.when(topic, F.col("topic_key"))).alias("topics_represented"))


def trend_stats(candidates: DataFrame, trends_: DataFrame, topical: DataFrame) -> DataFrame:
    """One row: candidates, trends selected globally and for a topic, the best and the mean of the global ones."""
    told = trends_.agg(F.count("*").alias("global_selected"), F.coalesce(F.max("adjusted"), F.lit(0.0)).alias("top_global_score"), F.coalesce(F.avg("adjusted"), F.lit(0.0)).alias("avg_global_score"))
    return told.select(candidates.agg(F.count("*")).scalar().alias("total_candidates"), "global_selected", topical.agg(F.count("*")).scalar().alias("topic_selected"), "top_global_score", "avg_global_score")


def first_items(items: DataFrame, most: int = 3) -> DataFrame:
    """The newest items of each cluster, ``most`` of them, ranked."""
    return top_by(items, ["cluster_id"], [F.desc("published_at"), F.col("item_id")], most, "rank")


def domain_sets(items: DataFrame) -> DataFrame:
    """``cluster_id, domains``: each cluster's distinct domains in order."""
    pairs = items.filter(F.coalesce("domain", F.lit("")) != "").select("cluster_id", "domain").distinct()
    return pairs.groupBy("cluster_id").agg(F.sort_array(F.collect_list("domain")).alias("domains"))


def representatives(items: DataFrame) -> DataFrame:
    """``cluster_id, title, summary, domains, sources``: the longest title with fewest alarm words, the longest summary.

    Among equals the item of smallest item_id speaks.
    """
    title, summary = F.trim(F.coalesce("title", F.lit(""))), F.trim(F.coalesce("summary", F.lit("")))
    low = F.lower(title)
    by_title = F.struct(F.length(title), -occurrences(low, "breaking"), -occurrences(low, "update"), -F.col("item_id"))
    by_summary = F.struct(F.length(summary), -F.col("item_id"))
    return items.groupBy("cluster_id").agg(
        F.max_by(title, by_title).alias("title"), shorten(F.max_by(summary, by_summary)).alias("summary"), F.count_distinct(F.nullif(F.col("domain"), F.lit(""))).alias("domains"), F.count_distinct(F.nullif(F.col("source_id"), F.lit(""))).alias("sources")
    )
