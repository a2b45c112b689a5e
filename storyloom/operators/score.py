"""Scores of clusters of items. ``items`` has cluster_id, item_id, published_at, source_id, domain, title, summary,
content, url; all times are compared with ``now``."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyloom.functions.dates import age_hours
from storyloom.sources.shared import cut

#: Weights of the three factors, and of the five.
THREE = {"trend": 0.45, "diversity": 0.35, "fresh": 0.20}
FIVE = {"viral": 0.25, "freshness": 0.20, "diversity": 0.20, "volume": 0.15, "quality": 0.20}


def _share(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


# ---- three factors


def trend_spike(counts: DataFrame, history: DataFrame) -> DataFrame:
    """``cluster_id, trend`` from ``counts`` (cluster_id, items_count) and ``history`` (cluster_id, run_ts, n).

    The logistic function of how many deviations a count stands above the last seven; with a shorter history one for two
    items or more, else zero. The history doesn't hold the present count.
    """
    last = history.withColumn("_k", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("run_ts")))).filter("_k <= 7")
    stats = last.groupBy("cluster_id").agg(F.count("*").alias("_n"), F.avg("n").alias("_mean"), F.stddev_pop("n").alias("_sd"))
    z = (F.col("items_count") - F.col("_mean")) / F.when(F.col("_sd") == 0, 1.0).otherwise(F.col("_sd"))
    spike = F.when(F.coalesce("_n", F.lit(0)) < 7, F.when(F.col("items_count") >= 2, 1.0).otherwise(0.0)).otherwise(1 / (1 + F.exp(-z)))
    return counts.join(stats, "cluster_id", "left").select("cluster_id", spike.alias("trend"))


def histogram(items: DataFrame, by: str) -> DataFrame:
    """``cluster_id, <by>, n`` of the values that are neither null nor empty."""
    return items.filter(F.coalesce(F.col(by), F.lit("")) != "").groupBy("cluster_id", by).agg(F.count("*").alias("n"))


def gini(counts: DataFrame) -> DataFrame:
    """``cluster_id, gini`` of the counts ``n``: no negatives here; zero if all are zero."""
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy("n"))
    size = F.count("*").over(Window.partitionBy("cluster_id"))
    ranked = counts.select("cluster_id", F.col("n"), (F.col("n") + 1e-7).alias("x"), rank.alias("i"), size.alias("k"))
    total = F.sum((2 * F.col("i") - F.col("k") - 1) * F.col("x")) / (F.max("k") * F.sum("x"))
    return ranked.groupBy("cluster_id").agg(F.when(F.sum("n") == 0, 0.0).otherwise(total).alias("gini"))


def freshness3(items: DataFrame, now: Column, tau: float) -> DataFrame:
    """``cluster_id, fresh``: exp of minus the mean age over tau hours; an item without time is new."""
    age = F.coalesce(F.greatest(F.lit(0.0), age_hours(F.col("published_at"), now)), F.lit(0.0))
    return items.groupBy("cluster_id").agg(F.exp(-F.avg(age) / tau).alias("fresh"))


def three_factors(items: DataFrame, history: DataFrame, now: Column, tau: float = 3.0) -> DataFrame:
    """``cluster_id, items_count, trend, diversity, fresh, total`` of every cluster."""
    counts = items.groupBy("cluster_id").agg(F.count("*").alias("items_count"))
    spread = gini(histogram(items, "domain")).select("cluster_id", (1 - F.col("gini")).alias("diversity"))
    joined = counts.join(trend_spike(counts, history), "cluster_id").join(spread, "cluster_id", "left").join(freshness3(items, now, tau), "cluster_id")
    scored = joined.select("cluster_id", "items_count", "trend", F.coalesce("diversity", F.lit(0.0)).alias("diversity"), "fresh")
    return scored.withColumn("total", sum((F.col(k) * w for k, w in THREE.items()), F.lit(0.0)))


def open_only(clusters: DataFrame) -> DataFrame:
    return clusters.filter(F.col("status") == "open")


def rank_clusters(scored: DataFrame, k: int = 10, score: str = "total") -> DataFrame:
    """The k best, of the open ones where there is a status; a missing score is zero, the smaller cluster_id goes first among equals."""
    if "status" in scored.columns:
        scored = open_only(scored)
    return scored.orderBy(F.coalesce(F.col(score), F.lit(0.0)).desc(), "cluster_id").limit(k)


# ---- five factors


def item_quality() -> Column:
    """Four quarters: title, summary, content, URL."""
    title, summary, content = (F.trim(F.coalesce(F.col(c), F.lit(""))) for c in ("title", "summary", "content"))
    n = F.length(title)
    plain = ~F.lower(title).rlike("news|update|breaking|latest")
    t = F.when((n >= 10) & (n <= 200), F.least(F.lit(1.0), F.least(F.lit(1.0), n / 100) * F.when(plain, 1.2).otherwise(1.0))).otherwise(0.0)
    s = F.when(F.length(summary) >= 50, F.least(F.lit(1.0), F.length(summary) / 500)).otherwise(0.0)
    c = F.when(F.length(content) >= 100, F.least(F.lit(1.0), F.length(content) / 2000)).otherwise(0.0)
    low = F.lower(F.coalesce("url", F.lit("")))
    hits = sum((F.contains(low, F.lit(x)).cast("int") for x in ("redirect", "track", "utm_", "fb_", "gclid")), F.lit(0))
    u = F.when(low != "", F.pow(F.lit(0.8), hits)).otherwise(0.0)
    return F.least(F.lit(1.0), 0.25 * (t + s + c + u))


def cluster_parts(items: DataFrame, now: Column) -> DataFrame:
    """One row of sums per cluster, from one pass over the items."""
    return _sums(_slim(items, now))


def _slim(items: DataFrame, now: Column) -> DataFrame:
    """What the five factors need of an item: no texts."""
    age = F.coalesce(age_hours(F.col("published_at"), now), F.lit(0.0))
    return items.select("cluster_id", "source_id", "domain", age.alias("_age"), F.greatest(F.lit(0), age.cast("int")).alias("_h"), item_quality().alias("_quality"))


def _sums(slim: DataFrame) -> DataFrame:
    return slim.groupBy("cluster_id").agg(
        F.count("*").alias("item_count"),
        F.avg("_age").alias("avg_age_hours"),
        F.count_if(F.col("_age") <= 6).alias("young"),
        F.count_if(F.col("_h") <= 6).alias("recent"),
        F.max(F.when(F.col("_h") <= 6, F.col("_h"))).alias("recent_max"),
        F.max("_h").alias("hour_max"),
        F.avg("_quality").alias("quality"),
    )


def viral() -> Column:
    recent = F.when(F.col("recent") > 0, F.col("recent") / F.least(F.lit(6), F.col("recent_max") + 1)).otherwise(0.0)
    ratio = recent / (F.col("item_count") / F.greatest(F.lit(1), F.col("hour_max") + 1))
    return F.when(F.col("item_count") < 2, 0.0).otherwise(F.least(F.lit(1.0), F.log(1 + ratio) / math.log(10)))


def freshness5() -> Column:
    return F.least(F.lit(1.0), 0.7 * F.exp(-F.col("avg_age_hours") / 12) + 0.3 * F.col("young") / F.col("item_count"))


def entropy(items: DataFrame, by: str = "source_id") -> DataFrame:
    """``cluster_id, entropy, kinds``: in bits, the shares being of all items, also those without a value."""
    sizes = items.groupBy("cluster_id").agg(F.count("*").alias("_all"))
    p = F.col("n") / F.col("_all")
    return histogram(items, by).join(sizes, "cluster_id").groupBy("cluster_id").agg(F.sum(-p * F.log2(p)).alias("entropy"), F.count("*").alias("kinds"))


def diversity5() -> Column:
    """From entropy, kinds (sources), domains and item_count."""
    h = F.when(F.coalesce("kinds", F.lit(0)) > 1, F.col("entropy") / F.log2(F.col("kinds").cast("double"))).otherwise(0.0)
    d = F.least(F.lit(1.0), F.coalesce("domains", F.lit(0)) / F.greatest(F.lit(1.0), 0.5 * F.col("item_count")))
    return F.least(F.lit(1.0), 0.6 * h + 0.4 * d)


def volume(average: Column) -> Column:
    ratio = F.coalesce(F.when(average > 0, F.col("item_count") / average), F.lit(1.0))
    return F.least(F.lit(1.0), 0.7 * F.log(1 + F.col("item_count").cast("double")) / math.log(100) + 0.3 * F.least(F.lit(2.0), ratio) / 2)


def five_factors(items: DataFrame, now: Column, least: int = 3) -> DataFrame:
    """All factors and ``composite``; a cluster of fewer than ``least`` items keeps its row, with zeros."""
    slim = cut(_slim(items, now), "slim")  # the items are scanned once for all aggregates
    parts = _sums(slim)
    domains = histogram(slim, "domain").groupBy("cluster_id").agg(F.count("*").alias("domains"))
    joined = parts.join(entropy(slim), "cluster_id", "left").join(domains, "cluster_id", "left")
    average = parts.agg(F.avg("item_count")).scalar()
    total = sum(FIVE.values())
    big = F.col("item_count") >= least
    factors = {"viral": viral(), "freshness": freshness5(), "diversity": diversity5(), "volume": volume(average), "quality": F.col("quality")}
    kept = joined.select("cluster_id", "item_count", *[F.when(big, F.coalesce(c, F.lit(0.0))).otherwise(0.0).alias(k) for k, c in factors.items()], "avg_age_hours", F.coalesce("kinds", F.lit(0)).alias("unique_sources"), F.coalesce("domains", F.lit(0)).alias("unique_domains"))
    return kept.withColumn("composite", _share(sum((F.col(k) * (w / total) for k, w in FIVE.items()), F.lit(0.0))))
