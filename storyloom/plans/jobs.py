"""Whole jobs: ingest, trending, topics, both; their stages timed, their results checked and written."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions import dates
from storyloom.operators import ingest, score, select, topics
from storyloom.operators.topics import Topic
from storyloom.sources.shared import cut


@dataclass
class Run:
    """A job's tables, and how long each stage took."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    seconds: dict[str, float] = field(default_factory=dict)

    def stage(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        began = time.monotonic()
        self.tables[name] = cut(make(), name)
        self.seconds[name] = time.monotonic() - began
        return self.tables[name]


def within(rows: DataFrame, now: Column, window_hours: int | None) -> DataFrame:
    """The rows fetched within the window; all without one."""
    return rows if window_hours is None else rows.filter(dates.recent(F.col("fetched_at"), now, window_hours))


def run_ingest(entries: DataFrame, stored: DataFrame, recent: DataFrame, now: Column, window_hours: int | None = None) -> Run:
    """Normalise entries (with entry_id), reject the invalid ones, and insert what is new: ``normal, rejects, outcomes,
    inserted, counters``. With a window only recent rows fetched within it (by ``fetched_at``) filter near texts; a stored
    URL counts however old it is."""
    run = Run()
    recent = within(recent, now, window_hours)
    normal = run.stage("normal", lambda: ingest.normalise(entries, now))
    run.stage("rejects", lambda: normal.filter("not valid"))
    order = F.concat(F.date_format("published_at", "yyyyMMddHHmmssSSSSSS"), F.lpad(F.col("entry_id").cast("string"), 20, "0"))
    ranked = normal.filter("valid").select(F.col("entry_id").alias("item_id"), order.alias("rank"), "h", "url_sha1")
    began = time.monotonic()
    outcomes, counted = ingest.written_outcomes(ingest.run(ranked, stored, recent))
    run.tables["outcomes"], run.seconds["outcomes"] = outcomes, time.monotonic() - began
    new = outcomes.filter("outcome = 'inserted'").select(F.col("item_id").alias("entry_id"))
    run.stage("inserted", lambda: normal.join(new, "entry_id", "left_semi"))
    run.stage("counters", lambda: counted)
    return run


def run_trending(items: DataFrame, now: Column, k: int = 50, window_hours: int | None = None) -> Run:
    """Score the clusters of the items of the window and pick the k best: ``metrics, picks``."""
    run = Run()
    items = within(items, now, window_hours)
    scored = run.stage("metrics", lambda: score.five_factors(items, now))
    run.stage("picks", lambda: select.global_picks(scored, k))
    return run


def run_topics(items: DataFrame, conf: list[Topic], last_runs: DataFrame, now: Column, window_hours: int | None = None) -> Run:
    """The due topics on the items of the window: ``runs, metrics, picks`` (by priority, within the caps of the topics)."""
    run = Run()
    items = within(items, now, window_hours)
    told = run.stage("runs", lambda: topics.run_topics(items, conf, last_runs, now))
    scored = run.stage("metrics", lambda: score.five_factors(items, now))
    mapped = told.select("topic_key", F.explode("clusters_updated").alias("cluster_id"))
    table = items.sparkSession.createDataFrame([(t.key, t.priority, t.enabled, t.max_posts_per_run) for t in conf], "topic_key string, priority double, enabled boolean, cap int")
    run.stage("picks", lambda: select.topic_picks(scored, mapped, table))
    return run


def run_all(items: DataFrame, conf: list[Topic], last_runs: DataFrame, centroids: DataFrame, now: Column, k: int = 50, window_hours: int | None = None) -> Run:
    """Global and topic picks without overlap: ``picks, stats, checks`` beside the tables of both jobs."""
    items = within(items, now, window_hours)
    trending, topical = run_trending(items, now, k), run_topics(items, conf, last_runs, now)
    run = Run(topical.tables | trending.tables, {f"topics.{n}": s for n, s in topical.seconds.items()} | {f"trending.{n}": s for n, s in trending.seconds.items()})
    both = trending.tables["picks"].unionByName(topical.tables["picks"])
    picks = run.stage("picks", lambda: select.without_overlap(both, centroids))
    run.stage("stats", lambda: select.selection_stats(picks))
    clustered = items.agg((F.count("cluster_id") / F.count("*")).alias("r")).first().r
    run.stage("checks", lambda: quality_checks(picks, clustered or 0.0, sum(run.seconds.values()), k))
    return run


def quality_checks(picks: DataFrame, clustered: float, seconds: float, k: int) -> DataFrame:
    """One row: half of k picks, a mean adjusted score of 0.2, three tenths of the items clustered, 300 seconds; and the share
    of these that hold."""
    told = picks.agg(F.count("*").alias("n"), F.avg("adjusted").alias("a"))
    checks = {"enough_picks": F.col("n") >= 0.5 * k, "good_scores": F.coalesce(F.col("a") >= 0.2, F.lit(False)), "clustered": F.lit(clustered >= 0.3), "in_time": F.lit(seconds <= 300)}
    return told.select(*[c.alias(n) for n, c in checks.items()], (sum((c.cast("int") for c in checks.values()), F.lit(0)) / len(checks)).alias("score"))


def persist(run: Run, at: str, names: list[str]) -> dict[str, int]:
    """Write tables of a run to a folder, each as a whole; their row counts."""
    for name in names:
        run.tables[name].write.mode("overwrite").parquet(f"{at}/{name}")
    return {name: run.tables[name].count() for name in names}
