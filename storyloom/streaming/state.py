"""Keyed state of streams: the history of counts, the cadence of topics; and clusters as a table with versions.

States live in RocksDB beside the stream's checkpoint. What a row gives follows from the rows' own times alone, so a replay
or a restart gives the same, however the rows fall into micro-batches (in the order of their times).
"""

from __future__ import annotations

import contextlib
import math
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from storyloom.operators.leaders import leader_clusters
from storyloom.sources.shared import cut, drop

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY = 86_400_000_000


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """A query that starts here keeps its state in RocksDB; the session's own setting comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def drain(stream: DataFrame, at: str) -> DataFrame:
    """Run a stateful stream over what its source holds, to ``at``/out; all that it has given so far."""
    spark = stream.sparkSession
    with rocksdb(spark):
        running = stream.writeStream.format("parquet").outputMode("append").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


# ---- the history of a cluster's counts


class History(StatefulProcessor):
    """The last counts of a cluster: at most ``most`` of the last ``days``."""

    def __init__(self, most: int, days: int, window: int) -> None:
        self.most, self.span, self.window = most, days * DAY, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getListState("counts", "run_us long, n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [(int(r[0]), int(r[1])) for r in self.counts.get()]
        new = sorted((int(t), int(n)) for pdf in rows for t, n in zip(pdf["run_us"], pdf["n"], strict=True))
        out = []
        for at, n in new:
            if held and at <= held[-1][0]:
                out.append((int(key[0]), at, n, math.nan, len(held)))
                continue
            held = [h for h in held if h[0] >= at - self.span]
            last = [h[1] for h in held[-self.window :]]
            if len(last) < self.window:
                trend = 1.0 if n >= 2 else 0.0
            else:
                mean = sum(last) / len(last)
                sd = math.sqrt(sum((x - mean) ** 2 for x in last) / len(last))
                z = (n - mean) / (sd or 1.0)
                trend = 1 / (1 + math.exp(-z)) if z > -700 else 0.0
            held = [*held, (at, n)][-self.most :]
            out.append((int(key[0]), at, n, trend, len(held)))
        self.counts.put(held)
        yield pd.DataFrame(out, columns=["cluster_id", "run_us", "n", "trend", "remembered"])

    def close(self) -> None:
        pass


def trends(counts: DataFrame, most: int = 30, days: int = 30, window: int = 7) -> DataFrame:
    """``cluster_id, run_us, n, trend, remembered`` of a stream of counts (cluster_id, run_ts, n), a row per run.

    The trend of a count is that against the last ``window`` counts remembered before it (:func:`score.trend_spike`);
    it is remembered itself then. A run that isn't later than the last one remembered has no trend (null) and is forgotten.
    """
    held = counts.select(F.col("cluster_id").cast("long").alias("cluster_id"), F.unix_micros(F.col("run_ts").cast("timestamp")).alias("run_us"), F.col("n").cast("long").alias("n"))
    found = held.groupBy("cluster_id").transformWithStateInPandas(History(most, days, window), "cluster_id long, run_us long, n long, trend double, remembered int", "Append", "None")
    return found.withColumn("trend", F.nullif(F.col("trend"), F.lit(math.nan)))


# ---- the clock of topics


class Cadence(StatefulProcessor):
    """A topic's last run, and a timer for when it falls due."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "run_ms long, cadence_ms long, told boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = self.last.get()
        run, cadence, told = (int(state[0]), int(state[1]), bool(state[2])) if state is not None else (None, 0, True)
        out = []
        for at, minutes, enabled in sorted((int(t), int(m), bool(e)) for pdf in rows for t, m, e in zip(pdf["run_ms"], pdf["cadence_minutes"], pdf["enabled"], strict=True)):
            if run is not None and at < run:
                continue  # late
            if run is not None and not told:
                self.handle.deleteTimer(run + cadence)
                if run + cadence <= at:
                    out.append((key[0], run, run + cadence))
            run, cadence, told = at, minutes * 60_000, not enabled
            if not told:
                self.handle.registerTimer(run + cadence)
        if run is not None:
            self.last.update((run, cadence, told))
        yield pd.DataFrame(out, columns=["topic_key", "run_ms", "due_ms"]).astype({"run_ms": "int64", "due_ms": "int64"})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        run, cadence, told = self.last.get()
        if not told and run + cadence == expiredTimerInfo.getExpiryTimeInMs():
            self.last.update((run, cadence, True))
            yield pd.DataFrame({"topic_key": [key[0]], "run_ms": [run], "due_ms": [run + cadence]})

    def close(self) -> None:
        pass


def due_times(runs: DataFrame, late: str = "0 seconds") -> DataFrame:
    """``topic_key, run_ms, due_ms``: of a stream of runs (topic_key, ts, cadence_minutes, enabled) when each topic falls due.

    A topic is due ``cadence_minutes`` after its run unless it has run again before: at the latest when the watermark has
    passed that time, without any row of its own. A disabled topic is never due. Times are whole milliseconds.
    """
    held = runs.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = held.select("topic_key", "ts", F.unix_millis("ts").alias("run_ms"), F.col("cadence_minutes").cast("long").alias("cadence_minutes"), "enabled")
    return rows.groupBy("topic_key").transformWithStateInPandas(Cadence(), "topic_key string, run_ms long, due_ms long", "Append", "EventTime")


# ---- clusters over micro-batches

CLUSTERS = "cluster_id long, place long, v array<double>, first_seen timestamp_ntz, last_seen timestamp_ntz, items_count long"
MEMBERS = "id long, leader long, similarity double, new boolean"


def cluster_stream(vectors: DataFrame, at: str, threshold: float, hours: int = 72) -> DataFrame:
    """Run a stream of (id, v, rank, ts) into clusters; returns ``id, leader, similarity, new`` of all so far.

    A micro-batch reads the version of the clusters that the batch before it wrote, clusters by rank against those seen
    first within ``hours`` before its latest time, and writes the next version once: a batch that is run again reads and
    writes the same. Versions before the last two are deleted. ``rank`` grows from batch to batch, and ties of existing
    clusters go to the one of lowest rank, so that several batches give what one gives.
    """
    spark = vectors.sparkSession

    def version(k: int) -> str:
        return f"{at}/clusters/version={k}"

    def batch(rows: DataFrame, number: int) -> None:
        held = cut(rows.select("id", F.col("v").cast("array<double>").alias("v"), F.col("rank").cast("long").alias("rank"), F.col("ts").cast("timestamp_ntz").alias("ts")), "batch")
        latest = held.agg(F.max("ts").alias("t")).first()["t"]
        stored = spark.read.schema(CLUSTERS).parquet(version(number - 1)) if number else spark.createDataFrame([], CLUSTERS)
        active = stored if latest is None else stored.filter(F.col("first_seen") >= F.lit(latest) - F.expr(f"interval {hours} hours"))
        found = cut(leader_clusters(held, threshold, active.select(F.col("cluster_id").alias("id"), "v", F.col("place").alias("rank"))), "found")
        seen = found.join(held, "id")
        sums = seen.groupBy(F.col("leader").alias("cluster_id")).agg(F.max("ts").alias("_last"), F.count("*").alias("_n"))
        opened = seen.filter("new").select(F.col("id").alias("cluster_id"), F.col("rank").alias("place"), "v", F.col("ts").alias("first_seen"), F.col("ts").alias("last_seen"), F.lit(0).cast("long").alias("items_count"))
        after = active.unionByName(opened).join(sums, "cluster_id", "left").select("cluster_id", "place", "v", "first_seen", F.greatest("last_seen", "_last").alias("last_seen"), (F.col("items_count") + F.coalesce("_n", F.lit(0))).alias("items_count"))
        found.write.mode("overwrite").parquet(f"{at}/members/batch={number}")
        after.write.mode("overwrite").parquet(version(number))
        old = spark._jvm.org.apache.hadoop.fs.Path(version(number - 2))
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        for t in (held, found):
            drop(t)

    running = vectors.writeStream.foreachBatch(batch).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(f"{MEMBERS}, batch long").parquet(f"{at}/members").drop("batch")
