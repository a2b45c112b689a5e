"""Near duplicates of a stream within a window of time, against what earlier micro-batches inserted.

What is inserted is remembered in a keyed state (RocksDB): each hash under its keys of bit blocks, each URL under its hash,
in slots of time of a bucket of keys. A micro-batch asks the state of each of its rows' buckets; rows that nothing stored
stands against are scanned among themselves, and what is inserted comes back to the state as the input of the next
micro-batch, by the table of outcomes that each of them writes. So no batch reads history, and slots that have left the
window go as soon as their bucket is asked: the state holds a window, however long the stream.

The window follows the rows' own times, not the clock on the wall (a time to live would make a replay differ): a
micro-batch's now is the latest time of a row so far. A batch that is run again asks the same state and writes the same
folder, and a restarted stream goes on from its checkpoint.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from storyloom.functions import hashing, text
from storyloom.operators import ingest
from storyloom.operators.hamming import Tables
from storyloom.sources.shared import cut, drop, shared_dir
from storyloom.streaming.arrivals import in_parts
from storyloom.streaming.state import rocksdb

#: What a stream of entries has, and what is written of each.
ENTRIES = "item_id long, rank long, h long, url_sha1 string, ts timestamp_ntz"
OUTCOMES = f"{ENTRIES}, outcome string"
NEVER = -(1 << 62)
HOUR = 3_600_000_000
#: Buckets of keys, and slots of time in a window.
BUCKETS, SLOTS = 1024, 24
#: Comparisons that are made at once.
AT_ONCE = 1 << 22


def _latest(asked: np.ndarray, stored: np.ndarray, distance: int) -> np.ndarray:
    """For each row (key, h) the latest time of a stored row (key, h, time) of its key within the distance; NEVER if none."""
    out = np.full(len(asked), NEVER)
    stored = stored[np.argsort(stored[:, 0], kind="stable")]
    low, high = (np.searchsorted(stored[:, 0], asked[:, 0], side) for side in ("left", "right"))
    todo = np.flatnonzero(high > low)
    while len(todo):
        n = np.minimum(high[todo] - low[todo], AT_ONCE)
        some = max(1, int(np.searchsorted(np.cumsum(n), AT_ONCE, side="right")))
        rows, n = todo[:some], n[:some]
        at = np.repeat(low[rows] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        who = np.repeat(rows, n)
        near = np.bitwise_count((asked[who, 1] ^ stored[at, 1]).view(np.uint64)) <= distance
        np.maximum.at(out, who[near], stored[at[near], 2])
        low[rows] += n
        todo = np.r_[rows[high[rows] > low[rows]], todo[some:]]
    return out


class Recent(StatefulProcessor):
    """The state of a bucket: by kind (hashes, URLs) the inserted (key, h, time) of each slot of time."""

    def __init__(self, distance: int, spans: tuple[int, int], slots: int = SLOTS) -> None:
        self.distance, self.spans, self.slots = distance, spans, slots

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.states = [handle.getMapState(name, "slot long", "rows binary") for name in ("hashes", "urls")]

    def _remember(self, kind: int, rows: np.ndarray, newest: int) -> np.ndarray:
        """Add rows, let what is out of the window go, and return all that is left."""
        state, span = self.states[kind], self.spans[kind]
        width = max(1, span // self.slots)
        held = {int(k[0]): np.frombuffer(v[0], np.int64).reshape(-1, 3) for k, v in state.iterator()}
        for slot in [s for s in held if (s + 1) * width <= newest - span]:
            state.removeKey((slot,))
            del held[slot]
        rows = rows[rows[:, 2] >= newest - span]
        slots = rows[:, 2] // width
        for slot in np.unique(slots).tolist():
            more = np.unique(np.concatenate([held.get(slot, np.zeros((0, 3), np.int64)), rows[slots == slot]]), axis=0)
            state.updateValue((slot,), (more.tobytes(),))
            held[slot] = more
        return np.concatenate([np.zeros((0, 3), np.int64), *held.values()])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pdf = pd.concat(list(rows))  # a bucket's rows of one batch
        newest = int(pdf["at"].max())
        for kind, name in ((0, "near_at"), (1, "url_at")):
            own = pdf[pdf["kind"] == kind]
            stored = self._remember(kind, own.loc[~own["asks"], ["key", "h", "at"]].to_numpy(np.int64), newest)
            asks = own[own["asks"]]
            latest = _latest(asks[["key", "h"]].to_numpy(np.int64), stored, self.distance if kind == 0 else 0)
            told = pd.DataFrame({"item_id": asks["item_id"], "rank": asks["rank"], "h": asks["h"], "url_sha1": asks["url_sha1"], "at": asks["at"], "carries": asks["carries"], "near_at": NEVER, "url_at": NEVER})
            told[name] = latest
            yield told[told["carries"] | (latest != NEVER)]

    def close(self) -> None:
        pass


def _asked(entries: DataFrame, asks: bool, distance: int, buckets: int) -> DataFrame:
    """A row per key of each entry; its first one carries the entry itself."""
    held = entries.select("item_id", "rank", F.col("h").cast("long").alias("h"), "url_sha1", F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(0)).alias("at"))
    keyed = Tables(distance).keyed(held, ["item_id", "rank", "url_sha1", "at"])
    hashes = keyed.select("item_id", "rank", "url_sha1", "at", (F.col("t") == 0).alias("carries"), F.lit(0).alias("kind"), "key", "h")
    urls = held.filter("url_sha1 is not null").select("item_id", "rank", "url_sha1", "at", F.lit(False).alias("carries"), F.lit(1).alias("kind"), F.xxhash64("url_sha1").alias("key"), F.xxhash64(F.lit("second"), F.col("url_sha1")).alias("h"))
    return hashes.unionByName(urls).withColumns({"asks": F.lit(asks), "bucket": F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")})


def start(stream: DataFrame, at: str, window_hours: int = 24, url_hours: int = 30 * 24, distance: int = 3, buckets: int = BUCKETS, slots: int = SLOTS, trigger: str = "0 seconds"):  # noqa: ANN201
    """Start a stream of ENTRIES (h isn't null, item_id is unique); ``at``/outcomes gets the outcome of each.

    A micro-batch is a run of ingest: an entry near one that an earlier batch inserted at most ``window_hours`` before the
    batch's now is filtered, one whose URL was inserted in the last ``url_hours`` is a duplicate, and the others are
    scanned in the order of (rank, item_id). An entry without a time is as old as can be: it is judged, and not remembered.
    """
    spark = stream.sparkSession
    window, url_window = window_hours * HOUR, url_hours * HOUR
    base = spark.createDataFrame([], f"{OUTCOMES}, batch long").drop("batch")
    base.write.mode("ignore").parquet(f"{at}/outcomes/batch=-1")
    back = spark.readStream.schema(OUTCOMES).parquet(f"{at}/outcomes").filter("outcome = 'inserted'")
    both = _asked(stream, True, distance, buckets).unionByName(_asked(back.select(stream.columns), False, distance, buckets))
    kinds = "item_id long, rank long, h long, url_sha1 string, at long, carries boolean, near_at long, url_at long"
    told = both.groupBy("bucket").transformWithStateInPandas(Recent(distance, (window, url_window), slots), kinds, "Append", "None")

    def batch(rows: DataFrame, number: int) -> None:
        answers = cut(rows, "answers")
        own = answers.filter("carries")
        clock = own.agg(F.max("at").alias("at")).first()["at"]
        if clock is not None:  # else only what came back
            clocks = spark.read.schema("at long, batch long").parquet(f"{at}/clock").filter(F.col("batch") < number) if number else None
            now = max([clock, *([] if clocks is None else [x for (x,) in clocks.agg(F.max("at")).collect() if x is not None])])
            latest = answers.groupBy("item_id").agg(F.max("near_at").alias("near_at"), F.max("url_at").alias("url_at"))
            seen = own.select("item_id", "rank", "h", "url_sha1", "at").join(latest, "item_id")
            seen = cut(seen.withColumns({"_near": F.when(F.col("near_at") >= now - window, True), "_known": F.when(F.col("url_at") >= now - url_window, True)}), "seen")
            found = ingest.decide(seen, distance)
            ts = F.timestamp_micros("at").cast("timestamp_ntz")
            done = seen.join(found, "item_id").select("item_id", "rank", "h", "url_sha1", ts.alias("ts"), "outcome")
            done.write.mode("overwrite").parquet(f"{at}/outcomes/batch={number}")
            spark.createDataFrame([(now,)], "at long").write.mode("overwrite").parquet(f"{at}/clock/batch={number}")
            drop(seen)
        drop(answers)

    spark.createDataFrame([], "at long").write.mode("ignore").parquet(f"{at}/clock/batch=-1")
    with rocksdb(spark):
        return told.writeStream.foreachBatch(batch).option("checkpointLocation", f"{at}/state").trigger(processingTime=trigger).start()


def drain(stream: DataFrame, at: str, **settings: Any) -> DataFrame:
    """Run a stream over what its source holds, and return all outcomes so far."""
    running = start(stream, at, **settings)
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    return outcomes(stream.sparkSession, at)


def outcomes(spark: SparkSession, at: str) -> DataFrame:
    return spark.read.schema(f"{OUTCOMES}, batch long").parquet(f"{at}/outcomes")


def drain_near(spark: SparkSession, sf_dir: str, hours: int = 18) -> DataFrame:
    """Documents at the time of the event of their number, in stretches of 18 hours that arrive one after another: their outcomes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("doc_id"), F.col("ts").cast("timestamp_ntz").alias("ts"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("doc_id"), "url")
    first = F.get(F.split("text", "\n"), F.lit(0))
    h = hashing.simhash64(text.simhash_text(first, F.col("text")))
    address = F.coalesce("url", F.concat(F.lit("http://x.org/"), F.col("doc_id") % 700))
    rows = docs.join(events, "doc_id").join(pages, "doc_id", "left").select(F.col("doc_id").alias("item_id"), F.col("doc_id").alias("rank"), h.alias("h"), address.alias("url_sha1"), "ts")
    part = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (hours * HOUR)).cast("long")
    at = f"{shared_dir(spark)}/storyloom/near-{uuid.uuid4().hex}"
    for stream in in_parts(rows.withColumn("part", part), "part", f"{at}/in"):  # stretches
        drain(stream, at, buckets=32)  # a small table
    return outcomes(spark, at).select("item_id", "outcome")
