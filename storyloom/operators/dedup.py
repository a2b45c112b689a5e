"""Exact and near duplicates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyloom.functions.hashing import hamming
from storyloom.operators.hamming import blocks_of, pairs
from storyloom.sources.shared import cut, drop


def top_by(df: DataFrame, keys: list[str], order: list[Column], most: int, name: str = "_k") -> DataFrame:
    """The first ``most`` rows of each key, ranked from 1. Rows are cut down within each task first, so no key fills one."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= most)


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return top_by(df, keys, order, 1).drop("_k")


def new_only(batch: DataFrame, stored: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Rows of a batch whose key isn't stored, the first of each key."""
    return first_by(batch, [key], order).join(stored.select(key), key, "left_anti")


def near_pairs(hashes: DataFrame, distance: int = 3) -> DataFrame:
    """``a, b, distance`` of the different 64-bit hashes ``h`` (distinct, as longs) that differ in at most that many bits."""
    held = hashes.select("h")
    return pairs(held, held, distance, same=True).select("a", "b", hamming(F.col("a"), F.col("b")).alias("distance"))


#: Nodes that one task decides by the plain scan.
LOCAL = 200_000


class Scanner:
    """The plain scan: takes a hash and a URL in order, unless a taken hash is near or the URL was taken."""

    def __init__(self, distance: int) -> None:
        self.distance, self.bands, self.urls = distance, [{} for _ in range(distance + 1)], set()
        self.blocks = blocks_of(distance + 1)

    def take(self, h: int, url: str | None) -> bool:
        keys = [h >> at & ((1 << width) - 1) for at, width in self.blocks]  # a near hash agrees in one of these blocks
        near = any((h ^ x).bit_count() <= self.distance for band, key in zip(self.bands, keys, strict=True) for x in band.get(key, ()))
        if near or (url is not None and url in self.urls):
            return False
        for band, key in zip(self.bands, keys, strict=True):
            band.setdefault(key, []).append(h)
        if url is not None:
            self.urls.add(url)
        return True


def scan(nodes: DataFrame, distance: int = 3, local: int = LOCAL) -> DataFrame:
    """``node, taken``: a scan by (rank, node) over (node, h, url, rank), which takes a node if no taken one has its URL or a
    hash within the distance. A null URL is like no other; hashes aren't null.

    The graph of conflicts is made once: pairs of different hashes within the distance. Nodes of one hash, or of one URL,
    conflict with each other, and are held back by the first undecided one of them without any pairs. A round takes every
    node that no undecided conflicting node stands before, and what conflicts with a taken node falls. So the rounds are
    as many as the longest chain of conflicts in the order of the scan, whatever else shares a block of bits; they end when
    ``local`` nodes at most are left, which one task scans.
    """
    left = cut(nodes.select("node", F.col("h").cast("long").alias("h"), F.col("url").cast("string").alias("url"), "rank"), "undecided")
    kind = left.schema["node"].dataType.simpleString()
    taken_all: list[DataFrame] = []
    edges = None
    while left.count() > local:
        if edges is None:
            found = pairs(left.select("h").distinct(), left.select("h").distinct(), distance, same=True)
            edges = cut(found.select("a", "b").union(found.select("b", "a")), "conflicts")
        at = F.struct("rank", "node")
        by_hash = cut(left.groupBy("h").agg(F.min(F.struct("rank", "node", "url")).alias("f")), "first")
        by_url = left.filter("url is not null").groupBy("url").agg(F.min(at).alias("u"))
        before = edges.join(by_hash.select(F.col("h").alias("b"), "f"), "b").groupBy("a").agg(F.min(F.struct("f.rank", "f.node")).alias("n"))
        held = by_hash.select("h", F.col("f.node").alias("node"), F.col("f.url").alias("url"), F.struct("f.rank", "f.node").alias("at"))
        free = held.join(before.withColumnRenamed("a", "h"), "h", "left").filter(F.col("n").isNull() | (F.col("at") < F.col("n")))
        free = free.join(by_url, "url", "left").filter(F.col("u").isNull() | (F.col("at") == F.col("u")))
        taken = cut(free.select("node", "h", "url"), "taken")
        taken_all.append(taken)
        gone = cut(taken.select("h").union(edges.join(taken.select(F.col("h").alias("b")), "b").select("a")).distinct(), "gone")
        urls = taken.filter("url is not null").select("url")
        rest = cut(left.join(gone, "h", "left_anti").join(urls, "url", "left_anti"), "undecided")
        fewer = cut(edges.join(gone.toDF("a"), "a", "left_anti").join(gone.toDF("b"), "b", "left_anti"), "conflicts")
        for old in (by_hash, gone, edges):
            drop(old)
        if len(taken_all) > 1:
            drop(left)
        left, edges = rest, fewer

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        scanner = Scanner(distance)
        pdf = pdf.sort_values(["rank", "node"])
        return pd.DataFrame({"node": pdf["node"], "taken": [scanner.take(h & (1 << 64) - 1, u) for h, u in zip(pdf["h"].tolist(), pdf["url"], strict=True)]})

    last = left.groupBy(F.lit(0).alias("_all")).applyInPandas(lambda pdf: finish(pdf), f"node {kind}, taken boolean").filter("taken").select("node")  # ``local`` nodes
    for t in taken_all:
        last = last.unionByName(t.select("node"))
    return nodes.select("node").join(last.withColumn("taken", F.lit(True)), "node", "left").select("node", F.coalesce("taken", F.lit(False)).alias("taken"))


def near_filter(rows: DataFrame, distance: int = 3, local: int = LOCAL) -> DataFrame:
    """``item_id, h, kept`` of rows (item_id, h) scanned by item_id: a row goes if a kept one is within the distance.

    Equal hashes are one node, ranked by their first row; only that row can be kept.
    """
    nodes = cut(rows.groupBy("h").agg(F.min("item_id").alias("rank")), "hashes")
    decided = scan(nodes.select(F.col("h").alias("node"), "h", F.lit(None).cast("string").alias("url"), "rank"), distance, local)
    kept = nodes.join(decided.filter("taken").select(F.col("node").alias("h")), "h").select(F.col("rank").alias("item_id"), F.lit(True).alias("_kept"))
    return rows.join(kept, "item_id", "left").select("item_id", "h", F.coalesce("_kept", F.lit(False)).alias("kept"))
