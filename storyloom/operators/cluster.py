"""Vector similarity in blocks, and the rows of clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyloom.functions.vectors import unit
from storyloom.operators.leaders import leader_clusters, unit_rows

__all__ = ["active_clusters", "cluster_rows", "leader_clusters", "running_mean", "scan_group", "top_similar"]

#: Vectors in a block: a task compares two blocks at a time.
BLOCK = 2048


def _blocked(vectors: DataFrame, size: int) -> tuple[DataFrame, int]:
    n = max(1, -(-vectors.count() // size))
    return vectors.select("id", "v").withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")), n


def top_similar(queries: DataFrame, vectors: DataFrame, k: int, size: int = BLOCK, exclude_self: bool = True) -> DataFrame:
    """``query, id, similarity, rank``: the k vectors of highest cosine for each query, itself excluded, by id among equals."""
    rows, n = _blocked(vectors, size)
    asked, m = _blocked(queries, size)
    left = asked.withColumnRenamed("_b", "j").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("asks", F.lit(True))
    right = rows.withColumnRenamed("_b", "i").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).withColumn("asks", F.lit(False))

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        q, r = pdf[pdf["asks"]], pdf[~pdf["asks"]].sort_values("id")
        out = []
        if len(q) and len(r):
            s = np.round(unit_rows(q["v"]) @ unit_rows(r["v"]).T, 9)
            ids = r["id"].to_numpy()
            for row, own in zip(s, q["id"], strict=True):
                if exclude_self:
                    row[ids == own] = -9
                at = np.argsort(-row, kind="stable")[:k]
                out.append(pd.DataFrame({"query": own, "id": ids[at], "similarity": row[at]})[row[at] > -9])
        return pd.concat(out) if out else pd.DataFrame({"query": [], "id": [], "similarity": []})

    found = left.select("id", "v", "i", "j", "asks").unionByName(right.select("id", "v", "i", "j", "asks")).groupBy("i", "j").applyInPandas(best, "query long, id long, similarity double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def scan_group(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """``id, leader, similarity`` of a few vectors (id, rank, v) scanned by rank."""
    pdf = pdf.sort_values("rank")
    x, ids = unit_rows(pdf["v"]), pdf["id"].to_numpy()
    near = np.round(x @ x.T, 9)
    leads: list[int] = []
    leader, similarity = ids.copy(), np.zeros(len(x))
    for i in range(len(x)):
        best = max(leads, key=lambda j: near[i, j], default=None)
        if best is not None and near[i, best] >= threshold:
            leader[i], similarity[i] = ids[best], near[i, best]
        else:
            leads.append(i)
    return pd.DataFrame({"id": ids, "leader": leader, "similarity": similarity})


def cluster_rows(members: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """``cluster_id, items_count, first_seen, last_seen, domains, domains_count`` after a run.

    ``members`` is (cluster_id, item_id, ts, domain, new): ``new`` marks the item that opened its cluster, whose domain counts
    twice. Stored ``clusters`` (cluster_id, items_count, first_seen, last_seen, domains) go on from what they had. Items
    whose domain is unknown count as items alone.
    """
    known = members.filter(F.coalesce("domain", F.lit("unknown")) != "unknown")
    hosts = known.groupBy("cluster_id", "domain").agg((F.count("*") + F.count_if("new")).alias("n"))
    sums = members.groupBy("cluster_id").agg(F.count("*").alias("items_count"), F.min(F.when(F.col("new"), F.col("ts"))).alias("first_seen"), F.max("ts").alias("last_seen"))
    if clusters is not None:
        hosts = hosts.unionByName(clusters.select("cluster_id", F.explode("domains").alias("domain", "n"))).groupBy("cluster_id", "domain").agg(F.sum("n").alias("n"))
        both = sums.unionByName(clusters.select("cluster_id", "items_count", "first_seen", "last_seen"))
        sums = both.groupBy("cluster_id").agg(F.sum("items_count").alias("items_count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    maps = hosts.groupBy("cluster_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("domain", "n")))).alias("domains"), F.count("*").alias("domains_count"))
    none = F.create_map().cast("map<string,bigint>")
    return sums.join(maps, "cluster_id", "left").withColumns({"domains": F.coalesce("domains", none), "domains_count": F.coalesce("domains_count", F.lit(0))})


def running_mean(centroid: Column, n: Column, vector: Column) -> Column:
    """The mean of a centroid of n vectors and one more, brought to length one."""
    return unit(F.zip_with(centroid, vector, lambda c, x: (c * n + x) / (n + 1)))


def active_clusters(clusters: DataFrame, now: Column, hours: int) -> DataFrame:
    """The open clusters with a centroid that were first seen within the hours."""
    return clusters.filter((F.col("status") == "open") & (F.col("first_seen") >= now - F.expr(f"interval {hours} hours")) & F.col("centroid").isNotNull() & (F.size("centroid") > 0))
