"""Clustering by running means: a scan in which every vector that joins a cluster moves its centroid.

Such a scan depends on its order, so it is split only where it provably makes no difference. Vectors fall into the cells of
some pivots. A centroid is a positive mean of its members, so it stays in any cap of less than a right angle that holds
them. If the vectors of one set are all farther from a pivot than those of another by more than the angle of the threshold,
none of them can ever join a centroid of that other set. Cells for which no pivot proves this, both ways, are joined to one
component; components are scanned beside each other, each as a sorted stream that holds its centroids alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.operators.leaders import PIVOTS, SAMPLE, SLACK, angles, reach_of, spread_out, unit_rows
from storyloom.sources.shared import cut, drop


def apart(low: np.ndarray, high: np.ndarray, reach: float) -> list[int]:
    """The component of each cell, where ``low`` and ``high`` are the least and largest angles of a cell's vectors to each pivot."""
    groups = [[k] for k in range(len(low))]

    def safe(a: list[int], b: list[int]) -> bool:
        """No vector of a can join a centroid of b."""
        far, near = low[a].min(axis=0), high[b].max(axis=0)
        return bool(((near < np.pi / 2 - SLACK) & (far - near > reach)).any())

    merged = True
    while merged:
        merged = False
        for i in range(len(groups)):
            for j in range(len(groups) - 1, i, -1):
                if not (safe(groups[i], groups[j]) and safe(groups[j], groups[i])):
                    groups[i] = groups[i] + groups.pop(j)
                    merged = True
    out = [0] * len(low)
    for g, cells in enumerate(groups):
        for c in cells:
            out[c] = g
    return out


class Scan:
    """The scan of one component: its centroids, in the order in which their clusters were opened."""

    def __init__(self, threshold: float, dims: int) -> None:
        self.threshold, self.ids, self.n = threshold, [], []
        self.c = np.zeros((16, dims))

    def open(self, cluster: int, x: np.ndarray, n: int) -> None:
        if len(self.ids) == len(self.c):
            self.c = np.concatenate([self.c, np.zeros_like(self.c)])
        self.c[len(self.ids)] = x
        self.ids.append(cluster)
        self.n.append(n)

    def take(self, id_: int, x: np.ndarray) -> tuple[int, float, bool]:
        """The cluster of the next vector, its cosine, and whether it is a new one."""
        if self.ids:
            s = np.round(self.c[: len(self.ids)] @ x, 9)
            k = int(s.argmax())
            if s[k] >= self.threshold:
                m = (self.c[k] * self.n[k] + x) / (self.n[k] + 1)
                size = np.linalg.norm(m)
                self.c[k] = m / size if size > 0 else m
                self.n[k] += 1
                return self.ids[k], float(s[k]), False
        self.open(id_, x, 1)
        return id_, 0.0, True


def mean_clusters(vectors: DataFrame, threshold: float, existing: DataFrame | None = None, told: dict | None = None) -> DataFrame:
    """``id, leader, similarity, new``: a scan of (id, v, rank; without rank, by id) by rank, in which a vector joins the
    cluster of the nearest centroid, if its cosine (to nine digits) reaches the threshold, and moves it to the running mean.

    Clusters are known by the vector that opened them; ``existing`` ones (id, v, n) have n members already and come first
    among equals, in the order of their ids; then those opened earlier. Vectors count as brought to length one; one of no
    length is like no other above a threshold of zero. ``told`` gets the number of components.
    """
    schema = "id long, leader long, similarity double, new boolean"
    rank = F.col("rank" if "rank" in vectors.columns else "id").cast("long")
    rows = vectors.select("id", rank.alias("place"), F.lit(0).cast("long").alias("n"), F.col("v").cast("array<double>").alias("v"))
    if existing is not None:
        rows = rows.unionByName(existing.select("id", F.lit(-(1 << 62)).alias("place"), F.col("n").cast("long").alias("n"), F.col("v").cast("array<double>").alias("v")))
    base = cut(rows, "vectors")
    some = unit_rows(base.orderBy(F.xxhash64("id", "n")).limit(SAMPLE).toPandas()["v"])
    if not len(some):
        return vectors.sparkSession.createDataFrame([], schema)
    pivots = spread_out(some, PIVOTS)
    k, dims = pivots.shape

    def celled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(cell=angles(unit_rows(pdf["v"]), pivots).argmin(axis=1).astype(np.int32))

    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = unit_rows(pdf["v"])
            if not len(x) or not x.any():
                continue
            a = angles(x[x.any(axis=1)], pivots)
            for c in np.unique(a.argmin(axis=1)):
                own = a[a.argmin(axis=1) == c]
                yield pd.DataFrame({"cell": int(c), "pivot": np.arange(k), "low": own.min(axis=0), "high": own.max(axis=0)})

    found = base.mapInPandas(spans, "cell int, pivot int, low double, high double").groupBy("cell", "pivot").agg(F.min("low").alias("low"), F.max("high").alias("high")).toPandas()  # pivots squared
    cells = sorted(found["cell"].unique())
    wide = found.pivot(index="cell", columns="pivot")
    groups = apart(wide["low"].to_numpy(), wide["high"].to_numpy(), reach_of(threshold)) if threshold > 0 and cells else [0] * len(cells)
    if told is not None:
        told["components"] = len(set(groups))
    of = dict(zip(map(int, cells), groups, strict=True))
    # vectors of no length may lie in a cell of their own; they meet nobody
    component = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in of.items() for x in pair]), F.col("cell")), F.lit(0)) if of else F.lit(0)
    sorted_ = base.mapInPandas(celled, "id long, place long, n long, v array<double>, cell int").select(component.alias("g"), "place", "id", "n", "v").repartition("g").sortWithinPartitions("g", "place", "id")

    def scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, scan = None, None
        for pdf in batches:
            out = []
            for g, place, id_, n, x in zip(pdf["g"], pdf["place"], pdf["id"], pdf["n"], unit_rows(pdf["v"]), strict=True):
                if g != at:
                    at, scan = g, Scan(threshold, dims)
                if place == -(1 << 62):
                    scan.open(int(id_), x, int(n))
                else:
                    out.append((id_, *scan.take(int(id_), x)))
            yield pd.DataFrame(out, columns=["id", "leader", "similarity", "new"])

    done = cut(sorted_.mapInPandas(scanned, schema), "clusters")
    drop(base)
    return done
