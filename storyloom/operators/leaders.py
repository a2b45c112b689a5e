"""Leader clustering with exact pruning on angles.

A vector joins a leader if their cosine reaches the threshold, that is, if their angle is at most ``reach``. Every vector
knows its angles to some pivots and its cell, that of the nearest pivot. By the triangle inequality a vector at angle a
from pivot j, and b from its own, can only be within reach of a leader of cell j if a <= b + 2 reach, and if a lies within
reach of the angles that this cell's leaders have to j. Other cells are never compared.

Two phases. The first finds the leaders: a round scans the first undecided vectors in one task, and those later ones that
join one of the leaders found are decided; only undecided vectors are read again. The second finds the best leader of
every vector in one pass: against few leaders where the vectors lie, against many by a shuffle in which a vector goes to
the groups of leaders that it can reach. Vectors are written once, and never again with their state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.sources.shared import cut, drop

#: Pivots; vectors that they are chosen from; vectors scanned in a round; leaders that a task compares with at once.
PIVOTS, SAMPLE, HEAD, GROUP = 64, 2048, 4096, 8192
#: Vectors that a task of the shuffle compares, about, and vectors multiplied at once.
PART, ROWS = 200_000, 2048
#: What rounding may take from an angle.
SLACK = 1e-6


def unit_rows(v: pd.Series) -> np.ndarray:
    """The vectors as rows of length one; those without length stay zero."""
    if not len(v):
        return np.zeros((0, 0))
    x = np.stack(v.to_numpy()).astype(np.float64)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1.0, 1.0))


def reach_of(threshold: float) -> float:
    """The largest angle at which the rounded cosine reaches the threshold. At or below zero anything may."""
    return float(np.pi) if threshold <= 0 else float(np.arccos(min(1.0, threshold - 1e-9))) + SLACK


def spread_out(x: np.ndarray, k: int) -> np.ndarray:
    """Up to k rows, each the farthest from those before it; one of any if none has a length."""
    x = x[x.any(axis=1)] if x.any() else x[:1]
    kept = [0]
    closest = x @ x[0]
    while len(kept) < min(k, len(x)):
        at = int(closest.argmin())
        if closest[at] > 1 - 1e-9:
            break
        kept.append(at)
        closest = np.maximum(closest, x @ x[at])
    return x[kept]


class Leaders:
    """Leaders by cell, and the comparison of vectors with those they can reach."""

    def __init__(self, ids: np.ndarray, places: np.ndarray, x: np.ndarray, pivots: np.ndarray, threshold: float) -> None:
        a = angles(x, pivots)
        cell = a.argmin(axis=1)
        order = np.lexsort((ids, places, cell))
        self.ids, self.places, self.x, self.threshold, self.reach = ids[order], places[order], x[order], threshold, reach_of(threshold)
        cell, own = cell[order], a.min(axis=1)[order]
        self.cells, starts = np.unique(cell, return_index=True)
        self.ends = np.r_[starts, len(cell)]
        self.low = np.array([own[s:e].min() for s, e in zip(starts, self.ends[1:], strict=True)])
        self.high = np.array([own[s:e].max() for s, e in zip(starts, self.ends[1:], strict=True)])

    def reached(self, a: np.ndarray) -> np.ndarray:
        """Which cells of the leaders each vector (its angles to the pivots) can reach."""
        to = a[:, self.cells]
        return (to <= a.min(axis=1, keepdims=True) + 2 * self.reach) & (to <= self.high + self.reach) & (to >= self.low - self.reach)

    def best(self, x: np.ndarray, a: np.ndarray, ids: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Cosine, place and id of the best leader that stands before each vector (-9 if none reaches the threshold), and how
        many pairs were compared. The highest cosine wins, then the first place, then the smallest id."""
        s, place, who, met = np.full(len(x), -9.0), np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), 0
        may = self.reached(a) if len(x) else np.zeros((0, len(self.cells)), bool)
        for c in range(len(self.cells)):
            lo, hi = self.ends[c], self.ends[c + 1]
            rows = np.flatnonzero(may[:, c])
            met += len(rows) * int(hi - lo)
            for k in range(0, len(rows), ROWS):
                at = rows[k : k + ROWS]
                near = np.round(x[at] @ self.x[lo:hi].T, 9)
                p, i = self.places[lo:hi], self.ids[lo:hi]
                before = (p < places[at, None]) | ((p == places[at, None]) & (i < ids[at, None]))
                near = np.where(before & (near >= self.threshold), near, -9.0)
                j = near.argmax(axis=1)  # of equals the first in the order of places
                top = near[np.arange(len(at)), j]
                better = (top > s[at]) | ((top == s[at]) & (top > -9) & ((p[j] < place[at]) | ((p[j] == place[at]) & (i[j] < who[at]))))
                s[at[better]], place[at[better]], who[at[better]] = top[better], p[j[better]], i[j[better]]
        return s, place, who, met


def scan_head(ids: np.ndarray, places: np.ndarray, x: np.ndarray, threshold: float) -> np.ndarray:
    """Which of a few vectors, in the order of (place, id), join none before them that leads."""
    order = np.lexsort((ids, places))
    x = x[order]
    joined, lead = np.zeros(len(x), bool), np.zeros(len(x), bool)
    for i in range(len(x)):
        if not joined[i]:
            lead[i] = True
            joined[i + 1 :] |= np.round(x[i + 1 :] @ x[i], 9) >= threshold
    out = np.zeros(len(x), bool)
    out[order] = lead
    return out


NONE = "id long, s double, place long, leader long, met long"


def _best_rows(pdf: pd.DataFrame, leaders: Leaders, pivots: np.ndarray) -> pd.DataFrame:
    x = unit_rows(pdf["v"])
    ids, places = pdf["id"].to_numpy(np.int64), pdf["place"].to_numpy(np.int64)
    s, place, who, met = leaders.best(x, angles(x, pivots), ids, places) if len(pdf) else (np.zeros(0), ids, ids, 0)
    out = pd.DataFrame({"id": ids, "s": s, "place": place, "leader": who, "met": 0})
    if len(out):
        out.loc[out.index[0], "met"] = met
    return out[(out["s"] > -9) | (out["met"] > 0)]


def _by_groups(base: DataFrame, found: DataFrame, pivots: np.ndarray, threshold: float, group: int, part: int) -> DataFrame:
    """``id, s, place, leader, met`` against many leaders (id, place, v): by groups of leaders of a cell."""
    reach = reach_of(threshold)

    def celled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                a = angles(unit_rows(pdf["v"]), pivots)
                yield pdf.assign(cell=a.argmin(axis=1).astype(np.int32), own=a.min(axis=1))

    led = cut(found.select("id", "place", "v").mapInPandas(celled, "id long, place long, v array<double>, cell int, own double"), "leaders")
    cells = led.groupBy("cell").agg(F.min("own").alias("low"), F.max("own").alias("high"), F.count("*").alias("n")).orderBy("cell").toPandas()  # a row per pivot
    chunks = -(-cells["n"].to_numpy() // group)
    first = np.r_[0, np.cumsum(chunks)[:-1]]
    which, low, high = cells["cell"].to_numpy(), cells["low"].to_numpy(), cells["high"].to_numpy()

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                a = angles(unit_rows(pdf["v"]), pivots)
                to = a[:, which]
                may = (to <= a.min(axis=1, keepdims=True) + 2 * reach) & (to <= high + reach) & (to >= low - reach)
                yield pdf.assign(groups=[[int(g) for c in np.flatnonzero(m) for g in range(first[c], first[c] + chunks[c])] for m in may])

    asked = cut(base.select("id", "place", "v").mapInPandas(visits, "id long, place long, v array<double>, groups array<int>"), "visits")
    counts = asked.select(F.explode("groups").alias("g")).groupBy("g").agg(F.ceil(F.count("*") / part).cast("int").alias("parts")).toPandas()  # a row per group
    parts = F.lit(1)
    many = counts[counts["parts"] > 1]
    if len(many):
        parts = F.coalesce(F.try_element_at(F.create_map(*[F.lit(int(v)) for row in many.itertuples(index=False) for v in row]), F.col("g")), F.lit(1))
    table = F.create_map(*[F.lit(int(v)) for c in range(len(which)) for v in (which[c], first[c])])
    sizes = F.create_map(*[F.lit(int(v)) for c in range(len(which)) for v in (which[c], chunks[c])])
    mine = led.withColumn("g", (F.element_at(table, F.col("cell")) + F.pmod(F.xxhash64("id"), F.element_at(sizes, F.col("cell")))).cast("int"))
    l_ = mine.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).select("g", "part", F.lit(0).alias("kind"), "id", "place", "v")
    v_ = asked.withColumn("g", F.explode("groups")).withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int")).select("g", "part", F.lit(1).alias("kind"), "id", "place", "v")

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, kept, held = None, [], None
        for pdf in batches:
            for key, some in pdf.groupby(["g", "part", "kind"], sort=True):
                if key[:2] != at:
                    at, kept, held = key[:2], [], None
                if key[2] == 0:
                    kept.append(some)  # a group of leaders
                elif kept:
                    if held is None:
                        all_ = pd.concat(kept)
                        held = Leaders(all_["id"].to_numpy(np.int64), all_["place"].to_numpy(np.int64), unit_rows(all_["v"]), pivots, threshold)
                    yield _best_rows(some, held, pivots)

    dealt = l_.unionByName(v_).repartition("g", "part").sortWithinPartitions("g", "part", "kind")
    return dealt.mapInPandas(compared, NONE)


def best_leaders(base: DataFrame, found: DataFrame, pivots: np.ndarray, threshold: float, group: int = GROUP, part: int = PART) -> DataFrame:
    """``id, s, place, leader, met``: of the vectors (id, place, v) that some leader (id, place, v) before them takes, the best
    one. ``met`` counts compared pairs (on some row of each batch); its rows without an ``s`` over -9 join none."""
    if found.count() > group:
        rows = _by_groups(base, found, pivots, threshold, group, part)
    else:
        few = found.select("id", "place", "v").toPandas()  # ``group`` leaders at most
        leaders = Leaders(few["id"].to_numpy(np.int64), few["place"].to_numpy(np.int64), unit_rows(few["v"]), pivots, threshold) if len(few) else None

        def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if leaders is not None:
                    yield _best_rows(pdf, leaders, pivots)

        rows = base.select("id", "place", "v").mapInPandas(compared, NONE)
    best = F.min(F.struct((-F.col("s")).alias("t"), F.col("place"), F.col("leader")))
    return rows.groupBy("id").agg(best.alias("b"), F.sum("met").alias("met")).select("id", (-F.col("b.t")).alias("s"), "b.place", "b.leader", "met")


def leader_clusters(vectors: DataFrame, threshold: float, existing: DataFrame | None = None, size: int = HEAD, group: int = GROUP, part: int = PART, told: dict | None = None) -> DataFrame:
    """``id, leader, similarity, new``: a scan of (id, v, rank; without rank, by id) by rank, in which a vector joins the best cluster so far.

    The clusters are the ``existing`` ones (id, v), if any, and the vectors before it that lead one. The best has the
    highest cosine (to nine digits), which must reach the threshold; among equals existing ones come first (by their
    own rank, if they have one, and id), then the earliest. A vector that joins none leads its own cluster, ``new`` and with a similarity of 0. Ids are unique; a vector
    of no length is like no other above a threshold of zero. ``told`` gets the number of leaders, rounds and compared pairs.
    """
    rank = F.col("rank" if "rank" in vectors.columns else "id").cast("long")
    base = cut(vectors.select("id", rank.alias("place"), F.col("v").cast("array<double>").alias("v")), "vectors")
    some = unit_rows(base.orderBy(F.xxhash64("id")).limit(SAMPLE).toPandas()["v"])
    if not len(some):
        return vectors.sparkSession.createDataFrame([], "id long, leader long, similarity double, new boolean")
    pivots = spread_out(some, PIVOTS)
    met, rounds = 0, 0
    none = base.sparkSession.createDataFrame([], NONE)
    old = none
    if existing is not None:
        order = F.col("rank").cast("long") if "rank" in existing.columns else F.lit(0)
        stored = existing.select("id", (F.lit(-(1 << 62)) + order).alias("place"), F.col("v").cast("array<double>").alias("v"))
        old = cut(best_leaders(base, stored, pivots, threshold, group, part), "joined")
    left = base.join(old.filter("s > -9").select("id"), "id", "left_anti") if existing is not None else base
    found: list[DataFrame] = []
    while True:
        first = left.orderBy("place", "id").limit(size).groupBy(F.lit(0).alias("_all"))

        def scanned(pdf: pd.DataFrame) -> pd.DataFrame:
            return pdf.loc[scan_head(pdf["id"].to_numpy(np.int64), pdf["place"].to_numpy(np.int64), unit_rows(pdf["v"]), threshold), ["id", "place", "v"]]

        new = cut(first.applyInPandas(scanned, "id long, place long, v array<double>"), "leaders")  # ``size`` vectors at most
        few = new.toPandas()
        if few.empty:
            drop(new)
            break
        rounds, met = rounds + 1, met + size * len(few)  # what the scan compares at most
        found.append(new)
        leaders = Leaders(few["id"].to_numpy(np.int64), few["place"].to_numpy(np.int64), unit_rows(few["v"]), pivots, threshold)

        def undecided(batches: Iterator[pd.DataFrame], leaders: Leaders = leaders) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    x, ids = unit_rows(pdf["v"]), pdf["id"].to_numpy(np.int64)
                    s, _, _, n = leaders.best(x, angles(x, pivots), ids, pdf["place"].to_numpy(np.int64))
                    out = pdf[(s <= -9) & ~np.isin(ids, leaders.ids)].assign(met=0)
                    yield pd.concat([out, pd.DataFrame({"id": [0], "place": [0], "v": [None], "met": [n]})])  # a row for the count alone

        rest = cut(left.select("id", "place", "v").mapInPandas(undecided, "id long, place long, v array<double>, met long"), "undecided")
        if told is not None:
            met += rest.agg(F.sum("met")).first()[0] or 0
        if rounds > 1:
            drop(before)
        before, left = rest, rest.filter("v is not null").drop("met")
    lead = found[0] if found else base.limit(0).select("id", "place", "v")
    for f in found[1:]:
        lead = lead.unionByName(f)
    lead = cut(lead, "leaders")
    own = cut(best_leaders(base, lead, pivots, threshold, group, part), "joined")
    if told is not None:
        told |= {"leaders": lead.count(), "rounds": rounds, "met": met + sum(t.agg(F.sum("met")).first()[0] or 0 for t in (old, own))}
    best = old.unionByName(own).filter("s > -9").groupBy("id").agg(F.min(F.struct((-F.col("s")).alias("t"), F.col("place"), F.col("leader"))).alias("b"))
    joined = base.select("id").join(best.select("id", "b"), "id", "left").join(lead.select("id", F.lit(True).alias("new")), "id", "left")
    seed = F.coalesce("new", F.lit(False))
    return joined.select("id", F.when(seed, F.col("id")).otherwise(F.col("b.leader")).alias("leader"), F.when(seed, 0.0).otherwise(-F.col("b.t")).alias("similarity"), seed.alias("new"))
