"""Streams with keyed state, against plain versions; restarts and repeated batches."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from storyloom.operators import means
from storyloom.operators.leaders import leader_clusters
from storyloom.streaming import state
from storyloom.streaming.arrivals import in_parts

START = datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """A state's partition is a Python worker of its own in every batch."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_history_over_restarts(spark, tmp_path):
    """Runs over 60 days in three parts, each from the checkpoint: old counts leave, and 12 stay at most."""
    rng = random.Random(1)
    rows = sorted({(c, START + timedelta(days=rng.randrange(60), hours=c)) for c in range(4) for _ in range(40)}, key=lambda r: r[1])
    rows = [(c, t, rng.randrange(20), (t - START).days // 20) for c, t in rows]
    table = spark.createDataFrame(rows, "cluster_id long, run_ts timestamp_ntz, n long, part int")
    for stream in in_parts(table, "part", f"{tmp_path}/in"):
        found = state.drain(state.trends(stream, most=12, days=10), f"{tmp_path}/h")
    want, held = {}, {}
    for c, t, n, _ in rows:
        last = [x for x in held.get(c, []) if x[0] >= t - timedelta(days=10)]
        if len(last) < 7:
            trend = 1.0 if n >= 2 else 0.0
        else:
            w = np.array([x[1] for x in last[-7:]])
            trend = 1 / (1 + math.exp(-(n - w.mean()) / (w.std() or 1.0)))
        held[c] = [*last, (t, n)][-12:]
        want[c, int((t - datetime(1970, 1, 1)).total_seconds()) * 10**6] = (round(trend, 9), len(held[c]))
    assert {(r.cluster_id, r.run_us): (round(r.trend, 9), r.remembered) for r in found.collect()} == want
    # a run that isn't later than the last one
    spark.createDataFrame([(0, START, 5)], "cluster_id long, run_ts timestamp_ntz, n long").write.mode("append").parquet(f"{tmp_path}/in")
    again = state.drain(state.trends(spark.readStream.schema("cluster_id long, run_ts timestamp_ntz, n long").parquet(f"{tmp_path}/in"), most=12, days=10), f"{tmp_path}/h")
    late = [r for r in again.collect() if r.cluster_id == 0 and r.trend is None]
    assert len(late) == 1 and again.count() == len(rows) + 1


def test_topics_fall_due_without_input(spark, tmp_path):
    """A topic that is never seen again falls due as the time of others passes."""
    at = lambda h: START + timedelta(hours=h)
    parts = [[("a", at(0), 60, True), ("b", at(0), 600, True), ("off", at(0), 60, False)], [("c", at(3), 6000, True)], [("b", at(4), 120, True), ("c", at(5), 60, True)], [("z", at(30), 60, True)]]
    rows = [(*r, k) for k, p in enumerate(parts) for r in p]
    seen = []
    for stream in in_parts(spark.createDataFrame(rows, "topic_key string, ts timestamp_ntz, cadence_minutes int, enabled boolean, part int"), "part", f"{tmp_path}/in"):
        found = state.drain(state.due_times(stream), f"{tmp_path}/c")
        base = int((START - datetime(1970, 1, 1)).total_seconds()) * 1000
        seen.append(sorted((r.topic_key, (r.run_ms - base) / 3.6e6, (r.due_ms - base) / 3.6e6) for r in found.collect()))
    assert seen[0] == []
    assert ("a", 0.0, 1.0) in seen[1] or ("a", 0.0, 1.0) in seen[2]
    assert seen[3] == [("a", 0.0, 1.0), ("b", 4.0, 6.0), ("c", 5.0, 6.0)]


def test_clusters_of_batches_are_those_of_one(spark, tmp_path):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 6))
    rows = [(i, [float(c) for c in centres[rng.integers(12)] + 0.5 * rng.normal(size=6)], i, START + timedelta(hours=i), i // 40) for i in range(120)]
    table = spark.createDataFrame(rows, "id long, v array<double>, rank long, ts timestamp_ntz, part int")
    want = {r.id: (r.leader, round(r.similarity, 9), r.new) for r in leader_clusters(table.drop("part", "ts"), 0.8).collect()}
    for stream in in_parts(table, "part", f"{tmp_path}/in"):
        found = state.cluster_stream(stream, f"{tmp_path}/c", 0.8, hours=1000)
    assert {r.id: (r.leader, round(r.similarity, 9), r.new) for r in found.collect()} == want
    versions = sorted(p.name for p in (tmp_path / "c/clusters").glob("version=*"))
    assert versions == ["version=1", "version=2"]  # the version before last is there for a batch that is run again
    kept = spark.read.parquet(f"{tmp_path}/c/clusters/version=2")
    assert {r.cluster_id: r.items_count for r in kept.collect()} == {k: sum(x[0] == k for x in want.values()) for k in {x[0] for x in want.values()}}
    # the last batch again, as after a loss before its commit
    for name in ("2", ".2.crc"):
        (tmp_path / "c/state/commits" / name).unlink(missing_ok=True)
    again = state.cluster_stream(spark.readStream.schema("id long, v array<double>, rank long, ts timestamp_ntz").parquet(f"{tmp_path}/in"), f"{tmp_path}/c", 0.8, hours=1000)
    assert {r.id: (r.leader, round(r.similarity, 9), r.new) for r in again.collect()} == want


def plain_means(vectors, threshold, existing=()):
    c = [[i, np.array(v) / np.linalg.norm(v), n] for i, v, n in existing]
    out = {}
    for i, v in vectors:
        x = np.array(v) / (np.linalg.norm(v) or 1.0)
        s = [round(float(x @ m), 9) for _, m, _ in c]
        k = int(np.argmax(s)) if s else 0
        if s and s[k] >= threshold:
            out[i] = (c[k][0], round(s[k], 6), False)
            m = (c[k][1] * c[k][2] + x) / (c[k][2] + 1)
            c[k][1:] = [m / np.linalg.norm(m), c[k][2] + 1]
        else:
            c.append([i, x, 1])
            out[i] = (i, 0.0, True)
    return out


@pytest.mark.parametrize(("threshold", "noise", "components"), [(0.9, 0.15, 20), (0.5, 0.8, 1), (-0.5, 0.3, 1)])
@pytest.mark.parametrize("old", [0, 3])
def test_running_means_are_the_scan(spark, threshold, noise, components, old):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(25, 24))
    v = [(i, [float(c) for c in centres[rng.integers(25)] + noise * rng.normal(size=24)]) for i in range(300)] + [(300, [0.0] * 24)] * (threshold > 0)
    existing = [(1000 + k, [float(c) for c in centres[k]], 5) for k in range(old)]
    order = rng.permutation(len(v))
    df = spark.createDataFrame([(i, x, int(order[i])) for i, x in v], "id long, v array<double>, rank long").repartition(3)
    stored = spark.createDataFrame(existing, "id long, v array<double>, n long") if old else None
    told = {}
    got = {r.id: (r.leader, round(r.similarity, 6), r.new) for r in means.mean_clusters(df, threshold, stored, told).collect()}
    assert got == plain_means(sorted(v, key=lambda r: order[r[0]]), threshold, existing)
    assert told["components"] >= components
    assert means.mean_clusters(df.limit(0), threshold).count() == 0
