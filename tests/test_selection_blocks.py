"""Picks compared in blocks, words counted within rows, counts observed while tables are written."""

import random
from collections import Counter
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyloom.functions import dates, text
from storyloom.operators import ingest, select, stores


def plain(picks, centroids, limit):
    """All pairs in the order of the picks; a pick that loses still beats others."""
    order = sorted(picks, key=lambda p: (p[3] == "topic", p[4] or "", p[6]))
    lost = set()
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if a[0] not in centroids or b[0] not in centroids:
                continue
            u, v = (np.array(centroids[x[0]]) for x in (a, b))
            size = np.linalg.norm(u) * np.linalg.norm(v)
            if a[0] != b[0] and (size == 0 or u @ v / size < limit):
                continue
            if a[3] != b[3]:
                first = a[3] == "topic"
            elif a[3] == "topic" and a[5] != b[5]:
                first = a[5] > b[5]
            else:
                first = a[2] > b[2]
            lost.add(b if first else a)
    return {p for p in picks if p not in lost}


@pytest.mark.parametrize("size", [1024, 7])
def test_picks_in_blocks_are_all_pairs(spark, size):
    rng = random.Random(4)
    centroids = {c: [rng.choice([0.0, 1.0, 1.0, 0.3]) for _ in range(4)] for c in range(45)}
    picks = [(c, s := rng.choice([0.2, 0.5, 0.9]), s, "global", None, None, k) for k, c in enumerate(rng.sample(range(50), 30))]
    for t, p in (("a", 2.0), ("b", 2.0), ("c", 0.5)):
        picks += [(c, 0.5, p * rng.choice([0.3, 0.5]), "topic", t, p, k) for k, c in enumerate(rng.sample(range(50), 15))]
    table = spark.createDataFrame(picks, "cluster_id long, score_total double, adjusted double, kind string, topic_key string, priority double, rank int").repartition(4)
    side = spark.createDataFrame(list(centroids.items()), "cluster_id long, centroid array<double>")
    got = select.without_overlap(table, side, 0.9, size)
    assert got.columns == table.columns and {tuple(r) for r in got.collect()} == plain(picks, centroids, 0.9)
    assert select.without_overlap(table.limit(0), side).count() == 0


def test_words_within_a_row(spark):
    rng = random.Random(1)
    rows = [[rng.choice("abcdefgh") + rng.choice(["", "x"]) for _ in range(rng.randrange(60))] for _ in range(50)] + [[], None, ["é", "e", "é"]]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, w array<string>").select("i", text.top_words(F.col("w"), 5).alias("t")).collect()
    for r in got:
        want = rows[r.i]
        assert (None if r.t is None else [(x.word, x.n) for x in r.t]) == (None if want is None else Counter(want).most_common(5))


def test_counts_observed_while_writing(spark):
    outcomes = spark.createDataFrame([(i, ["inserted", "filtered", "duplicated", "inserted"][i % 4]) for i in range(42)], "item_id long, outcome string")
    table, told = ingest.written_outcomes(outcomes)
    assert table.count() == 42 and told.collect() == ingest.counters(outcomes).collect()
    none, told = ingest.written_outcomes(outcomes.limit(0))
    assert none.count() == 0 and tuple(told.first()) == (0, 0, 0, 0)
    stored = spark.createDataFrame([(1, datetime(2024, 1, 1)), (2, datetime(2024, 1, 30)), (3, None)], "id int, fetched_at timestamp_ntz")
    kept, deleted = stores.delete_old(stored, dates.literal("2024-01-31 00:00:00"), 20)
    assert [r.id for r in kept.collect()] == [2] and deleted == 2
