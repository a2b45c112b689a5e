"""Operators against published values, sequential scans and plain models."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyloom.functions import dates
from storyloom.operators import cluster, dedup, score, select, stores, topics, validate
from storyloom.operators.topics import Topic, compile_query


@pytest.mark.parametrize(("counts", "want"), [([1, 1, 1, 1], 0.0), ([0, 0, 0, 10], 0.74999997), ([10, 1], 0.40909090165)])
def test_gini(spark, counts, want):
    got = score.gini(spark.createDataFrame([(1, n) for n in counts], "cluster_id int, n long")).first().gini
    assert abs(got - want) < 1e-9


def test_trend_of_short_and_long_history(spark):
    now = datetime(2024, 1, 10)
    rows = [(1, now - timedelta(days=i), 5) for i in range(7)] + [(2, now - timedelta(days=i), 3) for i in range(3)]
    history = spark.createDataFrame(rows, "cluster_id int, run_ts timestamp, n long")
    counts = spark.createDataFrame([(1, 6), (2, 2), (3, 1)], "cluster_id int, items_count long")
    got = {r.cluster_id: r.trend for r in score.trend_spike(counts, history).collect()}
    assert abs(got[1] - 1 / (1 + np.exp(-1))) < 1e-12 and got[2] == 1.0 and got[3] == 0.0


def test_history_keeps_the_last_thirty(spark):
    now = datetime(2024, 1, 10)
    rows = spark.createDataFrame([(1, now - timedelta(hours=34 - i), i) for i in range(35)], "cluster_id int, run_ts timestamp, n long")
    kept = sorted(r.n for r in stores.history(rows, F.lit(now)).collect())
    assert kept == list(range(5, 35))


def test_rank(spark):
    rows = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, None), (4, 0.5)], "cluster_id int, total double")
    assert [r.cluster_id for r in score.rank_clusters(rows, 3).collect()] == [2, 1, 4]


def scan(hashes, distance):
    kept = []
    for i, h in hashes:
        if all(bin(h ^ k).count("1") > distance for _, k in kept):
            kept.append((i, h))
    return {i for i, _ in kept}


def test_near_filter_is_the_scan(spark):
    rng = random.Random(8)
    hashes, x = [], rng.getrandbits(63)
    for i in range(300):
        if rng.random() < 0.15:
            x = rng.getrandbits(63)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            x ^= 1 << rng.randrange(63)
        hashes.append((i, x))
    rows = spark.createDataFrame(hashes, "item_id long, h long")
    assert {r.item_id for r in dedup.near_filter(rows).collect() if r.kept} == scan(hashes, 3)
    values = sorted({h for _, h in hashes})
    want = {(a, b) for a in values for b in values if a < b and bin(a ^ b).count("1") <= 3}
    found = [(r.a, r.b) for r in dedup.near_pairs(rows.select("h").distinct()).collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_leaders_are_the_scan(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(120, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    leaders, want = [], {}
    for i, x in enumerate(v):
        s = [(round(float(v[j] @ x), 9), -j) for j in leaders if v[j] @ x >= 0.7]
        want[i] = -max(s)[1] if s else i
        if not s:
            leaders.append(i)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    assert {r.id: r.leader for r in cluster.leader_clusters(df, 0.7, size=40).collect()} == want


TEXT8 = "machine learning models and deep neural network training"


@pytest.mark.parametrize(
    ("query", "text", "want"),
    [
        ("machine NEAR/3 neural", TEXT8, False),
        ("machine NEAR/5 neural", TEXT8, True),
        ('"Taiwan" OR "Taipei"', "Taiwan news", False),
        ("a OR b AND c", "only a here", False),
        ("a OR b AND c", "b and c", True),
        ("art", "start", False),
        ("term AND (x", "term with (x", False),  # no word boundary before a parenthesis
        ("", "text", False),
        ("word", "", False),
        ("word", None, False),
    ],
)
def test_plain_queries(spark, query, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(compile_query(query)(F.col("t"))).first()[0] is want


@pytest.mark.parametrize(("query", "text", "want"), [('"Taiwan" OR "Taipei"', "Taiwan news", True), ("a OR b AND c", "only a here", True), ("(a OR b) AND c", "only a here", False), ('x AND ("y z" OR neural NEAR/2 net)', "x neural big net", True)])
def test_boolean_queries(spark, query, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(compile_query(query, "boolean")(F.col("t"))).first()[0] is want


def test_topic_settings():
    t = Topic.of({"name": "Big News", "max_per_run": 7, "keywords": ["a", "b"], "odd": 1}, use_keywords=True)
    assert (t.key, t.max_posts_per_run, t.queries) == ("big_news", 7, ["a OR b"])


def test_topic_picks_and_overlap(spark):
    metrics = spark.createDataFrame([(1, 0.8), (2, 0.7), (3, 0.6)], "cluster_id int, composite double")
    mapped = spark.createDataFrame([(1, "hi"), (2, "hi"), (3, "lo")], "cluster_id int, topic_key string")
    conf = spark.createDataFrame([("hi", 2.0, True, 5), ("lo", 0.5, True, 5)], "topic_key string, priority double, enabled boolean, cap int")
    got = sorted((r.cluster_id, round(r.adjusted, 6)) for r in select.topic_picks(metrics, mapped, conf).collect())
    assert got == [(1, 1.6), (2, 1.4), (3, 0.3)]
    picks = select.global_picks(metrics.filter("cluster_id < 3"), 5).unionByName(select.topic_picks(metrics, mapped.filter("cluster_id = 3").union(spark.createDataFrame([(4, "hi")], mapped.schema)), conf))
    centroids = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.01])], "cluster_id int, centroid array<double>")
    kept = {(r.kind, r.cluster_id) for r in select.without_overlap(picks, centroids).collect()}
    assert kept == {("global", 2), ("topic", 3)}


def test_upsert_attach_retain(spark):
    stored = spark.createDataFrame([("u", "old", "en", 2), ("v", "v", "fr", 1)], "url string, name string, lang string, errors int")
    new = spark.createDataFrame([("u", "new"), ("w", None)], "url string, name string")
    got = {r.url: (r.name, r.lang, r.errors) for r in stores.upsert(stored, new, "url", ["name", "lang"], {"name": F.lit("none"), "lang": F.lit("en"), "errors": F.lit(0)}).collect()}
    assert got == {"u": ("new", "en", 2), "v": ("v", "fr", 1), "w": ("none", "en", 0)}
    whole = {r.url: (r.name, r.lang, r.errors) for r in stores.replace(stored, new.filter("url = 'u'"), "url", {"errors": F.lit(0)}).collect()}
    assert whole == {"u": ("new", None, 0), "v": ("v", "fr", 1)}


def test_validators(spark):
    claims = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "alpha one two three")], "claim_id int, text string")
    sources = spark.createDataFrame([(7, "Beta gamma delta omega"), (8, "alpha")], "source_id int, text string")
    got = {r.claim_id: (r.supported, r.best, r.n_sources) for r in validate.support(claims, sources, 0.6).collect()}
    assert got == {1: (True, 0.75, 1), 2: (False, None, 0)}
    row = spark.createDataFrame([('He said "this is a rather long quotation" on 3 of 12,5% and 3',)], "t string")
    r = row.select(validate.numbers(F.col("t")).alias("n"), validate.quotes(F.col("t")).alias("q")).first()
    assert r.n == ["3", "12,5%"] and r.q == ["this is a rather long quotation"]
    empty, three = F.array().cast("array<string>"), F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    scores = spark.range(1).select(validate.score(empty, empty), validate.score(empty, three), validate.score(three, empty)).first()
    assert tuple(scores) == (100, 85, 20)


def test_native_plans(spark):
    rows = spark.createDataFrame([(1, 2, "t", "s", "c", "u", "d", "x", datetime(2024, 1, 1))], "cluster_id int, item_id int, title string, summary string, content string, url string, domain string, source_id string, published_at timestamp")
    plan = score.five_factors(rows, dates.literal("2024-01-02 00:00:00"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan
