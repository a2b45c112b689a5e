"""Runs against plain sequential versions: ingest, scans, leader clusters, updates of sources."""

import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyloom.functions import dates, text
from storyloom.operators import cluster, dedup, hamming, ingest, stores
from storyloom.operators.dedup import Scanner
from storyloom.sources import shared


def now():
    return dates.literal("2024-01-31 00:00:00")


def hashes(rng, n, bases=6):
    """Hashes with many near ones, some equal."""
    base = [rng.getrandbits(64) for _ in range(bases)]
    out = []
    for _ in range(n):
        h = rng.choice(base)
        for _ in range(rng.randrange(5)):
            h ^= 1 << rng.randrange(64)
        out.append(h)
        if rng.random() < 0.2:
            base.append(h)
    return out


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def near(a, b):
    return (a ^ b).bit_count() <= 3


def plain_run(entries, stored, recent):
    """(item, h, url) one after another."""
    seen, urls, out = list(recent), set(stored), {}
    for item, h, u in entries:
        if any(near(h, x) for x in seen):
            out[item] = "filtered"
        elif u in urls:
            out[item] = "duplicated"
        else:
            out[item] = "inserted"
            seen.append(h)
            urls.add(u)
    return out


def test_ingest_run_is_the_sequential_one(spark):
    rng = random.Random(4)
    h = hashes(rng, 260, 30)
    rows = [(i, i, signed(x), f"u{rng.randrange(120)}") for i, x in enumerate(h)]
    old = [(signed(x), f"u{rng.randrange(120)}") for x in hashes(rng, 15, 4)] + [(signed(h[7] ^ 5), "u3")]
    entries = spark.createDataFrame(rows, "item_id long, rank long, h long, url_sha1 string").repartition(3)
    stored = spark.createDataFrame(old, "h long, url_sha1 string")
    got = {r.item_id: r.outcome for r in ingest.run(entries, stored, stored).collect()}
    want = plain_run([(i, h[i], u) for i, _, _, u in rows], [u for _, u in old], [x & (1 << 64) - 1 for x, _ in old])
    assert got == want and set(want.values()) == {"inserted", "duplicated", "filtered"}
    sums = ingest.counters(spark.createDataFrame(list(got.items()), "item_id long, outcome string")).first()
    assert sums.items_total == 260 and sums.items_inserted == list(want.values()).count("inserted")


@pytest.mark.parametrize("local", [0, 100, 10**6])
def test_scan_in_rounds_is_the_plain_scan(spark, local):
    rng = random.Random(9)
    h = list(dict.fromkeys(hashes(rng, 150, 12)))
    urls = [rng.choice([None, f"u{rng.randrange(60)}"]) for _ in h]
    scanner = Scanner(3)
    want = {i: scanner.take(x, u) for i, (x, u) in enumerate(zip(h, urls, strict=True))}
    df = spark.createDataFrame([(i, signed(x), u, i) for i, (x, u) in enumerate(zip(h, urls, strict=True))], "node long, h long, url string, rank long")
    assert {r.node: r.taken for r in dedup.scan(df, 3, local).collect()} == want


def counted(monkeypatch):
    """How many rounds a scan takes: each writes one table of what it takes."""
    plain, rounds = dedup.cut, []

    def cut(df, name):
        rounds.append(name)
        return plain(df, name)

    monkeypatch.setattr(dedup, "cut", cut)
    return rounds


def test_accepted_hashes_of_one_key_take_few_rounds(spark, monkeypatch):
    """10,000 hashes that agree in 26 bits, none near another but for some pairs: what shares a key alone doesn't wait."""
    rng = random.Random(6)
    h: list[int] = []
    while len(h) < 10_000:
        h.append(rng.getrandbits(38) << 26 | 0x2AAAAAA)
    h += [x ^ 1 << 40 for x in h[:50]]
    rng.shuffle(h)
    h = list(dict.fromkeys(h))
    rounds = counted(monkeypatch)
    df = spark.createDataFrame([(i, signed(x), None, i) for i, x in enumerate(h)], "node long, h long, url string, rank long")
    got = {r.node: r.taken for r in dedup.scan(df, 3, local=2).collect()}
    scanner = Scanner(3)
    assert got == {i: scanner.take(x, None) for i, x in enumerate(h)}
    assert rounds.count("taken") < 10


def test_rounds_follow_chains_of_conflicts(spark, monkeypatch):
    """One URL for many, one hash for many, and a chain of 30 in which each conflicts with the next."""
    chain = [(1 << 2 * i) - 1 for i in range(31)]
    rows = [(x, None) for x in chain] + [(0xF0F0F0F0F0F0F0F0 ^ (i * 0x0101010101010101), "one") for i in range(1, 40)] + [(0x5A5A5A5A5A5A5A5A, f"u{i}") for i in range(40)]
    rounds = counted(monkeypatch)
    df = spark.createDataFrame([(i, signed(x & (1 << 64) - 1), u, i) for i, (x, u) in enumerate(rows)], "node long, h long, url string, rank long")
    got = {r.node: r.taken for r in dedup.scan(df, 3, local=0).collect()}
    scanner = Scanner(3)
    assert got == {i: scanner.take(x & (1 << 64) - 1, u) for i, (x, u) in enumerate(rows)}
    assert rounds.count("taken") <= 17


@pytest.mark.parametrize(("crowd", "chunk"), [(1 << 22, 1 << 14), (50, 1 << 14), (50, 7), (0, 1)])
def test_near_pairs_of_crowded_keys(spark, crowd, chunk, monkeypatch):
    """Split keys and chunks find the pairs that all pairs do, each once."""
    rng = random.Random(8)
    h = sorted({signed(x) for x in hashes(rng, 120, 5)} | {signed(rng.getrandbits(20) << 30 | 5) for _ in range(60)})
    other = sorted({signed(rng.choice(h) & (1 << 64) - 1 ^ 1 << rng.randrange(64)) for _ in range(60)} | {0, -1})
    if crowd == 50:
        monkeypatch.setattr(hamming, "SMALL", 3)  # the fullest keys apart from the others
    one = spark.createDataFrame([(x,) for x in h], "h long")
    two = spark.createDataFrame([(x, i) for i, x in enumerate(other)], "h long, place int")
    d = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1")
    got = sorted((r.a, r.b) for r in hamming.pairs(one, one, 3, same=True, crowd=crowd, chunk=chunk).collect())
    assert got == [(a, b) for i, a in enumerate(h) for b in h[i + 1 :] if d(a, b) <= 3]
    got = sorted((r.a, r.b, r.place) for r in hamming.pairs(one, two, 2, crowd=crowd, chunk=chunk).collect())
    assert got == sorted((a, b, i) for a in h for i, b in enumerate(other) if d(a, b) <= 2)


def plain_leaders(vectors, existing, limit):
    leads = [(i, np.array(v), "old") for i, v in existing]
    out = {}
    for i, v in vectors:
        v = np.array(v)
        sims = [round(float(v @ w / (np.linalg.norm(v) * np.linalg.norm(w))), 9) for _, w, _ in leads]
        k = max(range(len(sims)), key=lambda j: (sims[j], -j), default=None)
        if k is not None and sims[k] >= limit:
            out[i] = (leads[k][0], sims[k], False)
        else:
            leads.append((i, v, "new"))
            out[i] = (i, 0.0, True)
    return out


@pytest.mark.parametrize(("head", "group", "part"), [(3, 8192, 99), (4096, 8192, 99), (5, 2, 7)])
@pytest.mark.parametrize("old", [0, 4])
def test_leaders_are_those_of_the_scan(spark, head, group, part, old):
    rng = np.random.default_rng(2)
    v = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(60)]
    existing = [(100 + k, [float(x) for x in rng.normal(size=4)]) for k in range(old)]
    order = list(rng.permutation(60))
    df = spark.createDataFrame([(i, x, int(order[i])) for i, x in v], "id long, v array<double>, rank long")
    stored = spark.createDataFrame(existing, "id long, v array<double>") if old else None
    got = {r.id: (r.leader, round(r.similarity, 6), r.new) for r in cluster.leader_clusters(df, 0.7, stored, head, group, part).collect()}
    want = plain_leaders(sorted(v, key=lambda r: order[r[0]]), existing, 0.7)
    assert got == {i: (a, round(s, 6), n) for i, (a, s, n) in want.items()}


@pytest.mark.parametrize("group", [8192, 40])
def test_few_pairs_are_compared_on_clustered_vectors(spark, group):
    """50 tight clusters, each with some leaders: a vector meets those of its own, not a tenth of all pairs."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(50, 32))
    x = centres[rng.integers(0, 50, 1500)] + 0.12 * rng.normal(size=(1500, 32))
    v = [(i, [float(c) for c in row]) for i, row in enumerate(x)] + [(1500, [0.0] * 32), (1501, [0.0] * 32)]
    told = {}
    got = {r.id: (r.leader, round(r.similarity, 6), r.new) for r in cluster.leader_clusters(spark.createDataFrame(v, "id long, v array<double>").repartition(4), 0.985, size=40, group=group, told=told).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    leads, want = [], {}
    for i in range(1500):
        s = np.round(unit[leads] @ unit[i], 9)
        k = int(s.argmax()) if len(s) else 0
        if len(s) and s[k] >= 0.985:
            want[i] = (leads[k], round(float(s[k]), 6), False)
        else:
            want[i] = (i, 0.0, True)
            leads.append(i)
    assert got == want | {i: (i, 0.0, True) for i in (1500, 1501)}
    assert told["leaders"] == len(leads) + 2 > 150
    assert told["met"] < 0.1 * 1502 * told["leaders"]


@pytest.mark.parametrize("threshold", [0.0, -0.2, 1.0])
def test_leaders_at_odd_thresholds(spark, threshold):
    v = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [-1.0, 0.1])]
    got = {r.id: r.leader for r in cluster.leader_clusters(spark.createDataFrame(v, "id long, v array<double>"), threshold).collect()}
    assert got == {0.0: {0: 0, 1: 0, 2: 0, 3: 0, 4: 4}, -0.2: {0: 0, 1: 0, 2: 0, 3: 0, 4: 4}, 1.0: {0: 0, 1: 1, 2: 0, 3: 3, 4: 4}}[threshold]
    assert cluster.leader_clusters(spark.createDataFrame(v, "id long, v array<double>").limit(0), threshold).count() == 0


def test_seed_domains_count_twice_and_stored_clusters_go_on(spark):
    t = datetime(2024, 1, 1)
    rows = [(1, 10, t, "a.org", True), (1, 11, t, "a.org", False), (1, 12, t, "unknown", False), (2, 13, t, "b.org", False)]
    stored = spark.createDataFrame([(2, 5, datetime(2023, 1, 1), datetime(2023, 2, 1), {"b.org": 4, "c.org": 1})], "cluster_id long, items_count long, first_seen timestamp, last_seen timestamp, domains map<string,bigint>")
    got = {r.cluster_id: r for r in cluster.cluster_rows(spark.createDataFrame(rows, "cluster_id long, item_id long, ts timestamp, domain string, new boolean"), stored).collect()}
    assert got[1].domains == {"a.org": 3} and got[1].items_count == 3 and got[1].domains_count == 1 and got[1].first_seen == t
    assert got[2].domains == {"b.org": 5, "c.org": 1} and got[2].items_count == 6 and got[2].last_seen == t


def test_sources_after_their_fetches(spark):
    src = "id long, etag string, last_modified timestamp_ntz, error_count int, last_checked_at timestamp_ntz"
    sources = spark.createDataFrame([(1, "a", None, 2, None), (2, "b", None, 2, None), (3, "c", None, 2, None), (4, "d", None, 2, None)], src)
    fetches = spark.createDataFrame([(1, 200, "new", None), (2, 304, "x", None), (3, 0, None, None)], "source_id long, status int, etag string, last_modified timestamp_ntz")
    got = {r.id: (r.etag, r.error_count, r.last_checked_at is not None) for r in ingest.checked_sources(sources, fetches, now()).collect()}
    assert got == {1: ("new", 0, True), 2: ("b", 0, True), 3: ("c", 3, True), 4: ("d", 2, False)}
    assert ingest.run_status(fetches).first().status == "partial_success"
    assert ingest.run_status(fetches.filter("status = 0")).first().status == "error"
    assert ingest.run_status(fetches.filter("status = 304")).first().status == "success"


def test_null_scores_keep_the_old_ones(spark):
    stored = spark.createDataFrame([(1, 0.5, None), (2, 0.25, None)], "cluster_id long, score double, updated_at timestamp_ntz")
    new = spark.createDataFrame([(1, None), (3, 0.9)], "cluster_id long, score double")
    got = {r.cluster_id: (r.score, r.updated_at is not None) for r in stores.set_scores(stored, new, now()).collect()}
    assert got == {1: (0.5, True), 2: (0.25, False)}


def test_sanitised_html_keeps_the_allowed_parts():
    page = '<p onclick="x()">Hi <b>you</b> &amp; <script>bad()</script><a href="http://a.org" target="_b">link</a><a href="javascript:x">no</a><img src="x"></p>'
    assert text.sanitised_html(page) == '<p>Hi <b>you</b> &amp; bad()<a href="http://a.org">link</a><a>no</a></p>'
    assert text.sanitised_html(None) == ""


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})()

    with pytest.raises(RuntimeError, match="checkpoint"):
        shared.shared_dir(Session())
    df = shared.cut(spark.range(3), "t")
    path = df._storyloom_path
    assert df.count() == 3
    shared.drop(df)
    assert not spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path))


def test_topics_of_their_own_clusters(spark):
    from storyloom.operators import topics

    hits = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 2, 1), ("a", 3, 3)], "topic_key string, item_id long, rank int")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], "id long, v array<double>")
    got = {(r.topic_key, r.id): r.leader for r in topics.clusters_by_topic(hits, vectors, 0.8).collect()}
    assert got == {("a", 1): 1, ("a", 2): 1, ("a", 3): 3, ("b", 2): 2}


def test_capped_topics_cut_down_within_tasks(spark):
    from storyloom.operators import topics

    items = spark.range(50).select(F.col("id").alias("item_id"), F.lit("a b").alias("title"), F.lit("").alias("summary"), F.lit("en").alias("lang"), F.lit("x.org").alias("domain"), F.lit("").alias("url"))
    found = topics.match_topics(items, [topics.Topic("T", "t", queries=["a"], max_posts_per_run=3)])
    assert [r.item_id for r in found.orderBy("rank").collect()] == [0, 1, 2]
    assert "WindowGroupLimit" in found._jdf.queryExecution().toString()
