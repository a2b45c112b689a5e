"""Near duplicates of a stream within a window, against a plain sequential version."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from test_runs import hashes, near, signed

from storyloom.streaming import near as streaming
from storyloom.streaming import state

START = datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """A state's partition is a Python worker of its own in every batch."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def plain(batches, window, url_window):
    """Batches of (item, h, url, time) one after another."""
    kept, out, now = [], {}, datetime.min
    for rows in batches:
        now = max([now, *(t for *_, t in rows)])
        here = []
        for item, h, url, t in rows:
            if any(near(h, x) and at >= now - window for x, _, at in kept) or any(near(h, x) for x, _, _ in here):
                out[item] = "filtered"
            elif any(u == url and at >= now - url_window for _, u, at in kept) or any(u == url for _, u, _ in here):
                out[item] = "duplicated"
            else:
                out[item] = "inserted"
                here.append((h, url, t))
        kept += here
    return out


def batches_of(n, size, hours, seed=8):
    rng = random.Random(seed)
    h = hashes(rng, n * size, 6)
    rows = [(i, x, f"u{rng.randrange(n * size)}", START + timedelta(hours=hours * (i // size), minutes=rng.randrange(hours * 60))) for i, x in enumerate(h)]
    return [rows[k * size : (k + 1) * size] for k in range(n)]


def arrive(spark, at, rows):
    spark.createDataFrame([(i, i, signed(h), u, t) for i, h, u, t in rows], streaming.ENTRIES).coalesce(1).write.mode("append").parquet(f"{at}/in")
    return spark.readStream.schema(streaming.ENTRIES).parquet(f"{at}/in")


def got_of(table):
    rows = [(r.item_id, r.outcome) for r in table.collect()]
    assert len(dict(rows)) == len(rows)
    return dict(rows)


def test_twenty_batches_of_one_stream_keep_a_flat_state(spark, tmp_path):
    batches = batches_of(20, 12, 12)
    for rows in batches:
        stream = arrive(spark, tmp_path, rows)
    running = None
    try:
        # one file a batch, in the order in which they were written
        running = streaming.start(spark.readStream.schema(streaming.ENTRIES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", window_hours=24, url_hours=36, buckets=4, slots=4)
        running.processAllAvailable()
        rows = [p["stateOperators"][0]["numRowsTotal"] for p in running.recentProgress if p["stateOperators"]]
    finally:
        if running:
            running.stop()
    order = {r.item_id: r.batch for r in streaming.outcomes(spark, f"{tmp_path}/out").collect()}
    arrived = [sorted((r for b in batches for r in b if order[r[0]] == k), key=lambda r: r[0]) for k in sorted(set(order.values()))]
    assert len(arrived) == 20
    want = plain(arrived, timedelta(hours=24), timedelta(hours=36))
    assert got_of(streaming.outcomes(spark, f"{tmp_path}/out")) == want and set(want.values()) == {"inserted", "duplicated", "filtered"}
    # a row for each bucket, kind and slot: those of a window (4 slots, and one begun at either end), not the 40 of all 240 hours
    assert max(rows) <= 4 * 2 * 6 and len(rows) >= 20


def test_a_restarted_stream_and_a_repeated_batch(spark, tmp_path):
    """Every batch in a run of its own from the checkpoint; then the last one again, as after a loss before its commit."""
    batches = batches_of(4, 20, 20, seed=5)
    want = plain(batches, timedelta(hours=24), timedelta(hours=720))
    for rows in batches:
        found = streaming.drain(arrive(spark, tmp_path, rows), f"{tmp_path}/out", buckets=3)
    assert got_of(found) == want
    last = max((tmp_path / "out/state/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for p in [last, last.with_name(f".{last.name}.crc")]:
        p.unlink(missing_ok=True)
    again = streaming.drain(spark.readStream.schema(streaming.ENTRIES).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", buckets=3)
    assert got_of(again) == want
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != state.ROCKS


def test_rows_without_time_or_url(spark, tmp_path):
    rows = [(1, 7, None, START), (2, 1 << 40, None, None), (3, 1 << 40, "u", START), (4, 3 << 20, "u", None)]
    assert got_of(streaming.drain(arrive(spark, tmp_path, rows), f"{tmp_path}/out")).keys() == {1, 2, 3, 4}
    want = plain([[(i, h, u or object(), t or datetime(1970, 1, 1)) for i, h, u, t in rows]], timedelta(hours=24), timedelta(hours=720))
    assert got_of(streaming.outcomes(spark, f"{tmp_path}/out")) == want
    # what has no time isn't remembered
    later = streaming.drain(arrive(spark, tmp_path, [(5, 5 << 20, None, START)]), f"{tmp_path}/out")
    assert got_of(later)[5] == ("filtered" if near(5 << 20, 7) else "inserted")


@pytest.mark.parametrize("at_once", [1 << 22, 5])
def test_latest_against_all_pairs(monkeypatch, at_once):
    monkeypatch.setattr(streaming, "AT_ONCE", at_once)
    rng = np.random.default_rng(1)
    stored = np.stack([rng.integers(0, 4, 60), rng.integers(0, 16, 60), rng.integers(0, 99, 60)], axis=1)
    asked = np.stack([rng.integers(0, 5, 30), rng.integers(0, 16, 30)], axis=1)
    got = streaming._latest(asked, stored, 1)
    for (k, h), t in zip(asked.tolist(), got.tolist(), strict=True):
        assert t == max((c for a, b, c in stored.tolist() if a == k and (h ^ b).bit_count() <= 1), default=streaming.NEVER)
