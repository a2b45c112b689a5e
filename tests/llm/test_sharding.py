import zlib
from collections import Counter, defaultdict

import pytest

from storyloom.llm import sharding


def check(rows, got, shards):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(0 <= s < shards for s in by) and all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = [len(by.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1


@pytest.mark.parametrize("n", [5, 300])
def test_equal_counts_and_groups_stay_together(spark, n):
    rows = [(i, f"text {i if i % 3 else i % 20}" if i % 7 else None) for i in range(n)] + [(0, None), (None, "text 1"), (n, "long " * 50000)]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 shard", "2 h"), 6).collect()
    check(rows, got, 6)
    groups = defaultdict(Counter)
    for r in got:
        groups[r.text_crc32][r.shard] += 1
    for r in got:
        assert r.links == sum(groups[r.text_crc32].values()) - 1 and r.kept_links == groups[r.text_crc32][r.shard] - 1
    if n > 100:
        assert sum(r.kept_links for r in got) >= 0.9 * sum(r.links for r in got)


def test_a_group_larger_than_a_shard_fills_whole_shards(spark):
    rows = [(i, "same" if i < 130 else f"own {i}") for i in range(240)]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), 6).collect()
    check(rows, got, 6)
    held = sorted(Counter(r.shard for r in got if r.links).values(), reverse=True)
    assert held[:3] == [40, 40, 40] and len(held) == 4


def test_all_linked_no_room(spark):
    rows = [(i, f"pair {i // 2}") for i in range(80)]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    check(rows, got, 4)
    assert sum(r.kept_links for r in got) > 0.4 * sum(r.links for r in got)


def test_empty_table_and_native(spark):
    df = sharding.assign(spark.createDataFrame([], "doc_id long, text string"), 24)
    assert df.count() == 0
    assert "Python" not in df._jdf.queryExecution().toString()
