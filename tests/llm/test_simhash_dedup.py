import random

import numpy as np
import pyspark.sql.types as T
import pytest
import xxhash

from storyloom.llm import simhash_dedup as S

DOC = "doc_id long, text string"


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(fps, ids, distance=4):
    """component_id by comparing all pairs."""
    label = list(range(len(fps)))
    changed = True
    near = [[j for j in range(len(fps)) if bin(fps[i] ^ fps[j]).count("1") <= distance] for i in range(len(fps))]
    while changed:
        changed = False
        for i, js in enumerate(near):
            m = min(label[j] for j in js)
            if m < label[i]:
                label[i], changed = m, True
    least = {}
    for lab, i in zip(label, ids, strict=True):
        least[lab] = min(least.get(lab, i), i)
    return {i: least[lab] for lab, i in zip(label, ids, strict=True)}


def test_fingerprint_as_stated():
    for text in (None, "", " \n\t ", "One", "one TWO three", "A b C d e f g", "É ä " * 30, "x " * 5000):
        assert S.fingerprint_of(None if text is None else text.encode()) == plain_fingerprint(text)


def test_anchors_cover_every_pair_within_four_bits():
    rng = np.random.default_rng(3)
    for distance in range(6):
        for _ in range(150):
            x = int(rng.integers(0, 2**64, dtype=np.uint64))
            y = x
            for b in rng.choice(64, distance, replace=False):
                y ^= 1 << int(b)
            i, k, h = S.anchors(np.array([x, y], np.uint64))
            assert len(k[h]) == 6
            assert set(k[(i == 0) & h]) & set(k[i == 1])


@pytest.mark.parametrize("hot", [8192, 8])
def test_components_against_all_pairs(spark, hot):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 12, dtype=np.uint64)
    fps = []
    for b in base:
        x = int(b)
        for _ in range(25):
            fps.append(x)
            for bit in rng.choice(64, int(rng.integers(0, 5)), replace=False):
                x ^= 1 << int(bit)
    ids = [int(i) for i in rng.permutation(len(fps))]
    want = brute(fps, ids)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in set(signed)], "fp long").repartition(3)
    roots = {r.node: r.root for r in S.components(S.links(df, hot=hot)).collect()}
    least = {}
    for s, i in zip(signed, ids, strict=True):
        r = roots.get(s, s)
        least[r] = min(least.get(r, i), i)
    assert {i: least[roots.get(s, s)] for s, i in zip(signed, ids, strict=True)} == want


def test_nulls_ties_long_texts_extra_columns(spark):
    rows = [(3, None, 1), (2, "", 1), (5, "a b c d e f", 0), (4, "a b c d e f", 0), (4, "a b c d e f", 0), (None, "lone words here", 0), (9, "w%d " * 3 % (1, 2, 3) * 20000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int").withColumn("anchor", df_lit())
    got = S.near_duplicates(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.component_id for r in got}
    assert by[3] == by[2] == 2 and by[5] == by[4] == 4 and by[9] == 9 and by[None] is None


def df_lit():
    from pyspark.sql import functions as F

    return F.lit("x")


def test_empty_table(spark):
    df = spark.createDataFrame([], T.StructType().add("doc_id", "long").add("text", "string"))
    assert S.near_duplicates(df).count() == 0


def test_a_heavy_fingerprint_is_split(spark):
    """A third of the rows are copies of one text: their join broadcasts its row, and no exchange carries them."""
    rows = [(i, "one text for all of these" if i % 3 == 0 else f"own words {i} of this text {i * 7}") for i in range(4500)]
    found = S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), distance=0)
    plan = found._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "Union" in plan
    got = {r.doc_id: r.component_id for r in found.collect()}
    assert len(got) == len(rows) and all(got[i] == (0 if i % 3 == 0 else i) for i in got)


@pytest.mark.parametrize("local", [0, 40, 10**6])
def test_components_in_rounds_or_in_one_task(spark, local):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(50)]
    root = {x: x for pair in links if pair[0] != pair[1] for x in pair}
    for _ in range(400):
        for a, b in links:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in S.components(spark.createDataFrame(links * 2, "a long, b long").repartition(3), local).collect()}
    assert got == root
    assert S.components(spark.createDataFrame([], "a long, b long"), local).count() == 0
