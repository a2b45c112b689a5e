import random

import pytest

import corpus_pipeline as P
from storyloom.llm import near_copies as N

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def first_of_each(texts):
    """Of texts by id the smallest id of each component, against all pairs."""
    order = sorted(texts)
    sets = [grams(texts[i]) for i in order]
    label = list(range(len(order)))
    near = [(i, j) for j in range(len(order)) for i in range(j) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    changed = True
    while changed:
        changed = False
        for i, j in near:
            if label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    return [order[k] for k in sorted(set(label))]


def varied(rng, lengths=(40, 120, 300, 900), bases=6, shares=(0.005, 0.015, 0.02, 0.025, 0.04)):
    """Texts, and copies of them with some words changed, which differ in more than four SimHash bits."""
    texts = []
    for n in lengths:
        for _ in range(bases):
            base = [f"w{rng.randrange(4000)}" for _ in range(n)]
            texts.append(" ".join(base))
            for share in shares:
                w = list(base)
                for i in rng.sample(range(n), max(1, round(n * share))):
                    w[i] = f"x{rng.randrange(4000)}"
                texts.append(" ".join(w))
    return texts


def test_stage_removes_near_copies_of_any_length(spark):
    rng = random.Random(7)
    texts = [*varied(rng), "one two", "One  TWO", "", " \n", "one two three four five six"]
    rng.shuffle(texts)
    df = spark.createDataFrame([(i, t, "x", "a", len(t)) for i, t in enumerate(texts)], DOC)
    got = P.stage_near_dedup(spark, df.repartition(3), "")
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == first_of_each(dict(enumerate(texts)))


@pytest.mark.parametrize(("group", "shingles"), [(5, N.SHINGLES), (40, N.SHINGLES), (10**6, 1000)])
def test_a_large_group_is_dealt_out_and_loses_no_link(spark, group, shingles):
    """Chains of copies, each somewhat farther from the first: components of texts that are unlike each other at their ends."""
    rng = random.Random(3)
    texts = []
    for _ in range(3):
        w = [f"w{rng.randrange(3000)}" for _ in range(200)]
        for step in range(60):
            texts.append(" ".join(w))
            for i in rng.sample(range(200), 3 if step % 10 else 6):
                w[i] = f"x{rng.randrange(9000)}"
    rng.shuffle(texts)
    df = spark.createDataFrame([(i, t, "x", "a", len(t)) for i, t in enumerate(texts)], DOC)
    got = N.keep_first(df.repartition(3), group=group, block=4, shingles=shingles)
    assert sorted(r.doc_id for r in got.collect()) == first_of_each(dict(enumerate(texts)))


def test_groups_of_large_sets_are_bounded_by_their_size(spark, monkeypatch):
    """50 sets of 1 MB, alike in their keys but not in fact: no group compared holds over the bound and one more set."""
    import numpy as np

    rng = np.random.default_rng(5)
    sets = [(1, 13, k, rng.integers(0, 1 << 62, 1 << 17).astype(np.uint64).tobytes()) for k in range(50)]
    table = spark.createDataFrame(sets, "root long, parts int, node long, found binary").repartition(10)
    seen, plain = [], N.compared

    def counted(rows, limit):
        seen.append(rows.groupBy("root", "block", "chunk").agg(N.F.sum(N.F.octet_length("found")).alias("b")).agg(N.F.max("b")).first()[0])
        return plain(rows, limit)

    monkeypatch.setattr(N, "compared", counted)
    assert N._spanning(table, 0.8, 500, 128, shingles=1 << 19).count() == 0
    assert len(seen) >= 3 and max(seen) <= 20 << 20  # blocks and chunks of 4 MB on the mean, as a hash deals them


def test_one_row_of_each_group_stays(spark):
    long = " ".join(f"w{i % 977}" for i in range(60000))
    rows = [(3, None), (2, ""), (5, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (4, "another text of that id"), (None, "lone words here"), (None, "lone words here"), (None, "a b c d e f"), (9, long), (10, long + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id _id", "text _h", "1 node", "2 bands", "3 `x.y`")
    got = N.keep_first(df)
    assert got.columns == df.columns
    kept = sorted((r.doc_id is None, r.doc_id, r.text) for r in got.collect())
    assert kept == [(False, 2, ""), (False, 4, "a b c d e f"), (False, 4, "another text of that id"), (False, 9, long), (True, None, "lone words here")]
    assert N.keep_first(df.limit(0)).count() == 0
