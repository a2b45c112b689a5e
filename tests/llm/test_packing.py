import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from storyloom.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: [*t.encode(text, add_special_tokens=False).ids, 1]


def check(rows, want):
    """Each document's pieces follow one another and give its ids; each sequence is filled without gaps."""
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    assert set(docs) == set(want)
    for d, got in docs.items():
        got.sort(key=lambda r: r.start)
        assert [r.start for r in got] == np.cumsum([0, *(r.length for r in got[:-1])]).tolist()
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in got]).tolist() == want[d]
        assert {r.doc_tokens for r in got} == {len(want[d])}
    short = 0
    for got in seqs.values():
        got.sort(key=lambda r: r.offset)
        total = sum(r.length for r in got)
        assert [r.offset for r in got] == np.cumsum([0, *(r.length for r in got[:-1])]).tolist()
        assert len({(r.window, r.step_group) for r in got}) == 1 and total <= got[0].window <= 2048
        short += total < got[0].window
    return short


def texts():
    rng = random.Random(11)
    out = [None, "", " ", "x", "word " * 9000, "é|🙂\t\x00 <|endoftext|> it's" * 20]
    return out + [" ".join(rng.choice(["the", "ntheré", "of", "12", "||", "qzx\n"]) for _ in range(rng.choice([3, 40, 300, 900]))) for _ in range(60)]


@pytest.mark.parametrize("most", [400_000, 20])
def test_pieces_against_the_library(spark, library, most):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' ids", "0 length").repartition(3)
    got = packing.pack(df, PATH, public_tokenizers.PATTERN, most=most).collect()
    assert check(got, {i: library(t or "") for i, t in rows}) <= 3


def test_fills_windows_and_balances_groups():
    rng = np.random.default_rng(2)
    p = packing.Packer()
    total = 0
    for d in range(3000):
        n = int(rng.choice([1, 30, 200, 300, 600, 1100, 2500]))
        p.add(d, np.arange(n))
        total += n
        if p.tokens > 50_000:
            p.pack(10_000)
    p.pack()
    used, tiers, groups = defaultdict(int), {}, defaultdict(set)
    for _, _, n, _, _, s, _, tier, g in p.out:
        used[s] += n
        tiers[s] = tier
        groups[g].add(s)
    assert sum(used.values()) == total
    assert sum(used[s] < tiers[s] for s in used) <= 1
    sizes = sorted(sum(tiers[s] for s in got) for got in groups.values())
    assert sum(x < packing.GROUP for x in sizes) <= len(packing.TIERS) and sizes[-1] == packing.GROUP


def test_query_and_empty_table(spark, library, tmp_path):
    from storyloom.llm import queries

    rows = [*enumerate(texts()[:8]), (None, "no id")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.op9_packing(spark, str(tmp_path)).collect():
        ids = library(dict(rows)[r.doc_id] or "")[r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(empty, PATH, public_tokenizers.PATTERN).count() == 0
