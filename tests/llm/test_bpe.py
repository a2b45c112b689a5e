import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from storyloom.llm import bpe

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def plain():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(RANKS), special_tokens={})


def texts():
    rng = random.Random(7)
    alphabet = "abcdeth  \n\t'sll éßñ0123$%&|…  漢字🙂\x00\x1c<|endoftext|>"
    out = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 200))) for _ in range(150)]
    out += ["", None, " ", "a" * 600, "It's they'll   x\n\n  y ", "<|endoftext|>", "ß" * 300 + " end", "thereafter " * 4000, "aab" * 400]
    return out


@pytest.mark.parametrize(("most", "common"), [(400_000, 300_000), (50, 0)])
def test_same_ids_as_the_library_and_round_trip(spark, plain, most, common):
    rows = [(i, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame([*rows, (0, rows[0][1]), (None, "no id")], "doc_id long, text string").withColumn("ids", bpe.F.lit(1)).repartition(3)
    enc = bpe.encode(df, RANKS, public_tokenizers.PATTERN, most=most, common=common)
    got = enc.select("doc_id", "ids", bpe.decode(bpe.F.col("ids"), RANKS).alias("back")).collect()
    assert len(got) == len(rows) + 2
    want = dict(rows) | {None: "no id"}
    for r in got:
        t = want[r.doc_id] or ""
        assert list(r.ids) == plain.encode_ordinary(t)
        assert bytes(r.back) == t.encode()


def test_long_pieces_merge_alike(plain):
    rng = random.Random(1)
    for _ in range(200):
        w = "".join(rng.choice("abethin") for _ in range(rng.randint(1, 60))).encode()
        assert bpe.merge_long(w, bpe.ranks(RANKS)) == plain.encode_ordinary(w.decode())


def test_query_on_a_small_table(spark, plain, tmp_path):
    from storyloom.llm import queries

    rows = list(enumerate(texts()[:40]))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.op6_bpe(spark, str(tmp_path)).collect():
        ids = plain.encode_ordinary(rows[r.doc_id][1] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((rows[r.doc_id][1] or "").encode()).hexdigest()


def test_common_words_have_their_ids(spark, plain):
    df = spark.createDataFrame([(i, "zqxthere unaccountablything zqxthere") for i in range(3)], "doc_id long, text string")
    known = bpe.common_words(df, RANKS, public_tokenizers.PATTERN)
    words = known.words.to_pylist()
    assert {" unaccountablything", " zqxthere"} <= set(words)
    for w in words:
        ids, (n,) = known.of(bpe.pa.array([w]))
        assert n == len(ids) and [-1 - ids[0], *ids[1:].tolist()] == plain.encode_ordinary(w)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(df, RANKS, public_tokenizers.PATTERN).count() == 0


def test_pairs_have_their_ranks():
    found = bpe.ranks(RANKS)
    tokens = {r: t for t, r in found.items()}
    shift, cells, owner, end = bpe.pair_table(RANKS)

    def rank(a, b):
        pair = cells[shift[a] + b] ^ owner[a]
        if pair >= 1 << bpe.NO_PAIR:
            return None
        assert pair & 65535 == a
        return pair >> bpe.RANK

    for t, r in found.items():
        for cut in range(1, len(t)):
            if t[:cut] in found and t[cut:] in found:
                assert rank(found[t[:cut]], found[t[cut:]]) == r
    rng = random.Random(3)
    for _ in range(100_000):
        a, b = rng.choice((rng.randrange(256), rng.randrange(end))), rng.randrange(end)
        assert rank(a, b) == found.get(tokens[a] + tokens[b])
    assert all(rank(a, end) is None and rank(end, a) is None for a in range(end + 1))


def test_a_step_takes_the_place_from_the_least_pair(spark, plain):
    # interpreted, array_position leaves its loop by an exception: it took most of the CPU seconds
    df = spark.createDataFrame([("x",)], "word string")
    found = bpe.ranks(RANKS)
    words = ["a" * 256, "ab" * 128, "n" * 255, "ñ" * 128, "unaccountablything", "zqxthere", "aab" * 85, "qz"]
    rng = random.Random(4)
    words += ["".join(rng.choice("abethin") for _ in range(rng.randint(2, 256))) for _ in range(40)]
    starts = [[found[bytes([b])] for b in w.encode()] for w in words]
    folded = df.select(bpe.fold(bpe.F.from_json(bpe.F.lit(str(starts)), "array<array<int>>"), RANKS).alias("ids"))
    assert "array_position" not in str(bpe.fold(bpe.F.col("starts"), RANKS)._jc.toString())
    assert [list(ids) for ids in folded.first().ids] == [plain.encode_ordinary(w) for w in words]
