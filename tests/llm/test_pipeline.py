from collections import defaultdict

import numpy as np
import public_tokenizers
from test_near_copies import first_of_each
from test_packing import check
from tokenizers import Tokenizer

import corpus_pipeline as P
from storyloom.llm.queries import SITES

DIR = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").cache()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    columns = docs.columns
    kept = P.stage_language(spark, docs, DIR)
    assert kept.columns == columns and kept.count() == docs.count()  # every text of this table is in a known language
    good = P.stage_quality(spark, kept, DIR).cache()
    ids = {r.doc_id for r in good.collect()}
    assert good.columns == columns and {i for i, q in labels.items() if q == 1} <= ids
    assert sum(i in ids for i, q in labels.items() if q == 0) <= 0.1 * sum(q == 0 for q in labels.values())

    lines = P.stage_lines(spark, good, DIR).cache()
    rows = {r.doc_id: r for r in good.collect()}
    sites = defaultdict(set)
    for r in rows.values():
        for x in r.text.split("\n"):
            sites[x.strip(" ")].add(r.source)
    want = {i: "\n".join(x for x in r.text.split("\n") if not x.strip(" ") or len(sites[x.strip(" ")]) < SITES) for i, r in rows.items()}
    got = {r.doc_id: r for r in lines.collect()}
    assert lines.columns == columns and {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for i, r in got.items() if r.text != rows[i].text)

    near = P.stage_near_dedup(spark, lines, DIR).cache()
    assert near.columns == columns and sorted(r.doc_id for r in near.collect()) == first_of_each(want)

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    left = {r.doc_id: [*t.encode(r.text, add_special_tokens=False).ids, 1] for r in near.collect()}
    check(P.stage_packing(spark, near, DIR).collect(), left)

    whole = P.run(spark, DIR).select("doc_id", "start", "ids").collect()
    joined = defaultdict(list)
    for r in sorted(whole, key=lambda r: (r.doc_id, r.start)):
        joined[r.doc_id] += np.frombuffer(r.ids, "<u4").tolist()
    assert joined == left


def test_odd_rows_and_an_empty_table(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "Just some fine words in a row here.", "en", None, 35), (3, "Just some fine words in a row here.", "en", None, 35), (None, "More fine words.", None, "b", 16)]
    for name, some in (("odd", rows), ("empty", [])):
        spark.createDataFrame(some, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(3, 1)] if some else [], "doc_id long, quality int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        got = P.run(spark, f"{tmp_path}/{name}").collect()
        assert sorted((r.doc_id is None, r.doc_id) for r in got) == ([(False, 3), (True, None)] if some else [])


def test_clashing_columns_and_a_very_long_text(spark, tmp_path):
    """Columns of the operators' own names come through; a text of 1.5 MB is packed whole."""
    words = "the of and to in is that for it was with on as are this".split()
    long = " ".join(words[i * i % 13] + str(i % 977) for i in range(200_000))
    rows = [(i, " ".join(words[(i * 7 + k * k) % 15] for k in range(80)), "en", f"s{i}", 0) for i in range(30)] + [(99, long, "en", "s", 0)]
    extra = "*, 1 _row, 'x' node, 2 _h, 'y' bands, 'mine' _lines, 'z' h, 4 label, 'b' _bad, doc_id _removed, 'c' counts, 5 Counts_, 'd' `a.b`, 'p' _parts, 'q' _left, 7 _id, 8 _hash, 9 _text"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr(*extra.split(", ")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(30)] + [(99, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in P.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == spark.read.parquet(f"{tmp_path}/documents.parquet").columns
        for r in docs.collect():
            assert tuple(r)[5:] == (1, "x", 2, "y", "mine", "z", 4, "b", r.doc_id, "c", 5, "d", "p", "q", 7, 8, 9)
    assert {99} <= {r.doc_id for r in docs.select("doc_id").collect()}
    packed = [r for r in P.stage_packing(spark, docs, "").select("doc_id", "length", "doc_tokens").collect() if r.doc_id == 99]
    assert sum(r.length for r in packed) == packed[0].doc_tokens > 200_000
