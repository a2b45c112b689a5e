import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from storyloom.llm import grams, language_id, quality, queries

CORPUS = "/root/testdata/sf0.01"


def held(ids, by):
    return [zlib.crc32(str(i).encode()) % by for i in ids]


def test_ngrams_do_not_depend_on_the_batch():
    texts = ["The cat  sat!!", "", "é É 12 ab", "x", "the the the", "a" * 50]
    padded = [f" {t} ".encode() for t in texts]
    for make, rows in ((lambda d, o: grams.word_ngrams(d, o, 18), [t.encode() for t in texts]), (lambda d, o: grams.letter_trigrams(d, o, 13), padded)):
        whole = [sorted(b.tolist()) for b in _by_doc(make, rows)]
        single = [sorted(_by_doc(make, [r])[0].tolist()) for r in rows]
        assert whole == single
    cut = pa.array([t.encode() for t in texts], pa.binary()).slice(2, 3)
    assert [d.tobytes() for _, _, d, _ in grams.chunks(cut)] == [b"".join(t.encode() for t in texts[2:5])]


def _by_doc(make, rows):
    out = []
    for lo, hi, data, doc in grams.chunks(pa.array(rows, pa.binary())):
        at, bucket = make(data, doc)
        out += [bucket[at == i] for i in range(hi - lo)]
    return out


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{CORPUS}/documents.parquet")
    truth = {r.doc_id: (r.lang, r.text) for r in docs.collect()}
    got = queries.op5_language_id(spark, CORPUS).collect()
    assert len(got) == len(truth)
    out = [r for r in got if r.held_out]
    assert {r.doc_id for r in out} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r.lang_pred == truth[r.doc_id][0] for r in out]) >= 0.97
    assert not any(r.rejected for r in got) and all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark):
    rng = random.Random(4)
    words = {"en": ["the", "house", "of", "with"], "de": ["und", "schön", "über", "nicht"]}
    train = [(i, " ".join(rng.choice(words[k]) for _ in range(80)), k) for i, k in enumerate(["en", "de"] * 40)] + [(900, None, "en"), (901, "who", None)]
    model = language_id.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"), per_language=30, clusters=2)
    assert model.languages == ["de", "en"] and len(model.owner) == 4
    rows = [(1, None), (2, ""), (3, "12 !!"), (4, "x"), (5, "the house " * 9000), (5, "the house " * 9000), (None, "nicht über"), (7, "漢字かな交じり文 " * 200)]
    got = language_id.predict(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 score", "'q' lang_pred"), model).collect()
    assert len(got) == 8
    by = {r.doc_id: r for r in got}
    assert [(by[i].lang_pred, by[i].score, by[i].rejected) for i in (1, 2, 3)] == [("und", 0.0, True)] * 3
    assert by[4].lang_pred in model.languages and not by[4].rejected
    assert by[5].lang_pred == "en" and by[None].lang_pred == "de" and by[7].rejected
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    nothing = language_id.fit(empty)
    assert language_id.predict(empty, model).count() == 0
    assert [r.lang_pred for r in language_id.predict(spark.createDataFrame(rows[3:4], "doc_id long, text string"), nothing).collect()] == ["und"]


def test_quality_held_out(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{CORPUS}/labels.parquet").collect()}
    got = queries.op7_quality(spark, CORPUS).collect()
    out = [r for r in got if r.held_out and r.doc_id in labels]
    assert len(got) == spark.read.parquet(f"{CORPUS}/documents.parquet").count() and len(out) > 40
    good = [r for r in out if labels[r.doc_id] == 1]
    bad = [r for r in out if labels[r.doc_id] == 0]
    assert np.mean([r.predicted == 1 for r in good]) >= 0.98 and np.mean([r.predicted == 0 for r in bad]) >= 0.8
    assert all(r.predicted == (r.score >= 0.3) for r in got)


def test_quality_edges(spark):
    docs = [(i, "a good plain text of words" if i % 2 else "BAD!! BAD!! &&& $$$") for i in range(60)] + [(None, "x"), (70, None), (71, ""), (72, "word " * 30000), (72, "word " * 30000)]
    labels = [(i, i % 2) for i in range(60)] + [(1, 1), (3, 0), (70, None), (None, 1), (500, 1)]
    docs = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 label", "2 h")
    model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"), rounds=5)
    by = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert by[5] > 0.7 > 0.3 > by[6] and by[70] == by[71] and len(by) == 64
    empty = spark.createDataFrame([], "doc_id long, text string")
    none = quality.fit(empty, spark.createDataFrame([], "doc_id long, quality int"))
    assert quality.score(empty, none).count() == 0 and none.bias == 0.0


def test_ftrl_against_plain_formula():
    m = quality.Ftrl(3)
    for at, v, y in (([0, 3], [1.0, 1.0], 1), ([0, 2, 3], [0.5, 2.0, 1.0], 0)):
        m.update(np.array(at), np.array(v), y)
    z, n = np.zeros(4), np.zeros(4)
    for at, v, y in (([0, 3], [1.0, 1.0], 1), ([0, 2, 3], [0.5, 2.0, 1.0], 0)):
        w = [0 if abs(z[i]) <= m.l1 else -(z[i] - np.sign(z[i]) * m.l1) / ((m.beta + n[i] ** 0.5) / m.alpha + m.l2) for i in at]
        p = 1 / (1 + np.exp(-sum(a * b for a, b in zip(w, v, strict=True))))
        for i, wi, vi in zip(at, w, v, strict=True):
            g = (p - y) * vi
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / m.alpha * wi
            n[i] += g * g
    assert np.allclose(m.z, z) and np.allclose(m.n, n)


def test_a_hundred_languages_are_all_learned(spark):
    """Each language is words of its own syllables; no language is left out, however many there are."""
    rng = random.Random(2)
    syllables = [a + b for a in "bcdfghjklmnpqrstvwxz" for b in "aeiou"]
    rows = []
    for k in range(100):
        own = [syllables[k], *rng.sample(syllables, 2)]
        for i in range(6):
            rows.append((k * 10 + i, " ".join("".join(rng.choice(own) for _ in range(rng.randint(2, 4))) for _ in range(60)), f"l{k:03d}"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = language_id.fit(df.filter("doc_id % 10 < 5"))
    assert model.languages == [f"l{k:03d}" for k in range(100)]
    got = {r.doc_id: r.lang_pred for r in language_id.predict(df.filter("doc_id % 10 = 5"), model).collect()}
    assert sum(got[i] == lang for i, _, lang in rows if i % 10 == 5) >= 90


def test_nearest_centroid_by_brute_force(spark):
    """Cosines of TF-IDF vectors, trigram by trigram, give the same language and score."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.fit(docs)
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    for r in docs.limit(40).collect():
        data = np.frombuffer(f" {r.text} ".encode(), np.uint8)
        _, bucket = grams.letter_trigrams(data, np.zeros(len(data), np.int64), language_id.BITS)
        weights = {b: np.log1p(n) * model.idf[b] for b, n in Counter(bucket.tolist()).items()}
        norm = sum(w * w for w in weights.values()) ** 0.5 or 1.0
        cosine = [sum(w * c[b] for b, w in weights.items()) / norm for c in model.centroids]
        best = int(np.argmax(cosine))
        assert abs(got[r.doc_id].score - cosine[best]) < 1e-4 and got[r.doc_id].lang_pred == model.languages[model.owner[best]]


def test_quality_scores_by_brute_force(spark):
    """Words and pairs counted one by one, their weights summed up, give the same score."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = quality.fit(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    for r in docs.limit(40).collect():
        data = np.frombuffer(r.text.encode(), np.uint8)
        _, bucket = grams.word_ngrams(data, np.zeros(len(data), np.int64), quality.BITS)
        share = {b: n / len(bucket) for b, n in Counter(bucket.tolist()).items()}
        z = model.bias + quality.SCALE * sum(float(model.weights[b]) * x for b, x in share.items())
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-z))) < 1e-6
