"""Trained profiles of languages: accuracy on texts that weren't learned, and a plain version."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from storyloom.functions import language, text
from storyloom.plans import runs


def plain_buckets(t):
    low = "".join(c if c.isalpha() else " " for c in (t or "").lower())
    x = f" {' '.join(low.split())} "
    return [(ord(a) * language.FIRST + ord(b) * language.SECOND + ord(c)) % language.BUCKETS for a, b, c in zip(x, x[1:], x[2:], strict=False)]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_titles_that_were_not_learned(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", F.col("lang").alias("truth"))
    found = runs.language_profiles(spark, f"/root/testdata/{sf}").join(docs, "doc_id").filter("held_out and truth is not null")
    right, n = found.agg(F.avg((F.col("lang") == F.col("truth")).cast("int")), F.count("*")).first()
    assert n >= 50 and right >= 0.97


def test_scores_by_a_plain_version(spark):
    rows = [("the sea and the rain", "en"), ("der Regen und die See", "de"), ("la pluie et la mer, l'été", "fr"), ("niño año", None), (None, "de"), ("", "en"), ("The RAIN\n12 rains", "en")]
    profiles = language.learn(spark.createDataFrame(rows, "text string, lang string"))
    counts = defaultdict(Counter)
    for t, k in rows:
        if k:
            counts[k].update(plain_buckets(t))
    assert profiles.langs == ["de", "en", "fr"]
    weight = {k: {b: math.log((counts[k][b] + language.SMOOTH) / (sum(counts[k].values()) + language.SMOOTH * language.BUCKETS)) for b in range(language.BUCKETS)} for k in counts}
    asked = ["rain", "die See", "été", "x", "", None, "12 34", "la mer und the sea"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "i int, t string").select("i", profiles.scores(F.col("t")).alias("s"), profiles.guess(F.col("t"), F.lit("none")).alias("g")).collect()
    for r in got:
        b = plain_buckets(asked[r.i])
        want = {k: sum(weight[k][x] for x in b) for k in weight}
        assert {x.lang: round(x.score, 9) for x in r.s} == {k: round(v, 9) for k, v in want.items()}
        letters = sum(c.isalpha() for c in asked[r.i] or "")
        assert r.g == ("none" if letters < 3 else min(want, key=lambda k: (-want[k], k)))


def test_no_rows_to_learn_from_and_the_entries_guards(spark):
    none = language.learn(spark.createDataFrame([("a", None)], "text string, lang string"))
    one = language.learn(spark.createDataFrame([("the rain", "en")], "text string, lang string"))
    rows = spark.createDataFrame([("short", None), ("a title of some length", "and more"), (None, None)], "t string, s string")
    for profiles, want in ((none, ["xx", "xx", "xx"]), (one, ["xx", "en", "xx"])):
        assert [r.k for r in rows.select(text.detect_language(F.col("t"), F.col("s"), F.lit("xx"), profiles).alias("k")).collect()] == want
