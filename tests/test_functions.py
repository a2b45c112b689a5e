"""Scalar functions against their published values and plain Python."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from storyloom.functions import dates, hashing, text, url, vectors


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("https://news.test/story?utm_medium=mail&cid=9&nr=7#top", "https://news.test/story?nr=7"),
        ("https://news.test/list?z=1&m=2&b=3", "https://news.test/list?b=3&m=2&z=1"),
        ("https://news.test/story?mc_cid=q&GCLID=w&referrer=front", "https://news.test/story"),
        ("HTTPS://Example.com/A?x=&y=%20z&y=1", "https://Example.com/A?y=+z&y=1"),
        ("", ""),
        (None, ""),
    ],
)
def test_normalize_url(spark, given, want):
    assert one(spark, url.normalize(F.col("u")), u=given) == want


def test_sha1_and_domain_and_safety(spark):
    u = "https://news.test/story?utm_medium=mail&cid=9&nr=7#top"
    assert one(spark, url.sha1(F.col("u")), u=u) == hashlib.sha1(b"https://news.test/story?nr=7").hexdigest()
    assert one(spark, url.domain(F.col("u")), u="http://User@WWW.Example.com:80/x") == "user@www.example.com:80"
    assert [one(spark, url.safe(F.col("u")), u=x) for x in ("https://a.b/c", "ftp://a.b", "http://localhost:1/", None, "http:///x")] == [True, False, False, False, False]


# Fingerprints of short texts.
@pytest.mark.parametrize(("given", "want"), [("The quick brown fox jumps over the lazy dog", "2d826d2221ca8b1f"), ("a", "31c399e269772661"), ("123 456 789", "8c48a796a7330a72"), ("", "0" * 16), (None, "0" * 16)])
def test_simhash(spark, given, want):
    assert one(spark, hashing.to_hex(hashing.simhash64(F.col("t"))), t=given) == want


def test_simhash_of_other_sizes_and_distance(spark):
    # fixed values: fingerprints of one text
    assert f"{hashing.simhash_of('Sample text for bit size testing', 32):08x}" == "041a18e5"
    assert f"{hashing.simhash_of('Sample text for bit size testing', 128):032x}" == "d633698e1d1a85c22809b029041a18e5"
    pairs = [("f", "e", 1), ("ff", "00", 8), ("ffffffffffffffff", "0", 64), ("xyz", "0", float("inf"))]
    assert [one(spark, hashing.hamming_hex(F.col("a"), F.col("b")), a=a, b=b) for a, b, _ in pairs] == [w for *_, w in pairs]


def test_tokens_and_cleaning(spark):
    assert one(spark, text.tokens(F.col("t")), t="Salt_and-PEPPER") == ["salt", "and", "pepper"]
    assert one(spark, text.tokens(F.col("t")), t="  ünter 12% (off) ") == ["nter", "12", "off"]
    page = '<style>b{}</style><h1>Salt &lt; pepper</h1><script>var p = "<p>no</p>"</script>\n<p>and  more</p>'
    assert one(spark, text.html_to_text(F.col("t")), t=page) == "Salt < pepper and more"
    assert one(spark, text.clean(F.col("t")), t=" ﬁne \n １ ") == "fine 1"


def plain_slug(t, most=80):
    slug = re.sub("[^a-z0-9]+", "-", t.lower()).strip("-")
    if len(slug) > most:
        head = slug[:most]
        slug = head[: head.rfind("-")] if head.rfind("-") > most * 0.7 else head
    return slug or "articulo"


def test_slugs_and_excerpts_on_random_texts(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefgh     --.!?") for _ in range(rng.randint(1, 260))) for _ in range(150)] + ["x" * 200, "Año Nuevo"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = rows.select("i", text.slugify(text.nfkd_ascii(F.col("t"))).alias("s"), text.excerpt(text.squeeze(F.col("t")), 60).alias("e")).collect()
    for r in got:
        flat = " ".join(texts[r.i].split())
        assert r.s == plain_slug(texts[r.i].replace("ñ", "n"))
        assert r.e == flat if len(flat) <= 60 else len(r.e) <= 63 and flat.startswith(r.e.removesuffix("...").rstrip())


def test_dates(spark):
    want = 1704164645000000
    for t in ("2024-01-02T03:04:05Z", "Tue, 2 Jan 2024 03:04:05 +0000", "Tue, 2 Jan 2024 03:04:05 GMT", "2024-01-02 03:04:05", "2024-01-02T04:04:05+01:00", "01/02/2024 03:04:05"):
        assert one(spark, dates.parse(F.col("t")), t=t) == want, t
    assert one(spark, dates.parse(F.col("t")), t="soon") is None
    now = dates.literal("2024-01-10 12:00:00")
    for t, hours in (("3 hours ago", 3), ("2 days ago", 48), ("1 week ago", 168), ("yesterday", 24), ("today", 0), ("90 minutes ago", 1.5)):
        assert one(spark, dates.age_hours(dates.parse_relative(F.col("t"), now), now), t=t) == hours


def test_vectors_and_embedding(spark):
    row = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    r = row.select(vectors.cosine("a", "b").alias("c"), vectors.cosine("a", "z").alias("z"), vectors.unit(F.col("a")).alias("u")).first()
    assert abs(r.c - 0.96) < 1e-12 and r.z == 0.0 and r.u == [0.6, 0.8]
    v = one(spark, hashing.hash_embedding(F.col("t")), t="words")
    assert len(v) == 384 and abs(sum(x * x for x in v) - 1) < 1e-9 and v[:20] == v[20:40]
