from datetime import datetime

from pyspark.sql import functions as F

from storyloom.sources import feeds

RSS = "<rss><channel><title>c</title><item><title>A &amp; B</title><link>http://a/1</link><description>d</description><pubDate>Tue, 2 Jan 2024 03:04:05 GMT</pubDate></item></channel></rss>"
ATOM = '<feed><title>c</title><entry><title>T</title><link href="http://b/1"/><link href="http://b/2"/><summary>s</summary><updated>2024-01-02T03:04:05Z</updated></entry></feed>'


def test_entries(spark):
    bodies = spark.createDataFrame([(1, RSS), (2, ATOM), (3, ""), (4, None), (5, "<rss><chan")], "id int, body string")
    got = {r.id: (r.title, r.link, r.summary, r.published) for r in feeds.entries(bodies, "id", "body").collect()}
    assert got == {1: ("A & B", "http://a/1", "d", "Tue, 2 Jan 2024 03:04:05 GMT"), 2: ("T", "http://b/1", "s", "2024-01-02T03:04:05Z")}


def test_catalogues(spark, tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("sources:\n- {name: N, url: http://n}\n- {url: http://m, lang: es, active: false}\n- {name: no url}\ntopics:\n- {name: One, keywords: [a, b]}\n- {name: Two, queries: [x], enabled: false}\n")
    assert sorted(map(tuple, feeds.load_sources(spark, str(path)).collect())) == [("N", "rss", "http://n", "en", True), ("http://m", "rss", "http://m", "es", False)]
    topics = feeds.load_topics(str(path), use_keywords=True)
    assert [t.queries for t in topics] == [["a OR b"], ["x"]] and len(feeds.load_topics(str(path), enabled_only=True)) == 1
    assert feeds.find_topic(topics, "ONE").key == "one" and feeds.find_topic(topics, "three") is None


def test_headers_and_json(spark):
    row = spark.createDataFrame([(' "e" ', datetime(2030, 1, 1), 'x {"k": 1} y'), (None, None, "none")], "e string, m timestamp, t string")
    got = row.select(feeds.conditional_headers(F.col("e"), F.col("m"), F.lit(datetime(2024, 1, 2, 3, 4, 5))).alias("h"), feeds.embedded_json(F.col("t"), "k int")["k"].alias("k")).collect()
    assert got[0].h == {"If-None-Match": '"e"', "If-Modified-Since": "Tue, 02 Jan 2024 03:04:05 GMT"} and got[0].k == 1
    assert got[1].h == {} and got[1].k is None


def test_fetched_bodies_are_read_whole(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<rss><channel>\n<item><title>One</title><link>http://a.org/1</link></item>\n<item><title>Two</title></item></channel></rss>")
    (tmp_path / "b.xml").write_text("not a feed")
    bodies = feeds.read_bodies(spark, str(tmp_path))
    assert bodies.count() == 2
    assert sorted(r.title for r in feeds.entries(bodies, "id", "body").collect()) == ["One", "Two"]
