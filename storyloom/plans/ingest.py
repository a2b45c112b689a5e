"""Queries on feed items as they come in: URLs, hashes, duplicates, texts, dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.functions import dates, hashing, text, url
from storyloom.operators import dedup, validate
from storyloom.plans.items import ITEMS, NOW, items, now, table
from storyloom.sources import feeds

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_TRACK = ", ".join(f"'{t}'" for t in url.TRACKING)
_NORMAL = f"""u AS (SELECT page_id, url, regexp_replace(trim(url), '#.*$', '') AS whole FROM pages),
    p AS (SELECT page_id, url, regexp_extract(whole, '^([^?]*)', 1) AS base, regexp_extract(whole, '\\?(.*)$', 1) AS query FROM u),
    k AS (SELECT page_id, url, base, unnest(string_split(query, '&')) AS part, generate_subscripts(string_split(query, '&'), 1) AS i FROM p),
    g AS (SELECT page_id, url, base, coalesce(string_agg(part, '&' ORDER BY string_split(part, '=')[1], i) FILTER (WHERE regexp_extract(part, '=(.*)$', 1) <> '' AND lower(string_split(part, '=')[1]) NOT IN ({_TRACK})), '') AS query FROM k GROUP BY ALL),
    n AS (SELECT page_id, url, CASE WHEN query = '' THEN base ELSE base || '?' || query END AS normal FROM g)"""


@query(f"WITH {_NORMAL} SELECT page_id, normal FROM n")
def url_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", url.normalize(F.col("url")).alias("normal"))


@query(f"WITH {_NORMAL} SELECT page_id, sha1(normal) AS url_sha1 FROM n")
def url_sha1(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", url.sha1(F.col("url")).alias("url_sha1"))


@query("SELECT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS domain, count(*) AS n FROM pages GROUP BY 1")
def domain_histogram(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").groupBy(url.domain(F.col("url")).alias("domain")).agg(F.count("*").alias("n"))


@query(f"""WITH {_NORMAL}, v AS (SELECT page_id AS item_id, normal FROM n UNION ALL SELECT page_id + 1000000000, normal FROM n)
    SELECT min(item_id) AS item_id, sha1(normal) AS url_sha1, count(*) AS copies FROM v GROUP BY normal""")
def exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Pages and copies of them with other tracking parameters: the first of each normalised URL, and how often it came."""
    p = table(spark, d, "pages")
    joint = F.when(F.contains("url", F.lit("?")), "&").otherwise("?")
    bare = F.regexp_replace("url", "#.*$", "")
    copies = p.select((F.col("page_id") + 1_000_000_000).alias("item_id"), F.concat(bare, joint, F.lit("utm_medium=mail&fbclid=1#part")).alias("url"))
    hashed = p.select(F.col("page_id").alias("item_id"), "url").union(copies).withColumn("url_sha1", url.sha1(F.col("url")))
    counts = hashed.groupBy("url_sha1").agg(F.count("*").alias("copies"), F.min("item_id").alias("item_id"))
    return counts.select("item_id", "url_sha1", "copies")


@query(f"""WITH {_NORMAL}, b AS (SELECT page_id, sha1(normal) AS h FROM n), s AS (SELECT h FROM b WHERE page_id % 3 = 0)
    SELECT min(page_id) AS item_id, h AS url_sha1 FROM b WHERE h NOT IN (SELECT h FROM s) GROUP BY h""")
def insert_if_new(spark: SparkSession, d: str) -> DataFrame:
    """Of the pages those whose hash isn't stored; stored are the pages whose number three divides."""
    b = table(spark, d, "pages").select(F.col("page_id").alias("item_id"), url.sha1(F.col("url")).alias("url_sha1"))
    return dedup.new_only(b, b.filter("item_id % 3 = 0"), "url_sha1", [F.col("item_id")])


_TOKENS = "list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]', ' ', 'g'), ' '), lambda x: x <> '')"
_BITS = " + ".join(f"(CASE WHEN 2 * sum((h >> {i}) & 1) > count(*) THEN 1::HUGEINT << {i} ELSE 0::HUGEINT END)" for i in range(64))
_SIMHASH = f"""t AS (SELECT doc_id, unnest({_TOKENS}) AS w FROM documents),
    m AS (SELECT doc_id, ('0x' || substr(md5(w), 17))::UBIGINT AS h FROM t),
    f AS (SELECT doc_id, ({_BITS})::UBIGINT AS h FROM m GROUP BY doc_id),
    hashes AS (SELECT d.doc_id, coalesce(f.h, 0::UBIGINT) AS h FROM documents d LEFT JOIN f USING (doc_id))"""


def _hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), hashing.simhash64(F.col("text")).alias("h"))


@query(f"WITH {_SIMHASH} SELECT doc_id AS item_id, lpad(lower(to_hex(h)), 16, '0') AS simhash FROM hashes")
def simhash(spark: SparkSession, d: str) -> DataFrame:
    return _hashes(spark, d).select("item_id", hashing.to_hex(F.col("h")).alias("simhash"))


@query(f"""WITH {_SIMHASH} SELECT DISTINCT lpad(lower(to_hex(h)), 16, '0') AS simhash FROM hashes JOIN events e ON e.event_id = doc_id WHERE e.ts >= {NOW} - INTERVAL 720 HOUR""")
def recent_simhashes(spark: SparkSession, d: str) -> DataFrame:
    seen = items(spark, d).filter(dates.recent(F.col("fetched_at"), now(), 720))
    return seen.select(hashing.to_hex(hashing.simhash64(F.col("content"))).alias("simhash")).distinct()


@query(f"""WITH {_SIMHASH}, u AS (SELECT h, min(doc_id) AS item_id, count(*) AS copies FROM hashes GROUP BY h)
    SELECT least(a.item_id, b.item_id) AS item_a, greatest(a.item_id, b.item_id) AS item_b, bit_count(xor(a.h, b.h))::INT AS distance FROM u a JOIN u b ON a.h < b.h AND bit_count(xor(a.h, b.h)) < 4""")
def near_dup_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Different fingerprints fewer than four bits apart, by the first item of each; ``simhash`` tells the members."""
    nodes = _hashes(spark, d).groupBy("h").agg(F.min("item_id").alias("item_id"))
    pairs = dedup.near_pairs(nodes.select("h"))
    named = pairs.join(nodes.toDF("a", "x"), "a").join(nodes.toDF("b", "y"), "b")
    return named.select(F.least("x", "y").alias("item_a"), F.greatest("x", "y").alias("item_b"), F.col("distance").cast("int").alias("distance"))


@query(f"""WITH {_SIMHASH}, s AS (SELECT list([{{'i': doc_id, 'h': h}}] ORDER BY doc_id) AS l FROM hashes),
    r AS (SELECT list_reduce(l, lambda a, b: CASE WHEN len(list_filter(a, lambda x: bit_count(xor(x.h, b[1].h)) < 4)) = 0 THEN list_concat(a, b) ELSE a END) AS kept FROM s)
    SELECT doc_id AS item_id, list_contains(list_transform((SELECT kept FROM r), lambda x: x.i), doc_id) AS kept FROM documents""")
def near_dup_filter(spark: SparkSession, d: str) -> DataFrame:
    """The scan by item_id that drops an item fewer than four bits from a kept one."""
    return dedup.near_filter(_hashes(spark, d)).select("item_id", "kept")


@query("""SELECT a.doc_id AS item_id, bit_count(xor(('0x' || substr(md5(a.text), 17))::UBIGINT, ('0x' || substr(md5(a.lang), 17))::UBIGINT))::DOUBLE AS distance FROM documents a""")
def hamming_hex(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("item_id"), hashing.hamming_hex(F.substring(F.md5("text"), 17, 16), F.substring(F.md5("lang"), 17, 16)).alias("distance"))


@query()
def html_clean(spark: SparkSession, d: str) -> DataFrame:
    """The text of every page."""
    return table(spark, d, "pages").select("page_id", text.html_to_text("html").alias("text"))


_RE_CLEAN = r"trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT page_id, {_RE_CLEAN} AS text FROM pages")
def html_strip(spark: SparkSession, d: str) -> DataFrame:
    """Tags cut by pattern, the plainer cleaning."""
    return table(spark, d, "pages").select("page_id", text.squeeze(text.strip_tags(F.col("html"))).alias("text"))


@query(r"SELECT doc_id, trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g')) AS text FROM documents")
def text_clean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.clean(F.col("text")).alias("text"))


_GUESS = ", ".join("{'n': len(list_filter(w, lambda x: x IN (" + ", ".join(f"'{x}'" for x in text.GUESS[k]) + f"))), 'l': '{k}'}}" for k in sorted(text.GUESS))


@query(rf"""WITH d AS (SELECT doc_id, length(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS n, string_split_regex(lower(regexp_replace(text, '[^\p{{L}}\s]', ' ', 'g')), '\s+') AS w FROM documents),
    b AS (SELECT doc_id, n, list_max([{_GUESS}]) AS best FROM d) SELECT doc_id, CASE WHEN n >= 20 AND best.n > 0 THEN best.l ELSE 'en' END AS lang FROM b""")
def detect_language(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", text.guess_language(F.col("text"), F.lit("en")).alias("lang"))


_FLAT_NFC = r"trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g'))"
_STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)


@query(rf"""WITH l AS (SELECT doc_id, list_filter(regexp_extract_all(lower({_FLAT_NFC}), '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-záéíóúñü]+') AND length(w) >= 3 AND w NOT IN ({_STOP})) AS l FROM documents),
    u AS (SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS p FROM l), c AS (SELECT doc_id, w, count(*) AS n, min(p) AS p FROM u GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p) AS rank FROM c)
    SELECT doc_id, w AS keyword, n, rank FROM r WHERE rank <= 10""")
def keywords_topn(spark: SparkSession, d: str) -> DataFrame:
    """The ten most frequent words of every text, whole, the first to come first among equals."""
    found = table(spark, d, "documents").select("doc_id", F.posexplode(text.top_words(text.keyword_tokens(text.clean(F.col("text"))), 10)).alias("p", "top"))
    return found.select("doc_id", F.col("top.word").alias("keyword"), F.col("top.n").alias("n"), (F.col("p") + 1).alias("rank"))


_TITLE = "string_split(text, chr(10))[1]"


@query(rf"""WITH a AS (SELECT doc_id, trim(regexp_replace(lower(replace(strip_accents({_TITLE}), 'ß', '')), '[^a-z0-9]+', '-', 'g'), '-') AS s, {_TITLE} AS t FROM documents),
    b AS (SELECT *, left(s, 80) AS h FROM a), c AS (SELECT *, CASE WHEN contains(h, '-') THEN 80 - strpos(reverse(h), '-') ELSE -1 END AS cut FROM b)
    SELECT doc_id, CASE WHEN t = '' THEN '' WHEN s = '' THEN 'articulo' WHEN length(s) <= 80 THEN s WHEN cut > 56 THEN left(h, cut) ELSE h END AS slug FROM c""")
def slugify(spark: SparkSession, d: str) -> DataFrame:
    title = F.get(F.split("text", "\n"), F.lit(0))
    return table(spark, d, "documents").select("doc_id", text.slugify(text.nfkd_ascii(title)).alias("slug"))


_FLAT = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query(rf"""WITH a AS (SELECT doc_id, {_FLAT} AS t FROM documents),
    b AS (SELECT *, length(regexp_extract(left(t, 160), '^(.*[.!?])', 1, 's')) AS e, list_filter(string_split(left(t, 180), ' '), lambda x: x <> '') AS w FROM a),
    c AS (SELECT *, array_to_string(w[1:len(w) - 1], ' ') AS j FROM b)
    SELECT doc_id, CASE WHEN length(t) <= 160 THEN t WHEN e - 1 > 96 THEN trim(left(t, e)) WHEN len(w) > 1 AND length(j) <= 160 THEN j || '...' ELSE trim(left(t, 157)) || '...' END AS excerpt FROM c""")
def excerpt(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.excerpt(text.squeeze(F.col("text"))).alias("excerpt"))


@query(rf"""WITH a AS (SELECT doc_id, {_FLAT} AS t FROM documents),
    b AS (SELECT *, string_split_regex(left(t, 147), '[.!?]') AS s, list_filter(string_split(left(t, 117), ' '), lambda x: x <> '') AS w FROM a),
    c AS (SELECT *, array_to_string(w[1:len(w) - 1], ' ') AS j FROM b)
    SELECT doc_id, CASE WHEN length(t) <= 100 THEN t WHEN len(s) > 1 AND length(s[1]) >= 97 * 0.7 THEN trim(s[1]) || '...' WHEN len(w) > 1 AND length(j) <= 97 THEN j || '...' ELSE trim(left(t, 97)) || '...' END AS clamped FROM c""")
def clamp_length(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.clamp_length(text.squeeze(F.col("text")), 20, 100).alias("clamped"))


@query("""WITH e AS (SELECT event_id, ts FROM events)
    SELECT event_id, event_id % 6 AS format, CASE event_id % 6 WHEN 5 THEN NULL WHEN 4 THEN epoch_us(date_trunc('day', ts)) ELSE epoch_us(date_trunc('second', ts)) END AS parsed FROM e""")
def date_parse(spark: SparkSession, d: str) -> DataFrame:
    """Times of events written in feeds' formats, one that isn't among them, and read again."""
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    styles = ["yyyy-MM-dd'T'HH:mm:ss'Z'", "EEE, d MMM yyyy HH:mm:ss '+0000'", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'+00:00'", "yyyy-MM-dd"]
    written = F.lit("no date")
    for i, s in enumerate(styles):
        written = F.when(F.col("event_id") % 6 == i, F.date_format("ts", s)).otherwise(written)
    return e.select("event_id", (F.col("event_id") % 6).alias("format"), dates.parse(written).alias("parsed"))


@query(f"""SELECT event_id, epoch_us({NOW} - to_hours(event_id % 50)) - epoch_us(TIMESTAMP '1970-01-01') AS parsed FROM events""")
def relative_dates(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.concat(F.col("event_id") % 50, F.lit(" hours ago")).alias("t"))
    return e.select("event_id", dates.micros(dates.parse_relative(F.col("t"), now())).alias("parsed"))


@query(f"SELECT event_id, round((epoch_us({NOW}) - epoch_us(ts)) / 3.6e9, 6) AS hours FROM events")
def age_hours(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", F.round(dates.age_hours(F.col("ts").cast("timestamp_ntz"), now()), 6).alias("hours"))


@query(f"SELECT trunc((epoch_us({NOW}) - epoch_us(ts)) / 3.6e9)::INT AS hour, count(*) AS n FROM events GROUP BY 1")
def hour_buckets(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy(dates.age_hours(F.col("ts").cast("timestamp_ntz"), now()).cast("int").alias("hour")).agg(F.count("*").alias("n"))


@query("""WITH h AS (SELECT doc_id, sha1(text) AS s FROM documents), b AS (SELECT doc_id, list_transform(range(20), lambda i: ('0x' || substr(s, 2 * i + 1, 2))::INT / 255.0) AS v FROM h),
    n AS (SELECT doc_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x)) * 19 + list_sum(list_transform(v[1:4], lambda x: x * x))) AS norm FROM b)
    SELECT doc_id, 384 AS size, round(v[1] / norm, 9) AS first, round(v[4] / norm, 9) AS last, round(v[20] / norm, 9) AS at_20, round(list_sum(list_transform(range(384), lambda i: v[i % 20 + 1] / norm * (i + 1))), 6) AS weighted FROM n""")
def hash_embedding(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "documents").select("doc_id", hashing.hash_embedding(F.col("text")).alias("v"))
    at = lambda i: F.round(F.get("v", F.lit(i)), 9)
    return e.select("doc_id", F.size("v").alias("size"), at(0).alias("first"), at(383).alias("last"), at(19).alias("at_20"), F.round(F.aggregate(F.transform("v", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x), 6).alias("weighted"))


@query(f"WITH {ITEMS} SELECT item_id, lang, epoch_us(fetched_at) AS fetched_us FROM items WHERE fetched_at >= {NOW} - INTERVAL 720 HOUR")
def recent_items(spark: SparkSession, d: str) -> DataFrame:
    found = items(spark, d).filter(dates.recent(F.col("fetched_at"), now(), 720))
    return found.select("item_id", "lang", dates.micros(F.col("fetched_at")).alias("fetched_us"))


@query(f"WITH {ITEMS} SELECT item_id, epoch_us(fetched_at) AS fetched_us FROM items WHERE fetched_at IS NOT NULL ORDER BY fetched_at DESC, item_id LIMIT 100")
def latest_items(spark: SparkSession, d: str) -> DataFrame:
    """The newest hundred, a top-k report."""
    found = items(spark, d).filter("fetched_at is not null").orderBy(F.desc("fetched_at"), "item_id").limit(100)
    return found.select("item_id", dates.micros(F.col("fetched_at")).alias("fetched_us"))


@query(f"""WITH {ITEMS} SELECT source_id, count(*) AS total, count(*) FILTER (WHERE fetched_at >= {NOW} - INTERVAL 720 HOUR) AS recent, epoch_us(max(fetched_at)) AS last_us FROM items GROUP BY 1""")
def source_stats(spark: SparkSession, d: str) -> DataFrame:
    stats = items(spark, d).groupBy("source_id").agg(F.count("*").alias("total"), F.count_if(dates.recent(F.col("fetched_at"), now(), 720)).alias("recent"), F.max("fetched_at").alias("_l"))
    return stats.select("source_id", "total", "recent", dates.micros(F.col("_l")).alias("last_us"))


@query(f"""WITH {_NORMAL}, {ITEMS} SELECT i.item_id, (coalesce(i.title, '') <> '' AND coalesce(i.url, '') <> '' AND i.published_at IS NOT NULL AND regexp_matches(i.url, '^https?://')) IS TRUE AS valid,
    (regexp_matches(coalesce(i.url, ''), '^https?://') AND coalesce(i.domain, '') <> '' AND NOT contains(i.domain, 'localhost')) AS safe FROM items i""")
def entry_validation(spark: SparkSession, d: str) -> DataFrame:
    x = items(spark, d).withColumn("url_sha1", url.sha1(F.col("url")))
    return x.select("item_id", F.coalesce(validate.valid_entry(), F.lit(False)).alias("valid"), url.safe(F.col("url")).alias("safe"))


@query("SELECT doc_id AS id, unnest([0, 1]) AS place, CASE unnest([0, 1]) WHEN 0 THEN trim(string_split(text, chr(10))[1]) ELSE 'second' END AS title, 'http://x.org/' || doc_id AS link FROM documents WHERE trim(string_split(text, chr(10))[1]) <> ''")
def feed_parse(spark: SparkSession, d: str) -> DataFrame:
    """Titles written into RSS and Atom bodies of two entries, and read again."""
    docs = table(spark, d, "documents").withColumn("t", F.trim(F.get(F.split("text", "\n"), F.lit(0)))).filter("t <> ''")
    safe = F.replace(F.replace(F.replace(F.col("t"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    link = F.concat(F.lit("http://x.org/"), "doc_id")
    rss = F.format_string("<rss><channel><title>c</title><item><title>%s</title><link>%s</link></item><item><title>second</title><link>%s</link></item></channel></rss>", safe, link, link)
    atom = F.format_string('<feed><title>c</title><entry><title>%s</title><link href="%s"/></entry><entry><title>second</title><link href="%s"/></entry></feed>', safe, link, link)
    bodies = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, rss).otherwise(atom).alias("body"))
    return feeds.entries(bodies, "doc_id", "body").select("id", "place", "title", "link")


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE (props->>'k')::INT END AS k FROM events")
def json_extract(spark: SparkSession, d: str) -> DataFrame:
    """A JSON object within other words; every seventh text has none."""
    e = table(spark, d, "events").select("event_id", F.concat(F.lit("Sure: "), F.when(F.col("event_id") % 7 != 0, F.col("props")).otherwise("none"), F.lit(" done")).alias("t"))
    return e.select("event_id", feeds.embedded_json(F.col("t"), "k int")["k"].alias("k"))
