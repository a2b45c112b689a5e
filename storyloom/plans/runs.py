"""Queries on whole runs: ingest against what is stored, updates of stored rows, clustering, topic runs, statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.functions import dates, hashing, language, text, url
from storyloom.operators import cluster, ingest, score, select, stores, topics
from storyloom.plans.ingest import _NORMAL
from storyloom.plans import scoring
from storyloom.plans.items import ITEMS, NOW, items, now, table
from storyloom.plans.scoring import FIVE, TAU, TOTAL, _rounded, history, metrics
from storyloom.plans.selection import PICKS, TOPIC_HITS, TOPICS, _topic_table, mapped
from storyloom.sources import fetched
from storyloom.sources.shared import cut, shared_dir
from storyloom.streaming import near, state
from storyloom.streaming.arrivals import in_parts

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- ingest: every tenth document is stored already, the others come in by number

_BITS = " + ".join(f"(CASE WHEN 2 * sum((h >> {i}) & 1) > count(*) THEN 1::HUGEINT << {i} ELSE 0::HUGEINT END)" for i in range(64))


def _hashed(text_sql: str, name: str = "hashes") -> str:
    return f"""t0 AS (SELECT doc_id, unnest(list_filter(string_split(regexp_replace(lower({text_sql}), '[^a-z0-9]', ' ', 'g'), ' '), lambda x: x <> '')) AS w FROM documents),
    m0 AS (SELECT doc_id, ('0x' || substr(md5(w), 17))::UBIGINT AS h FROM t0), f0 AS (SELECT doc_id, ({_BITS})::UBIGINT AS h FROM m0 GROUP BY doc_id),
    {name} AS (SELECT d.doc_id, coalesce(f0.h, 0::UBIGINT) AS h FROM documents d LEFT JOIN f0 USING (doc_id))"""


_BOTH = "string_split(text, chr(10))[1] || ' ' || text"
_NEAR = "bit_count(xor({}, {})) < 4"
RUN = f"""{_hashed(_BOTH)}, e AS (SELECT h.doc_id, h.h, coalesce(p.url, 'http://x.org/' || (h.doc_id % 700)) AS u, h.doc_id % 10 = 0 AS old FROM hashes h LEFT JOIN pages p ON p.page_id = h.doc_id),
    mark AS (SELECT *, EXISTS (SELECT 1 FROM e s WHERE s.old AND {_NEAR.format('s.h', 'e.h')}) AS near, u IN (SELECT u FROM e s WHERE s.old) AS known FROM e WHERE NOT old),
    l AS (SELECT list([{{'i': doc_id, 'h': h, 'u': u}}] ORDER BY doc_id) AS l FROM mark WHERE NOT near AND NOT known),
    k AS (SELECT list_reduce(l, lambda a, b: CASE WHEN len(list_filter(a, lambda x: {_NEAR.format('x.h', 'b[1].h')} OR x.u = b[1].u)) = 0 THEN list_concat(a, b) ELSE a END) AS kept FROM l),
    kept AS (SELECT unnest(kept) AS s FROM k),
    outcomes AS (SELECT doc_id AS item_id, CASE WHEN near THEN 'filtered' WHEN EXISTS (SELECT 1 FROM kept WHERE s.i = doc_id) THEN 'inserted'
        WHEN EXISTS (SELECT 1 FROM kept WHERE s.i < doc_id AND {_NEAR.format('s.h', 'mark.h')}) THEN 'filtered' ELSE 'duplicated' END AS outcome FROM mark)"""


def _entries(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("_t", F.get(F.split("text", "\n"), F.lit(0)))
    pages = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), "url")
    address = F.coalesce("url", F.concat(F.lit("http://x.org/"), F.col("doc_id") % 700))
    return docs.join(pages, "doc_id", "left").select(F.col("doc_id").alias("item_id"), F.col("doc_id").alias("rank"), hashing.simhash64(text.simhash_text(F.col("_t"), F.col("text"))).alias("h"), address.alias("url_sha1"))


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    rows = cut(_entries(spark, d), "entries")
    old = rows.filter("item_id % 10 = 0")
    return ingest.run(rows.filter("item_id % 10 <> 0"), old, old)


@query(f"WITH {RUN} SELECT item_id, outcome FROM outcomes")
def ingest_run(spark: SparkSession, d: str) -> DataFrame:
    """The outcome of every entry that comes in: near a stored or inserted text, a known URL, or inserted."""
    return _outcomes(spark, d)


@query(f"WITH {RUN} SELECT count(*) AS items_total, count(*) FILTER (WHERE outcome = 'inserted') AS items_inserted, count(*) FILTER (WHERE outcome = 'duplicated') AS items_duplicated, count(*) FILTER (WHERE outcome = 'filtered') AS items_simhash_filtered FROM outcomes")
def ingest_counters(spark: SparkSession, d: str) -> DataFrame:
    """The counters of a run, observed while its outcomes are written."""
    return ingest.written_outcomes(_outcomes(spark, d))[1]


@query(f"WITH {RUN} SELECT doc_id AS item_id, near FROM mark")
def near_dup_window(spark: SparkSession, d: str) -> DataFrame:
    """Which entries are near a stored text of the window."""
    rows = cut(_entries(spark, d), "entries")
    new, old = rows.filter("item_id % 10 <> 0"), rows.filter("item_id % 10 = 0")
    hits = ingest.near_stored(new.select("h").distinct(), old).withColumn("near", F.lit(True))
    return new.join(hits, "h", "left").select("item_id", F.coalesce("near", F.lit(False)).alias("near"))


_STRETCHES = f"""{_hashed(_BOTH)}, e AS (SELECT h.doc_id, h.h, coalesce(p.url, 'http://x.org/' || (h.doc_id % 700)) AS u, ev.ts, epoch_us(ev.ts) // 64800000000 AS b FROM hashes h JOIN events ev ON ev.event_id = h.doc_id LEFT JOIN pages p ON p.page_id = h.doc_id),
    n AS (SELECT b, max(max(ts)) OVER (ORDER BY b) AS now FROM e GROUP BY b),
    l AS (SELECT list([{{'i': doc_id, 'h': h, 'u': u, 'b': e.b, 'ts': ts, 'now': now}}] ORDER BY e.b, doc_id) AS l FROM e JOIN n ON n.b = e.b),
    k AS (SELECT list_reduce(l, lambda a, y: CASE WHEN len(list_filter(a, lambda x: ({_NEAR.format('x.h', 'y[1].h')} AND (x.b = y[1].b OR x.ts >= y[1].now - INTERVAL 24 HOUR)) OR (x.u = y[1].u AND (x.b = y[1].b OR x.ts >= y[1].now - INTERVAL 30 DAY)))) = 0 THEN list_concat(a, y) ELSE a END) AS kept FROM l),
    kept AS (SELECT s.i, s.h, s.b, s.ts FROM (SELECT unnest(kept) AS s FROM k))"""


@query(f"""WITH {_STRETCHES} SELECT e.doc_id AS item_id, CASE WHEN EXISTS (SELECT 1 FROM kept WHERE kept.i = e.doc_id) THEN 'inserted'
    WHEN EXISTS (SELECT 1 FROM kept WHERE {_NEAR.format('kept.h', 'e.h')} AND ((kept.b = e.b AND kept.i < e.doc_id) OR (kept.b < e.b AND kept.ts >= n.now - INTERVAL 24 HOUR))) THEN 'filtered' ELSE 'duplicated' END AS outcome FROM e JOIN n ON n.b = e.b""")
def stream_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Documents that arrive in stretches of 18 hours, each batch against what the earlier ones inserted within 24 hours."""
    return near.drain_near(spark, d)


# ---- states of streams


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/storyloom/{name}-{uuid.uuid4().hex}"


@query("""WITH h AS (SELECT user_id % 50 AS cluster_id, date_trunc('day', ts) AS run_ts, count(*) AS n FROM events GROUP BY ALL),
    w AS (SELECT *, count(*) OVER p AS k, avg(n) OVER p AS mean, stddev_pop(n) OVER p AS sd, least(30, row_number() OVER (PARTITION BY cluster_id ORDER BY run_ts)) AS remembered FROM h
        WINDOW p AS (PARTITION BY cluster_id ORDER BY run_ts ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
    SELECT cluster_id, epoch_us(run_ts) AS run_us, n, round(CASE WHEN k < 7 THEN CASE WHEN n >= 2 THEN 1.0 ELSE 0.0 END ELSE 1 / (1 + exp(-(n - mean) / CASE WHEN sd = 0 THEN 1 ELSE sd END)) END, 6) AS trend, remembered FROM w""")
def stream_history(spark: SparkSession, d: str) -> DataFrame:
    """Daily counts that arrive in three parts: the trend of each against what the stream remembers."""
    at = _place(spark, "history")
    third = F.floor((F.dayofmonth("run_ts") - 1) / 11)
    for stream in in_parts(history(spark, d).withColumn("part", third), "part", f"{at}/in"):
        found = state.drain(state.trends(stream), at)
    return found.select("cluster_id", "run_us", "n", F.round("trend", 6).alias("trend"), "remembered")


_RUNS = "r AS (SELECT user_id % 50 || '.' || event_type AS topic_key, epoch_us(ts) // 1000 AS run_ms, 60 * (1 + user_id % 50) AS cadence, user_id % 2 = 0 AS enabled FROM events)"


@query(f"""WITH {_RUNS}, n AS (SELECT *, lead(run_ms) OVER (PARTITION BY topic_key ORDER BY run_ms) AS next_ms, max(run_ms) OVER () AS now_ms FROM r)
    SELECT topic_key, run_ms, run_ms + cadence * 60000 AS due_ms FROM n WHERE enabled AND run_ms + cadence * 60000 <= coalesce(next_ms, now_ms)""")
def stream_cadence(spark: SparkSession, d: str) -> DataFrame:
    """Events as runs of their user's and type's topic: every time at which a topic fell due before it ran again."""
    at = _place(spark, "cadence")
    e = table(spark, d, "events").select(F.concat_ws(".", F.col("user_id") % 50, "event_type").alias("topic_key"), F.col("ts").cast("timestamp_ntz").alias("ts"), (60 * (1 + F.col("user_id") % 50)).alias("cadence_minutes"), (F.col("user_id") % 2 == 0).alias("enabled"))
    for stream in in_parts(e.withColumn("part", F.floor((F.dayofmonth("ts") - 1) / 11)), "part", f"{at}/in"):
        found = state.drain(state.due_times(stream), at)
    return found


@query(scoring.LEADERS)
def stream_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Vectors that arrive in four parts, each against the clusters that the parts before it left: those of one run."""
    at = _place(spark, "clusters")
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), F.col("vec_id").alias("rank"), (now() + F.make_dt_interval(secs=F.col("vec_id"))).alias("ts"))
    n = e.agg(F.max("id")).first()[0] or 0
    for stream in in_parts(e.withColumn("part", F.floor(4 * F.col("id") / (n + 1))), "part", f"{at}/in"):
        found = state.cluster_stream(stream, at, 0.3, hours=10**6)
    return found.select("id", "leader", F.round("similarity", 6).alias("similarity"))


_LETTERS = r"' ' || trim(regexp_replace(lower(coalesce(string_split(text, chr(10))[1], '')), '[^\p{L}]+', ' ', 'g')) || ' '"
_HELD = "(doc_id * 7919) % 1000 < 300"


@query(f"""WITH t AS (SELECT doc_id, lang, list_transform(string_split({_LETTERS}, ''), lambda c: unicode(c)) AS c FROM documents),
    g AS (SELECT doc_id, lang, list_transform(range(1, greatest(1, len(c) - 1)), lambda i: (c[i] * 7919 + c[i + 1] * 131 + c[i + 2]) % 4099) AS b, len(list_filter(c, lambda x: x <> 32)) AS letters FROM t),
    u AS (SELECT doc_id, lang, unnest(b) AS b FROM g), n AS (SELECT lang, b, count(*) AS n FROM u WHERE lang IS NOT NULL AND NOT ({_HELD}) GROUP BY ALL),
    l AS (SELECT lang, sum(n) + 4099 * 0.5 AS total FROM n GROUP BY 1),
    s AS (SELECT u.doc_id, l.lang, sum(ln((coalesce(n.n, 0) + 0.5) / l.total)) AS score FROM u CROSS JOIN l LEFT JOIN n ON n.lang = l.lang AND n.b = u.b GROUP BY ALL),
    r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 6) DESC, lang) AS k FROM s)
    SELECT g.doc_id, CASE WHEN g.letters < 3 THEN 'und' ELSE r.lang END AS lang, {_HELD.replace('doc_id', 'g.doc_id')} AS held_out FROM g LEFT JOIN r ON r.doc_id = g.doc_id AND r.k = 1""")
def language_profiles(spark: SparkSession, d: str) -> DataFrame:
    """The language of every title by profiles learned from seven tenths of them."""
    docs = table(spark, d, "documents").select("doc_id", "lang", F.get(F.split("text", "\n"), F.lit(0)).alias("title"))
    held = (F.col("doc_id") * 7919) % 1000 < 300
    profiles = language.learn(docs.filter(~held), "title")
    return docs.select("doc_id", profiles.guess(F.col("title"), F.lit("und")).alias("lang"), held.alias("held_out"))


_FETCHED = "r AS (SELECT event_id, user_id % 50 AS source_id, CASE event_id % 5 WHEN 0 THEN 304 WHEN 1 THEN 503 ELSE 200 END AS status, CASE WHEN event_id % 7 <> 0 THEN 'e' || (event_id // 400) END AS etag FROM events)"


@query(f"""WITH {_FETCHED}, k AS (SELECT *, last_value(CASE WHEN status = 200 THEN etag END IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM r)
    SELECT event_id, source_id, coalesce(etag, known) AS etag FROM k WHERE status = 200 AND (etag IS NULL OR known IS NULL OR etag <> known)""")
def stream_feeds(spark: SparkSession, d: str) -> DataFrame:
    """Events as responses to conditional fetches, in two parts with a restart between: those that bring a new body."""
    at = _place(spark, "feeds")
    k = F.col("event_id")
    e = table(spark, d, "events").select(k, (F.col("user_id") % 50).alias("source_id"), F.when(k % 5 == 0, 304).when(k % 5 == 1, 503).otherwise(200).alias("status"), F.when(k % 7 != 0, F.concat(F.lit("e"), F.floor(k / 400))).alias("etag"), F.concat(F.lit("body/"), k).alias("body_path"))
    half = F.lit((e.agg(F.max("event_id")).first()[0] or 0) // 2)
    for n, part in enumerate((k <= half, k > half)):
        e.filter(part).repartitionByRange(4, "event_id").sortWithinPartitions("event_id").drop("event_id").write.json(f"{at}/in/{n}")
        running = fetched.read_stream(spark, f"{at}/in").writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
        running.awaitTermination()
    found = spark.read.schema(fetched.SCHEMA).parquet(f"{at}/out")
    return found.select(F.substring_index("body_path", "/", -1).cast("long").alias("event_id"), "source_id", "etag")


_STYLES = ["%Y-%m-%dT%H:%M:%SZ", "%Y-%m-%d %H:%M:%S"]


@query(f"""WITH {_NORMAL}, x AS (SELECT d.doc_id, trim(regexp_replace(string_split(text, chr(10))[1], '\\s+', ' ', 'g')) AS title, trim(regexp_replace(CASE WHEN d.doc_id % 3 = 0 THEN 'first part ' || d.doc_id ELSE text END, '\\s+', ' ', 'g')) AS summary, coalesce(p.url, '') AS url, e.ts, coalesce(n.normal, '') AS normal
        FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id LEFT JOIN n ON n.page_id = d.doc_id LEFT JOIN events e ON e.event_id = d.doc_id)
    SELECT doc_id AS entry_id, title, length(summary) AS n, url, CASE WHEN doc_id % 5 IN (3, 4) OR ts IS NULL THEN epoch_us({NOW}) ELSE epoch_us(date_trunc('second', ts)) END AS published_us, CASE WHEN url = '' THEN '' ELSE sha1(normal) END AS url_sha1, title <> '' AND url <> '' AND regexp_matches(url, '^https?://') AS valid FROM x""")
def entry_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Entries with a date under one of four names, or none, or one that can't be read; content, or else a summary."""
    docs = table(spark, d, "documents")
    e = table(spark, d, "events").select(F.col("event_id").alias("doc_id"), F.col("ts").cast("timestamp_ntz").alias("ts"))
    p = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("link"))
    k = F.col("doc_id") % 5
    iso, plain = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    part = F.array(F.struct(F.concat(F.lit("first part "), "doc_id").alias("value")))
    rows = docs.join(e, "doc_id", "left").join(p, "doc_id", "left").select(
        F.col("doc_id").alias("entry_id"),
        F.get(F.split("text", "\n"), F.lit(0)).alias("title"),
        "link",
        F.when(F.col("doc_id") % 3 == 0, part).alias("content"),
        F.col("text").alias("summary"),
        F.when(k == 0, iso).alias("published"),
        F.when(k == 1, plain).alias("updated"),
        F.when(k == 2, iso).alias("pubDate"),
        F.when(k == 3, "no date").alias("created"),
    )
    found = ingest.normalise(rows, now())
    return found.select("entry_id", "title", F.length("summary").alias("n"), "url", dates.micros(F.col("published_at")).alias("published_us"), "url_sha1", "valid")


_FETCH = "f AS (SELECT user_id AS source_id, CASE user_id % 4 WHEN 0 THEN 304 WHEN 1 THEN 200 WHEN 2 THEN 503 ELSE 200 END AS status, CASE WHEN user_id % 8 = 1 THEN NULL ELSE 'e' || user_id END AS etag FROM (SELECT DISTINCT user_id FROM events))"


def _fetches(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "events").select("user_id").distinct()
    k = F.col("user_id") % 4
    return users.select(F.col("user_id").alias("source_id"), F.when(k == 0, 304).when(k == 2, 503).otherwise(200).alias("status"), F.when(F.col("user_id") % 8 != 1, F.concat(F.lit("e"), "user_id")).alias("etag"), F.lit(None).cast("timestamp_ntz").alias("last_modified"))


@query(f"""WITH {_FETCH}, s AS (SELECT c_custkey AS id, 'old' AS etag, c_custkey % 3 AS error_count FROM customer)
    SELECT id, CASE WHEN status = 200 THEN coalesce(f.etag, s.etag) ELSE s.etag END AS etag, (CASE WHEN status IN (200, 304) THEN 0 WHEN status IS NULL THEN error_count ELSE error_count + 1 END)::INT AS error_count, status IS NOT NULL AS checked FROM s LEFT JOIN f ON f.source_id = s.id""")
def source_updates(spark: SparkSession, d: str) -> DataFrame:
    """Sources after their fetches: new headers, errors reset or counted."""
    stamp = F.lit(None).cast("timestamp_ntz")
    sources = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("old").alias("etag"), stamp.alias("last_modified"), (F.col("c_custkey") % 3).cast("int").alias("error_count"), stamp.alias("last_checked_at"))
    after = ingest.checked_sources(sources, _fetches(spark, d), now())
    return after.select("id", "etag", "error_count", F.col("last_checked_at").isNotNull().alias("checked"))


@query(f"WITH {_FETCH}, c AS (SELECT count(*) FILTER (WHERE status = 200) AS sources_ok, count(*) FILTER (WHERE status = 304) AS sources_not_modified, count(*) FILTER (WHERE status NOT IN (200, 304)) AS sources_error FROM f) SELECT *, CASE WHEN sources_ok = 0 AND sources_error > 0 THEN 'error' WHEN sources_error > 0 THEN 'partial_success' ELSE 'success' END AS status FROM c")
def run_status(spark: SparkSession, d: str) -> DataFrame:
    return ingest.run_status(_fetches(spark, d))


@query("""WITH f AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 429 WHEN 2 THEN 500 WHEN 3 THEN 404 ELSE 200 END AS status, 1 + event_id % 5 AS attempt, CASE WHEN event_id % 3 = 0 THEN event_id % 100 END AS after FROM events)
    SELECT event_id, status IN (0, 429, 500) AND attempt < 4 AS again, coalesce(least(after, 60)::DOUBLE, least(4.0, greatest(0.5, 0.5 * pow(2, attempt - 1)))) AS seconds FROM f""")
def fetch_retry(spark: SparkSession, d: str) -> DataFrame:
    """Whether a fetch is tried again, and after how long."""
    k = F.col("event_id") % 5
    rows = table(spark, d, "events").select("event_id", F.when(k == 0, 0).when(k == 1, 429).when(k == 2, 500).when(k == 3, 404).otherwise(200).alias("status"), (1 + k).alias("attempt"), F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 100).cast("string")).alias("after"))
    return rows.select("event_id", ingest.should_retry(F.col("status"), F.col("attempt")).alias("again"), ingest.retry_seconds(F.col("attempt"), F.col("after")).alias("seconds"))


@query(f"""SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN 'tag' || event_id END AS etag, CASE WHEN event_id % 3 <> 0 THEN epoch_us(least(date_trunc('second', ts) + INTERVAL 10 DAY, {NOW})) END AS modified_us FROM events""")
def response_headers(spark: SparkSession, d: str) -> DataFrame:
    """Headers of responses: tags trimmed, dates in the future cut to now."""
    e = table(spark, d, "events").withColumn("_t", F.col("ts").cast("timestamp_ntz") + F.expr("interval 10 days"))
    headers = F.create_map(F.lit("etag"), F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("  tag"), "event_id", F.lit(" "))).otherwise(" "), F.lit("last-modified"), F.when(F.col("event_id") % 3 != 0, F.date_format("_t", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")))
    found = e.select("event_id", ingest.response_headers(headers, now()).alias("r"))
    return found.select("event_id", "r.etag", dates.micros(F.col("r.last_modified")).alias("modified_us"))


@query(f"WITH {ITEMS}, r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY published_at DESC NULLS LAST, item_id) AS k FROM items) SELECT item_id, source_id FROM r WHERE k <= 5")
def source_cap(spark: SparkSession, d: str) -> DataFrame:
    """At most five posts of each source."""
    return ingest.capped_per_source(items(spark, d), 5).select("item_id", "source_id")


# ---- updates of stored rows


@query("""WITH b AS (SELECT page_id AS item_id, url AS url_sha1 FROM pages UNION ALL SELECT page_id + 100000, url FROM pages), s AS (SELECT url FROM pages WHERE page_id % 4 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY url_sha1 ORDER BY item_id) AS k FROM b) SELECT item_id, k = 1 AND url_sha1 NOT IN (SELECT url FROM s) AS created FROM r""")
def insert_batch(spark: SparkSession, d: str) -> DataFrame:
    """A batch with repeats: which rows are created."""
    p = table(spark, d, "pages").select(F.col("page_id").alias("item_id"), F.col("url").alias("url_sha1"))
    batch = p.union(p.select(F.col("item_id") + 100000, "url_sha1"))
    return stores.insert_batch(batch, p.filter("item_id % 4 = 0"), [F.col("item_id")]).select("item_id", "created")


@query(f"""WITH {ITEMS}, {{}} SELECT 1""".replace(", {}", "").replace("SELECT 1", f"""SELECT c.cluster_id, CASE WHEN c.cluster_id % 5 = 0 THEN NULL ELSE round(s.score, 6) END AS score_total, c.items_count, CASE WHEN s.cluster_id IS NULL THEN NULL ELSE epoch_us({NOW}) END AS updated_us
    FROM (SELECT cluster_id, count(*) AS items_count FROM items GROUP BY 1) c LEFT JOIN (SELECT cluster_id, avg(length(text)) AS score FROM items JOIN documents ON doc_id = item_id WHERE cluster_id % 2 = 0 OR cluster_id % 5 > 0 GROUP BY 1) s USING (cluster_id)"""))
def cluster_scores_update(spark: SparkSession, d: str) -> DataFrame:
    """Scores written to their clusters: a score that is null keeps the old one."""
    x = items(spark, d)
    stamp = F.lit(None).cast("timestamp_ntz")
    stored = x.groupBy("cluster_id").agg(F.count("*").alias("items_count")).withColumns({"score_total": F.lit(None).cast("double"), "updated_at": stamp, "last_scored_at": stamp})
    new = x.filter("cluster_id % 2 = 0 or cluster_id % 5 > 0").groupBy("cluster_id").agg(F.when(F.col("cluster_id") % 5 != 0, F.avg(F.length("content"))).alias("score_total"))
    after = stores.set_scores(stored, new, now())
    return after.select("cluster_id", F.round("score_total", 6).alias("score_total"), "items_count", dates.micros(F.col("updated_at")).alias("updated_us"))


@query(f"SELECT vec_id AS cluster_id, round(CASE WHEN vec_id % 3 = 0 THEN -embedding[1] ELSE embedding[1] END, 6) AS first, CASE WHEN vec_id % 3 = 0 THEN epoch_us({NOW}) END AS updated_us FROM embeddings")
def centroid_update(spark: SparkSession, d: str) -> DataFrame:
    """Every third centroid is replaced."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("cluster_id"), F.col("embedding").alias("centroid"))
    new = e.filter("cluster_id % 3 = 0").select("cluster_id", F.transform("centroid", lambda x: -x).alias("centroid"))
    after = stores.set_centroids(e.withColumn("updated_at", F.lit(None).cast("timestamp_ntz")), new, now())
    return after.select("cluster_id", F.round(F.get("centroid", F.lit(0)), 6).alias("first"), dates.micros(F.col("updated_at")).alias("updated_us"))


@query(f"SELECT event_type AS topic_key, CASE WHEN event_type IN (SELECT event_type FROM events WHERE event_id % 7 = 0 AND value > 0) THEN epoch_us({NOW}) ELSE max(epoch_us(ts)) END AS last_us FROM events GROUP BY 1")
def topic_marks(spark: SparkSession, d: str) -> DataFrame:
    """The topics that ran are marked."""
    e = table(spark, d, "events")
    stored = e.groupBy(F.col("event_type").alias("topic_key")).agg(F.max("ts").cast("timestamp_ntz").alias("last_run"))
    ran = e.filter("event_id % 7 = 0 and value > 0").select(F.col("event_type").alias("topic_key")).distinct()
    return stores.mark_runs(stored, ran, now()).select("topic_key", dates.micros(F.col("last_run")).alias("last_us"))


@query(f"""WITH h AS (SELECT user_id % 50 AS cluster_id, date_trunc('day', ts) AS run_ts, count(*) AS n FROM events GROUP BY ALL), c AS (SELECT cluster_id, {NOW} AS run_ts, sum(n)::BIGINT AS n FROM h GROUP BY 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY run_ts DESC) AS k FROM (SELECT * FROM h UNION ALL SELECT * FROM c) WHERE run_ts >= {NOW} - INTERVAL 30 DAY) SELECT cluster_id, epoch_us(run_ts) AS run_us, n FROM r WHERE k <= 30""")
def history_append(spark: SparkSession, d: str) -> DataFrame:
    """A run's counts at the end of the history."""
    h = history(spark, d)
    after = stores.append_history(h, h.groupBy("cluster_id").agg(F.sum("n").alias("n")), now())
    return after.select("cluster_id", dates.micros(F.col("run_ts")).alias("run_us"), "n")


@query(f"SELECT vec_id AS cluster_id, 'open' AS status, 0 AS items_count, epoch_us({NOW}) AS first_us FROM embeddings WHERE vec_id % 2 = 0 UNION ALL SELECT vec_id, 'closed', label::INT, NULL FROM embeddings WHERE vec_id % 2 = 1")
def create_cluster(spark: SparkSession, d: str) -> DataFrame:
    """New clusters beside stored ones."""
    e = table(spark, d, "embeddings")
    stamp = F.lit(None).cast("timestamp_ntz")
    stored = e.filter("vec_id % 2 = 1").select(F.col("vec_id").alias("cluster_id"), F.col("embedding").alias("centroid"), F.lit("closed").alias("status"), F.col("label").cast("int").alias("items_count"), stamp.alias("first_seen"), stamp.alias("last_seen"))
    after = stores.create_cluster(stored, e.filter("vec_id % 2 = 0").select(F.col("vec_id").alias("cluster_id"), F.col("embedding").alias("centroid")), now())
    return after.select("cluster_id", "status", "items_count", dates.micros(F.col("first_seen")).alias("first_us"))


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 2 = 0 ORDER BY c_name")
def sources_by_name(spark: SparkSession, d: str) -> DataFrame:
    """The active sources in the order of their names."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), (F.col("c_custkey") % 2 == 0).alias("active"))
    return rows.filter("active").orderBy("name", "id").select("id", "name")


@query("SELECT event_id, coalesce(CASE WHEN event_id % 7 = 0 THEN '' ELSE props->>'k' END, '') AS content, '' AS source_url, CASE WHEN event_id % 7 = 0 THEN 0 ELSE 1 END AS keys FROM events")
def payload_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields of a JSON payload, the empty string where they are missing or the payload can't be read."""
    payload = F.when(F.col("event_id") % 7 == 0, "{broken").otherwise(F.col("props"))
    rows = table(spark, d, "events").select("event_id", F.coalesce(F.from_json(payload, "map<string,string>"), F.create_map().cast("map<string,string>")).alias("m"))
    field = lambda k: F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(""))
    return rows.select("event_id", field("k").alias("content"), field("source_url").alias("source_url"), F.size("m").alias("keys"))


@query("SELECT event_id, '{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\",\"user_id\":' || user_id || '}' AS json FROM events")
def json_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows as JSON."""
    return table(spark, d, "events").select("event_id", F.to_json(F.struct("event_id", "event_type", "user_id")).alias("json"))


@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE string_split(text, chr(10))[1] END AS t, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE left(text, 30) END AS s FROM documents)
    SELECT doc_id, trim(CASE WHEN coalesce(s, '') <> '' THEN t || ' ' || s ELSE t END) AS for_embedding, t || ' ' || coalesce(s, '') AS for_hash, concat_ws(' ', nullif(trim(t), ''), nullif(trim(coalesce(s, '')), '')) AS for_match FROM d""")
def text_composition(spark: SparkSession, d: str) -> DataFrame:
    """Title and summary the three ways in which they are joined."""
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.get(F.split("text", "\n"), F.lit(0))).alias("title"), F.when(F.col("doc_id") % 4 != 0, F.substring("text", 1, 30)).alias("summary"))
    return docs.select("doc_id", text.embedding_text(F.col("title"), F.col("summary")).alias("for_embedding"), text.simhash_text(F.col("title"), F.col("summary")).alias("for_hash"), topics.match_text().alias("for_match"))


@query(f"WITH {_hashed('text')} SELECT doc_id, coalesce(nullif(ltrim(lower(to_hex(h)), '0'), ''), '0') AS simhash FROM hashes")
def simhash_short(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints of cleaned texts, without leading zeros."""
    return table(spark, d, "documents").select("doc_id", hashing.short_hex(hashing.simhash64(text.clean(F.col("text")))).alias("simhash"))


@query(r"SELECT doc_id, left(trim(regexp_replace(lower(replace(strip_accents(string_split(text, chr(10))[1]), 'ß', '')), '[^a-z0-9]+', '-', 'g'), '-'), 80) AS slug FROM documents")
def slug_hard(spark: SparkSession, d: str) -> DataFrame:
    """Slugs cut hard."""
    return table(spark, d, "documents").select("doc_id", text.hard_slug(text.nfkd_ascii(F.get(F.split("text", "\n"), F.lit(0)))).alias("slug"))


@query()
def html_sanitise(spark: SparkSession, d: str) -> DataFrame:
    """Pages with the allowed tags alone."""
    return table(spark, d, "pages").select("page_id", text.sanitise("html").alias("html"))


@query(f"SELECT event_id, CASE WHEN event_id % 4 = 3 THEN epoch_us({NOW}) ELSE epoch_us(ts) - (event_id % 4) * 3600000000 END AS utc_us, CASE WHEN event_id % 4 = 3 THEN strftime({NOW}, '%Y-%m-%d %H:%M:%S') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END || ' UTC' AS shown, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS taiwan FROM events")
def date_zones(spark: SparkSession, d: str) -> DataFrame:
    """Times with an offset, without, and missing; as feeds show them; in Taiwan."""
    k = F.col("event_id") % 4
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    some = F.when(k != 3, F.col("ts"))
    return e.select("event_id", dates.micros(dates.to_utc(some, k.cast("int"), now())).alias("utc_us"), dates.format_feed(F.coalesce(some, now())).alias("shown"), F.date_format(dates.taiwan(F.col("ts")), "yyyy-MM-dd HH:mm:ss").alias("taiwan"))


# ---- clustering against stored clusters: every tenth vector is one


_EXISTING = "e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), x AS (SELECT vec_id AS l, v FROM e WHERE vec_id % 10 = 0), n AS (SELECT vec_id AS id, v, row_number() OVER (ORDER BY vec_id DESC) AS r FROM e WHERE vec_id % 10 <> 0)"
_SIM = "round(list_cosine_similarity({}, {}), 9)"
LEADERS = f"""{_EXISTING},
    old AS MATERIALIZED (SELECT n.id, {_SIM.format('n.v', 'x.v')} AS s, x.l, -1::BIGINT AS place FROM n JOIN x ON {_SIM.format('n.v', 'x.v')} >= 0.3),
    p AS MATERIALIZED (SELECT b.id, b.r, a.id AS l, a.r AS place, {_SIM.format('a.v', 'b.v')} AS s FROM n a JOIN n b ON a.r < b.r AND {_SIM.format('a.v', 'b.v')} >= 0.3),
    free AS (SELECT list([{{'id': n.id, 'near': coalesce(q.near, []::BIGINT[])}}] ORDER BY n.r) AS l FROM n LEFT JOIN (SELECT id, list(l) AS near FROM p GROUP BY 1) q ON q.id = n.id WHERE n.id NOT IN (SELECT id FROM old)),
    k AS (SELECT list_transform(list_reduce(l, lambda a, b: CASE WHEN len(list_filter(a, lambda y: list_contains(b[1].near, y.id))) = 0 THEN list_concat(a, b) ELSE a END), lambda y: y.id) AS leaders FROM free),
    c AS (SELECT id, s, l, place FROM old UNION ALL SELECT id, s, l, place FROM p WHERE list_contains((SELECT leaders FROM k), l)),
    b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, place, l) AS rank FROM c),
    led AS (SELECT n.id, list_contains((SELECT leaders FROM k), n.id) AS new, CASE WHEN list_contains((SELECT leaders FROM k), n.id) THEN n.id ELSE b.l END AS leader, CASE WHEN list_contains((SELECT leaders FROM k), n.id) THEN 0.0 ELSE b.s END AS similarity FROM n LEFT JOIN b ON b.id = n.id AND b.rank = 1)"""


def _led(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return cluster.leader_clusters(e.filter("id % 10 <> 0").withColumn("rank", -F.col("id")), 0.3, e.filter("id % 10 = 0"))


@query(f"WITH {LEADERS} SELECT id, leader, round(similarity, 6) AS similarity, new FROM led")
def leader_existing(spark: SparkSession, d: str) -> DataFrame:
    """The newest vectors first, each into the best stored or new cluster."""
    return _led(spark, d).select("id", "leader", F.round("similarity", 6).alias("similarity"), "new")


_MEMBERS = "m AS (SELECT led.leader AS cluster_id, led.id, led.new, ev.ts, CASE WHEN p.url IS NULL THEN 'unknown' ELSE lower(regexp_extract(p.url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) END AS domain FROM led LEFT JOIN events ev ON ev.event_id = led.id LEFT JOIN pages p ON p.page_id = led.id)"


@query(f"""WITH {LEADERS}, {_MEMBERS}, h AS (SELECT cluster_id, domain, count(*) + count(*) FILTER (WHERE new) AS n FROM m WHERE domain <> 'unknown' GROUP BY ALL),
    g AS (SELECT cluster_id, string_agg(domain || ':' || n, ',' ORDER BY domain) AS domains, count(*) AS k FROM h GROUP BY 1)
    SELECT cluster_id, count(*) AS items_count, epoch_us(min(ts) FILTER (WHERE new)) AS first_us, epoch_us(max(ts)) AS last_us, coalesce(any_value(g.domains), '') AS domains, coalesce(any_value(g.k), 0) AS domains_count FROM m LEFT JOIN g USING (cluster_id) GROUP BY cluster_id""")
def cluster_flush(spark: SparkSession, d: str) -> DataFrame:
    """What a run writes to its clusters: counts, times, domains, the seed's domain counted twice."""
    led = _led(spark, d).select(F.col("leader").alias("cluster_id"), F.col("id").alias("item_id"), "new")
    e = table(spark, d, "events").select(F.col("event_id").alias("item_id"), F.col("ts").cast("timestamp_ntz").alias("ts"))
    p = table(spark, d, "pages").select(F.col("page_id").alias("item_id"), url.domain(F.col("url")).alias("domain"))
    rows = cluster.cluster_rows(led.join(e, "item_id", "left").join(p, "item_id", "left"))
    told = F.array_join(F.transform(F.sort_array(F.map_entries("domains")), lambda x: F.concat(x["key"], F.lit(":"), x["value"].cast("string"))), ",")
    return rows.select("cluster_id", "items_count", dates.micros(F.col("first_seen")).alias("first_us"), dates.micros(F.col("last_seen")).alias("last_us"), told.alias("domains"), "domains_count")


@query(f"WITH {LEADERS} SELECT count(*) AS total_items, count(*) FILTER (WHERE new) AS new_clusters, (SELECT count(*) FROM x) AS existing_clusters, count(leader) AS items_clustered FROM led")
def clustering_stats(spark: SparkSession, d: str) -> DataFrame:
    """What a clustering run did."""
    stored = table(spark, d, "embeddings").filter("vec_id % 10 = 0").agg(F.count("*")).scalar()
    told = _led(spark, d).agg(F.count("*").alias("total_items"), F.count_if("new").alias("new_clusters"), F.count("leader").alias("items_clustered"))
    return told.withColumn("existing_clusters", stored)


@query(f"SELECT vec_id AS cluster_id, epoch_us(ts) AS first_us FROM embeddings JOIN events ON event_id = vec_id WHERE vec_id % 3 <> 0 AND vec_id % 5 <> 0 AND ts >= {NOW} - INTERVAL 744 HOUR")
def active_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Open clusters with a centroid, of the last days."""
    e = table(spark, d, "events").select(F.col("event_id").alias("vec_id"), F.col("ts").cast("timestamp_ntz").alias("first_seen"))
    c = table(spark, d, "embeddings").join(e, "vec_id").select(F.col("vec_id").alias("cluster_id"), F.when(F.col("vec_id") % 3 != 0, "open").otherwise("closed").alias("status"), "first_seen", F.when(F.col("vec_id") % 5 != 0, F.col("embedding")).alias("centroid"))
    return cluster.active_clusters(c, now(), 744).select("cluster_id", dates.micros(F.col("first_seen")).alias("first_us"))


@query("""WITH m AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: (x * 3 + list_reverse(embedding::DOUBLE[])[1]) / 4) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS s FROM m)
    SELECT vec_id, round(v[1] / s, 6) AS first, round(v[64] / s, 6) AS last FROM n""")
def centroid_mean(spark: SparkSession, d: str) -> DataFrame:
    """The mean of three times a vector and one of equal elements, of length one."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    other = F.transform("v", lambda _: F.get("v", F.size("v") - 1))
    m = e.select("vec_id", cluster.running_mean(F.col("v"), F.lit(3), other).alias("m"))
    return m.select("vec_id", F.round(F.get("m", F.lit(0)), 6).alias("first"), F.round(F.get("m", F.size("m") - 1), 6).alias("last"))


# ---- topic runs, selection statistics


_CONF = "conf(topic_key, enabled, cadence, minutes) AS (VALUES ('heat', true, 60, 90), ('sea', true, 60, 30), ('aus', true, 60, NULL), ('off', false, 60, NULL))"
TOPIC_RUN = f"""{TOPIC_HITS}, capped AS (SELECT * FROM hits WHERE rank <= cap), {_CONF},
    s AS (SELECT topic_key, count(*) AS n, list_sort(list(DISTINCT cluster_id)) AS c, min(score) AS least, avg(score) AS mean, max(score) AS most FROM capped GROUP BY 1),
    g AS (SELECT conf.topic_key, enabled, enabled AND coalesce(minutes >= cadence, true) AS due, coalesce(n, 0) AS n, c, least, mean, most FROM conf LEFT JOIN s USING (topic_key)),
    runs AS (SELECT topic_key, enabled, due, CASE WHEN due THEN n ELSE 0 END AS items_matched, CASE WHEN due AND n > 0 THEN c ELSE [] END AS clusters, CASE WHEN due AND n > 0 THEN round(least::DOUBLE, 6) END AS least, CASE WHEN due AND n > 0 THEN round(mean::DOUBLE, 6) END AS mean, CASE WHEN due AND n > 0 THEN round(most::DOUBLE, 6) END AS most,
        due AND n > 0 AS processed, CASE WHEN NOT due THEN 'cadence_not_met' WHEN n = 0 THEN 'no_matching_items' END AS skip_reason FROM g)"""


def _runs(spark: SparkSession, d: str) -> DataFrame:
    last = spark.createDataFrame([("heat", 90), ("sea", 30)], "topic_key string, minutes int").select("topic_key", (now() - F.make_dt_interval(mins=F.col("minutes"))).alias("last_run"))
    return topics.run_topics(items(spark, d), TOPICS, last, now())


@query(f"WITH {ITEMS}, {TOPIC_RUN} SELECT topic_key, enabled, due, items_matched, array_to_string(clusters, ',') AS clusters, least, mean, most, processed, skip_reason FROM runs")
def topic_run(spark: SparkSession, d: str) -> DataFrame:
    """A run over all topics: those due, their items, clusters and scores, and why the others were skipped."""
    r = _runs(spark, d)
    return r.select("topic_key", "enabled", "due", "items_matched", F.array_join(F.col("clusters_updated").cast("array<string>"), ",").alias("clusters"), *[F.round(c, 6).alias(c) for c in ("least", "mean", "most")], "processed", "skip_reason")


@query(f"WITH {ITEMS}, {TOPIC_RUN} SELECT count(*) AS total_topics, count(*) FILTER (WHERE processed) AS topics_processed, sum(items_matched)::BIGINT AS total_items_matched, len(list_distinct(flatten(list(clusters)))) AS total_clusters_updated FROM runs")
def topic_run_summary(spark: SparkSession, d: str) -> DataFrame:
    return topics.run_summary(_runs(spark, d))


@query(f"""WITH {ITEMS}, {TOPIC_HITS}, h AS (SELECT topic_key, item_id AS id, rank, embedding::DOUBLE[] AS v FROM hits JOIN embeddings ON vec_id = item_id WHERE rank <= cap),
    p AS MATERIALIZED (SELECT a.topic_key, b.id, a.id AS l, a.rank AS place, {_SIM.format('a.v', 'b.v')} AS s FROM h a JOIN h b ON a.topic_key = b.topic_key AND a.rank < b.rank WHERE {_SIM.format('a.v', 'b.v')} >= 0.3),
    o AS (SELECT h.topic_key, list([{{'id': h.id, 'near': coalesce(q.near, []::BIGINT[])}}] ORDER BY h.rank) AS l FROM h LEFT JOIN (SELECT topic_key, id, list(l) AS near FROM p GROUP BY ALL) q ON q.topic_key = h.topic_key AND q.id = h.id GROUP BY h.topic_key),
    k AS (SELECT topic_key, list_transform(list_reduce(l, lambda a, b: CASE WHEN len(list_filter(a, lambda y: list_contains(b[1].near, y.id))) = 0 THEN list_concat(a, b) ELSE a END), lambda y: y.id) AS leaders FROM o),
    b AS (SELECT p.*, row_number() OVER (PARTITION BY p.topic_key, p.id ORDER BY s DESC, place) AS r FROM p JOIN k USING (topic_key) WHERE list_contains(k.leaders, p.l))
    SELECT h.topic_key, h.id, CASE WHEN list_contains(k.leaders, h.id) THEN h.id ELSE b.l END AS leader, CASE WHEN list_contains(k.leaders, h.id) THEN 0.0 ELSE round(b.s, 6) END AS similarity FROM h JOIN k USING (topic_key) LEFT JOIN b ON b.topic_key = h.topic_key AND b.id = h.id AND b.r = 1""")
def topic_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of each topic's items alone."""
    hits = topics.match_topics(items(spark, d), TOPICS)
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return topics.clusters_by_topic(hits, vectors, 0.3).select("topic_key", "id", "leader", F.round("similarity", 6).alias("similarity"))


@query(f"""{PICKS} SELECT count(*) AS total_picks, count(*) FILTER (WHERE kind = 'global') AS global_count, count(*) FILTER (WHERE kind = 'topic') AS topic_count, count(DISTINCT topic_key) FILTER (WHERE kind = 'topic') AS topics_represented FROM picks""")
def selection_stats(spark: SparkSession, d: str) -> DataFrame:
    scored = cut(metrics(spark, d), "metrics")
    picks = select.global_picks(scored, 20).unionByName(select.topic_picks(scored, mapped(spark, d), _topic_table(spark)))
    return select.selection_stats(picks)


_KEYS = ["there", "ung", "zzz"]
_REL = f"""rel AS (SELECT cluster_id, avg(least(1.0, (CASE WHEN contains(t, 'there') THEN 1 + 0.5 * contains(ti, 'there')::INT ELSE 0 END + CASE WHEN contains(t, 'ung') THEN 1 + 0.5 * contains(ti, 'ung')::INT ELSE 0 END + CASE WHEN contains(t, 'zzz') THEN 1.5 ELSE 0 END) / 3.0)) AS relevance
        FROM (SELECT cluster_id, lower(coalesce(title, '')) AS ti, lower(trim(coalesce(title, '') || ' ' || coalesce(summary, ''))) AS t FROM items) WHERE t <> '' GROUP BY 1),
    topical AS (SELECT cluster_id, composite * (1 + relevance) AS adjusted, row_number() OVER (ORDER BY composite * (1 + relevance) DESC, cluster_id) AS rank FROM metrics JOIN rel USING (cluster_id) WHERE relevance > 0.1 QUALIFY rank <= 10)"""


@query(f"{FIVE}, {_REL} SELECT cluster_id, round(adjusted, 6) AS adjusted FROM topical")
def topic_trends(spark: SparkSession, d: str) -> DataFrame:
    """The ten best clusters for some keywords."""
    found = select.topic_trends(metrics(spark, d), topics.keyword_relevance(items(spark, d), _KEYS), 10)
    return found.select("cluster_id", F.round("adjusted", 6).alias("adjusted"))


_TRENDS = """tr0 AS (SELECT * FROM metrics WHERE composite >= 0.1 ORDER BY composite DESC, cluster_id LIMIT 15), tr AS (SELECT composite * CASE WHEN avg_age_hours <= 6 THEN least(1.2, 1 + (6 - avg_age_hours) / 6 * 0.2) ELSE 1.0 END AS adjusted FROM tr0)"""


@query(f"{FIVE}, {_REL}, {_TRENDS} SELECT (SELECT count(*) FROM metrics) AS total_candidates, count(*) AS global_selected, (SELECT count(*) FROM topical) AS topic_selected, round(coalesce(max(adjusted), 0.0), 6) AS top_global_score, round(coalesce(avg(adjusted), 0.0), 6) AS avg_global_score FROM tr")
def trend_stats(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of a selection run."""
    scored = cut(metrics(spark, d), "metrics")
    topical = select.topic_trends(scored, topics.keyword_relevance(items(spark, d), _KEYS), 10)
    told = select.trend_stats(scored, select.trends(scored, 15), topical)
    return told.select("total_candidates", "global_selected", "topic_selected", F.round("top_global_score", 6).alias("top_global_score"), F.round("avg_global_score", 6).alias("avg_global_score"))


@query(f"{TOTAL} SELECT cluster_id, round(total, 6) AS total FROM total WHERE cluster_id % 4 <> 0 ORDER BY total.total DESC, cluster_id LIMIT 10")
def rank_open(spark: SparkSession, d: str) -> DataFrame:
    """The ten best of the open clusters; every fourth is closed."""
    scored = score.three_factors(items(spark, d), history(spark, d), now(), TAU).withColumn("status", F.when(F.col("cluster_id") % 4 != 0, "open").otherwise("closed"))
    return score.rank_clusters(scored, 10).select("cluster_id", F.round("total", 6).alias("total"))


@query(f"{FIVE} SELECT cluster_id, item_count, round(composite, 6) AS composite FROM metrics ORDER BY metrics.composite DESC, cluster_id LIMIT 10")
def scoring_top(spark: SparkSession, d: str) -> DataFrame:
    """The ten best of a scoring run."""
    best = score.rank_clusters(metrics(spark, d), 10, "composite")
    return _rounded(best.select("cluster_id", "item_count", "composite"), "cluster_id", "item_count")


@query(f"WITH {ITEMS}, r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY published_at DESC NULLS LAST, item_id) AS rank FROM items) SELECT cluster_id, item_id, rank FROM r WHERE rank <= 3")
def first_items(spark: SparkSession, d: str) -> DataFrame:
    """The three newest items of every cluster."""
    return select.first_items(items(spark, d)).select("cluster_id", "item_id", "rank")


@query(f"WITH {ITEMS} SELECT cluster_id, string_agg(DISTINCT domain, ',' ORDER BY domain) AS domains FROM items WHERE coalesce(domain, '') <> '' GROUP BY 1")
def domain_sets(spark: SparkSession, d: str) -> DataFrame:
    return select.domain_sets(items(spark, d)).select("cluster_id", F.array_join("domains", ",").alias("domains"))


@query(f"WITH {ITEMS} SELECT item_id, epoch_us(coalesce(CASE WHEN item_id % 3 <> 0 THEN published_at END, fetched_at)) AS item_us FROM items")
def item_times(spark: SparkSession, d: str) -> DataFrame:
    """An item's time: published, or else fetched."""
    published = F.when(F.col("item_id") % 3 != 0, F.col("published_at"))
    return items(spark, d).select("item_id", dates.micros(F.coalesce(published, F.col("fetched_at"))).alias("item_us"))


