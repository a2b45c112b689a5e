"""Queries that score clusters of items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.functions import dates
from storyloom.operators import score
from storyloom.plans.items import AGE, ITEMS, NOW, items, now, table

Q: dict = {}
SQL: dict[str, str] = {}
#: Hours over which freshness falls, long enough for a month of data.
TAU = 240.0


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def history(spark: SparkSession, d: str) -> DataFrame:
    """Daily event counts of users, as the counts of clusters over time: (cluster_id, run_ts, n)."""
    e = table(spark, d, "events")
    return e.groupBy((F.col("user_id") % 50).alias("cluster_id"), F.date_trunc("day", F.col("ts")).cast("timestamp_ntz").alias("run_ts")).agg(F.count("*").alias("n"))


HISTORY = "hist AS (SELECT user_id % 50 AS cluster_id, date_trunc('day', ts) AS run_ts, count(*) AS n FROM events GROUP BY ALL)"
TREND = f"""{HISTORY}, last AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY run_ts DESC) AS k FROM hist),
    stats AS (SELECT cluster_id, count(*) AS hn, avg(n) AS mean, stddev_pop(n) AS sd FROM last WHERE k <= 7 GROUP BY 1),
    counts AS (SELECT cluster_id, count(*) AS items_count FROM items GROUP BY 1),
    trend AS (SELECT c.cluster_id, c.items_count, CASE WHEN coalesce(hn, 0) < 7 THEN CASE WHEN items_count >= 2 THEN 1.0 ELSE 0.0 END ELSE 1 / (1 + exp(-(items_count - mean) / CASE WHEN sd = 0 THEN 1 ELSE sd END)) END AS trend FROM counts c LEFT JOIN stats s USING (cluster_id))"""
GINI = """dom AS (SELECT cluster_id, domain, count(*) AS n FROM items WHERE coalesce(domain, '') <> '' GROUP BY ALL),
    dr AS (SELECT *, n + 1e-7 AS x, row_number() OVER (PARTITION BY cluster_id ORDER BY n) AS i, count(*) OVER (PARTITION BY cluster_id) AS k FROM dom),
    gini AS (SELECT cluster_id, CASE WHEN sum(n) = 0 THEN 0.0 ELSE sum((2 * i - k - 1) * x) / (max(k) * sum(x)) END AS gini FROM dr GROUP BY 1)"""
FRESH = f"fresh AS (SELECT cluster_id, exp(-avg(greatest(0.0, coalesce({AGE}, 0.0))) / {TAU}) AS fresh FROM items GROUP BY 1)"
TOTAL = f"""WITH {ITEMS}, {TREND}, {GINI}, {FRESH}, total AS (SELECT t.cluster_id, t.items_count, t.trend, coalesce(1 - g.gini, 0.0) AS diversity, f.fresh,
    0.45 * t.trend + 0.35 * coalesce(1 - g.gini, 0.0) + 0.20 * f.fresh AS total FROM trend t LEFT JOIN gini g USING (cluster_id) JOIN fresh f USING (cluster_id))"""


@query(f"WITH {ITEMS}, {TREND} SELECT cluster_id, round(trend, 6) AS trend FROM trend")
def trend_spike(spark: SparkSession, d: str) -> DataFrame:
    counts = items(spark, d).groupBy("cluster_id").agg(F.count("*").alias("items_count"))
    return score.trend_spike(counts, history(spark, d)).select("cluster_id", F.round("trend", 6).alias("trend"))


@query(f"WITH {ITEMS}, {GINI} SELECT cluster_id, round(gini, 6) AS gini, round(1 - gini, 6) AS diversity FROM gini")
def gini_diversity(spark: SparkSession, d: str) -> DataFrame:
    found = score.gini(score.histogram(items(spark, d), "domain"))
    return found.select("cluster_id", F.round("gini", 6).alias("gini"), F.round(1 - F.col("gini"), 6).alias("diversity"))


@query(f"WITH {ITEMS}, {FRESH} SELECT cluster_id, round(fresh, 6) AS fresh FROM fresh")
def freshness3(spark: SparkSession, d: str) -> DataFrame:
    return score.freshness3(items(spark, d), now(), TAU).select("cluster_id", F.round("fresh", 6).alias("fresh"))


def _rounded(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, *[F.round(c, 6).alias(c) for c in df.columns if c not in keep])


@query(f"{TOTAL} SELECT cluster_id, items_count, round(trend, 6) AS trend, round(diversity, 6) AS diversity, round(fresh, 6) AS fresh, round(total, 6) AS total FROM total")
def three_factors(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(score.three_factors(items(spark, d), history(spark, d), now(), TAU), "cluster_id", "items_count")


@query(f"{TOTAL} SELECT cluster_id, round(total, 6) AS total FROM total ORDER BY total.total DESC, cluster_id LIMIT 10")
def total3_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten best clusters."""
    best = score.rank_clusters(score.three_factors(items(spark, d), history(spark, d), now(), TAU), 10)
    return best.select("cluster_id", F.round("total", 6).alias("total"))


QUALITY = """least(1.0, 0.25 * (
      CASE WHEN length(trim(title)) BETWEEN 10 AND 200 THEN least(1.0, least(1.0, length(trim(title)) / 100.0) * CASE WHEN regexp_matches(lower(title), 'news|update|breaking|latest') THEN 1.0 ELSE 1.2 END) ELSE 0.0 END
    + CASE WHEN length(trim(summary)) >= 50 THEN least(1.0, length(trim(summary)) / 500.0) ELSE 0.0 END
    + CASE WHEN length(trim(content)) >= 100 THEN least(1.0, length(trim(content)) / 2000.0) ELSE 0.0 END
    + CASE WHEN coalesce(url, '') <> '' THEN pow(0.8, contains(lower(url), 'redirect')::INT + contains(lower(url), 'track')::INT + contains(lower(url), 'utm_')::INT + contains(lower(url), 'fb_')::INT + contains(lower(url), 'gclid')::INT) ELSE 0.0 END))"""
FIVE = f"""WITH {ITEMS}, aged AS (SELECT *, coalesce({AGE}, 0.0) AS age, greatest(0, trunc(coalesce({AGE}, 0.0))::INT) AS h FROM items),
    parts AS (SELECT cluster_id, count(*) AS item_count, avg(age) AS avg_age_hours, count(*) FILTER (WHERE age <= 6) AS young, count(*) FILTER (WHERE h <= 6) AS recent,
        max(h) FILTER (WHERE h <= 6) AS recent_max, max(h) AS hour_max, avg({QUALITY}) AS quality FROM aged GROUP BY 1),
    src AS (SELECT cluster_id, source_id, count(*) AS n FROM items WHERE coalesce(source_id, '') <> '' GROUP BY ALL),
    ent AS (SELECT cluster_id, sum(-(n / item_count::DOUBLE) * log2(n / item_count::DOUBLE)) AS entropy, count(*) AS kinds FROM src JOIN parts USING (cluster_id) GROUP BY 1),
    dm AS (SELECT cluster_id, count(DISTINCT domain) AS domains FROM items WHERE coalesce(domain, '') <> '' GROUP BY 1),
    f AS (SELECT p.cluster_id, item_count, avg_age_hours, coalesce(kinds, 0) AS unique_sources, coalesce(domains, 0) AS unique_domains,
        CASE WHEN item_count < 2 THEN 0.0 ELSE least(1.0, ln(1 + (CASE WHEN recent > 0 THEN recent / least(6, recent_max + 1)::DOUBLE ELSE 0.0 END) / (item_count / greatest(1, hour_max + 1)::DOUBLE)) / ln(10)) END AS viral,
        least(1.0, 0.7 * exp(-avg_age_hours / 12) + 0.3 * young / item_count::DOUBLE) AS freshness,
        least(1.0, 0.6 * (CASE WHEN coalesce(kinds, 0) > 1 THEN entropy / log2(kinds) ELSE 0.0 END) + 0.4 * least(1.0, coalesce(domains, 0) / greatest(1.0, 0.5 * item_count))) AS diversity,
        least(1.0, 0.7 * ln(1 + item_count) / ln(100) + 0.3 * least(2.0, item_count / (SELECT avg(item_count) FROM parts)) / 2) AS volume, quality
      FROM parts p LEFT JOIN ent USING (cluster_id) LEFT JOIN dm USING (cluster_id)),
    five AS (SELECT cluster_id, item_count, avg_age_hours, unique_sources, unique_domains, CASE WHEN item_count >= 3 THEN viral ELSE 0.0 END AS viral, CASE WHEN item_count >= 3 THEN freshness ELSE 0.0 END AS freshness,
        CASE WHEN item_count >= 3 THEN diversity ELSE 0.0 END AS diversity, CASE WHEN item_count >= 3 THEN volume ELSE 0.0 END AS volume, CASE WHEN item_count >= 3 THEN quality ELSE 0.0 END AS quality FROM f),
    metrics AS (SELECT *, greatest(0.0, least(1.0, 0.25 * viral + 0.20 * freshness + 0.20 * diversity + 0.15 * volume + 0.20 * quality)) AS composite FROM five)"""


def metrics(spark: SparkSession, d: str) -> DataFrame:
    return score.five_factors(items(spark, d), now())


@query(f"{FIVE} SELECT cluster_id, item_count, unique_sources, unique_domains, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("viral", "freshness", "diversity", "volume", "quality", "avg_age_hours", "composite")) + " FROM metrics")
def five_factors(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics(spark, d), "cluster_id", "item_count", "unique_sources", "unique_domains")


def _one(name: str) -> None:
    def f(spark: SparkSession, d: str) -> DataFrame:
        return metrics(spark, d).select("cluster_id", F.round(name, 6).alias(name))

    f.__name__ = {"freshness": "freshness5", "diversity": "diversity5"}.get(name, name)
    query(f"{FIVE} SELECT cluster_id, round({name}, 6) AS {name} FROM metrics")(f)


for _name in ("viral", "freshness", "diversity", "volume", "quality", "composite"):
    _one(_name)


@query(f"WITH {ITEMS} SELECT item_id, round({QUALITY}, 6) AS quality FROM items")
def item_quality(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).select("item_id", F.round(score.item_quality(), 6).alias("quality"))


@query(f"{FIVE} SELECT count(*) AS clusters, round(avg(composite), 6) AS mean, round(max(composite), 6) AS best, sum(item_count)::BIGINT AS items FROM metrics")
def scoring_summary(spark: SparkSession, d: str) -> DataFrame:
    return metrics(spark, d).agg(F.count("*").alias("clusters"), F.round(F.avg("composite"), 6).alias("mean"), F.round(F.max("composite"), 6).alias("best"), F.sum("item_count").alias("items"))


@query(f"""WITH {ITEMS}, members AS (SELECT doc_id % 50 AS cluster_id, doc_id AS raw_item_id FROM documents )
    SELECT m.cluster_id, i.item_id, epoch_us(i.published_at) AS published_us FROM members m JOIN items i ON i.item_id = m.raw_item_id""")
def cluster_items_join(spark: SparkSession, d: str) -> DataFrame:
    """Items by membership."""
    joined = items(spark, d).drop("cluster_id").join(members(spark, d), F.col("item_id") == F.col("raw_item_id"))
    return joined.select("cluster_id", "item_id", dates.micros(F.col("published_at")).alias("published_us"))


def members(spark: SparkSession, d: str) -> DataFrame:
    """Every item in one cluster."""
    return table(spark, d, "documents").select((F.col("doc_id") % 50).alias("cluster_id"), F.col("doc_id").alias("raw_item_id"))


@query(f"""WITH {ITEMS}, members AS (SELECT doc_id % 50 AS cluster_id, doc_id AS raw_item_id FROM documents)
    SELECT m.cluster_id, count(*) AS item_count, count(DISTINCT i.source_id) AS unique_sources, count(DISTINCT i.domain) AS domains, epoch_us(min(i.fetched_at)) AS first_us, epoch_us(max(i.fetched_at)) AS last_us
    FROM members m JOIN items i ON i.item_id = m.raw_item_id GROUP BY 1""")
def cluster_stats(spark: SparkSession, d: str) -> DataFrame:
    joined = items(spark, d).drop("cluster_id").join(members(spark, d), F.col("item_id") == F.col("raw_item_id"))
    stats = joined.groupBy("cluster_id").agg(F.count("*").alias("item_count"), F.count_distinct("source_id").alias("unique_sources"), F.count_distinct("domain").alias("domains"), F.min("fetched_at").alias("_f"), F.max("fetched_at").alias("_l"))
    return stats.select("cluster_id", "item_count", "unique_sources", "domains", dates.micros(F.col("_f")).alias("first_us"), dates.micros(F.col("_l")).alias("last_us"))


@query(f"WITH {ITEMS} SELECT cluster_id, coalesce(nullif(domain, ''), 'unknown') AS domain, count(*) AS n FROM items GROUP BY ALL")
def cluster_domains(spark: SparkSession, d: str) -> DataFrame:
    host = F.coalesce(F.nullif(F.col("domain"), F.lit("")), F.lit("unknown"))
    return items(spark, d).groupBy("cluster_id", host.alias("domain")).agg(F.count("*").alias("n"))


@query(f"WITH {HISTORY}, r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY run_ts DESC) AS age_rank FROM hist WHERE run_ts >= {NOW} - INTERVAL 30 DAY) SELECT cluster_id, epoch_us(run_ts) AS run_us, n, age_rank FROM r WHERE age_rank <= 30")
def count_history(spark: SparkSession, d: str) -> DataFrame:
    from storyloom.operators import stores

    kept = stores.history(history(spark, d), now())
    return kept.select("cluster_id", dates.micros(F.col("run_ts")).alias("run_us"), "n", "age_rank")


@query("WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT q.vec_id AS query, e.vec_id AS id, round(list_cosine_similarity(q.v, e.embedding::DOUBLE[]), 9) AS sim FROM q JOIN embeddings e ON e.vec_id <> q.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, id) AS rank FROM s) SELECT query, id, round(sim, 6) AS similarity, rank FROM r WHERE rank <= 5")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest of every vector whose number 100 divides, against all."""
    from storyloom.operators.cluster import top_similar

    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    found = top_similar(v.filter("id % 100 = 0"), v, 5)
    return found.select("query", "id", F.round("similarity", 6).alias("similarity"), "rank")


LEADERS = """WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
    p AS MATERIALIZED (SELECT a.vec_id AS u, b.vec_id AS v, round(list_cosine_similarity(a.v, b.v), 9) AS s FROM e a JOIN e b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.3),
    n AS (SELECT v AS id, list(u) AS near FROM p GROUP BY 1),
    o AS (SELECT list([{'id': e.vec_id, 'near': coalesce(n.near, []::BIGINT[])}] ORDER BY e.vec_id) AS l FROM e LEFT JOIN n ON n.id = e.vec_id),
    k AS (SELECT list_transform(list_reduce(l, lambda a, b: CASE WHEN len(list_filter(a, lambda x: list_contains(b[1].near, x.id))) = 0 THEN list_concat(a, b) ELSE a END), lambda x: x.id) AS leaders FROM o),
    b AS (SELECT p.v AS id, max({'s': p.s, 'l': -p.u}) AS best FROM p WHERE list_contains((SELECT leaders FROM k), p.u) GROUP BY 1)
    SELECT e.vec_id AS id, CASE WHEN list_contains((SELECT leaders FROM k), e.vec_id) THEN e.vec_id ELSE -b.best.l END AS leader, CASE WHEN list_contains((SELECT leaders FROM k), e.vec_id) THEN 0.0 ELSE round(b.best.s, 6) END AS similarity FROM e LEFT JOIN b ON b.id = e.vec_id"""


@query(LEADERS)
def leader_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Leaders in the order of their numbers, at a cosine of 0.3."""
    from storyloom.operators.cluster import leader_clusters as run

    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("vec_id").alias("rank"))
    return run(v, 0.3).select("id", "leader", F.round("similarity", 6).alias("similarity"))


MEANS = """WITH e AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings),
    l AS (SELECT list({'done': [{'id': vec_id, 'leader': vec_id, 's': 0.0::DOUBLE, 'new': true}], 'open': [{'l': vec_id, 'c': v, 'n': 1::BIGINT}]} ORDER BY vec_id) AS l FROM e),
    f AS (SELECT list_reduce(l, lambda a, b: list_transform([list_transform(a.open, lambda x: round(list_dot_product(x.c, b.open[1].c), 9))], lambda s: CASE WHEN list_max(s) >= 0.3
        THEN {'done': list_concat(a.done, [{'id': b.done[1].id, 'leader': a.open[list_position(s, list_max(s))].l, 's': list_max(s), 'new': false}]),
              'open': list_transform(a.open, lambda x, i: CASE WHEN i = list_position(s, list_max(s)) THEN list_transform([list_transform(x.c, lambda c, j: (c * x.n + b.open[1].c[j]) / (x.n + 1))], lambda m: {'l': x.l, 'c': list_transform(m, lambda y: y / sqrt(list_dot_product(m, m))), 'n': x.n + 1})[1] ELSE x END)}
        ELSE {'done': list_concat(a.done, b.done), 'open': list_concat(a.open, b.open)} END)[1]) AS f FROM l)
    SELECT o.id, o.leader, round(o.s, 6) AS similarity, o.new FROM (SELECT unnest(f.done) AS o FROM f)"""


@query(MEANS)
def mean_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters by running means in the order of their numbers, at a cosine of 0.3."""
    from storyloom.operators.means import mean_clusters as run

    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return run(v, 0.3).select("id", "leader", F.round("similarity", 6).alias("similarity"), "new")
