"""Feed entries to stored items: normalisation with rejects, the run against what is stored, counters, updates of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from storyloom.functions import dates, hashing, text, url
from storyloom.functions.language import Profiles
from storyloom.operators.dedup import scan, top_by
from storyloom.operators.hamming import pairs
from storyloom.operators.validate import valid_entry
from storyloom.sources.shared import cut


def _first(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def _field(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def summary_of(entries: DataFrame) -> Column:
    """The first of content (its first part), summary, description and subtitle of which a text is left."""
    content = F.get("content", F.lit(0))["value"] if "content" in entries.columns else F.lit(None).cast("string")
    plain = [text.html_to_text(c) for c in (content, *(_field(entries, n) for n in ("summary", "description", "subtitle")))]
    return F.coalesce(_first(*plain), F.lit(""))


def published_of(entries: DataFrame) -> Column:
    """The date of an entry, under any of its four names."""
    return _first(*(_field(entries, n) for n in ("published", "updated", "created", "pubDate")))


def parse_or_now(value: Column, now: Column) -> Column:
    """A feed's date as a time; a missing or unreadable one is now."""
    return F.coalesce(dates.from_micros(dates.parse(value)), now)


def normalise(entries: DataFrame, now: Column, fallback: Column | None = None, profiles: Profiles | None = None) -> DataFrame:
    """The entries with ``title, url, summary, lang, published_at, fetched_at, url_sha1, h, valid`` beside ``entry_id``.

    ``h`` is the SimHash of title and summary. Every entry keeps its row: those that aren't valid are the rejects.
    """
    link = _first(_field(entries, "link"), _field(entries, "url"))
    held = entries.select("entry_id", text.html_to_text("title").alias("title"), F.coalesce(link, F.lit("")).alias("url"), summary_of(entries).alias("summary"), published_of(entries).alias("_p"), (fallback if fallback is not None else F.lit("en")).alias("_lang"))
    told = held.withColumn("_t", F.trim(F.concat_ws(" ", "title", "summary")))
    out = told.select(
        "entry_id",
        "title",
        "url",
        "summary",
        text.detect_language(F.col("title"), F.col("summary"), F.col("_lang"), profiles).alias("lang"),
        parse_or_now(F.col("_p"), now).alias("published_at"),
        now.alias("fetched_at"),
        url.sha1(F.col("url")).alias("url_sha1"),
        hashing.simhash64(F.col("_t")).alias("h"),
    )
    return out.withColumn("valid", F.coalesce(valid_entry(), F.lit(False)))


def near_stored(hashes: DataFrame, stored: DataFrame, distance: int = 3) -> DataFrame:
    """The hashes ``h`` (distinct) that are within the distance of a stored one."""
    return pairs(hashes.select("h"), stored.select("h").distinct(), distance).select(F.col("a").alias("h")).distinct()


def run(entries: DataFrame, stored: DataFrame, recent: DataFrame, distance: int = 3) -> DataFrame:
    """``item_id, outcome`` of a run over (item_id, rank, h, url_sha1), in the order of rank.

    An entry near one of the ``recent`` hashes, or near one inserted earlier in the run, is ``filtered``; one whose URL is
    ``stored``, or was inserted earlier, is ``duplicated``; the others are ``inserted``. Only inserted hashes count for
    later entries, so the outcomes are those of the sequential run.
    """
    rows = cut(entries.select("item_id", "rank", "h", "url_sha1"), "entries")
    near = near_stored(rows.select("h").distinct(), recent, distance).withColumn("_near", F.lit(True))
    known = stored.select("url_sha1").distinct().withColumn("_known", F.lit(True))
    seen = cut(rows.join(near, "h", "left").join(known, "url_sha1", "left"), "seen")
    return decide(seen, distance)


def decide(seen: DataFrame, distance: int = 3) -> DataFrame:
    """``item_id, outcome`` of the written rows (item_id, rank, h, url_sha1, _near, _known), of which it is known whether a
    stored hash is near and whether the URL is stored (else null): the others are scanned among themselves."""
    free = seen.filter("_near is null and _known is null")
    # entries of equal hash and URL share their first one's fate
    nodes = cut(free.groupBy("h", "url_sha1").agg(F.min("rank").alias("rank"), F.min_by("item_id", "rank").alias("node")), "nodes")
    taken = cut(nodes.join(scan(nodes.select("node", "h", F.col("url_sha1").alias("url"), "rank"), distance).filter("taken"), "node").select("node", "h", "url_sha1", "rank"), "taken")
    # of those that were not taken: was it a near hash, inserted before, or else the URL?
    rest = cut(seen.filter("_near is null").join(taken.select(F.col("node").alias("item_id")), "item_id", "left_anti"), "rest")
    first = near_first(rest.select("h").distinct(), taken, distance)
    late = rest.join(first, "h", "left").withColumn("outcome", F.when(F.col("first") < F.col("rank"), "filtered").otherwise("duplicated"))
    return seen.filter("_near").select("item_id", F.lit("filtered").alias("outcome")).unionByName(taken.select(F.col("node").alias("item_id"), F.lit("inserted").alias("outcome"))).unionByName(late.select("item_id", "outcome"))


def near_first(hashes: DataFrame, taken: DataFrame, distance: int) -> DataFrame:
    """``h, first``: the lowest rank of the taken rows (h, rank) within the distance of each hash."""
    side = taken.groupBy("h").agg(F.min("rank").alias("rank"))
    return pairs(hashes.select("h"), side, distance).groupBy(F.col("a").alias("h")).agg(F.min("rank").alias("first"))


def _counts() -> list[Column]:
    count = lambda k: F.count_if(F.col("outcome") == k)
    return [F.count("*").alias("items_total"), count("inserted").alias("items_inserted"), count("duplicated").alias("items_duplicated"), count("filtered").alias("items_simhash_filtered")]


def counters(outcomes: DataFrame) -> DataFrame:
    """One row of a run's counters."""
    return outcomes.agg(*_counts())


def written_outcomes(outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The outcomes as a written table, and the run's counters, which are observed while it is written: no second scan."""
    seen = Observation()
    table = cut(outcomes.observe(seen, *_counts()), "outcomes")
    told = seen.get
    names = [f"items_{k}" for k in ("total", "inserted", "duplicated", "simhash_filtered")]
    return table, outcomes.sparkSession.createDataFrame([tuple(int(told[n]) for n in names)], ", ".join(f"{n} long" for n in names))


# ---- sources: fetches (source_id, status, etag, last_modified), where a status of 0 is a network error


def fetch_outcome(status: Column) -> Column:
    return F.when(status == 304, "not_modified").when(status == 200, "ok").otherwise("error")


def should_retry(status: Column, attempt: Column, most: int = 4) -> Column:
    """Too many requests, server errors and network errors are tried again, ``most`` times in all."""
    return (status.isin(0, 429) | status.between(500, 599)) & (attempt < most)


def retry_seconds(attempt: Column, retry_after: Column, least: float = 0.5, most: float = 4.0, cap: int = 60) -> Column:
    """What a Retry-After header asks for, up to a minute; else twice as long each time, within bounds."""
    asked = F.try_to_number(F.regexp_extract(F.coalesce(retry_after, F.lit("")), r"^\s*(\d{1,9})\s*$", 1), F.lit("999999999")).cast("double")
    backoff = F.least(F.lit(most), F.greatest(F.lit(least), least * F.pow(F.lit(2.0), attempt - 1)))
    return F.coalesce(F.least(asked, F.lit(float(cap))), backoff)


def response_headers(headers: Column, now: Column) -> Column:
    """``struct<etag, last_modified>`` of a response's header map, its keys in lower case: a date in the future is now."""
    etag = F.nullif(F.trim(headers["etag"]), F.lit(""))
    changed = dates.from_micros(dates.parse(headers["last-modified"]))
    return F.struct(etag.alias("etag"), F.when(changed.isNotNull(), F.least(changed, now)).alias("last_modified"))


def checked_sources(sources: DataFrame, fetches: DataFrame, now: Column) -> DataFrame:
    """The sources (id, etag, last_modified, error_count, last_checked_at) after their fetches.

    A success resets the errors and brings new headers where it has some; not modified keeps them; an error counts one
    more. Sources that weren't fetched stay as they are.
    """
    f = fetches.select(F.col("source_id").alias("id"), fetch_outcome(F.col("status")).alias("_o"), F.col("etag").alias("_e"), F.col("last_modified").alias("_m"))
    joined = sources.join(f, "id", "left")
    ok = F.col("_o") == "ok"
    changed = {
        "etag": F.when(ok, F.coalesce("_e", "etag")).otherwise(F.col("etag")),
        "last_modified": F.when(ok, F.coalesce("_m", "last_modified")).otherwise(F.col("last_modified")),
        "error_count": F.when(F.col("_o") == "error", F.col("error_count") + 1).when(F.col("_o").isNotNull(), F.lit(0)).otherwise(F.col("error_count")),
        "last_checked_at": F.when(F.col("_o").isNotNull(), now).otherwise(F.col("last_checked_at")),
    }
    return joined.select(*[changed[c].cast(sources.schema[c].dataType).alias(c) if c in changed else F.col(c) for c in sources.columns])


def run_status(fetches: DataFrame) -> DataFrame:
    """One row: sources by outcome, and the run's status."""
    count = {k: F.count_if(fetch_outcome(F.col("status")) == k) for k in ("ok", "not_modified", "error")}
    told = fetches.agg(*[c.alias(f"sources_{k}") for k, c in count.items()])
    status = F.when((F.col("sources_ok") == 0) & (F.col("sources_error") > 0), "error").when(F.col("sources_error") > 0, "partial_success").otherwise("success")
    return told.withColumn("status", status)


def capped_per_source(items: DataFrame, most: int) -> DataFrame:
    """At most so many items of each source, the newest first: within each task at first, so that no source fills one."""
    return top_by(items, ["source_id"], [F.desc("published_at"), F.col("item_id")], most).drop("_k")
