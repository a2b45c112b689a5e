"""Feeds and configuration as data: fetched bodies, YAML catalogues, JSON inside text."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.operators.topics import Topic

ITEM = "struct<title:string,link:string,description:string,pubDate:string,guid:string>"
RSS = f"channel struct<title:string,item:array<{ITEM}>>"
ENTRY = "struct<title:string,link:array<struct<_href:string>>,summary:string,published:string,updated:string,id:string>"
ATOM = f"title string, entry array<{ENTRY}>"


def entries(bodies: DataFrame, id_col: str, body_col: str) -> DataFrame:
    """``id, place, title, link, summary, published`` of the entries of RSS or Atom bodies; a broken body has none.

    An Atom entry's first link counts; its date is that of publication or else of the last change.
    """
    rss = F.from_xml(F.col(body_col), RSS)["channel"]["item"]
    atom = F.from_xml(F.col(body_col), ATOM)["entry"]
    as_rows = F.transform(rss, lambda e: F.struct(e["title"].alias("title"), e["link"].alias("link"), e["description"].alias("summary"), e["pubDate"].alias("published")))
    of_atom = F.transform(atom, lambda e: F.struct(e["title"].alias("title"), F.get(e["link"], F.lit(0))["_href"].alias("link"), e["summary"].alias("summary"), F.coalesce(e["published"], e["updated"]).alias("published")))
    found = bodies.filter(F.coalesce(F.trim(F.col(body_col)), F.lit("")) != "").select(F.col(id_col).alias("id"), F.posexplode(F.coalesce(as_rows, of_atom)).alias("place", "e"))
    return found.select("id", "place", "e.*")


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """``id, body`` of fetched feeds: every file of a folder whole, by its path. Fetching itself is not Spark's."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("id"), F.col("value").alias("body"))


def embedded_json(text: Column, schema: str) -> Column:
    """What stands between a text's first and last brace, as JSON; null if that can't be read."""
    return F.from_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1), schema)


def _yaml(path: str) -> dict[str, Any]:
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML takes the yaml package") from e
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def load_sources(spark: SparkSession, path: str) -> DataFrame:
    """``name, type, url, lang, active`` of a catalogue's sources; a record without URL is left out."""
    rows = [(s.get("name") or s["url"], s.get("type", "rss"), s["url"], s.get("lang", "en"), bool(s.get("active", True))) for s in _yaml(path).get("sources") or [] if s.get("url")]
    return spark.createDataFrame(rows, "name string, type string, url string, lang string, active boolean")


def load_topics(path: str, enabled_only: bool = False, use_keywords: bool = False) -> list[Topic]:
    """A catalogue's topics; none if it has no such section."""
    found = [Topic.of(t, use_keywords) for t in _yaml(path).get("topics") or []]
    return [t for t in found if t.enabled or not enabled_only]


def find_topic(topics: list[Topic], name: str) -> Topic | None:
    return next((t for t in topics if t.name.lower() == name.lower()), None)


def conditional_headers(etag: Column, last_modified: Column, now: Column) -> Column:
    """Headers of a conditional request; a date in the future counts as now."""
    when = F.date_format(F.when(last_modified.isNotNull(), F.least(last_modified, now)), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    return F.map_filter(F.create_map(F.lit("If-None-Match"), F.trim(etag), F.lit("If-Modified-Since"), when), lambda _, v: F.coalesce(v, F.lit("")) != "")
