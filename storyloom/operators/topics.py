"""Topic queries: compiled on the driver to a column, evaluated natively.

A query holds quoted phrases, ``a NEAR/n b`` terms and words joined by AND and OR. In the ``plain`` semantics every phrase
and every NEAR term must hold, whatever joins them, and the rest is read from left to right without precedence; the
parentheses are part of their words. In the ``boolean`` semantics AND binds closer than OR, parentheses group, and
phrases and NEAR terms are operands like any other.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.operators.dedup import top_by

Matcher = Callable[[Column], Column]
_PHRASE = re.compile(r'"([^"]+)"')
_NEAR = re.compile(r"(\w+)\s+NEAR/(\d+)\s+(\w+)", re.IGNORECASE)


@dataclass(frozen=True)
class Atom:
    """What a query is made of: a ``phrase`` or ``term`` of some words, or two words ``near`` each other."""

    kind: str
    words: str
    distance: int = 0
    other: str = ""


#: A query: an atom, "true", "false", or ("and" | "or", queries).
Query = Any


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with the value evaluated once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def phrase(words: str) -> Matcher:
    """A substring, in any case."""
    return lambda text: F.contains(F.lower(text), F.lit(words.lower()))


def term_pattern(word: str) -> str:
    return r"(?iU)\b" + re.sub(r"([^\w\s])", r"\\\1", word) + r"\b"


def term(word: str) -> Matcher:
    """A word with boundaries on both sides, in any case."""
    return lambda text: text.rlike(term_pattern(word))


def alike(w: str) -> list[str]:
    """A word, with and without an s at its end."""
    w = w.lower()
    return [w, w + "s", *([w[:-1]] if w.endswith("s") else [])]


def near_columns(text: Column, a: Column, n: Column, b: Column) -> Column:
    """Whether two of the words between spaces, one of a and one of b, are at most n apart."""
    places = lambda words, some: F.filter(F.transform(words, lambda t, i: F.when(F.array_contains(some, t), i).otherwise(-1)), lambda i: i >= 0)

    def close(words: Column) -> Column:
        return _let(places(words, a), lambda at: _let(places(words, b), lambda to: F.exists(at, lambda i: F.exists(to, lambda j: F.abs(i - j) <= n))))

    return _let(F.split(F.trim(F.lower(text)), r"(?U)\s+"), close)


def near(a: str, n: int, b: str) -> Matcher:
    """Two words at most n apart among the words between spaces; an s at the end of one doesn't count."""
    return lambda text: near_columns(text, F.array(*map(F.lit, alike(a))), F.lit(n), F.array(*map(F.lit, alike(b))))


def _plain(query: str) -> Query:
    phrases = [Atom("phrase", p) for p in _PHRASE.findall(query)]
    rest = _PHRASE.sub(" \0 ", query)
    nears = [Atom("near", a, int(n), b) for a, n, b in _NEAR.findall(rest)]
    rest = _NEAR.sub(" \0 ", rest)
    if not phrases and not nears and not rest.strip():
        return "false"
    parts = re.split(r"\s+(AND|OR)\s+", rest.strip(), flags=re.IGNORECASE)

    def operand(part: str) -> Query:
        part = part.strip()
        if part.replace("\0", "").strip() == "":
            return "true"  # a phrase, a NEAR term or nothing
        return Atom("term", re.sub(r"\s+", " ", part.replace("\0", " ")).strip())

    out = operand(parts[0])
    for op, part in zip(parts[1::2], parts[2::2], strict=True):
        out = (op.lower(), [out, operand(part)])
    return ("and", [*phrases, *nears, out])


def _boolean(query: str) -> Query:
    found = re.findall(r'"[^"]+"|\(|\)|\w+\s+NEAR/\d+\s+\w+|[^\s()"]+', query, flags=re.IGNORECASE)
    at = 0

    def operand() -> Query:
        nonlocal at
        token = found[at] if at < len(found) else ")"
        at += 1
        if token == "(":
            inner = either()
            at += 1
            return inner
        if token.startswith('"'):
            return Atom("phrase", token.strip('"'))
        if m := _NEAR.fullmatch(token):
            return Atom("near", m[1], int(m[2]), m[3])
        words = [token]
        while at < len(found) and found[at].upper() not in ("AND", "OR", "(", ")") and not found[at].startswith('"') and not _NEAR.fullmatch(found[at]):
            words.append(found[at])
            at += 1
        return Atom("term", " ".join(words))

    def chain(op: str, part: Callable[[], Query]) -> Query:
        nonlocal at
        parts = [part()]
        while at < len(found) and found[at].upper() == op:
            at += 1
            parts.append(part())
        return parts[0] if len(parts) == 1 else (op.lower(), parts)

    def both() -> Query:
        return chain("AND", operand)

    def either() -> Query:
        return chain("OR", both)

    return either() if found else "false"


def parse(query: str, semantics: str = "plain") -> Query:
    return {"plain": _plain, "boolean": _boolean}[semantics](query)


def _column(query: Query, text: Column) -> Column:
    if isinstance(query, Atom):
        make = {"phrase": lambda: phrase(query.words), "term": lambda: term(query.words), "near": lambda: near(query.words, query.distance, query.other)}
        return make[query.kind]()(text)
    if isinstance(query, str):
        return F.lit(query == "true")
    return reduce((lambda a, b: a & b) if query[0] == "and" else (lambda a, b: a | b), [_column(q, text) for q in query[1]])


def compile_query(query: str, semantics: str = "plain") -> Matcher:
    """A function from a text column to a boolean column, false for a missing text."""
    tree = parse(query, semantics)
    return lambda text: F.coalesce((text != "") & _column(tree, text), F.lit(False))


@dataclass
class Topic:
    """A topic's settings; keys of a configuration may be spelt in its older ways."""

    name: str
    key: str = ""
    queries: list[str] = field(default_factory=list)
    keywords: list[str] = field(default_factory=list)
    allow_domains: list[str] = field(default_factory=list)
    lang: str | list[str] = ""
    cadence_minutes: int = 60
    max_posts_per_run: int = 20
    enabled: bool = True
    boost_factor: float = 1.0
    min_score: float = 0.1
    priority: float = 1.0

    @classmethod
    def of(cls, spec: dict[str, Any], use_keywords: bool = False) -> Topic:
        known = {k: v for k, v in spec.items() if k in cls.__dataclass_fields__}
        key = spec.get("topic_key") or spec.get("key") or spec["name"].lower().replace(" ", "_")
        cap = spec.get("max_posts_per_run", spec.get("max_per_run", 20))
        topic = cls(**known | {"key": key, "max_posts_per_run": cap})
        if use_keywords and not topic.queries and topic.keywords:
            topic.queries = [" OR ".join(topic.keywords)]
        return topic


def match_text() -> Column:
    """Title and summary, trimmed, joined where they are there."""
    part = lambda c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    return F.concat_ws(" ", part("title"), part("summary"))


def allowed_domain(topic: Topic) -> Column:
    """The host contains an allowed domain; items without URL pass."""
    if not topic.allow_domains:
        return F.lit(True)
    host = F.coalesce(F.col("domain"), F.lit(""))
    return (F.coalesce(F.col("url"), F.lit("")) == "") | reduce(lambda a, b: a | b, [F.contains(host, F.lit(d.lower())) for d in topic.allow_domains])


def language(topic: Topic) -> Column:
    langs = [topic.lang] if isinstance(topic.lang, str) else topic.lang
    langs = [x.lower() for x in langs if x]
    return F.coalesce(F.lower("lang").isin(langs), F.lit(False)) if langs else F.lit(True)


def match_score(topic: Topic, text: Column, semantics: str = "plain") -> Column:
    """The share of the topic's queries that match, times its boost, one at most."""
    if not topic.queries:
        return F.lit(0.0)
    hits = sum((compile_query(q, semantics)(text).cast("int") for q in topic.queries), F.lit(0))
    return F.least(F.lit(1.0), hits / len(topic.queries) * topic.boost_factor)


def match_topics(items: DataFrame, topics: list[Topic], semantics: str = "plain", cap: bool = True) -> DataFrame:
    """``item_id, topic_key, score, rank`` of the items that each enabled topic takes: all topics in one pass."""
    on = [t for t in topics if t.enabled]
    each = F.array(*[F.struct(F.lit(t.key).alias("topic_key"), F.when(allowed_domain(t) & language(t), match_score(t, match_text(), semantics)).otherwise(0.0).alias("score"), F.lit(t.min_score).cast("double").alias("_least"), F.lit(t.max_posts_per_run).alias("_cap")) for t in on])
    found = items.select("item_id", F.explode(F.filter(each, lambda m: (m["score"] >= m["_least"]) & (m["score"] > 0))).alias("m")).select("item_id", "m.*")
    if not cap:
        return found.select("item_id", "topic_key", "score")
    # the highest cap is a literal, so that tasks cut their rows down before a topic's rows meet
    most = max((t.max_posts_per_run for t in on), default=0)
    return top_by(found, ["topic_key"], [F.desc("score"), F.col("item_id")], most, "rank").filter(F.col("rank") <= F.col("_cap")).select("item_id", "topic_key", "score", "rank")


def run_topics(items: DataFrame, topics: list[Topic], last_runs: DataFrame, now: Column, semantics: str = "plain") -> DataFrame:
    """``topic_key, enabled, due, items_matched, clusters_updated, least, mean, most, processed, skip_reason`` of every topic.

    A topic that isn't due (or is off) is skipped, and so is one without items. ``clusters_updated`` is the sorted list of
    the clusters of its items; ``least``, ``mean`` and ``most`` are those of its scores. All topics are matched in one pass.
    """
    told = items.sparkSession.createDataFrame([(t.key, t.enabled, t.cadence_minutes) for t in topics], "topic_key string, enabled boolean, cadence_minutes int")
    gated = told.join(last_runs.select("topic_key", "last_run"), "topic_key", "left").withColumn("due", due(F.col("last_run"), now))
    capped = match_topics(items, topics, semantics)
    hits = capped.join(items.select("item_id", "cluster_id"), "item_id")
    sums = hits.groupBy("topic_key").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("cluster_id")).alias("c"), F.min("score").alias("least"), F.avg("score").alias("mean"), F.max("score").alias("most"))  # capped rows
    joined = gated.join(sums, "topic_key", "left")
    ran = F.col("due") & (F.coalesce("n", F.lit(0)) > 0)
    none = F.array().cast("array<bigint>")
    return joined.select(
        "topic_key",
        "enabled",
        "due",
        F.when(F.col("due"), F.coalesce("n", F.lit(0))).otherwise(0).alias("items_matched"),
        F.when(ran, F.col("c").cast("array<bigint>")).otherwise(none).alias("clusters_updated"),
        *[F.when(ran, F.col(c)).alias(c) for c in ("least", "mean", "most")],
        ran.alias("processed"),
        F.when(~F.col("due"), "cadence_not_met").when(~ran, "no_matching_items").alias("skip_reason"),
    )


def run_summary(runs: DataFrame) -> DataFrame:
    """One row over the topics of a run: how many, processed, items, distinct clusters."""
    clusters = F.size(F.array_distinct(F.flatten(F.collect_list("clusters_updated"))))  # a row per topic
    return runs.agg(F.count("*").alias("total_topics"), F.count_if("processed").alias("topics_processed"), F.sum("items_matched").alias("total_items_matched"), clusters.alias("total_clusters_updated"))


def clusters_by_topic(hits: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """``topic_key, id, leader, similarity``: leader clusters of each topic's items alone.

    ``hits`` is (topic_key, item_id, rank), capped, so a topic's vectors are some dozens and are scanned in one task.
    """
    from storyloom.operators.cluster import scan_group

    rows = hits.join(vectors.select(F.col("id").alias("item_id"), "v"), "item_id").select("topic_key", F.col("item_id").alias("id"), "rank", "v")
    return rows.groupBy("topic_key").applyInPandas(lambda key, pdf: scan_group(pdf, threshold).assign(topic_key=key[0])[["topic_key", "id", "leader", "similarity"]], "topic_key string, id long, leader long, similarity double")


def keyword_relevance(items: DataFrame, keywords: list[str]) -> DataFrame:
    """``cluster_id, relevance``: hits (half as much again in the title) over keywords, mean over items with text."""
    title, text = F.lower(F.coalesce("title", F.lit(""))), F.lower(match_text())
    hits = sum((F.when(F.contains(text, F.lit(k.lower())), 1.0 + F.when(F.contains(title, F.lit(k.lower())), 0.5).otherwise(0.0)).otherwise(0.0) for k in keywords), F.lit(0.0))
    return items.filter(match_text() != "").groupBy("cluster_id").agg(F.avg(F.least(F.lit(1.0), hits / len(keywords))).alias("relevance"))


def due(last_run: Column, now: Column) -> Column:
    """Of (enabled, cadence_minutes) and a last run: enabled, and never run or not within the cadence."""
    return F.col("enabled") & F.coalesce(F.timestamp_diff("SECOND", last_run, now) >= F.col("cadence_minutes") * 60, F.lit(True))
