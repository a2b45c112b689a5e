"""Very many topics against items by an index of their terms.

Every query is a set of clauses, each a set of atoms that must hold (queries have no negation). An item's words are looked
up in the index of all atoms' words, and its text is searched for all phrases at once, so that only the atoms that may
hold are tried, each by the expression that the plain match uses. A clause is looked up by one of its atoms, the one that
the fewest clauses have, and its other atoms are looked for among those that hold. All of this happens within an item's
row, so that nothing is shuffled but an item's topics where they are ranked, and equal items stay apart. The plan has the
same size for any number of topics, and the work follows the hits. Topics are configuration: they go to all tasks.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import product

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.operators.dedup import top_by
from storyloom.operators.topics import Atom, Query, Topic, alike, compile_query, match_text, near_columns, parse, term_pattern

#: Clauses that a query may have; one with more is tried as an expression of its own.
CLAUSES = 256
#: Items that are looked at together.
STEP = 1000
_RUN = re.compile(r"\w+")


def clauses(query: Query, most: int = CLAUSES) -> set[frozenset[Atom]] | None:
    """The sets of atoms any of which makes a query true; None if there are too many."""
    if isinstance(query, Atom):
        return {frozenset([query])}
    if isinstance(query, str):
        return {frozenset()} if query == "true" else set()
    parts = [clauses(q, most) for q in query[1]]
    if any(p is None for p in parts):
        return None
    if query[0] == "or":
        out = set().union(*parts)
    else:
        out = {frozenset()}
        for p in parts:
            if len(out) * len(p) > most * most:
                return None
            out = {a | b for a, b in product(out, p)}
    out = {c for c in out if not any(d < c for d in out)}
    return out if len(out) <= most else None


def folded(text: str) -> str:
    """Letters of one shape for all their cases, at least those that a pattern takes for equal."""
    return text.replace("İ", "i").upper().lower()


def keys_of(atom: Atom) -> tuple[list[str], list[str]]:
    """Words one of which a text must have, as a whole, for the atom to hold, and further ones one of which it must have too.

    Longer words come first, as they are in fewer texts; a phrase has none."""
    if atom.kind == "term":
        runs = sorted(_RUN.findall(folded(atom.words)), key=len)
        return runs[-1:] or [""], runs[:1] if len(runs) > 1 else []
    if atom.kind == "near":
        short, long = sorted(([folded(w) for w in alike(x)] for x in (atom.words, atom.other)), key=lambda w: len(w[0]))
        return long, short
    return [], []


_ATOM = pa.struct({"atom": pa.int32(), "kind": pa.string(), "pattern": pa.string(), "some": pa.list_(pa.string()), "distance": pa.int32(), "others": pa.list_(pa.string())})


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b.slice(i, STEP) for b in batches for i in range(0, b.num_rows, STEP))


def _lists(places: list[list[int]], table: pa.Array) -> pa.Array:
    """The table's rows at each list of places."""
    ends = np.cumsum([0, *map(len, places)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), table.take(pa.array([n for ns in places for n in ns], pa.int32())))


def match_topics(items: DataFrame, topics: list[Topic], semantics: str = "plain", cap: bool = True) -> DataFrame:
    """``item_id, topic_key, score, rank`` as :func:`topics.match_topics` gives them, for any number of topics.

    Topics are known by their place, so that keys may repeat."""
    spark = items.sparkSession
    on = [t for t in topics if t.enabled]
    atoms: dict[Atom, int] = {}
    found, wide = [], []  # (atoms of a clause, query), and queries of too many clauses
    topic_of = []
    for k, t in enumerate(on):
        for q in t.queries:
            each = clauses(parse(q, semantics))
            if each is None:
                wide.append((len(topic_of), q))
            found += [(frozenset(atoms.setdefault(a, len(atoms)) for a in c), len(topic_of)) for c in each or ()]
            topic_of.append(k)
    words, phrases = defaultdict(list), defaultdict(list)
    always = []
    for a, n in atoms.items():
        if a.kind == "phrase":
            phrases[a.words.lower()].append(n)
        else:
            first, also = keys_of(a)
            for key in first:
                (words[key].append((n, frozenset(also))) if key else always.append(n))
    shared = Counter(n for c, _ in found for n in c)
    by_atom, free = defaultdict(list), [q for c, q in found if not c]
    for c, q in found:
        if c:
            key = min(c, key=lambda n: (shared[n], n))
            by_atom[key].append((c - {key}, q))
    told = [{"atom": n, "kind": a.kind, "pattern": a.words.lower() if a.kind == "phrase" else term_pattern(a.words) if a.kind == "term" else "", "some": alike(a.words), "distance": a.distance, "others": alike(a.other) if a.other else []} for a, n in atoms.items()]

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for p, ns in phrases.items():
            automaton.add_word(p, ns)
        if phrases:
            automaton.make_automaton()
        table = pa.array(told, _ATOM)
        for part in _steps(batches):
            out = []
            for text, low in zip(part.column("text").to_pylist(), part.column("low").to_pylist(), strict=True):
                hit = set(always)
                own = set(_RUN.findall(folded(text)))
                for w in words.keys() & own:
                    hit.update(n for n, also in words[w] if not also or not own.isdisjoint(also))
                if phrases:
                    for _, ns in automaton.iter(low):
                        hit.update(ns)
                out.append(sorted(hit))
            yield pa.record_batch([part.column(c) for c in ("text", *own_columns)] + [_lists(out, table)], ["text", *own_columns, "atoms"])

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _steps(batches):
            at, topic, n = [], [], []
            for i, (have, more) in enumerate(zip(part.column("atoms").to_pylist(), part.column("wide").to_pylist(), strict=True)):
                holds = set(have)
                queries = {q for a in holds & by_atom.keys() for rest, q in by_atom[a] if rest <= holds}.union(free, more)
                for k, times in Counter(topic_of[q] for q in queries).items():
                    at.append(i)
                    topic.append(k)
                    n.append(times)
            rows = part.select(own_columns).take(pa.array(at, pa.int32()))
            yield pa.record_batch([*rows.columns, pa.array(topic, pa.int32()), pa.array(n, pa.int64())], [*own_columns, "topic", "n"])

    text, t = match_text(), F.col("text")
    held = items.select("item_id", text.alias("text"), F.lower(text).alias("low"), F.lower("lang").alias("lang"), F.coalesce("domain", F.lit("")).alias("domain"), (F.coalesce(F.col("url"), F.lit("")) == "").alias("no_url")).filter("text <> ''")
    own_columns = ["item_id", "lang", "domain", "no_url"]
    own = f"item_id {dict(held.dtypes)['item_id']}, lang string, domain string, no_url boolean"

    def holds(a: Column) -> Column:
        is_term = F.when(a["kind"] == "term", F.rlike(t, a["pattern"])).otherwise(near_columns(t, a["some"], a["distance"], a["others"]))
        return F.when(a["kind"] == "phrase", F.contains(F.lower(t), a["pattern"])).otherwise(is_term)

    tried = held.mapInArrow(candidates, f"text string, {own}, atoms array<struct<atom: int, kind: string, pattern: string, some: array<string>, distance: int, others: array<string>>>")
    each = F.array_compact(F.array(*[F.when(compile_query(q, semantics)(t), n) for n, q in wide])) if wide else F.array()
    true = tried.select(*own_columns, F.transform(F.filter("atoms", holds), lambda a: a["atom"]).alias("atoms"), each.cast("array<int>").alias("wide"))
    counted = true.mapInArrow(counts, f"{own}, topic int, n long")
    conf = [(k, x.key, len(x.queries), float(x.boost_factor), float(x.min_score), x.max_posts_per_run, [d.lower() for d in x.allow_domains], [v.lower() for v in ([x.lang] if isinstance(x.lang, str) else x.lang) if v]) for k, x in enumerate(on)]
    topic = spark.createDataFrame(conf, "topic int, topic_key string, queries int, boost double, least double, cap int, domains array<string>, langs array<string>")
    score = F.least(F.lit(1.0), F.col("n") / F.col("queries") * F.col("boost"))
    allowed = (F.size("domains") == 0) | F.col("no_url") | F.exists("domains", lambda d: F.contains(F.col("domain"), d))
    spoken = (F.size("langs") == 0) | F.coalesce(F.array_contains("langs", F.col("lang")), F.lit(False))
    hits = counted.join(F.broadcast(topic), "topic").filter(allowed & spoken).withColumn("score", score).filter("score >= least and score > 0")
    if not cap:
        return hits.select("item_id", "topic_key", "score")
    most = max((x.max_posts_per_run for x in on), default=0)
    return top_by(hits, ["topic"], [F.desc("score"), F.col("item_id")], most, "rank").filter(F.col("rank") <= F.col("cap")).select("item_id", "topic_key", "score", "rank")
