"""The term index of topics against the plain match."""

import random

import pytest

from storyloom.operators import topic_index, topics
from storyloom.operators.topics import Atom, Topic

WORDS = ["rain", "Rains", "sea", "party", "art", "the", "of", "c++", "x-ray", "Straße", "éA", "İst", "two_words", "42", "K", "ſet", " "]


def query(rng):
    def operand():
        k = rng.randrange(4)
        w = rng.choice(WORDS)
        if k == 0:
            return f'"{rng.choice(["art", "he s", "of the", "x-r", w])}"'
        if k == 1:
            return f"{rng.choice(['rain', 'sea', 'party'])} NEAR/{rng.randrange(4)} {rng.choice(['art', 'arts', 'rains', 'the'])}"
        return w if k == 2 else f"{w} {rng.choice(WORDS)}"

    out = operand()
    for _ in range(rng.randrange(3)):
        out += f" {rng.choice(['AND', 'OR', 'and'])} {operand()}"
    return out


@pytest.fixture(scope="module")
def items(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(12))), rng.choice([None, "", "rain, art. SEA"]), rng.choice(["en", "ES", None]), rng.choice(["a.org", "b.com", None]), rng.choice(["http://a.org/1", "", None])) for i in range(80)]
    rows += [(80, None, None, "en", "a.org", ""), (81, "", "", "en", "a.org", "x")]
    return spark.createDataFrame(rows, "item_id long, title string, summary string, lang string, domain string, url string").cache()


@pytest.mark.parametrize("semantics", ["plain", "boolean"])
@pytest.mark.parametrize("cap", [True, False])
def test_as_the_plain_match(items, semantics, cap):
    rng = random.Random(7)
    conf = [Topic(f"t{i}", f"t{i}", queries=[query(rng) for _ in range(rng.randrange(4))], lang=rng.choice(["", "en", ["es", "EN"]]), allow_domains=rng.choice([[], ["A.org"]]), max_posts_per_run=rng.choice([2, 50]), boost_factor=rng.choice([1.0, 2.5]), min_score=rng.choice([0.1, 0.5]), enabled=i % 7 != 3) for i in range(40)]
    columns = ["item_id", "topic_key", "score"] + ["rank"] * cap
    rows = lambda df: sorted(tuple(r) for r in df.select(columns).collect())
    want = rows(topics.match_topics(items, conf, semantics, cap))
    assert len(want) > 50 and rows(topic_index.match_topics(items, conf, semantics, cap)) == want


def test_queries_of_too_many_clauses(items, monkeypatch):
    monkeypatch.setattr(topic_index.clauses, "__defaults__", (2,))
    conf = [Topic("a", "a", queries=["rain OR sea OR art OR party", "rain"]), Topic("b", "b", queries=["(rain OR sea) AND (art OR the)"])]
    rows = lambda df: sorted(tuple(r) for r in df.select("item_id", "topic_key", "score").collect())
    assert rows(topic_index.match_topics(items, conf, "boolean", False)) == rows(topics.match_topics(items, conf, "boolean", False)) != []


def test_clauses():
    a, b, c = (Atom("term", x) for x in "abc")
    assert topic_index.clauses(("and", [("or", [a, b]), ("or", [a, c])])) == {frozenset([a]), frozenset([b, c])}
    assert topic_index.clauses("false") == set() and topic_index.clauses("true") == {frozenset()}
    wide = ("and", [("or", [Atom("term", f"{i}x"), Atom("term", f"{i}y")]) for i in range(20)])
    assert topic_index.clauses(wide) is None


def test_the_plan_does_not_grow(items):
    def size(n):
        conf = [Topic(f"t{i}", f"t{i}", queries=[f"rain AND sea{i}", f'"art {i}"']) for i in range(n)]
        return topic_index.match_topics(items, conf)._jdf.queryExecution().optimizedPlan().treeString().count("\n")

    assert size(1000) == size(2)
    many = [Topic(f"t{i}", f"t{i}", queries=[f"rain AND q{i}"]) for i in range(999)] + [Topic("r", "r", queries=["rain"])]
    assert {r.topic_key for r in topic_index.match_topics(items, many).collect()} == {"r"}
    assert topic_index.match_topics(items.limit(0), many).count() == 0
