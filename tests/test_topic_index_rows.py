"""The term index of topics: work within rows, and equal items."""

import pytest

from storyloom.operators import topic_index, topics
from storyloom.operators.topics import Topic


@pytest.fixture(scope="module")
def items(spark):
    rows = [(i // 2, f"of the sea {i // 2}", "rain in the art", "en", "a.org", "http://a.org/1") for i in range(60)]
    return spark.createDataFrame(rows, "item_id long, title string, summary string, lang string, domain string, url string").repartition(4)


def test_clauses_of_common_words_are_not_shuffled(items):
    """A thousand topics share two words that every item has; nothing of them leaves an item's row."""
    conf = [Topic(f"t{i}", f"t{i}", queries=[f'the AND "no {i} such" AND of']) for i in range(1000)] + [Topic("r", "r", queries=["rain AND of"])]
    found = topic_index.match_topics(items, conf, cap=False)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Generate" not in plan
    assert found.count() == 60


def test_equal_items_stay_apart(items):
    conf = [Topic("a", "a", queries=["rain OR sea", '"of the" AND art', "none"]), Topic("b", "b", queries=["in NEAR/1 the"])]
    rows = lambda df: sorted(tuple(r) for r in df.select("item_id", "topic_key", "score").collect())
    got = rows(topic_index.match_topics(items, conf, cap=False))
    assert got == rows(topics.match_topics(items, conf, cap=False)) and len(got) == 120
