import random

import public_tokenizers
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from storyloom.llm import token_counts
from storyloom.llm.packing import _vocabulary

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, steps int, pieces string"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


TEXTS = [
    None,
    "",
    " ",
    "x",
    "it's they're we'll I've 'rest 'l 've'll",
    "a  b\n\nc \t d   \n e ",
    "foo  <|endoftext|>bar!!<|endoftext|><|endoftext|> <|endof<|endoftext|>'<|endoftext|>",
    "<|endoftext|>",
    "naïve 🙂🙂 日本語テキスト  x \x1c\x1d y",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 3 + " " * 70 + "-" * 90,
]


def stored(spark, texts, most=400_000):
    rows = spark.createDataFrame([(i, t, 3, "own") for i, t in enumerate(texts)], SCHEMA).repartition(2)
    return token_counts.prefix_steps(rows, PATH, PATTERN, most=most)


@pytest.mark.parametrize("most", [400_000, 5])
def test_every_prefix_by_the_library(spark, library, most):
    rng = random.Random(3)
    more = ["".join(rng.choice(["'", "re", "ll", " ", "  ", "\n", "<|", "endoftext", "|>", "<|endoftext|>", "é", "the", "Ġ", "12", "!", "zq"]) for _ in range(14)) for _ in range(40)]
    texts = TEXTS + more
    for r in stored(spark, texts, most).collect():
        text, total = texts[r.doc_id] or "", 0
        assert len(r.steps) == len(text) and r.n_bytes == len(text.encode())
        for k, step in enumerate(r.steps, 1):
            total += step
            assert total == library(text[:k]), (text, k)


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.one_of(st.text("abeinorst", max_size=30), st.text(max_size=12)))
def test_prefixes_of_any_piece(library, text):
    made = token_counts._prefixes(PATH, PATTERN, _vocabulary(PATH))
    for piece in made.pattern.findall(text):
        total = 0
        for k, step in enumerate(made.steps(piece.encode()), 1):
            total += step
            assert total == library(piece[:k])


def test_budgets_and_truncation(spark, library):
    texts = [*TEXTS, "word " * 3000, " ".join(f"w{i}" for i in range(700))]
    for budget in (0, 3, 40, 1024):
        for r in token_counts.within(stored(spark, texts), budget).collect():
            text = texts[r.doc_id] or ""
            assert (r.n_tokens, r.over_limit) == (library(text), library(text) > budget)
            assert library(text[: r.fitting_chars]) <= budget
            if len(text) < 500:
                assert r.fitting_chars == max(k for k in range(len(text) + 1) if library(text[:k]) <= budget)
    asked = stored(spark, texts).select("doc_id", token_counts.tokens_of_first(F.lit(9)).alias("k")).collect()
    assert {r.doc_id: r.k for r in asked} == {i: library((t or "")[:9]) for i, t in enumerate(texts)}


def test_long_text_and_repeats(spark, library):
    long = "".join(random.Random(1).choice("abcdefgh \n") for _ in range(300_000)) + "x" * 100_000
    found = token_counts.within(stored(spark, [long, long, "b"]), 10).collect()
    assert {r.doc_id: r.n_tokens for r in found} == {0: library(long), 1: library(long), 2: 1}


def test_nulls_and_empty_table(spark):
    rows = spark.createDataFrame([(None, None), (None, "two words")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_tokens) for r in token_counts.within(token_counts.prefix_steps(rows, PATH, PATTERN), 1).collect()) == [(None, 0), (None, 2)]
    assert token_counts.prefix_steps(rows.limit(0), PATH, PATTERN).count() == 0
