"""Exact token counts of every prefix of a text, so that later questions about budgets need no tokenizer.

A piece of the pattern is decided by prefix dynamic programming: the last token of a prefix is the one token that ends
there and goes together with the last token of the prefix before it (two tokens go together if their joined bytes are
encoded as these two), and the prefix has one token more than the one before it. Tokens that end at a place are found in
a trie of reversed tokens. So one pass from left to right counts all prefixes, whatever the length of the piece.

What is stored for a text is how the count changes from one code point to the next (``steps``): small numbers that
Parquet packs into a few bits. Prefixes that end where the pattern would cut otherwise are counted as they are cut:
after the first blank of a piece that follows blanks, within a contraction, and within a special token.

The work per distinct piece of a stretch of documents is done once (:mod:`storyloom.llm.pieces`); nothing is shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import pieces
from .packing import _vocabulary

#: Pairs of tokens whose answer a worker remembers.
PAIRS = 400_000


@lru_cache(2)
def special_tokens(path: str) -> dict[str, int]:
    """The special tokens of a tokenizers file, which are found in texts before the pattern cuts."""
    with open(path, encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added) or len(added) > 1:
        raise ValueError("one special token at most, found as it is written")
    return {t["content"]: t["id"] for t in added}


class Prefixes:
    """Counts the tokens of all prefixes of a piece."""

    def __init__(self, vocabulary: dict[bytes, int], pattern: str) -> None:
        self.pattern = regex.compile(pattern)
        self.bytes_of = {i: t for t, i in vocabulary.items()}
        self.size = max(vocabulary.values()) + 1
        self.merged = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=vocabulary, special_tokens={})._encode_single_piece
        self.child: dict[int, int] = {}
        self.token = [-1]
        for word, i in vocabulary.items():
            if self.merged(word) != [i]:
                continue  # no text is encoded as this token
            node = 0
            for b in reversed(word):
                key = node << 8 | b
                if key not in self.child:
                    self.child[key] = len(self.token)
                    self.token.append(-1)
                node = self.child[key]
            self.token[node] = i
        self.pairs: dict[int, bool] = {}

    def _together(self, a: int, b: int) -> bool:
        """Whether two tokens stand beside each other in the encoding of their joined bytes."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        known = self.pairs[a * self.size + b] = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def counts(self, word: bytes) -> list[int]:
        """The count of tokens of each prefix of a piece, by bytes; the first is that of no byte."""
        child, token, known, size = self.child, self.token, self.pairs.get, self.size
        last, count = [-1], [0]
        for i in range(1, len(word) + 1):
            node, j = 0, i
            while j:
                j -= 1
                node = child.get(node << 8 | word[j])
                if node is None:
                    raise ValueError("the vocabulary doesn't make this piece")
                t = token[node]
                if t >= 0:
                    if not j:
                        break
                    good = known(last[j] * size + t)
                    if good or (good is None and self._together(last[j], t)):
                        break
            last.append(t)
            count.append(count[j] + 1)
        return count

    def steps(self, word: bytes) -> list[int]:
        """How the count changes with each code point of a piece. Part of a contraction is cut as a quote and a letter."""
        count = self.counts(word)
        if len(word) == 3 and word[:1] == b"'" and len(self.pattern.findall(word[:2].decode(errors="replace"))) == 2:
            count[2] = count[1] + 1
        if not word.isascii():  # a prefix ends before a byte that begins a code point, or at the end
            count = [0, *(count[k] for k in range(1, len(word)) if word[k] & 0xC0 != 0x80), count[-1]]
        return [b - a for a, b in zip(count, count[1:], strict=False)]

    def total(self, text: str) -> int:
        """The count of tokens of a short text, cut by the pattern."""
        return sum(self.counts(p.encode())[-1] for p in self.pattern.findall(text))


_MADE: dict[tuple[str, str], Prefixes] = {}


def _prefixes(path: str, pattern: str, vocabulary: dict[bytes, int]) -> Prefixes:
    """One per Python worker: the file itself is read by the driver alone."""
    if (path, pattern) not in _MADE:
        _MADE.clear()
        _MADE[path, pattern] = Prefixes(vocabulary, pattern)
    return _MADE[path, pattern]


def _cut(text: Column, pattern: str, special: str | None) -> Column:
    """The pieces of a text, special tokens among them."""
    each = lambda part: F.regexp_extract_all(part, F.lit(f"(?U){pattern}"), F.lit(0))
    if special is None:
        return each(text)
    quoted = "\\Q" + special + "\\E"
    parts = F.flatten(F.transform(F.split(text, quoted, -1), lambda part: F.concat(each(part), F.array(F.lit(special)))))
    return F.when(F.contains(text, F.lit(special)), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(each(text))


def prefix_steps(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", most: int = pieces.MOST) -> DataFrame:
    """``doc_id, n_bytes, steps``: element k of ``steps`` is what the k-th code point adds to the count of tokens.

    The tokens are those of a byte-level tokenizers file without normaliser, special tokens in a text counted as the library
    does by default (one each), none added. The sum of the first k steps is the count of the text's first k code points
    taken alone. A null or empty text has no steps; a null doc_id stays null; equal rows give equal rows; an empty table
    gives no rows; other columns are not read. A text of any length is worked on whole.
    """
    vocabulary, special = _vocabulary(path), next(iter(special_tokens(path)), None)
    special_bytes = special.encode() if special is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _prefixes(path, pattern, vocabulary)
        numbers, runs, stretch = pieces.Numbers(most), pieces.Runs(), 0
        blank, lead, tokens = (np.zeros(0, bool), np.zeros(0, bool), np.zeros(0, np.int64))
        words: list[bytes] = []
        for b in batches:
            values, lengths = pieces.flat(b.column(1))
            refs, fresh = numbers.number(values)
            if numbers.stretch != stretch:
                runs.clear()
                blank, lead, tokens, words, stretch = blank[:0], lead[:0], tokens[:0], [], numbers.stretch
            new = [w.encode() for w in fresh.to_pylist()]
            # what a special token adds to each of its prefixes depends on what stands before it: its steps are set below
            each = [[1] + [0] * (len(w) - 1) if w == special_bytes else made.steps(w) for w in new]
            runs.add(np.fromiter(chain.from_iterable(each), np.int32), np.fromiter(map(len, each), np.int64, len(each)))
            words += new
            # a blank is one of Unicode, as in the pattern
            lead = np.r_[lead, pc.match_substring_regex(fresh, r"^[\s\p{Z}\x0b\x85]").to_numpy(zero_copy_only=False)].astype(bool)
            blank = np.r_[blank, pc.match_substring_regex(fresh, r"^[\s\p{Z}\x0b\x85]+$").to_numpy(zero_copy_only=False)].astype(bool)
            tokens = np.r_[tokens, np.fromiter(map(sum, each), np.int64, len(each))]
            steps, n = pieces.gather(refs, *runs.tables())
            steps = steps.copy()
            ends = np.cumsum(n)
            of = np.repeat(np.arange(b.num_rows), lengths)
            follows = np.r_[False, of[1:] == of[:-1]] if len(of) else np.zeros(0, bool)
            at = np.flatnonzero(follows & lead[refs] & np.r_[False, blank[refs[:-1]]]) if len(of) else []
            for i in at:  # a text that ends after the first blank of this piece ends in one run of blanks
                first = words[refs[i]].decode()[0]
                more = made.counts(words[refs[i - 1]] + first.encode())[-1] - int(tokens[refs[i - 1]]) - int(steps[ends[i] - n[i]])
                steps[ends[i] - n[i]] += more
                steps[ends[i] - n[i] + 1] -= more
            if special is not None:
                for i in np.flatnonzero(pc.equal(values, special).to_numpy(zero_copy_only=False)):
                    before = words[refs[i - 1]].decode() if follows[i] and words[refs[i - 1]].decode() != special else ""
                    had = int(tokens[refs[i - 1]]) if before else 0
                    inner = [made.total(before + special[:k]) - had for k in range(1, len(special))]
                    steps[ends[i] - n[i] : ends[i]] = np.diff([0, *inner, 1])
            bounds = np.r_[0, ends][np.r_[0, np.cumsum(lengths)]]
            sizes = np.r_[0, np.cumsum(pc.binary_length(values).to_numpy(zero_copy_only=False))][np.r_[0, np.cumsum(lengths)]]
            yield pa.record_batch(
                [b.column(0), pa.array(np.diff(sizes).astype(np.int64)), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(steps))], ["doc_id", "n_bytes", "steps"]
            )

    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.select(F.col(id_col).cast("long").alias("doc_id"), _cut(text, pattern, special).alias("pieces"))
    return split.mapInArrow(run, "doc_id long, n_bytes long, steps array<int>")


def tokens_of_first(chars: Column, steps: Column | None = None) -> Column:
    """How many tokens the first code points of a stored text have."""
    return F.aggregate(F.slice(F.col("steps") if steps is None else steps, F.lit(1), chars), F.lit(0), lambda a, b: a + b)


def within(stored: DataFrame, budget: int) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit, fitting_chars`` of stored texts: is the whole text over the budget, and how
    many code points may a prefix have at most that isn't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, lengths = pieces.flat(b.column(2))
            ends = np.cumsum(lengths)
            total = np.cumsum(values.to_numpy(zero_copy_only=False), dtype=np.int64)
            all_ = np.r_[0, total][ends]
            base = np.r_[0, all_[:-1]]
            fits = np.zeros(b.num_rows, np.int64)
            good = np.flatnonzero(total <= np.repeat(base, lengths) + budget)
            row = np.repeat(np.arange(b.num_rows), lengths)[good]
            fits[row] = good - (ends - lengths)[row] + 1  # the last one of a row stays
            n = all_ - base
            yield pa.record_batch([b.column(0), b.column(1), pa.array(n), pa.array(n > budget), pa.array(fits)], ["doc_id", "n_bytes", "n_tokens", "over_limit", "fitting_chars"])

    return stored.select("doc_id", "n_bytes", "steps").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fitting_chars long")
