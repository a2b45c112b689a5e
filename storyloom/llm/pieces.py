"""Distinct text pieces, numbered as a partition streams by.

Splitting is Catalyst's (a regular expression in the JVM). Python then sees each partition's pieces as Arrow
dictionaries, so that whatever is done per word is done once per distinct word of a stretch, and results are gathered
back per document by vector operations. Nothing is shuffled, and a stretch ends before its dictionary outgrows
``MOST`` words, so that memory is bounded whatever a partition holds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that one stretch's dictionary holds.
MOST = 400_000


def split(docs: DataFrame, pattern: str, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, pieces``: the matches of a Unicode-aware pattern in every whole text (null: none)."""
    found: Column = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(f"(?U){pattern}"), F.lit(0))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), found.alias("pieces"))


def flat(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """A list column's values, and the number of them in each row."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    return column.flatten(), np.nan_to_num(lengths).astype(np.int64)


def gather(refs: np.ndarray, starts: np.ndarray, lengths: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``values`` that ``refs`` name, one after another; and how long each is."""
    n = lengths[refs]
    ends = np.cumsum(n)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts[refs] - (ends - n), n)
    return values[at], n


class Runs:
    """A growing table of integer runs."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self._values, self._lengths, self._done = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], None

    def add(self, values: np.ndarray, lengths: np.ndarray) -> None:
        if len(lengths):
            self._values.append(values)
            self._lengths.append(lengths)
            self._done = None

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self._done is None:
            self._values, self._lengths = [np.concatenate(self._values)], [np.concatenate(self._lengths)]
            self._done = np.cumsum(self._lengths[0]) - self._lengths[0], self._lengths[0], self._values[0]
        return self._done


class Numbers:
    """Numbers the distinct pieces of a stretch. They are held as one Arrow array."""

    def __init__(self, most: int = MOST) -> None:
        self.most, self.known, self.stretch = most, pa.array([], pa.string()), 0

    def number(self, pieces: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """The number of each piece, and the pieces that are new, in the order of their numbers."""
        coded = pieces.dictionary_encode()
        words = coded.dictionary
        if not len(words):
            return np.zeros(0, np.int32), words
        at = found_in(words, self.known)
        if len(self.known) + int((at < 0).sum()) > self.most and len(self.known):
            self.known = words.slice(0, 0)
            self.stretch += 1
            at[:] = -1
        new = at < 0
        fresh = words.filter(pa.array(new))
        at[new] = len(self.known) + np.arange(len(fresh), dtype=np.int32)
        self.known = pa.concat_arrays([self.known, fresh])
        return at[coded.indices.to_numpy(zero_copy_only=False)], fresh


def found_in(words: pa.Array, known: pa.Array) -> np.ndarray:
    """The place of each word among the known ones, or -1."""
    if not len(known):
        return np.full(len(words), -1, np.int32)
    return pc.index_in(words, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32)


def raw(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all words, and where each starts and the last one ends."""
    if not len(words):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8) if words.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]
