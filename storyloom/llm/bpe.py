"""Byte-level BPE encoding and decoding.

A pattern cuts each text into pieces. The distinct pieces of a stretch of documents become arrays of byte tokens, and
higher-order functions fold the ranked merges over them: a step finds the pair of least rank, joins it, and looks up the
two pairs that are new. Ranks come from a literal: a table of all pairs of tokens whose bytes together are a
token, its rows (one for each left token) laid over one another so that their cells don't meet, so that a lookup is a few
array accesses. (One large Spark map would be scanned from its start at every lookup.) The least pair carries its place:
``array_position``, interpreted, leaves its loop by an exception, which took most of the time of a fold that used it.
Decoding maps ids to pieces by a literal array and joins their bytes.

Words that many documents share would be folded again by every task. So the words that a bounded sample of documents
shows twice or more, ``COMMON`` at most, are folded first and go to all tasks with their ids. The sample decides only
where a word is folded, never its ids: every other word is folded where it is found, and nothing is shuffled.

A piece of over ``LONG`` bytes would make the fold quadratic; a heap of pairs, with the same ranks, merges it instead.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import pieces
from .store import cut, drop

#: No rank: no such pair.
NONE = 1 << 30
#: Documents (about) whose words are looked at for common ones, and words that are folded beforehand at most.
SAMPLE, COMMON = 40_000, 300_000
#: Distinct words that a stretch holds.
MOST = 250_000
#: Bytes of a piece that is folded.
LONG = 256


@lru_cache(4)
def ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a tiktoken file. It is read where the query is planned."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


#: A cell of a fold: the token in the bits below PLACE, its place in the array from there on, and from RANK on the rank of
#: the token with the next one. A pair that makes no token has bits from NO_PAIR on instead.
PLACE, RANK, NO_PAIR = 16, 26, 42


@lru_cache(4)
def pair_table(path: str) -> tuple[list[int], list[int], list[int], int]:
    """Ranks of the pairs of tokens whose bytes together are a token: shift, cells, owner, and the token that ends a word.

    ``cells[shift[a] + b] ^ owner[a]`` is ``rank << RANK | a`` where (a, b) makes a token of that rank, and at least
    ``1 << NO_PAIR`` elsewhere. Rows are placed from the fullest on, each at the first shift where its cells are free.
    """
    found = ranks(path)
    rows: dict[int, list[tuple[int, int]]] = {}
    for token, rank in found.items():
        for cut in range(1, len(token)):
            if (a := found.get(token[:cut])) is not None and (b := found.get(token[cut:])) is not None:
                rows.setdefault(a, []).append((b, rank))
    end = max(found.values()) + 1
    if end > 65535:
        raise ValueError("a vocabulary this large needs wider cells")
    shift, placed, used = [0] * (end + 1), {}, 0  # used: a bit for each cell
    for a, row in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
        met = mask = 0
        for b, _ in row:
            met |= used >> b
            mask |= 1 << b
        shift[a] = d = (~met & (met + 1)).bit_length() - 1
        used |= mask << d
        placed |= {d + b: (a + 1) << NO_PAIR | rank << RANK for b, rank in row}
    cells = [placed.get(i, 0) for i in range(max(shift) + end + 1)]
    return shift, cells, [(a + 1) << NO_PAIR | a for a in range(end + 1)], end


@lru_cache(4)
def _pair_literal(path: str) -> str:
    shift, cells, owner, _ = pair_table(path)
    return json.dumps({"s": shift, "c": cells, "o": owner}, separators=(",", ":"))


@lru_cache(4)
def _token_literal(path: str) -> str:
    found = ranks(path)
    tokens = [""] * (max(found.values()) + 1)
    for token, rank in found.items():
        tokens[rank] = base64.b64encode(token).decode()
    return json.dumps(tokens, separators=(",", ":"))


def _let(value: Column, body) -> Column:  # noqa: ANN001
    """``body(value)``, with ``value`` evaluated once: what an aggregate over nothing does at its end."""
    return F.aggregate(F.array(), value, lambda v, _: v, body)


def fold(starts: Column, path: str) -> Column:
    """Merge each array of tokens (at first those of a word's bytes) by rank: array<array<int>> to the same.

    An array of one token, or whose first one is negative, stays as it is. Others have at most ``LONG`` tokens.
    """
    no_token = pair_table(path)[3]
    literal = F.from_json(F.lit(_pair_literal(path)), "s array<int>, c array<bigint>, o array<bigint>")

    def long(value: int) -> Column:
        return F.lit(value).cast("long")

    def token(cell: Column) -> Column:
        return cell.bitwiseAND(long((1 << PLACE) - 1))

    def one(start: Column, table: Column) -> Column:
        # A state holds a cell for each token, between two ends whose pairs have no rank. A rank is also the token that the
        # pair makes. Of equal ranks, the least cell is the leftmost.
        def cell(a: Column, b: Column, place: Column) -> Column:
            pair = table["c"][table["s"][a] + b].bitwiseXOR(table["o"][a])
            return pair.bitwiseOR(F.shiftleft(place.cast("long"), PLACE))

        def joined(cells: Column, least: Column) -> Column:
            new = F.shiftright(least, RANK)

            def around(at: Column, before: Column) -> Column:
                def kept(right: Column, i: Column) -> Column:
                    return (
                        F.when(i < before, cells[i])
                        .when(i > at, right - long(1 << PLACE))
                        .when(i == at, cell(new, token(cells[at + 2]), at))
                        .otherwise(cell(token(cells[before]), new, before))
                    )

                return F.transform(F.slice(cells, F.lit(2), F.size(cells) - 1), kept)

            at = F.shiftright(least, PLACE).bitwiseAND(long((1 << RANK - PLACE) - 1)).cast("int")
            return F.when(least < long(1 << NO_PAIR), _let(at, lambda at: _let(at - 1, lambda before: around(at, before)))).otherwise(cells)

        ends = F.array(long((no_token + 1) << NO_PAIR | no_token))
        tokens = F.transform(start, lambda t, i: cell(t, F.coalesce(F.get(start, i + 1), F.lit(no_token)), i + 1))
        merges = F.sequence(F.lit(2), F.size(start))
        end = F.aggregate(merges, F.concat(ends, tokens, ends), lambda cells, _: _let(F.array_min(cells), lambda least: joined(cells, least)))
        kept = F.transform(F.filter(end, lambda c: token(c) < long(no_token)), lambda c: token(c).cast("int"))
        return F.when((F.size(start) < 2) | (F.get(start, F.lit(0)) < 0), start).otherwise(kept)

    return _let(literal, lambda table: F.transform(starts, lambda w: one(w, table)))


def merge_long(word: bytes, found: dict[bytes, int]) -> list[int]:
    """Ids of one long piece: the leftmost pair of least rank first, by a heap."""
    n = len(word)
    end, back, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := found.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, to = heapq.heappop(heap)
        j = end[i]
        if not live[i] or j >= n or end[j] != to or not live[j]:
            continue
        live[j] = False
        end[i] = to
        if to < n:
            back[to] = i
            if (r := found.get(word[i : end[to]])) is not None:
                heapq.heappush(heap, (r, i, end[to]))
        if (h := back[i]) >= 0 and (r := found.get(word[h:to])) is not None:
            heapq.heappush(heap, (r, h, to))
    out, i = [], 0
    while i < n:
        out.append(found[word[i : end[i]]])
        i = end[i]
    return out


class Starts:
    """The arrays that the fold gets for words: their byte tokens; or their ids, the first as -1 - id, where they are known."""

    def __init__(self, found: dict[bytes, int], words: pa.Array, ids: np.ndarray, ends: np.ndarray) -> None:
        self.found, self.words, self.ends = found, words, ends
        self.ids = ids.copy()
        first = ends[:-1][np.diff(ends) > 0]
        self.ids[first] = -1 - self.ids[first]
        whole = sorted((t.decode(), r) for t, r in found.items() if _is_text(t))
        self.tokens, self.ranks = pa.array([t for t, _ in whole], pa.string()), np.array([r for _, r in whole], np.int32)
        self.bytes_ids = np.array([found[bytes([i])] for i in range(256)], np.int32)

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The arrays of all words, one after another; and how long each is."""
        data, ends = pieces.raw(words)
        token, common = pieces.found_in(words, self.tokens), pieces.found_in(words, self.words)
        size = np.diff(ends)
        long = [(i, merge_long(data[ends[i] : ends[i + 1]].tobytes(), self.found)) for i in np.flatnonzero((size > LONG) & (token < 0) & (common < 0))]
        merged = [np.array([-1 - ids[0], *ids[1:]], np.int32) for _, ids in long]
        pool = np.concatenate([self.bytes_ids[data], self.ranks, self.ids, *merged])
        starts, n = ends[:-1].copy(), size.copy()
        one, many = token >= 0, (token < 0) & (common >= 0)
        starts[one], n[one] = len(data) + token[one], 1
        starts[many] = len(data) + len(self.ranks) + self.ends[common[many]]
        n[many] = (self.ends[1:] - self.ends[:-1])[common[many]]
        at = len(data) + len(self.ranks) + len(self.ids)
        for (i, _), ids in zip(long, merged, strict=True):
            starts[i], n[i] = at, len(ids)
            at += len(ids)
        return pieces.gather(np.arange(len(words)), starts, n, pool)


def _is_text(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


def _none_known(found: dict[bytes, int]) -> Starts:
    return Starts(found, pa.array([], pa.string()), np.zeros(0, np.int32), np.zeros(1, np.int64))


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.array(values.astype(np.int32)))


def common_words(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", most: int = COMMON) -> Starts:
    """The ids of words that a sample of about SAMPLE documents shows twice or more, the most frequent, at most ``most``."""
    found = ranks(path)
    none = _none_known(found)
    total = docs.count()
    some = docs.sample(min(1.0, SAMPLE / total), seed=1) if total > SAMPLE else docs

    def unknown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            coded = b.column(1).flatten().dictionary_encode()
            words = coded.dictionary
            times = np.bincount(coded.indices.to_numpy(zero_copy_only=False), minlength=len(words)).astype(np.int64)
            new = (pieces.found_in(words, none.tokens) < 0) & (np.diff(pieces.raw(words)[1]) <= LONG)
            yield pa.record_batch([words.filter(pa.array(new)), pa.array(times[new])], ["word", "n"])

    counts = pieces.split(some, pattern, id_col, text_col).mapInArrow(unknown, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1")
    kept = cut(counts, "words")
    # words by the power of two that their count reaches: some dozens of rows
    levels = kept.groupBy(F.floor(F.log2(F.col("n").cast("double"))).cast("int").alias("level")).agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect()
    taken, least = 0, 63
    for row in levels:
        taken += row["words"]
        if taken > most:
            break
        least = row["level"]

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = _lists(*none.of(b.column(0)))
            yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(each) + 1, dtype=np.int32)), each)], ["word", "start"])

    told = kept.filter(F.col("n") >= 2.0**least).select("word").mapInArrow(starts, "word string, start array<array<int>>")
    got = told.select("word", fold(F.col("start"), path)[0].alias("ids")).toArrow().combine_chunks()
    drop(kept)
    if not got.num_rows:
        return none
    ids, lengths = pieces.flat(got.column(1).chunk(0))
    return Starts(found, got.column(0).chunk(0).cast(pa.string()), ids.to_numpy(zero_copy_only=False).astype(np.int32), np.r_[0, np.cumsum(lengths)])


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", most: int = MOST, common: int = COMMON) -> DataFrame:
    """``doc_id, ids`` of every whole text, by the ranks of a tiktoken file; special tokens are ordinary text.

    A null or empty text has no ids. Equal rows give equal rows; a null doc_id stays null; an empty table gives no
    rows; other columns are not read. ``path`` is read by the driver only.
    """
    known = common_words(docs, path, pattern, id_col, text_col, common)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = pieces.Numbers(most)
        for b in batches:
            values, lengths = pieces.flat(b.column(1))
            refs, fresh = numbers.number(values)
            words = _lists(*known.of(fresh))
            ends = np.r_[0, np.cumsum(lengths)].astype(np.int32)
            first = np.r_[0, np.full(b.num_rows, len(fresh))].astype(np.int32)  # the batch's new words go with its first row
            yield pa.record_batch(
                [b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(refs)), pa.array(np.full(b.num_rows, numbers.stretch, np.int32)), pa.ListArray.from_arrays(pa.array(first), words)],
                ["doc_id", "refs", "stretch", "fresh"],
            )

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, stretch = pieces.Runs(), 0
        for b in batches:
            stretches = b.column(2).to_numpy()
            bounds = [0, *(np.flatnonzero(np.diff(stretches)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                if hi == lo:
                    continue
                part = b.slice(lo, hi - lo)
                if stretches[lo] != stretch:
                    runs.clear()
                    stretch = stretches[lo]
                values, lengths = pieces.flat(part.column(3).flatten())
                ids = values.to_numpy(zero_copy_only=False).astype(np.int32)
                runs.add(np.where(ids < 0, -1 - ids, ids), lengths)
                refs, per_doc = pieces.flat(part.column(1))
                ids, n = pieces.gather(refs.to_numpy(zero_copy_only=False), *runs.tables())
                total = np.r_[0, np.cumsum(n)]
                ends = total[np.r_[0, np.cumsum(per_doc)]].astype(np.int32)
                yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))], ["doc_id", "ids"])

    numbered = pieces.split(docs, pattern, id_col, text_col).mapInArrow(number, "doc_id long, refs array<int>, stretch int, fresh array<array<int>>")
    merged = numbered.select("doc_id", "refs", "stretch", fold(F.col("fresh"), path).alias("folded"))
    return merged.mapInArrow(gather, "doc_id long, ids array<int>")


def decode(ids: Column, path: str) -> Column:
    """The bytes of an array of ids: binary pieces, one after another. (Spark joins strings alone, by their bytes as they are.)"""
    table = F.from_json(F.lit(_token_literal(path)), "array<binary>").cast("array<string>")  # a constant, cast once
    return _let(table, lambda tokens: F.array_join(F.transform(ids, lambda i: F.get(tokens, i)), "")).cast("binary")
