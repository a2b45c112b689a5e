"""Hierarchical multi-length packing of tokenised documents.

Documents (their ids and an end id) are routed to context-size tiers by length: full windows of the longest tier are
cut off first, and what is left goes to the least tier that holds it. Each tier is packed from its longest documents
down; the gap of a window is filled by the longest waiting document of any shorter length that fits and, where none
does, by a piece cut from the shortest. So windows are full, and only what a partition has left at its end leaves one
short. Windows of one tier are dealt to step groups of equal token counts.

A partition is packed as it streams by, with a bounded pool of waiting pieces: nothing is shuffled, no task grows, and a
lost executor's partition is packed again in the same way. Sequence and group ids hold the partition's number above
bit 33. At most one window of each partition is short, whatever the number of documents.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import pieces

TIERS = (256, 512, 1024, 2048)
#: Tokens that wait in a partition at most before they are packed, and those that stay for the next round.
POOL, REST = 1 << 22, 1 << 18
#: Tokens of a step group: 16 of the longest windows.
GROUP = 16 * TIERS[-1]


@lru_cache(2)
def _vocabulary(path: str) -> dict[bytes, int]:
    """The token bytes of a byte-level tokenizers file, whose merges are in the order of the ids."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec["added_tokens"]}
    pairs = [m.split(" ", 1) if isinstance(m, str) else m for m in spec["model"]["merges"]]
    made = [spec["model"]["vocab"]["".join(m)] for m in pairs]
    if made != sorted(made):
        raise ValueError("the merges aren't in the order of the ids, so ids can't stand for ranks")
    return {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}


class Packer:
    """Packs the pieces of one partition. A piece is (document, start, ids, document's tokens)."""

    def __init__(self, tiers: tuple[int, ...] = TIERS, group: int = GROUP, base: int = 0) -> None:
        self.tiers, self.group, self.base = tiers, group, base
        self.wait: list[list] = [[] for _ in range(tiers[-1] + 1)]
        self.mask, self.tokens, self.sequence, self.groups = 0, 0, 0, 0
        self.open = {t: (0, 0) for t in tiers}
        self.out: list[tuple] = []

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        top, at = self.tiers[-1], 0
        while len(ids) - at >= top:
            self._emit(top, [(doc, at, ids[at : at + top], len(ids))])
            at += top
        if at < len(ids):
            self._put((doc, at, ids[at:], len(ids)))

    def _put(self, piece: tuple) -> None:
        n = len(piece[2])
        self.wait[n].append(piece)
        self.mask |= 1 << n
        self.tokens += n

    def _take(self, n: int) -> tuple:
        piece = self.wait[n].pop()
        if not self.wait[n]:
            self.mask &= ~(1 << n)
        self.tokens -= n
        return piece

    def _emit(self, tier: int, parts: list[tuple]) -> None:
        step, used = self.open[tier]
        if used == 0:
            step, self.groups = self.groups, self.groups + 1
        used += tier
        self.open[tier] = (step, 0 if used >= self.group else used)
        offset = 0
        for doc, start, ids, total in parts:
            self.out.append((doc, start, len(ids), ids.astype("<u4").tobytes(), total, self.base + self.sequence, offset, tier, self.base + step))
            offset += len(ids)
        self.sequence += 1

    def pack(self, keep: int = 0) -> None:
        """Fill windows until at most ``keep`` tokens wait; at 0 the last window may be short."""
        while self.mask and self.tokens > keep:
            first = self._take(self.mask.bit_length() - 1)
            tier = next(t for t in self.tiers if t >= len(first[2]))
            parts, gap = [first], tier - len(first[2])
            while gap and self.mask:
                fits = (self.mask & ((1 << (gap + 1)) - 1)).bit_length() - 1
                if fits > 0:
                    parts.append(self._take(fits))
                    gap -= fits
                else:
                    doc, start, ids, total = self._take((self.mask & -self.mask).bit_length() - 1)
                    parts.append((doc, start, ids[:gap], total))
                    self._put((doc, start + gap, ids[gap:], total))
                    gap = 0
            self._emit(tier, parts)


COLUMNS = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, window int, step_group long"


def pack(docs: DataFrame, path: str, pattern: str, end_id: int = 1, tiers: tuple[int, ...] = TIERS, id_col: str = "doc_id", text_col: str = "text", most: int = pieces.MOST) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids`` (little-endian unsigned 32-bit), ``doc_tokens, sequence_id,
    offset, window`` (the tier) and ``step_group``.

    ``path`` is a byte-level tokenizers file without normaliser, read by the driver only; special tokens are ordinary
    text. A null or empty text is its end id alone. Equal rows are packed each for itself; a null doc_id stays null; an
    empty table gives no rows; other columns are not read. Texts of any length are cut into windows.
    """
    vocabulary = _vocabulary(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=vocabulary, special_tokens={}).encode_ordinary  # a piece as a whole
        packer = Packer(tiers, base=TaskContext.get().partitionId() << 33)
        numbers, runs, stretch = pieces.Numbers(most), pieces.Runs(), 0

        def rows() -> Iterator[pa.RecordBatch]:
            got, packer.out = packer.out, []
            for at in range(0, len(got), 4000):
                columns = list(zip(*got[at : at + 4000], strict=True))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in COLUMNS.split(", ")])

        for b in batches:
            values, lengths = pieces.flat(b.column(1))
            refs, fresh = numbers.number(values)
            if numbers.stretch != stretch:
                runs.clear()
                stretch = numbers.stretch
            coded = [one(w) for w in fresh.to_pylist()]
            runs.add(np.fromiter((i for x in coded for i in x), np.int32), np.fromiter(map(len, coded), np.int64, len(coded)))
            ids, n = pieces.gather(refs, *runs.tables())
            bounds = np.r_[0, np.cumsum(n)][np.r_[0, np.cumsum(lengths)]]
            for doc, lo, hi in zip(b.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                packer.add(doc, np.append(ids[lo:hi], np.int32(end_id)))
            if packer.tokens > POOL:
                packer.pack(REST)
            yield from rows()
        packer.pack()
        yield from rows()

    return pieces.split(docs, pattern, id_col, text_col).mapInArrow(run, COLUMNS)
