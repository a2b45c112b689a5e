"""Hashed n-grams of whole texts, by vector operations on the bytes of an Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes and texts that one vector operation takes; a longer text is taken alone.
BYTES, TEXTS = 1 << 20, 256


def chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, text of each byte) for runs of rows of a binary column without nulls."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, min(at + TEXTS, int(np.searchsorted(offsets, offsets[at] + BYTES, side="right")) - 1))
        yield at, to, data[offsets[at] : offsets[to]], np.repeat(np.arange(to - at), np.diff(offsets[at : to + 1]))
        at = to


_LETTERS = np.array([b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def letter_trigrams(data: np.ndarray, doc: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every trigram of lower-case letter bytes, other runs counting as one space.

    Each text is expected to start and end with a space.
    """
    b = _LETTERS[data]
    upper = np.flatnonzero((b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[:-1] == 0xC3)) + 1
    b[upper] += 0x20
    keep = np.ones(len(b), bool)
    keep[1:] = (b[1:] != 32) | (b[:-1] != 32) | (doc[1:] != doc[:-1])
    b, doc = b[keep].astype(np.uint32), doc[keep]
    if len(b) < 3:
        return doc[:0], np.zeros(0, np.int64)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    inside = doc[:-2] == doc[2:]
    bucket = (code[inside] * np.uint32(2654435761)) >> np.uint32(32 - bits)
    return doc[:-2][inside], bucket.astype(np.int64)


# 0: space and control; 1: letters, and all bytes of other scripts; 2: digits; 3: symbols
_CLASS = np.array([1 if b >= 128 or chr(b).isalpha() else 2 if 48 <= b <= 57 else 0 if b <= 32 or b == 127 else 3 for b in range(256)], np.uint8)
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, BYTES + 1)
        _POWERS[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size, p, np.uint64)], dtype=np.uint64) for p in (_P, _P_INVERSE)]
    return _POWERS[0], _POWERS[1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def word_ngrams(data: np.ndarray, doc: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every word and pair of neighbouring words. A word is a run of letters, digits or symbols.

    A pair of equal words counts twice: as itself, and as a pair of equal words, whichever they are.
    """
    if not len(data):
        return doc[:0], np.zeros(0, np.int64)
    kind = _CLASS[data]
    edge = np.r_[True, (kind[1:] != kind[:-1]) | (doc[1:] != doc[:-1])]
    starts = np.flatnonzero(edge)
    ends = np.r_[starts[1:], len(data)]
    words = kind[starts] > 0
    starts, ends = starts[words], ends[words]
    power, inverse = _powers(len(data) + 1)
    sums = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], dtype=np.uint64)]
    h = _mix((sums[ends] - sums[starts]) * inverse[starts])
    owner = doc[starts]
    pair = owner[1:] == owner[:-1]
    two = _mix(h[:-1][pair] * np.uint64(0x94D049BB133111EB) + h[1:][pair])
    shift = np.uint64(64 - bits)
    same = pair & (h[1:] == h[:-1])
    return np.concatenate([owner, owner[1:][pair], owner[1:][same]]), np.concatenate([h >> shift, two >> shift, np.zeros(int(same.sum()), np.uint64)]).astype(np.int64)
