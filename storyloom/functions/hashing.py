"""Fingerprints of texts, and distances between them."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


def simhash_of(text: str | None, bits: int = 64) -> int:
    """SimHash by the low bits of each token's MD5, one vote per occurrence; zero without tokens."""
    counts = Counter(re.sub("[^a-z0-9]", " ", (text or "").lower()).split())
    if not counts:
        return 0
    digests = np.frombuffer(b"".join(hashlib.md5(t.encode()).digest()[16 - bits // 8 :] for t in counts), np.uint8).reshape(-1, bits // 8)
    votes = np.fromiter(counts.values(), np.int64) @ (2 * np.unpackbits(digests, axis=1).astype(np.int64) - 1)
    return int.from_bytes(np.packbits(votes > 0).tobytes(), "big")


@F.pandas_udf(LongType())
def simhash64(texts: pd.Series) -> pd.Series:
    """The 64-bit SimHash as a signed long."""
    return pd.Series([(h := simhash_of(t)) - (1 << 64) * (h >> 63) for t in texts], dtype="int64")


def to_hex(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def short_hex(fingerprint: Column) -> Column:
    """The hex digits without leading zeros; of a missing text '0'."""
    return F.coalesce(F.lower(F.hex(fingerprint)), F.lit("0"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hamming_hex(a: Column, b: Column) -> Column:
    """Distance of two hex strings of up to 16 digits; infinite if one isn't hex."""
    good = a.rlike("^[0-9a-fA-F]{1,16}$") & b.rlike("^[0-9a-fA-F]{1,16}$")
    value = lambda x: F.conv(F.when(good, x), 16, -10).cast("long")
    return F.coalesce(hamming(value(a), value(b)).cast("double"), F.lit(float("inf")))


def hash_embedding(text: Column, size: int = 384) -> Column:
    """A stand-in for a text's embedding: its SHA-1 bytes over 255, repeated to ``size`` and brought to length one."""
    full, rest = divmod(size, 20)
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))  # noqa: E731  evaluated once
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)

    def scaled(raw: Column) -> Column:
        # size values repeat the 20 bytes: the norm is that of full repeats and of the rest
        norm = F.sqrt(square(raw) * full + (square(F.slice(raw, 1, rest)) if rest else F.lit(0.0)))
        once = let(norm, lambda n: F.transform(raw, lambda x: F.when(n > 0, x / n).otherwise(0.0)))
        return F.slice(F.flatten(F.array_repeat(once, full + 1)), 1, size)

    bytes_ = lambda digest: F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.conv(F.substring(digest, 2 * i + 1, F.lit(2)), 16, 10).cast("double") / 255)
    return let(F.sha1(F.coalesce(text, F.lit(""))), lambda digest: let(bytes_(digest), scaled))
