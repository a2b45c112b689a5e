"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Words are runs of letters, of digits or of symbols; words and pairs of neighbouring words are hashed to 2**18 buckets. A
text's features are its buckets' shares of all its n-grams times ``SCALE``; its score is the logistic function of their
dot product with the weights. Training takes a bounded sample of labelled rows in the order of a hash of their ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import grams

BITS = 18
SCALE = 30.0


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def _bytes(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).cast("binary")


class Ftrl:
    """FTRL-proximal of logistic loss, one example at a time."""

    def __init__(self, size: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> None:
        self.z, self.n, self.alpha, self.beta, self.l1, self.l2 = np.zeros(size + 1), np.zeros(size + 1), alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, at: np.ndarray, values: np.ndarray, label: int) -> None:
        """``at``: distinct places; the bias is the last place, with the value 1."""
        w = self.weights(at)
        g = (_sigmoid(float(w @ values)) - label) * values
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def _sigmoid(x):  # noqa: ANN001, ANN202
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit(docs: DataFrame, labels: DataFrame, most: int = 6000, rounds: int = 3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learn from at most ``most`` labelled ids. Ids that are null, unlabelled or labelled both ways teach nothing."""
    one = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.min(label_col).alias("lo"), F.max(label_col).alias("hi"))
    picked = one.filter("lo = hi").select("doc_id", F.col("lo").cast("int").alias("label"), F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, doc in grams.chunks(b.column(2)):
                at, bucket = grams.word_ngrams(data, doc, BITS)
                places, counts = np.unique((at << BITS) + bucket, return_counts=True)
                ends = np.searchsorted(places, np.arange(hi - lo + 1) << BITS).astype(np.int32)
                part = b.slice(lo, hi - lo)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v)) for v in ((places & ((1 << BITS) - 1)).astype(np.int32), counts.astype(np.int32))]
                yield pa.record_batch([part.column(0), part.column(1), *lists], ["h", "label", "at", "n"])

    rows = docs.select(F.col(id_col).alias("doc_id"), _bytes(F.col(text_col)).alias("text")).join(F.broadcast(picked), "doc_id").select("h", "label", "text")
    got = rows.mapInArrow(run, "h long, label int, at array<int>, n array<int>").toArrow().combine_chunks().sort_by("h")
    model, size = Ftrl(1 << BITS), 1 << BITS
    columns = [got.column(k).to_pylist() if k == 1 else [x.values.to_numpy() for x in got.column(k)] for k in (1, 2, 3)] if got.num_rows else [[], [], []]
    for _ in range(rounds):
        for label, at, n in zip(*columns, strict=True):
            model.update(np.append(at, size), np.append(n * (SCALE / max(1, n.sum())), 1.0), label)
    w = model.weights()
    return Model(w[:-1].astype(np.float32), float(w[-1]))


def scored(model: Model, text: Column) -> Column:
    """The score of a whole text, from 0 to 1. Null and empty texts have no features: theirs is that of the bias."""

    @F.arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        out = [np.zeros(0)]
        for lo, hi, data, doc in grams.chunks(texts):
            at, bucket = grams.word_ngrams(data, doc, BITS)
            dot = np.bincount(at, model.weights[bucket].astype(float), hi - lo)
            out.append(_sigmoid(model.bias + SCALE * dot / np.maximum(np.bincount(at, minlength=hi - lo), 1)))
        return pa.array(np.concatenate(out))

    return scores(_bytes(text))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every whole text: see :func:`scored`.

    Equal texts get equal scores, other columns are not read, a null doc_id stays null, an empty table gives no rows.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), scored(model, F.col(text_col)).alias("score"))
