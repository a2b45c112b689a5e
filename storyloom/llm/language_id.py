"""Language identification by the nearest of several centroids per language.

A text is the TF-IDF vector of its hashed letter trigrams (logarithmic counts), of length one. Document frequencies come
from all training rows. The vectors of a bounded sample of training rows, at most ``per_language`` of each language and
picked by a hash of their ids, are clustered by spherical k-means into ``clusters`` centroids per language. A language's
sample is clustered in one task, and the driver gets its centroids alone: 96 KB a language. A text gets the language of the centroid of highest cosine. It is rejected if that is below ``slack`` times the first percentile of
the centroid's own long members, that is, if it is far from everything learned; a text of under ``least`` letter
trigrams is too short to be rejected for its distance.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import grams

BITS = 13


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    floor: np.ndarray
    least: int = 200


def _padded(text: Column) -> Column:
    return F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" ")).cast("binary")


def _counts(data: np.ndarray, doc: np.ndarray, rows: int) -> np.ndarray:
    at, bucket = grams.letter_trigrams(data, doc, BITS)
    return np.bincount((at << BITS) + bucket, minlength=rows << BITS).reshape(rows, 1 << BITS)


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts.astype(np.float32)) * idf
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


def document_frequencies(texts: DataFrame, text_col: str = "text") -> tuple[int, np.ndarray]:
    """The number of texts and, of each trigram bucket, the number of texts that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << BITS, np.int64), 0
        for b in batches:
            n += b.num_rows
            for lo, hi, data, doc in grams.chunks(b.column(0)):
                total += (_counts(data, doc, hi - lo) > 0).sum(axis=0)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(np.r_[-1, used].astype(np.int32)), pa.array(np.r_[n, total[used]])], ["bucket", "n"])

    got = texts.select(_padded(F.col(text_col))).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out, n = np.zeros(1 << BITS, np.int64), 0
    for r in got:
        if r.bucket < 0:
            n = r.n
        else:
            out[r.bucket] = r.n
    return n, out


def sample(train: DataFrame, per_group: int, group_col: str, id_col: str = "doc_id") -> DataFrame:
    """At most ``per_group`` ids of each group, by the order of a hash of the id. Only the two columns are read."""
    ids = train.select(F.col(id_col).alias("doc_id"), F.col(group_col).alias("_group"))
    sizes = ids.groupBy("_group").count().collect()  # a row for each language
    share = F.from_json(F.lit(json.dumps({r["_group"]: 3.0 * per_group / r["count"] for r in sizes})), "map<string,double>")
    hashed = ids.withColumn("_h", F.xxhash64("doc_id")).filter(F.pmod(F.col("_h"), F.lit(1 << 20)) < F.element_at(share, F.col("_group")) * (1 << 20))
    rank = F.row_number().over(Window.partitionBy("_group").orderBy("_h", "doc_id"))
    return hashed.withColumn("_rank", rank).filter(F.col("_rank") <= per_group).select("doc_id").distinct()


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of length one, and each row's. Starts from rows far from those taken."""
    first = [int(np.argmax(x @ x.mean(axis=0)))]
    far = 1 - x @ x[first[0]]
    while len(first) < min(k, len(x)):
        first.append(int(np.argmax(far)))
        far = np.minimum(far, 1 - x @ x[first[-1]])
    c = x[first]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        c = np.stack([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c, (x @ c.T).argmax(axis=1)


def fit(train: DataFrame, per_language: int = 512, clusters: int = 3, slack: float = 0.5, least: int = 200, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from the rows whose language is not null. Without any, the model knows no language."""
    known = train.filter(F.col(lang_col).isNotNull())
    picked = sample(known, per_language, lang_col, id_col)
    n, df = document_frequencies(known, text_col)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, doc in grams.chunks(b.column(2)):
                counts = _counts(data, doc, hi - lo)
                vectors = _vectors(counts, idf)
                row, at = np.nonzero(vectors)
                ends = pa.array(np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32))
                part = b.slice(lo, hi - lo)
                sparse = [pa.ListArray.from_arrays(ends, pa.array(at.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(vectors[row, at]))]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(counts.sum(axis=1)), *sparse], ["doc_id", "lang", "size", "at", "value"])

    def cluster(table: pa.Table) -> pa.Table:
        rows = sorted(((r["doc_id"] or 0, r["at"], r["value"], r["size"]) for r in table.to_pylist()), key=lambda r: r[:3])
        x = np.zeros((len(rows), 1 << BITS), np.float32)
        for i, (_, at, value, _) in enumerate(rows):
            x[i, at] = value
        long = np.array([r[3] >= least for r in rows])
        c, own = _kmeans(x, clusters)
        near = [(x @ c[j])[(own == j) & long] for j in range(len(c))]
        floor = [slack * float(np.quantile(n, 0.01)) if len(n) >= 20 else 0.0 for n in near]
        return pa.table({"lang": [table.column("lang")[0].as_py()] * len(c), "place": list(range(len(c))), "floor": floor, "centroid": [v.astype(np.float32).tobytes() for v in c]}, pa.schema([("lang", pa.string()), ("place", pa.int32()), ("floor", pa.float64()), ("centroid", pa.binary())]))

    rows = known.join(F.broadcast(picked), known[id_col] == picked["doc_id"], "left_semi").select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).alias("lang"), _padded(F.col(text_col)))
    vectors = rows.mapInArrow(run, "doc_id long, lang string, size long, at array<int>, value array<float>").filter("size > 0")
    got = sorted(vectors.groupBy("lang").applyInArrow(cluster, "lang string, place int, floor double, centroid binary").toArrow().to_pylist(), key=lambda r: (r["lang"], r["place"]))
    languages = sorted({r["lang"] for r in got})
    owner = np.array([languages.index(r["lang"]) for r in got], np.int64)
    centroids = np.array([np.frombuffer(r["centroid"], np.float32) for r in got], np.float32).reshape(-1, 1 << BITS)
    return Model(languages, idf, centroids, owner, np.array([r["floor"] for r in got]), least)


PREDICTION = "struct<lang_pred:string,score:double,rejected:boolean>"


def prediction(model: Model, text: Column) -> Column:
    """``struct<lang_pred, score, rejected>`` of a whole text.

    score is the cosine with the nearest centroid, from 0 to 1. Texts without a letter (null and empty ones among them)
    are ``und``, score 0, rejected; so is everything if no language was learned.
    """
    names = np.array([*model.languages, "und"], dtype=object)
    names_of = ["lang_pred", "score", "rejected"]

    def one(lettered: np.ndarray, data: np.ndarray, doc: np.ndarray) -> pa.StructArray:
        n = len(lettered)
        counts = _counts(data, doc, n)
        if len(model.owner):
            cosine = _vectors(counts, model.idf) @ model.centroids.T
            best = cosine.argmax(axis=1)
            score = np.clip(cosine[np.arange(n), best], 0, 1).astype(float)
            lang = model.owner[best]
            far = (score < model.floor[best]) & (counts.sum(axis=1) >= model.least)
        else:
            score, lang, far = np.zeros(n), np.full(n, -1), np.ones(n, bool)
        lang, score = np.where(lettered, lang, -1), np.where(lettered, score, 0.0)
        return pa.StructArray.from_arrays([pa.array(names[lang], pa.string()), pa.array(score), pa.array(far | ~lettered)], names_of)

    @F.arrow_udf(PREDICTION)
    def predicted(lettered: pa.Array, texts: pa.Array) -> pa.Array:
        some = lettered.to_numpy(zero_copy_only=False)
        out = [one(some[lo:hi], data, doc) for lo, hi, data, doc in grams.chunks(texts)]
        kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])
        return pa.concat_arrays([x.cast(kind) for x in out]) if out else pa.array([], kind)

    return predicted(F.coalesce(text.rlike(r"\p{L}"), F.lit(False)), _padded(text))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` of every whole text: see :func:`prediction`.

    Equal texts get equal rows, other columns are not read, a null doc_id stays null, an empty table gives no rows.
    """
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), prediction(model, F.col(text_col)).alias("p"))
    return found.select("doc_id", "p.*")
