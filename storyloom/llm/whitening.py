"""Whitening of vectors by matrix-free block Lanczos.

The covariance is never formed. A pass over the vectors takes a block of directions X to the sum of xᵀ(xX) over all
centred vectors x: each task multiplies its own vectors, and what tasks send is added up by Spark, one row a cell of the
product. The driver holds the basis (dimensions by directions) and nothing of the data. Each new block is made
orthogonal to the whole basis, twice; directions that vanish (a breakdown) are begun anew at random. The eigenvectors
are those of the basis' projected matrix, and the passes end when the residuals of those asked for are at rounding
error or the basis spans the space. Beyond ``BASIS`` directions the basis is shrunk to its best ones and goes on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import cut, drop

#: Directions in a block, directions that the basis holds at most, and passes at most.
BLOCK, BASIS, PASSES = 16, 512, 400
#: Residuals at which an eigenvector is done, and below which a direction or an eigenvalue is nothing, as shares of the largest.
DONE, NOTHING = 1e-13, 1e-12


def to_whole(vector: Column, scale: float = 64.0, shift: int = 1_000_000) -> Column:
    """``floor(scale * c) + shift`` of every entry as a long; null if the vector is null or holds a null or non-finite entry.

    Entries beyond the range of whole doubles (2^53) are cut to it, so that no long overflows."""
    most = float(1 << 53)
    entries = F.transform(vector, lambda c: c.cast("double"))
    good = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(entries, lambda c: F.floor(F.greatest(F.lit(-most), F.least(F.lit(most), c * scale))).cast("long") + F.lit(shift))
    return F.when(F.coalesce(good, F.lit(False)), whole)


@dataclass
class Model:
    """``components`` are columns of length one; ``values`` their eigenvalues; ``sums`` and ``n`` those of the fit list."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float = float("nan")
    passes: int = 0

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """The mean as a whole part and the rest, so that differences keep all their digits."""
        whole = [s // self.n for s in self.sums]
        return np.array(whole, np.int64), np.array([(s - w * self.n) / self.n for s, w in zip(self.sums, whole, strict=True)])


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _summed(fit: DataFrame, product, shape: tuple[int, int]) -> np.ndarray:  # noqa: ANN001
    """The sum over all tasks of what ``product`` makes of their matrices of whole entries, in batches."""
    dims = shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                part = product(_matrix(b.column(0), dims))
                total = part if total is None else total + part
        if total is not None:
            yield pa.record_batch([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], ["cell", "value"])

    rows = fit.select("x").mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()  # a block's cells
    out = np.zeros(shape)
    for r in rows:
        out.ravel()[r["cell"]] = r["value"]
    return out


def _sums(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sums of every entry. Sums of a batch are whole; they are added as decimals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0), dims)
                high, low = x >> 32, x & 0xFFFFFFFF
                both = np.r_[high.sum(axis=0), low.sum(axis=0)]
                yield pa.record_batch([pa.array(np.arange(2 * dims, dtype=np.int32)), pa.array(both), pa.array(np.full(2 * dims, b.num_rows))], ["cell", "value", "n"])

    rows = fit.select("x").mapInArrow(run, "cell int, value long, n long").groupBy("cell").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"), F.sum("n").alias("n")).collect()  # two a dimension
    by = {r["cell"]: int(r["value"]) for r in rows}
    return rows[0]["n"], [(by[k] << 32) + by[dims + k] for k in range(dims)]


def _orthogonal(block: np.ndarray, basis: np.ndarray, scale: float, rng: np.random.Generator) -> np.ndarray:
    """As many orthonormal directions outside the basis as the block has, or as there is room for: what the block's columns
    have there, and random directions in place of columns of which nothing is left."""
    out, most = basis, min(len(block), basis.shape[1] + block.shape[1])
    columns = list(block.T)
    while out.shape[1] < most:
        v = columns.pop(0) if columns else rng.standard_normal(len(block)) * scale
        v = v - out @ (out.T @ v)
        if (size := np.linalg.norm(v)) <= NOTHING * scale:
            continue
        v = v / size
        v = v - out @ (out.T @ v)
        v = v - out @ (out.T @ v)
        if (left := np.linalg.norm(v)) > 0.1:
            out = np.c_[out, v / left]
    return out[:, basis.shape[1] :]


def lanczos(apply, dims: int, wanted: int, block: int = BLOCK, most: int = BASIS, passes: int = PASSES, seed: int = 7):  # noqa: ANN001, ANN201
    """``(values, vectors, passes)`` of the largest eigenvalues of the symmetric operator ``apply`` (a matrix of columns to the same)."""
    rng = np.random.default_rng(seed)
    wanted, block = min(wanted, dims), min(block, dims)
    most = max(most, wanted + 2 * block)
    basis, images = np.zeros((dims, 0)), np.zeros((dims, 0))
    new = _orthogonal(rng.standard_normal((dims, block)), basis, 1.0, rng)
    for done in range(1, passes + 1):
        basis, images = np.c_[basis, new], np.c_[images, apply(new)]
        projected = basis.T @ images
        values, turn = np.linalg.eigh((projected + projected.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors, taken = basis @ turn, images @ turn
        residual = np.linalg.norm(taken - vectors * values, axis=0)[:wanted]
        scale = max(float(abs(values).max()), np.finfo(float).tiny)
        if basis.shape[1] == dims or (len(values) >= wanted and (residual <= DONE * scale).all()):
            break
        new = _orthogonal(images[:, -new.shape[1] :], basis, scale, rng)
        if basis.shape[1] + block > most:  # the best directions and their images stay
            basis, images = vectors[:, : wanted + block], taken[:, : wanted + block]
    return values[:wanted], vectors[:, :wanted], done


def fit(vectors: DataFrame, components: int = 16, block: int = BLOCK) -> Model | None:
    """The model of a table with a column ``x`` of whole vectors of one length; None if there are none.

    The fit list is each distinct vector once. Eigenvalues that are nothing beside the largest make no component.
    """
    first = vectors.select(F.size("x").alias("d")).first()
    if first is None:
        return None
    dims = first["d"]
    distinct = cut(vectors.select("x").distinct(), "vectors")
    n, sums = _sums(distinct, dims)
    model = Model(n, sums, np.zeros(0), np.zeros((dims, 0)), 0.0)
    whole, rest = model.centre()

    def through(block_: np.ndarray) -> np.ndarray:
        def product(x: np.ndarray) -> np.ndarray:
            c = (x - whole).astype(np.float64) - rest
            return c.T @ (c @ block_)

        return _summed(distinct, product, (dims, block_.shape[1])) / n

    def deviations(x: np.ndarray) -> np.ndarray:
        out = np.zeros((dims, 1))
        out[0, 0] = (((x - whole).astype(np.float64) - rest) ** 2).sum()
        return out

    model.trace = float(_summed(distinct, deviations, (dims, 1))[0, 0]) / n
    if dims and model.trace > 0:
        values, found, model.passes = lanczos(through, dims, components, block)
        good = values > NOTHING * values[0]
        model.values, model.components = values[good], found[:, good]
        scaled = model.components / np.sqrt(model.values)
        k = len(model.values)

        def square(x: np.ndarray) -> np.ndarray:
            w = ((x - whole).astype(np.float64) - rest) @ scaled
            out = np.zeros((dims, k))
            out[:k] = w.T @ w
            return out

        gram = _summed(distinct, square, (dims, k))[:k] / n
        model.identity_error = float(abs(gram - np.eye(k)).max())
    drop(distinct)
    return model


COLUMNS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, x`` of the rows that stay: whole entries, all of one length (the most frequent; the longest of equals)."""
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), to_whole(F.col(vector_col)).alias("x")).filter("x is not null and size(x) > 0")
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("k")).orderBy(F.desc("k"), F.desc("d")).limit(1).collect()
    return rows.filter(F.size("x") == (lengths[0]["d"] if lengths else 0))


def whiten(table: DataFrame, components: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    Rows whose vector is null, empty, of another length than most, or holds a null or non-finite entry go. ``deviation`` is
    n² times the squared distance to the mean (null beyond a long), ``explained`` a component's share of the
    trace. There are as many components as the covariance has rank, and at most ``components``; where all vectors are equal
    there is none, and no row. Ties among eigenvalues give some basis of their space. Equal vectors are fitted once and
    give equal rows; a null vec_id stays null; an empty table gives no rows; other columns are not read.
    """
    rows = whole_vectors(table, id_col, vector_col)
    model = fit(rows, components)
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], COLUMNS)
    whole, rest = model.centre()
    scaled = model.components / np.sqrt(model.values)
    explained, k, n, dims = model.values / model.trace, len(model.values), model.n, len(model.sums)
    # n * (x - whole) - (S - n * whole), whose squares must not overflow
    left = np.array([s - n * int(w) for s, w in zip(model.sums, whole, strict=True)], dtype=object)

    def deviation(x: np.ndarray) -> pa.Array:
        near = x - whole
        top = (abs(near).max(initial=0).astype(object) + 1) * n
        if dims * int(top) ** 2 < 1 << 63:
            return pa.array(((n * near - left.astype(np.int64)) ** 2).sum(axis=1))
        exact = ((near.astype(object) * n - left) ** 2).sum(axis=1)
        return pa.array([v if v < 1 << 63 else None for v in exact.tolist()], pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1), dims)
            w = ((x - whole).astype(np.float64) - rest) @ scaled
            at = pa.array(np.repeat(np.arange(b.num_rows), k))
            count = b.num_rows * k
            yield pa.record_batch(
                [
                    b.column(0).take(at),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), b.num_rows)),
                    pa.array(np.full(count, n, np.int64)),
                    deviation(x).take(at),
                    pa.array(w.ravel()),
                    pa.array(np.tile(explained, b.num_rows)),
                    pa.array(np.full(count, model.identity_error)),
                ],
                [c.split()[0] for c in COLUMNS.split(", ")],
            )

    return rows.mapInArrow(run, COLUMNS)
