"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The vectors are packed once into blocks of whole numbers and written to the shared folder. All that follows are passes
over these blocks: a pass multiplies the centred covariance V with a few columns Q, as the sum of Xᵀ(XQ) over the blocks, each
centred before it is multiplied. Tasks add up their blocks, Spark adds up the tasks entry by entry, and only a matrix of the
vectors' dimension by the columns' number comes to the driver, whatever the number of vectors.

The subspace has half as many columns again as components are wanted. An iteration takes Ritz pairs (QR, then
the small eigenproblem of QᵀVQ) and the residuals that the same pass gives; until all wanted pairs are certified, a Chebyshev
polynomial of V, by its three-term recurrence, one pass a degree, damps the unwanted part of the spectrum: from a
lower bound, found by a few Lanczos steps, to the smallest Ritz value of the subspace. A subspace as
wide as the vectors holds every component at once.

The whitened rows' own covariance is measured by a last pass, and the largest deviation from the identity is returned.

Defined results: vectors that are NULL, empty or hold NULL, NaN or infinite entries are dropped; vectors of another
length than the most frequent one (of equally frequent ones the longest) are dropped too; repeated rows count as often as they
stand; a NULL id stays NULL; components whose eigenvalue is zero up to rounding have no whitened value and no rows, so
equal vectors, a single one and an empty table give none; equal eigenvalues may share any basis; further columns are
not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkassay.llm.common import settled

COMPONENTS = 32
#: Entries become floor(SCALE * entry) + SHIFT; fixed by the contract.
SCALE, SHIFT = 64, 1_000_000
#: Vectors of a block.
BLOCK_ROWS = 4096
#: Degree of a filter, Lanczos steps for the lower bound, iterations at most.
DEGREE, LANCZOS, ITERATIONS = 12, 8, 40
#: A pair is certified when its residual is below this share of the largest eigenvalue.
TOLERANCE = 1e-13
#: Bytes of result rows in a batch, roughly.
ROWS_OUT = 65_536

PARTIAL = "i int, j int, v double"


class Fit(NamedTuple):
    n: int
    sums: np.ndarray  # exact, per dimension
    trace: float
    values: np.ndarray  # falling eigenvalues
    vectors: np.ndarray  # their unit eigenvectors as columns
    residual: float  # largest residual of a wanted pair, as a share of the largest eigenvalue
    passes: int


# -- packing -----------------------------------------------------------------------------------


def usable(vector: Column) -> Column:
    """No NULL, no NULL entry, no entry that is not finite."""
    finite = F.forall(vector, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False))


def _packing(dims: int) -> Callable:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                rows = batch.slice(start, BLOCK_ROWS)
                entries = rows.column("_vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                x = np.floor(SCALE * entries.astype(np.float64)).astype(np.int64) + SHIFT
                narrow = len(x) == 0 or (x.min() >= -(2**31) and x.max() < 2**31)
                data = x.astype("<i4" if narrow else "<i8").tobytes()
                ids = pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows.column("_id"))
                yield pa.RecordBatch.from_arrays([ids, pa.array([data], pa.binary())], ["ids", "x"])

    return pack


def pack(vectors: DataFrame, ids: str = "vec_id", column: str = "embedding") -> tuple[DataFrame, int]:
    """Blocks (ids, x) of the usable vectors, and their dimension (0: there are none)."""
    rows = vectors.select(F.col(ids).alias("_id"), F.col(column).cast("array<double>").alias("_vector")).where(usable(F.col("_vector")))
    lengths = rows.groupBy(F.size("_vector").alias("d")).agg(F.count("*").alias("n"))
    most = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    if most is None:
        return rows, 0
    kind = rows.schema["_id"].dataType.simpleString()
    blocks = rows.where(F.size("_vector") == most["d"]).mapInArrow(_packing(most["d"]), f"ids array<{kind}>, x binary")
    return settled(blocks, "whitening-blocks"), most["d"]


def unpacked(data: bytes, rows: int, dims: int) -> np.ndarray:
    return np.frombuffer(data, "<i4" if len(data) == 4 * rows * dims else "<i8").astype(np.int64).reshape(rows, dims)


def _blocks_of(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for ids, data in zip(batch.column("ids"), batch.column("x"), strict=True):
            yield ids.values, unpacked(data.as_py(), len(ids.values), dims)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, exact; of objects where it may not fit in 64 bits."""
    if n * int(np.abs(x).max(initial=0)) + int(np.abs(sums).max(initial=0)) >= 2**63:
        return n * x.astype(object) - sums.astype(object)
    return n * x - sums.astype(np.int64)


# -- passes ------------------------------------------------------------------------------------


def _pass(blocks: DataFrame, dims: int, shape: tuple[int, int], of_block: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all blocks of a matrix of each, added up in tasks first and in Spark after."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(shape), False
        for _, x in _blocks_of(batches, dims):
            total += of_block(x)
            seen = True
        if seen:
            i, j = np.indices(shape, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "v"])

    out = np.zeros(shape)
    # as many rows as the matrix has entries
    for r in blocks.mapInArrow(partial, PARTIAL).groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = r["v"]
    return out


def _counted(blocks: DataFrame, dims: int) -> tuple[int, np.ndarray]:
    """Number of vectors and exact sums per dimension."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in _blocks_of(batches, dims):
            entries = [len(x), *x.sum(axis=0).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(range(dims + 1), pa.int32()), pa.array(entries, pa.int64())], ["i", "v"])

    total = [0] * (dims + 1)
    summed = blocks.mapInArrow(partial, "i int, v long").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    for r in summed.collect():
        total[r["i"]] = int(r["v"])
    return total[0], np.array(total[1:], dtype=object)


class Covariance:
    """Products with the centred covariance of all vectors; counts its passes."""

    def __init__(self, blocks: DataFrame, dims: int, n: int, sums: np.ndarray):
        self.blocks, self.dims, self.n, self.sums, self.passes = blocks, dims, n, sums, 0

    def times(self, q: np.ndarray) -> np.ndarray:
        n, sums = self.n, self.sums
        self.passes += 1

        def product(x: np.ndarray) -> np.ndarray:
            y = (centred(x, n, sums) / n).astype(np.float64)
            return y.T @ (y @ q)

        return _pass(self.blocks, self.dims, q.shape, product) / n

    def trace(self) -> float:
        n, sums = self.n, self.sums
        self.passes += 1

        def squares(x: np.ndarray) -> np.ndarray:
            y = (centred(x, n, sums) / n).astype(np.float64)
            return np.array([[np.einsum("ij,ij->", y, y)]])

        return float(_pass(self.blocks, self.dims, (1, 1), squares)[0, 0]) / n


def lower_bound(cov: Covariance, steps: int = LANCZOS, seed: int = 1) -> float:
    """Below the smallest eigenvalue, or close to it: smallest Ritz value of some Lanczos steps less the rest."""
    q = np.random.default_rng(seed).standard_normal(cov.dims)
    basis, alphas, betas = [q / np.linalg.norm(q)], [], []
    for _ in range(min(steps, cov.dims)):
        w = cov.times(basis[-1][:, None])[:, 0]
        alphas.append(float(basis[-1] @ w))
        for b in (*basis, *basis):  # twice, so that rounding does not bring old directions back
            w = w - b * (b @ w)
        betas.append(float(np.linalg.norm(w)))
        if betas[-1] <= 1e-12 * max(alphas):
            betas[-1] = 0.0
            break
        basis.append(w / betas[-1])
    small = np.diag(alphas) + np.diag(betas[:-1], 1) + np.diag(betas[:-1], -1)
    return max(0.0, float(np.linalg.eigvalsh(small)[0]) - betas[-1])


def chebyshev(cov: Covariance, q: np.ndarray, low: float, high: float, top: float, degree: int) -> np.ndarray:
    """A Chebyshev polynomial of V applied to the columns: small on [low, high], scaled to stay bounded at `top`."""
    half, middle = (high - low) / 2, (high + low) / 2
    sigma = half / (top - middle)
    first = sigma
    before, now = q, (cov.times(q) - middle * q) * (sigma / half)
    for _ in range(1, degree):
        following = 1.0 / (2.0 / first - sigma)
        before, now = now, (cov.times(now) - middle * now) * (2 * following / half) - (sigma * following) * before
        sigma = following
    return now


def eigenpairs(cov: Covariance, components: int, degree: int = DEGREE, tolerance: float = TOLERANCE, width: int | None = None) -> tuple:
    """(values, vectors, residual) of the largest eigenvalues, falling; the filter runs until the residuals of all of
    them are certified, or no longer shrink because they have reached rounding."""
    k = min(components, cov.dims)
    p = min(cov.dims, width or k + max(k // 2, 4))
    q = np.linalg.qr(np.random.default_rng(0).standard_normal((cov.dims, p)))[0]
    low, best = None, np.inf
    for _ in range(ITERATIONS):
        z = cov.times(q)
        small = q.T @ z
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        u = q @ turn
        residual = float(np.linalg.norm(z @ turn[:, :k] - u[:, :k] * values[:k], axis=0).max(initial=0.0))
        share = residual / values[0] if values[0] > 0 else 0.0
        # certified, the whole space, or no better than before at the level of rounding
        if share <= tolerance or p == cov.dims or (share < 1e-10 and share > best / 4):
            break
        best = min(best, share)
        if low is None:
            low = lower_bound(cov)
        high = float(values[-1])
        if high - min(low, high) <= 1e-14 * values[0]:
            low = 0.0
        q = np.linalg.qr(chebyshev(cov, u, min(low, high * (1 - 1e-6)), high, float(values[0]), degree))[0]
    return values[:k], u[:, :k], share


def fit(blocks: DataFrame, dims: int, components: int = COMPONENTS) -> Fit:
    n, sums = _counted(blocks, dims)
    cov = Covariance(blocks, dims, n, sums)
    trace = cov.trace()
    if trace <= 0:
        return Fit(n, sums, 0.0, np.zeros(0), np.zeros((dims, 0)), 0.0, cov.passes)
    values, vectors, residual = eigenpairs(cov, components)
    real = values > dims * np.finfo(float).eps * values[0]
    return Fit(n, sums, trace, values[real], vectors[:, real], residual, cov.passes)


def identity_error(blocks: DataFrame, dims: int, model: Fit) -> float:
    """Largest absolute entry of the whitened rows' covariance less the identity, measured over all rows."""
    k, n, sums = len(model.values), model.n, model.sums
    onto = model.vectors / np.sqrt(model.values)

    def moments(x: np.ndarray) -> np.ndarray:
        w = (centred(x, n, sums) / n).astype(np.float64) @ onto
        return np.vstack([w.T @ w, w.sum(axis=0)])

    total = _pass(blocks, dims, (k + 1, k), moments) / n
    mean = total[k]
    return float(np.abs(total[:k] - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


# -- result ------------------------------------------------------------------------------------


def _deviations(d: np.ndarray) -> pa.Array:
    """Sums of squares over the dimensions; NULL beyond 64 bits."""
    if d.dtype != object and float(np.abs(d).max(initial=0)) ** 2 * d.shape[1] < 2**62:
        return pa.array((d * d).sum(axis=1), pa.int64())
    exact = [sum(int(v) * int(v) for v in row) for row in d]
    return pa.array([v if v < 2**63 else None for v in exact], pa.int64())


def whiten(vectors: DataFrame, components: int = COMPONENTS, ids: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Rows (id, component, n, deviation, whitened, explained, identity_error) for every usable vector and component."""
    kind = vectors.schema[ids].dataType.simpleString()
    schema = f"`{ids}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    blocks, dims = pack(vectors, ids, column)
    model = fit(blocks, dims, components) if dims else None
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], schema)
    error = identity_error(blocks, dims, model)
    k, n, sums = len(model.values), model.n, model.sums
    onto, explained = model.vectors / np.sqrt(model.values), model.values / model.trace
    names = [ids, "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, ROWS_OUT // k)
        for of, x in _blocks_of(batches, dims):
            for start in range(0, len(x), step):
                d = centred(x[start : start + step], n, sums)
                w = (d / n).astype(np.float64) @ onto
                each = np.repeat(np.arange(len(d)), k)
                columns = [
                    of.slice(start, step).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(d))),
                    pa.array(np.full(len(each), n, np.int64)),
                    _deviations(d).take(pa.array(each)),
                    pa.array(w.ravel()),
                    pa.array(np.tile(explained, len(d))),
                    pa.array(np.full(len(each), error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    return blocks.mapInArrow(project, schema)
