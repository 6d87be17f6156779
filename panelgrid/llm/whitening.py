"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The leading eigenvectors of the covariance are found without forming it.  A pass
over the rows gives V·Q = XᵀX·Q / n for a narrow block Q, each task centring its
rows before it multiplies and sending only its share of the product; the shares
are summed by entry in the cluster, and dim × block numbers reach the driver.

1. A few Lanczos passes bound the spectrum from below.
2. A block wider than the number of components goes through a Chebyshev
   polynomial of V, one pass a degree by the three-term recurrence.  It stays
   within [-1, 1] on the unwanted part of the spectrum (from the lower bound to
   the block's smallest Ritz value) and grows steeply above it.
3. QR, one pass, Rayleigh-Ritz: eigenvalue estimates and their residuals.
4. Steps 2 and 3 repeat until each wanted residual is certified at TOLERANCE of
   the largest eigenvalue, or, being small already, no longer falls.

Where the block is as wide as the space, one pass and Rayleigh-Ritz are enough.

Defined results: rows whose vector is null, empty, or holds null or non-finite
entries are left out, and so are rows whose vector's length is not the most
frequent one (of equally frequent ones the greatest).  Entries beyond 2^40 in
size count as 2^40.  Rows that repeat an id, and rows with a null id, count as
rows of their own.  Components whose eigenvalue is zero up to rounding can't be
whitened and are not returned; there are none in a table of equal rows, and an
empty table gives no rows.  A deviation that does not fit a long is null.
Further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelgrid.llm.common import discard, stored_at

#: x = floor(SCALE * c) + SHIFT
SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Columns of the block for each wanted component.
GUARD = 4
LANCZOS_STEPS = 6
DEGREE = 10
#: Residual at which a component is certified, and that below which stalling ends the search, as shares of the largest eigenvalue.
TOLERANCE = 1e-14
SMALL_RESIDUAL = 1e-11
MOST_ROUNDS = 60
#: Vectors of a stored block.
BLOCK = 1024
LARGEST = float(2 ** 40)


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: component k of a row is (x - sums/n)·vectors[:, k] / sqrt(values[k])."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    residuals: np.ndarray
    passes: int


def _cells(parts: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
    flat = parts.ravel()
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat, kind)], names=["cell", "value"])


def _gather(rows: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], shape: tuple[int, ...], exact: bool = False) -> np.ndarray:
    """The sum over all rows of ``part``, an array of ``shape``; each task adds up
    its own rows, then entries are summed by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for k in range(batch.num_rows):
                got = part(batch.slice(k, 1))
                total = got if total is None else total + got
        if total is not None:
            yield _cells(total, pa.int64() if exact else pa.float64())

    sums = rows.mapInArrow(run, f"cell int, value {'long' if exact else 'double'}").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(math.prod(shape), np.int64 if exact else np.float64)
    out[sums["cell"].to_numpy()] = sums["value"].to_numpy()
    return out.reshape(shape)


def _matrix(row: pa.RecordBatch, dim: int) -> np.ndarray:
    """The integer vectors of a stored block."""
    return np.frombuffer(row["x"][0].as_buffer(), np.int64).reshape(-1, dim)


def _packed(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """Blocks of the valid rows' ids and integer vectors, and the vectors' length."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    v = v.where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf))) & (F.size("v") > 0))
    longest = v.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = longest["dim"] if longest else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                some = batch.slice(at, BLOCK)
                c = some.column(1).flatten().to_numpy()
                x = np.floor(np.clip(SCALE * c, -LARGEST, LARGEST)).astype(np.int64) + SHIFT
                yield pa.RecordBatch.from_arrays([
                    pa.array([some.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([x.tobytes()], pa.binary()),
                ], names=["vec_ids", "x"])

    return v.where(F.size("v") == dim).mapInArrow(run, "vec_ids array<long>, x binary"), dim


def _lower_bound(apply: Callable[[np.ndarray], np.ndarray], dim: int, rng: np.random.Generator) -> float:
    """A bound of the smallest eigenvalue: the smallest of a short Lanczos run less its residual."""
    q = rng.standard_normal(dim)
    basis, image = [q / np.linalg.norm(q)], []
    for _ in range(min(LANCZOS_STEPS, dim)):
        image.append(apply(basis[-1][:, None])[:, 0])
        w = image[-1].copy()
        for _ in range(2):
            w -= np.array(basis).T @ (np.array(basis) @ w)
        if np.linalg.norm(w) <= 1e-12 * np.linalg.norm(image[-1]):
            break
        basis.append(w / np.linalg.norm(w))
    q, vq = np.array(basis[:len(image)]).T, np.array(image).T
    values, s = np.linalg.eigh(q.T @ vq)
    return max(0.0, float(values[0] - np.linalg.norm(vq @ s[:, 0] - values[0] * (q @ s[:, 0]))))


def _chebyshev(apply: Callable[[np.ndarray], np.ndarray], q: np.ndarray, low: float, high: float, top: float, first: np.ndarray) -> np.ndarray:
    """The polynomial of DEGREE that is small on [low, high], scaled to be 1 at ``top``; ``first`` is V·q."""
    centre, half = (low + high) / 2, (high - low) / 2
    scale = half / (top - centre)
    before, now, sigma = q, (first - centre * q) * (scale / half), scale
    for _ in range(DEGREE - 1):
        after_sigma = 1 / (2 / scale - sigma)
        after = (apply(now) - centre * now) * (2 * after_sigma / half) - sigma * after_sigma * before
        before, now, sigma = now, after, after_sigma
    return now


def fit_blocks(blocks: DataFrame, dim: int, components: int = COMPONENTS, seed: int = 11) -> Whitening | None:
    """Fit on stored blocks of integer vectors; None where there is no row or no variance."""
    counted = _gather(blocks, lambda row: np.append(_matrix(row, dim).sum(axis=0), len(row["vec_ids"][0])), (dim + 1,), exact=True)
    sums, n = counted[:dim], int(counted[dim])
    if n == 0:
        return None
    passes = 0

    def apply(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1

        def part(row: pa.RecordBatch) -> np.ndarray:
            x = (n * _matrix(row, dim) - sums) / n  # centred before it is multiplied; the difference is exact
            return x.T @ (x @ q)

        return _gather(blocks, part, q.shape) / n

    trace = float(_gather(blocks, lambda row: (((n * _matrix(row, dim) - sums) / n) ** 2).sum(axis=0), (dim,)).sum()) / n
    if trace <= 0:
        return None
    rng = np.random.default_rng([seed, dim])
    width = min(dim, GUARD * components)
    wanted = min(components, dim)
    q = np.linalg.qr(rng.standard_normal((dim, width)))[0]
    low = 0.0 if width == dim else _lower_bound(apply, dim, rng)
    best = math.inf
    for _ in range(MOST_ROUNDS):
        vq = apply(q)
        h = q.T @ vq
        values, s = np.linalg.eigh((h + h.T) / 2)
        values, s = values[::-1], s[:, ::-1]
        q, vq = q @ s, vq @ s
        residuals = np.linalg.norm(vq - q * values, axis=0)[:wanted]
        worst = float(residuals.max() / values[0])
        if worst <= TOLERANCE or (worst <= SMALL_RESIDUAL and worst > best / 2) or width == dim:
            break
        best = min(best, worst)
        if values[0] - values[-1] <= 1e-14 * values[0]:
            break  # the whole block is one eigenspace
        q = np.linalg.qr(_chebyshev(apply, q, min(low, values[-1] * (1 - 1e-9)), values[-1], values[0], vq))[0]
    else:
        raise RuntimeError(f"the residual {worst} is not certified after {MOST_ROUNDS} rounds")
    q = q * np.sign(q[np.abs(q).argmax(axis=0), np.arange(width)])  # one sign for all rows
    real = int((values[:wanted] > dim * np.finfo(float).eps * trace).sum())
    return Whitening(n, sums, q[:, :real], values[:real], trace, residuals[:real], passes)


def whiten_blocks(blocks: DataFrame, dim: int, model: Whitening) -> DataFrame:
    """A row for each stored vector and component, with the error of the whole result."""
    n, sums, k = model.n, model.sums, len(model.values)
    scaled = model.vectors / np.sqrt(model.values)

    def project(row: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        moved = n * _matrix(row, dim) - sums
        return moved, (moved / n) @ scaled

    mean = _gather(blocks, lambda row: project(row)[1].sum(axis=0), (k,)) / n

    def spread(row: pa.RecordBatch) -> np.ndarray:
        w = project(row)[1] - mean
        return w.T @ w

    error = float(np.abs(_gather(blocks, spread, (k, k)) / n - np.eye(k)).max())
    explained = model.values / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(batch.num_rows):
                row = batch.slice(b, 1)
                moved, whitened = project(row)
                m = len(moved)
                fits = (moved.astype(np.float64) ** 2).sum(axis=1) < 2.0 ** 63 * (1 - 1e-9)
                deviation = pa.array((moved ** 2).sum(axis=1), mask=~fits)
                yield pa.RecordBatch.from_arrays([
                    row["vec_ids"].flatten().take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                    deviation.take(pa.array(np.repeat(np.arange(m), k))), pa.array(whitened.ravel()),
                    pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                ], names=[f.split()[0] for f in OUTPUT])

    return blocks.mapInArrow(run, ", ".join(OUTPUT))


OUTPUT = ["vec_id long", "component int", "n long", "deviation long", "whitened double", "explained double", "identity_error double"]


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (vec_id, component from 1, n, deviation, whitened, explained,
    identity_error) of every valid vector, for up to ``components`` components.

    The integer vectors are written once to the shared folder; every pass reads
    them there, and so does the result.
    """
    spark: SparkSession = vectors.sparkSession
    packed, dim = _packed(vectors, id_col, vector_col)
    if dim == 0:
        return spark.createDataFrame([], ", ".join(OUTPUT))
    blocks, path = stored_at(packed, "whitening")
    model = fit_blocks(blocks, dim, components)
    if model is None or not len(model.values):
        discard(spark, path)
        return spark.createDataFrame([], ", ".join(OUTPUT))
    return whiten_blocks(blocks, dim, model)
