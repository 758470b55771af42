"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation of their centred table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save

#: Entries are counted in steps of 1 / STEPS, from OFFSET up.
STEPS, OFFSET = 64, 1_000_000
#: Entries beyond this are not usable, as their counts would leave the whole numbers of a double.
LARGEST = float(1 << 46)
#: Bidiagonalisation is complete up to this width; beyond, it ends when the triplets asked for have converged.
COMPLETE = 64
#: Singular values below this share of the largest are zero.
RANK = 1e-10
#: Numbers of a table that are looked at together in a task.
TOGETHER = 2_000_000


@dataclass
class Whitening:
    """n and the sums S of the fit list; unit components (columns) and deviations (square roots of eigenvalues); trace."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    deviations: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x * self.n - self.sums) / self.n  # whole numbers up to the division

    def project(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x) @ self.components) / self.deviations


def usable(vector: Column) -> Column:
    """Whether a vector has entries, all of them numbers up to LARGEST."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LARGEST))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(fine, F.lit(False))


def counted(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * STEPS).cast("long") + OFFSET)


def _matrices(batches: Iterator[pa.RecordBatch], column: int, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches with their vectors as a matrix of whole numbers."""
    most = max(1, TOGETHER // width)
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            part = batch.slice(at, most)
            yield part, part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, width)


def _totals(fit: DataFrame, width: int, measure: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray:
    """The sum of measure(matrix) over all vectors of the fit list; only one value a place comes to the driver."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _matrices(batches, 0, width):
            total = measure(x) if total is None else total + measure(x)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["i", "v"])

    rows = fit.select("x").mapInArrow(summed, f"i int, v {kind}").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(rows), dtype=np.int64 if kind == "long" else np.float64)
    for r in rows:
        out[r["i"]] = r["v"]
    return out


def bidiagonalise(product: Callable[[np.ndarray], tuple[float, np.ndarray]], width: int, wanted: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right singular vectors as columns), largest first, of a table X known by its products.

    product(q) gives |Xq|^2 and X'(Xq), one pass over X. Left vectors are as long as X has rows, so they
    are never stored: each is X w for a short w, and their products with X q are those of w with
    X'Xq. Left and right vectors are made orthogonal to all earlier ones, twice where the first time
    took much away. Where a Krylov space ends early it goes on from a new direction, so repeated values are found
    as well. Up to COMPLETE columns all steps are made; beyond, it ends when `wanted` triplets and four
    more leave residuals below 1e-13 of the largest value.
    """
    rng = np.random.default_rng(seed)
    right, left, back = (np.zeros((width, 0)) for _ in range(3))  # v, w, and X'u of every step
    alphas: list[float] = []
    betas: list[float] = []
    scale = 0.0

    def away(r: np.ndarray) -> np.ndarray:
        for _ in range(2):
            r = r - right @ (right.T @ r)
        return r

    v = rng.standard_normal(width)
    v /= np.linalg.norm(v)
    while True:
        q = v - betas[-1] * left[:, -1] if betas else v
        while True:
            norm, s = product(q)
            c = left.T @ s
            q, s, rest = q - left @ c, s - back @ c, norm - float(c @ c)
            if rest >= 0.5 * norm or norm <= (1e-14 * scale) ** 2:
                break
        alpha = max(rest, 0.0) ** 0.5
        scale = max(scale, alpha)
        lost = alpha <= 1e-14 * scale
        alphas.append(0.0 if lost else alpha)
        w, z = (np.zeros(width), np.zeros(width)) if lost else (q / alpha, s / alpha)
        right, left, back = (np.column_stack([m, x]) for m, x in ((right, v), (left, w), (back, z)))
        k = len(alphas)
        if k == width:
            break
        r = away(z - alphas[-1] * v)
        beta = float(np.linalg.norm(r))
        ended = beta <= 1e-14 * scale
        if k >= max(COMPLETE, wanted + 4) and not ended:
            values, p = _small_svd(alphas, betas)[1:]
            if (beta * np.abs(p[-1, : wanted + 4]) <= 1e-13 * values[0]).all():
                break
        if ended:
            beta, r = 0.0, away(rng.standard_normal(width))
        v = away(r / np.linalg.norm(r))
        v /= np.linalg.norm(v)
        betas.append(beta)
    vectors, values, _ = _small_svd(alphas, betas)
    found = right @ vectors
    return values, found / np.linalg.norm(found, axis=0)


def _small_svd(alphas: list[float], betas: list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(right vectors, values, left vectors) of the small upper bidiagonal matrix."""
    b = np.diag(alphas) + np.diag(betas[: len(alphas) - 1], 1)
    p, values, q = np.linalg.svd(b)
    return q.T, values, p


def fit_whitening(fit: DataFrame, width: int, wanted: int = 16) -> Whitening | None:
    """The components of the fit list (x: distinct whole-number vectors of one width) with the largest eigenvalues.

    Up to `wanted`, and no more than its covariance has rank. None without vectors. The driver holds vectors of the width only.
    """
    first = _totals(fit, width, lambda x: np.append(x.sum(axis=0), len(x)), "long")
    if not len(first):
        return None
    model = Whitening(int(first[-1]), first[:-1], np.zeros((width, 0)), np.zeros(0), 0.0)
    centre = model.centred
    model.trace = float(_totals(fit, width, lambda x: np.array([(centre(x) ** 2).sum()]))[0]) / model.n
    if model.trace == 0:
        return model

    def product(q: np.ndarray) -> tuple[float, np.ndarray]:
        def measure(x: np.ndarray) -> np.ndarray:
            c = centre(x)
            p = c @ q
            return np.append(c.T @ p, p @ p)

        total = _totals(fit, width, measure)
        return float(total[-1]), total[:-1]

    values, vectors = bidiagonalise(product, width, wanted)
    kept = min(wanted, int((values > RANK * values[0]).sum()))
    model.components, model.deviations = vectors[:, :kept], values[:kept] / model.n**0.5
    return model


def identity_error(fit: DataFrame, width: int, model: Whitening) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity."""
    k, project, n = len(model.deviations), model.project, model.n
    mean = _totals(fit, width, lambda x: project(x).sum(axis=0)) / n

    def measure(x: np.ndarray) -> np.ndarray:
        y = project(x) - mean
        return (y.T @ y).ravel()

    return float(np.abs(_totals(fit, width, measure).reshape(k, k) / n - np.eye(k)).max())


def whiten(table: DataFrame, wanted: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each usable row and component.

    Entries c become x = floor(64 c) + 1000000. The fit list has each distinct x vector once; components are
    those of its covariance, numbered from 1 by falling eigenvalue. Rows whose vector is null or empty,
    or holds null, non-finite or enormous entries (beyond 2 ** 46), are dropped. Vectors of
    different widths are whitened apart, each width by its own list. A component without variance has no
    row, so a single distinct vector gives none. deviation is exact; where it exceeds a long it is
    null. Repeated rows and ids stay, a null id too. Other columns are not read.
    """
    spark = table.sparkSession
    id_type = table.schema[id_col].dataType.simpleString()
    rows = table.where(usable(F.col(vector_col))).select(F.col(id_col).alias("vec_id"), counted(F.col(vector_col)).alias("x"))
    fits = save(rows.select("x").distinct())
    widths = [r["w"] for r in fits.select(F.size("x").alias("w")).distinct().orderBy("w").collect()]
    schema = f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    out = spark.createDataFrame([], schema)
    for width in widths:
        fit = fits.where(F.size("x") == width)
        model = fit_whitening(fit, width, wanted)
        if model is not None and len(model.deviations):
            applied = _applied(model, width, identity_error(fit, width, model))
            out = out.unionByName(rows.where(F.size("x") == width).mapInArrow(applied, schema))
    return out


def _applied(model: Whitening, width: int, error: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    k = len(model.deviations)
    explained = model.deviations**2 / model.trace

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _matrices(batches, 1, width):
            y = model.project(x)
            off = x * model.n - model.sums
            if (off.astype(np.float64) ** 2).sum(axis=1).max() < 2.0**62:
                deviation = pa.array((off * off).sum(axis=1))
            else:
                exact = [sum(int(v) ** 2 for v in row) for row in off]
                deviation = pa.array([d if d < 1 << 63 else None for d in exact], pa.int64())
            m = part.num_rows
            each = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.n, dtype=np.int64)),
                    deviation.take(pa.array(each)),
                    pa.array(y.ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return applied
