"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

The centred rows X of the fit list stay in Spark. Each step multiplies them with a
vector and their transpose with the result, in two passes: the first gives the part
of u = Xv that lies in earlier left vectors, the second repeats this for what is
left, so that u is orthogonal to double precision, and returns Xᵀu. A left vector
is a product of X itself, u = Xw, so a task makes its entries of all earlier ones
from its rows and the vectors w; the driver holds a few vectors of one row's length
and nothing grows with the rows. The singular values and vectors of the small
bidiagonal matrix yield deviations and components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import vectors as vx
from textloom.session import staged

#: A vector counts as zero below this share of the largest singular value.
_ZERO = 1e-12
#: A component is final when its residual is below this share of the largest.
_FINAL = 1e-15
_MOST = 1 << 63


@dataclass(frozen=True)
class Whitening:
    """``n`` fit vectors with sums ``sums``; unit components as rows, falling
    ``variance``, and the trace of the covariance."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    variance: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return self.sums / max(self.n, 1)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.components.T / np.sqrt(self.variance)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n*x - S)^2; None beyond the range of a long."""
        off = x.astype(object) * self.n - self.sums if self._wide(x) else x * self.n - self.sums
        if off.dtype != object and np.abs(off, dtype=np.float64).max(initial=0) < np.sqrt(_MOST / (x.shape[1] + 1)):
            return (off * off).sum(1).tolist()
        exact = [sum(int(v) ** 2 for v in row) for row in off]
        return [v if v < _MOST else None for v in exact]

    def _wide(self, x: np.ndarray) -> bool:
        return float(np.abs(x.astype(np.float64)).max(initial=0)) * self.n * 4 >= _MOST


def _subtract(batch: pa.RecordBatch, width: int, mean: np.ndarray) -> np.ndarray:
    return vx.matrix(batch.column("x"), width).astype(np.float64) - mean


def _orthogonal(v: np.ndarray, basis: np.ndarray) -> np.ndarray:
    for _ in range(2):
        v = v - basis.T @ (basis @ v)
    return v


def bidiagonalise(fit: DataFrame, width: int, mean: np.ndarray, most: int, seed: int = 7):
    """The ``most`` largest singular values of the centred rows and their right
    vectors.

    Steps go on until these have converged. Where a direction ends early (fewer
    independent rows, or equal values, of which one start sees a single vector) the
    next one starts at random beside all earlier, until the energy left outside is
    less than the last wanted value's or the space is used up.
    """
    draw = np.random.default_rng(seed)
    energy = vx.totals(fit, lambda b: np.array([np.square(_subtract(b, width, mean)).sum()]), 1)[0]
    none = np.zeros((0, width))
    V, W, Z, alphas, betas = none, none, none, [], []
    v = draw.normal(size=width)
    v /= np.linalg.norm(v)
    beta, broken, scale = 0.0, False, np.sqrt(energy)
    while len(V) < width and scale > 0:
        V = np.vstack([V, v])
        w = v - beta * W[-1] if len(W) and beta else v
        # First pass: u = Xw against earlier left vectors.
        both = np.vstack([W, w])

        def first(b: pa.RecordBatch, both=both) -> np.ndarray:
            u = _subtract(b, width, mean) @ both.T
            return u[:, :-1].T @ u[:, -1]

        w = w - vx.totals(fit, first, len(W)) @ W if len(W) else w
        both = np.vstack([W, w])

        # Second pass: what rounding left of them, the norm, and X'u.
        def second(b: pa.RecordBatch, both=both) -> np.ndarray:
            x = _subtract(b, width, mean)
            u = x @ both.T
            return np.concatenate([u.T @ u[:, -1], x.T @ u[:, -1]])

        got = vx.totals(fit, second, len(both) + width)
        rest, square, z = got[: len(W)], got[len(W)], got[len(both) :]
        alpha = np.sqrt(max(square - rest @ rest, 0.0))
        dead = alpha <= _ZERO * scale
        alphas.append(0.0 if dead else alpha)
        W = np.vstack([W, np.zeros(width) if dead else (w - rest @ W) / alpha])
        Z = np.vstack([Z, np.zeros(width) if dead else (z - rest @ Z) / alpha])
        v = _orthogonal(Z[-1] - alphas[-1] * V[-1], V)
        beta = float(np.linalg.norm(v))
        B = np.diag(alphas) + np.diag(betas, 1)
        left, sigma, right = np.linalg.svd(B)
        k = min(most, len(sigma))
        outside = energy - float(np.square(sigma).sum())
        if len(sigma) >= most:
            final = (beta * np.abs(left[-1, :k]) <= _FINAL * sigma[0]).all()
            if final and (not broken or outside < sigma[k - 1] ** 2):
                break
        if beta <= _ZERO * scale:
            beta, broken = 0.0, True
            v = _orthogonal(draw.normal(size=width), V)
            if len(V) == width:
                break
            v = _orthogonal(v / np.linalg.norm(v), V)
            betas.append(0.0)
            v /= np.linalg.norm(v)
        else:
            betas.append(beta)
            v = v / beta
    if not len(V):
        return np.zeros(0), none
    k = min(most, len(sigma))
    return sigma[:k], (right @ V)[:k]


def quantised(table: DataFrame, column: str, factor: int) -> tuple[DataFrame, int]:
    """The rows whose vector takes part, with ``x``, and the vectors' length.

    Null vectors and those with null or non-finite entries leave, and so do vectors
    of another length than the commonest.
    """
    kept = table.filter(vx.finite(F.col(column)))
    width = vx.common_length(kept, column)
    x = F.transform(F.col(column), lambda c: F.floor(c.cast("double") * factor).cast("long"))
    return kept.filter(F.size(column) == width).withColumn("x", x), width


def fit(rows: DataFrame, width: int, components: int = 4) -> Whitening:
    """Fitted on each distinct ``x`` once. Components without variance are left out."""
    width = max(width, 1)
    listed = staged(rows.select("x").distinct(), "fit_list")

    def count(b: pa.RecordBatch) -> np.ndarray:
        return np.concatenate([[b.num_rows], vx.matrix(b.column("x"), width).sum(0)])

    got = vx.totals(listed, count, width + 1, np.int64)
    n, sums = int(got[0]), got[1:]
    model = Whitening(n, sums, np.zeros((0, width)), np.zeros(0), 0.0)
    if n < 2:
        return model
    mean = model.mean
    sigma, found = bidiagonalise(listed, width, mean, min(components, width))
    keep = sigma > _ZERO * sigma.max(initial=0)
    if not keep.any():
        return model
    energy = vx.totals(listed, lambda b: np.square(_subtract(b, width, mean)).sum(0), width)
    model = Whitening(n, sums, found[keep], np.square(sigma[keep]) / n, float(energy.sum()) / n)
    k = len(model.variance)

    def moments(b: pa.RecordBatch) -> np.ndarray:
        z = model.whiten(vx.matrix(b.column("x"), width))
        return np.concatenate([z.sum(0), (z.T @ z).ravel()])

    got = vx.totals(listed, moments, k + k * k) / n
    covariance = got[k:].reshape(k, k) - np.outer(got[:k], got[:k])
    error = float(np.abs(covariance - np.eye(k)).max())
    return Whitening(n, sums, model.components, model.variance, model.trace, error)


SCHEMA = (
    "component int, n long, deviation long, whitened double, explained double, identity_error double"
)


def whiten(table: DataFrame, column: str = "embedding", components: int = 4, factor: int = 256, key: str = "vec_id"):
    """Per row and component: the whitened value of floor(factor * vector).

    Rows whose vector is null, holds a null or non-finite entry or has another
    length than most give nothing; a null key stays a key; repeated rows are
    returned as often as they are there and fitted once. Fewer than two distinct
    vectors, or no variance, give no rows, as there are no components. A deviation
    beyond the range of a long is null.
    """
    rows, width = quantised(table.select(F.col(key).alias("_key"), F.col(column).alias("_v")), "_v", factor)
    rows = staged(rows.select("_key", "x"), "quantised")
    model = fit(rows, width, components)
    k = len(model.variance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            x = vx.matrix(batch.column("x"), width)
            m = len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_key").take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.n)),
                    pa.array([d for d in model.deviation(x) for _ in range(k)], pa.int64()),
                    pa.array(model.whiten(x).ravel()),
                    pa.array(np.tile(model.variance / model.trace, m)),
                    pa.array(np.full(m * k, model.identity_error)),
                ],
                [key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    kind = rows.schema["_key"].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {kind}, {SCHEMA}")
