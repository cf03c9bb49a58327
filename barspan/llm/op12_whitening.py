"""Embedding whitening by principal components in more than double precision.

Each entry c becomes the integer x = floor(1024 * c) + 100000. One pass sums x; a second one
multiplies y = x - m, where the integers m are next to the means, so that centring comes before
multiplying and every product and sum of entries below ``EXACT`` is exact. The driver gets d sums and
d * (d + 1) / 2 products, nothing that grows with the rows.

The covariance (an exact quotient, kept as extended precision) is decomposed in float32 first. Its
eigenvectors are then corrected by Ogita-Aishima steps: matrix products in extended precision give
the residuals R = I - X'X and S = X'VX, from which follows a correction that doubles the number of right
digits. Where eigenvalues are too close for the step to divide by their difference, the basis of the
cluster is turned by a small eigenvalue problem of the cluster alone (a sub-solve), taken relative to
the cluster's mean. Steps go on until the correction is below double precision or no longer falls. The
largest entry of a component is positive.

Nulls and odd rows: a vector that is null or holds null or non-finite entries is left out; an empty
vector has no component. Vectors of another length are another space with its own fit and n. A
null id is returned, repeated rows count and are returned each. Entries beyond 2**40 count as that
bound; a deviation that no long holds is null. A component without variance (one row, equal rows) has
``explained`` 0 and a null ``whitened`` (of no variance at all: a null ``explained``), and stands outside
``identity_error``. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspan.llm.common import modest_batches
from barspan.llm.textops import tidy

SCALE, SHIFT, BOUND = 1024, 100_000, 1 << 40
#: Largest |y| whose products sum exactly in double precision over ``BLOCK`` rows: 2**40 * 2**12 < 2**53.
EXACT, BLOCK = 1 << 20, 1 << 12
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def usable(table: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows whose vector is whole and finite."""
    v = F.col("embedding").cast("array<double>")
    whole = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    src = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding"))
    return src.where(F.col("embedding").isNotNull() & whole).select("vec_id", "embedding")


def _spaces(batch: pa.RecordBatch):
    """(rows, x as a matrix) per vector length of a batch."""
    lists = batch.column(batch.schema.names.index("embedding"))
    size = lists.value_lengths().to_numpy()
    flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    begin = np.cumsum(size) - size
    for d in np.unique(size).tolist():
        rows = np.flatnonzero(size == d)
        if d:
            c = flat[begin[rows][:, None] + np.arange(d)]
            yield rows, np.floor(np.clip(c * SCALE, -BOUND, BOUND)).astype(np.int64) + SHIFT


def _cells(dims: int, values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), pa.array([[str(v) for v in values]], pa.list_(pa.string()))], ["dims", "cells"])


def _added(parts: DataFrame, kind: str = "decimal(38,0)") -> dict[int, list]:
    """Cell by cell sums per vector length, exact and in any order."""
    rows = parts.select("dims", F.posexplode("cells").alias("at", "cell")).groupBy("dims", "at").agg(F.sum(F.col("cell").cast(kind)).alias("s"))
    out: dict[int, list] = {}
    for r in rows.orderBy("dims", "at").collect():
        out.setdefault(r.dims, []).append(r.s)
    return out


def sums(vectors: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Per vector length: rows and the sum of x of each dimension."""

    def run(batches):
        held: dict[int, list] = {}
        for b in batches:
            for rows, x in _spaces(b):
                now = [len(rows), *x.sum(0).tolist()]
                held[x.shape[1]] = [p + q for p, q in zip(held[x.shape[1]], now)] if x.shape[1] in held else now
        for d, cells in held.items():
            yield _cells(d, cells)

    got = _added(vectors.select("embedding").mapInArrow(tidy(run), "dims int, cells array<string>"))
    return {d: (int(c[0]), [int(s) for s in c[1:]]) for d, c in got.items()}


def _products(y: np.ndarray) -> np.ndarray:
    """Y'Y of integers as integers: exact below ``EXACT``, else to double precision."""
    if np.abs(y).max(initial=0) < EXACT:
        total = np.zeros((y.shape[1], y.shape[1]), np.int64)
        for at in range(0, len(y), BLOCK):
            part = y[at : at + BLOCK].astype(np.float64)
            total += (part.T @ part).astype(np.int64)
        return total.astype(object)
    part = y.astype(np.float64)
    whole = np.vectorize(int, otypes=[object])
    return whole(part.T @ part)


def covariances(vectors: DataFrame, fits: dict[int, tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """Covariance of x per vector length, divisor n, in extended precision."""
    centres = {d: [round(Fraction(s, n)) for s in total] for d, (n, total) in fits.items()}

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for _, x in _spaces(b):
                d = x.shape[1]
                held[d] = held.get(d, 0) + _products(x - np.array(centres[d]))
        for d, p in held.items():
            yield _cells(d, p[np.triu_indices(d)])

    got = _added(vectors.select("embedding").mapInArrow(tidy(run), "dims int, cells array<string>"))
    out = {}
    for d, cells in got.items():
        n, total = fits[d]
        rest = [s - n * m for s, m in zip(total, centres[d])]
        v = np.zeros((d, d), np.longdouble)
        for (i, j), cell in zip(zip(*np.triu_indices(d)), cells):
            exact = Fraction(n * int(cell) - rest[i] * rest[j], n * n)
            high = float(exact)
            v[i, j] = v[j, i] = np.longdouble(high) + np.longdouble(float(exact - Fraction(high)))
        out[d] = v
    return out


def _clusters(values: np.ndarray, delta) -> list[np.ndarray]:
    """Runs of eigenvalues (sorted) whose neighbours are within ``delta``; single ones left out."""
    cut = np.flatnonzero(np.abs(np.diff(values)) > delta) + 1
    return [c for c in np.split(np.arange(len(values)), cut) if len(c) > 1]


def refined_eigh(v: np.ndarray, steps: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors of a symmetric matrix, to double precision and beyond.

    Starts from float32 eigenvectors; each step squares their error (Ogita and Aishima), clusters
    are turned by sub-solves.
    """
    v = np.asarray(v, np.longdouble)
    scale = np.abs(v).max(initial=0)
    d = len(v)
    if not d or not scale > 0:
        return np.zeros(d), np.eye(d)
    a = v / scale
    x = np.linalg.eigh(a.astype(np.float32))[1][:, ::-1].astype(np.longdouble)
    eye, best, left = np.eye(d, dtype=np.longdouble), None, np.inf
    for _ in range(steps):
        r = eye - x.T @ x
        r = (r + r.T) / 2
        s = x.T @ a @ x
        s = (s + s.T) / 2
        lam = np.diag(s) / (1 - np.diag(r))
        order = np.argsort(-lam, kind="stable")
        if not np.array_equal(order, np.arange(d)):
            x, r, s, lam = x[:, order], r[np.ix_(order, order)], s[np.ix_(order, order)], lam[order]
        off = s - np.diag(lam)
        # the bound below which a difference of eigenvalues says nothing
        delta = 2 * (np.sqrt((off**2).sum()) + np.sqrt((a**2).sum()) * np.sqrt((r**2).sum()))
        gap = lam[None, :] - lam[:, None]
        # E = R / 2 + K with K antisymmetric, so that rounding over a small gap turns columns but leaves them orthogonal
        with np.errstate(divide="ignore", invalid="ignore"):
            k = np.where(np.abs(gap) > delta, (s + (lam[None, :] + lam[:, None]) / 2 * r) / gap, 0)
        k = np.triu(k, 1)
        e = r / 2 + k - k.T
        residual = np.abs(a @ x - x * lam).max() + np.abs(r).max()
        if best is None or residual < left:
            best = (lam.copy(), x.copy())
        if residual >= left / 2 and residual < 1e-16:
            break
        left = min(left, residual)
        x = x + x @ e
        for c in _clusters(lam, delta):
            y = x[:, c]
            q = y.T @ y
            y = y + y @ (np.eye(len(c), dtype=np.longdouble) - q) / 2  # back to unit columns
            shifted = y.T @ (a @ y - y * lam[c].mean())
            top = np.abs(shifted).max()
            if top > 0:
                turn = np.linalg.eigh(((shifted + shifted.T) / (2 * top)).astype(np.float64))[1][:, ::-1]
                x[:, c] = y @ turn.astype(np.longdouble)
    lam, x = best
    x = x / np.sqrt((x**2).sum(0))
    return (lam * scale).astype(np.float64), x


class Space:
    """What one vector length needs: sums, components and their standard deviations."""

    def __init__(self, n: int, total: list[int], v: np.ndarray, components: int):
        self.n, self.total = n, np.array(total, object)
        values, vectors = refined_eigh(v)
        k = min(components, len(values))
        trace = float(np.trace(v))
        noise = len(values) * np.finfo(np.float64).eps * max(float(values[0]), 0.0)
        self.alive = values[:k] > noise
        self.explained = np.where(self.alive, values[:k], 0.0) / trace if trace > 0 else np.full(k, np.nan)
        x = vectors[:, :k]
        x = x * np.where(x[np.abs(x).argmax(0), np.arange(k)] < 0, -1, 1)
        self.components = x.astype(np.float64)
        self.deviation = np.sqrt(np.where(self.alive, values[:k], 1.0))
        # S / n as an integer and the rest, so that x - S / n keeps its digits
        self.centre = np.array([round(Fraction(s, n)) for s in total], np.int64)
        self.rest = np.array([float(Fraction(s, n) - m) for s, m in zip(total, self.centre.tolist())])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.centre) - self.rest) @ self.components / self.deviation
        z[:, ~self.alive] = np.nan
        return z

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n * x - S)**2, exact; None beyond a long."""
        y = x - self.centre
        rest = [int(s) - self.n * int(m) for s, m in zip(self.total, self.centre)]
        most = max(int(np.abs(y).max(initial=0)) * self.n + max(map(abs, rest), default=0), 1)
        if most * most * x.shape[1] < 2**63:
            return ((y * self.n - np.array(rest, np.int64)) ** 2).sum(1).tolist()
        exact = ((y.astype(object) * self.n - np.array(rest, object)) ** 2).sum(1)
        return [int(e) if e < 2**63 else None for e in exact]


def _identity_errors(vectors: DataFrame, spaces: dict[int, Space]) -> dict[int, float | None]:
    """Largest absolute entry of the covariance of the whitened rows minus the identity."""

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for _, x in _spaces(b):
                space = spaces[x.shape[1]]
                z = space.whitened(x)[:, space.alive]
                held[x.shape[1]] = held.get(x.shape[1], 0) + np.concatenate([z.sum(0), (z.T @ z)[np.triu_indices(z.shape[1])]])
        for d, cells in held.items():
            yield _cells(d, [f"{c:.12f}" for c in cells.tolist()])

    got = _added(vectors.select("embedding").mapInArrow(tidy(run), "dims int, cells array<string>"), "decimal(38,12)")
    out: dict[int, float | None] = dict.fromkeys(spaces)
    for d, cells in got.items():
        n, k = spaces[d].n, int(spaces[d].alive.sum())
        mean = np.array([float(c) for c in cells[:k]]) / n
        cov = np.zeros((k, k))
        cov[np.triu_indices(k)] = np.array([float(c) for c in cells[k:]]) / n
        # the rows are centred at S / n already; what is left of their mean is rounding
        cov = cov + np.triu(cov, 1).T - np.outer(mean, mean)
        out[d] = float(np.abs(cov - np.eye(k)).max())
    return out


def fit(vectors: DataFrame, components: int = 8) -> dict[int, Space]:
    """Components of each vector length, on the driver: d * d numbers."""
    fits = sums(vectors)
    v = covariances(vectors, fits) if fits else {}
    return {d: Space(n, total, v[d], components) for d, (n, total) in fits.items()}


def whiten(table: DataFrame, components: int = 8) -> DataFrame:
    """One row per usable vector and component."""
    modest_batches(table.sparkSession)
    vectors = usable(table)
    spaces = fit(vectors, components)
    errors = _identity_errors(vectors, spaces) if spaces else {}

    def run(batches):
        for b in batches:
            ids = b.column(b.schema.names.index("vec_id"))
            for rows, x in _spaces(b):
                d = x.shape[1]
                space, k, m = spaces[d], len(spaces[d].alive), len(rows)
                z = space.whitened(x).ravel()
                explained = np.tile(space.explained, m)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(np.repeat(rows, k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, space.n)),
                        pa.array(space.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                        pa.array(z, mask=np.isnan(z)),
                        pa.array(explained, mask=np.isnan(explained)),
                        pa.array([errors[d]] * (m * k), pa.float64()),
                    ],
                    schema=SCHEMA,
                )

    return vectors.mapInArrow(tidy(run), RESULT)


SCHEMA = pa.schema(
    [("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())]
)
