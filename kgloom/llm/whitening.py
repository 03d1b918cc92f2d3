"""Embedding whitening: the leading eigenvectors of the covariance by LOBPCG (Knyazev, "Toward the Optimal Preconditioned Eigensolver",
2001), with every product of the covariance and a block of directions made over the rows on the cluster.

Rows come as whole numbers x = floor(64 * c) + 1000000. Their number n and the sums S of each dimension are exact, so a row is centred
without loss, as (n * x - S) / n, before anything is multiplied. A product of the covariance with a block B is one pass: each task
adds up row (row . B) over its centred rows and hands on one matrix as wide as B; these are added by place. The driver holds matrices
of dimensions times 3 * (components + GUARD) at most, whatever the number of rows.

A round takes the residuals of the iterate and the directions it last moved along, makes them orthonormal to the iterate and to each
other, multiplies the covariance with them, and solves the Rayleigh-Ritz problem on iterate, residuals and directions together.
Rounds end when the residuals ||V u - e u||, made from a fresh product with the very vectors that are returned, are at most
`tolerance` times the greatest eigenvalue: that certifies them. If that doesn't come about in `most_rounds` rounds, it raises.

Defined results: null vectors and vectors with a null, NaN or infinite entry are left out, and so are those whose length isn't the
commonest one (of several the greatest): they lack entries or have too many. Entries beyond 2**62 in absolute value, times 64, are cut there.
Null vec_ids and repeated rows are rows like others; extra columns are not read. Directions without variance (an eigenvalue
of no more than rounding makes of the greatest) have no whitened values, so there are fewer components then, and none if all rows are equal. A
deviation beyond a long is null. A table without rows gives none.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy, tune, written

#: Fixed values of the contract: the grid, its origin and the most components.
SCALE, ORIGIN, COMPONENTS = 64, 1_000_000, 32
#: Directions that are iterated beside the wanted ones, which makes these settle sooner.
GUARD = 8
_FAR = 1 << 62


@dataclasses.dataclass(frozen=True)
class Whitening:
    """What a fit gives: n and S of each dimension, eigenvalues by falling size with unit vectors as columns, the trace, the greatest
    certified residual over the greatest eigenvalue, the number of products made, and the whitened rows' distance from the identity."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residual: float
    products: int
    identity_error: float

    @property
    def whole(self) -> np.ndarray:
        """What centred rows are multiplied with."""
        return self.vectors / np.sqrt(self.values)


def lattice(vectors: DataFrame) -> DataFrame:
    """vec_id and x (array<long>) of the usable rows of (vec_id, embedding), written to the shared folder; all x are of one length."""
    c = lambda v: v.cast("double")
    fine = F.col("embedding").isNotNull() & F.forall("embedding", lambda v: F.coalesce(F.abs(c(v)) < float("inf"), F.lit(False)) & ~F.isnan(c(v)))
    grid = F.transform("embedding", lambda v: F.floor(F.least(F.greatest(c(v) * SCALE, F.lit(-float(_FAR))), F.lit(float(_FAR)))).cast("long") + F.lit(ORIGIN).cast("long"))
    x = written(vectors.where(fine).select("vec_id", grid.alias("x")))
    lengths = x.groupBy(F.size("x").alias("d")).count().where("d > 0").orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return x.where(F.size("x") == (lengths[0].d if lengths else -1))


def _rows(b: pa.RecordBatch) -> np.ndarray:
    x = b.column("x")
    return x.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)


def _exact(x: np.ndarray, times: int) -> np.ndarray:
    """x, as Python's integers if x times `times` wouldn't fit 64 bits."""
    return x if len(x) == 0 or int(np.abs(x).max()) * max(1, times) < _FAR else x.astype(object)


def _shifted(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly."""
    x = _exact(x, 2 * n)
    return x * n - (np.array(sums, dtype=object) if x.dtype == object or max(map(abs, sums)) >= _FAR else np.array(sums, dtype=np.int64))


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return (_shifted(x, n, sums) / n).astype(np.float64)


def _added(x: DataFrame, partial: Callable[[Iterator[np.ndarray]], list | None], kind: str) -> list:
    """The sums, place by place, of the lists that `partial` makes of each task's rows; lists are as long as a matrix of the driver's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = partial(_rows(b) for b in batches if b.num_rows)
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], type=pa.list_(pa.decimal128(38, 0) if kind.startswith("decimal") else pa.float64()))], names=["part"])

    parts = x.select("x").mapInArrow(tidy(run), f"part array<{kind}>")
    return [r.s for r in parts.select(F.posexplode("part").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("s")).orderBy("at").collect()]


def _totals(x: DataFrame) -> tuple[int, list[int]]:
    def partial(blocks: Iterator[np.ndarray]) -> list | None:
        n, sums = 0, None
        for b in blocks:
            n += len(b)
            s = _exact(b, len(b)).sum(axis=0).astype(object)
            sums = s if sums is None else sums + s
        return None if sums is None else [Decimal(int(v)) for v in (n, *sums)]

    found = [int(v) for v in _added(x, partial, "decimal(38,0)")]
    return (found[0], found[1:]) if found else (0, [])


def _product(x: DataFrame, n: int, sums: list[int], block: np.ndarray) -> tuple[np.ndarray, float]:
    """The covariance times a block, and the covariance's trace."""

    def partial(blocks: Iterator[np.ndarray]) -> list | None:
        total, trace, seen = np.zeros(block.shape), 0.0, False
        for b in blocks:
            y = _centred(b, n, sums)
            total += y.T @ (y @ block)
            trace += float(np.einsum("ij,ij->", y, y))
            seen = True
        return [*total.ravel().tolist(), trace] if seen else None

    out = np.array(_added(x, partial, "double")) / n
    return out[:-1].reshape(block.shape), float(out[-1])


def _identity_error(x: DataFrame, n: int, sums: list[int], whole: np.ndarray) -> float:
    k = whole.shape[1]

    def partial(blocks: Iterator[np.ndarray]) -> list | None:
        squares, means, seen = np.zeros((k, k)), np.zeros(k), False
        for b in blocks:
            z = _centred(b, n, sums) @ whole
            squares += z.T @ z
            means += z.sum(axis=0)
            seen = True
        return [*squares.ravel().tolist(), *means.tolist()] if seen else None

    out = np.array(_added(x, partial, "double")) / n
    mean = out[k * k :]
    return float(np.abs(out[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def _ritz(basis: np.ndarray, image: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The greatest Ritz values over an orthonormal basis, and their vectors' coordinates."""
    h = basis.T @ image
    values, coordinates = np.linalg.eigh((h + h.T) / 2)
    return values[::-1][:most], coordinates[:, ::-1][:, :most]


def _beside(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Orthonormal directions of a block, orthogonal to a basis; those that vanish in rounding are dropped."""
    kept = []
    size = np.linalg.norm(block, axis=0)
    for column in (block / np.where(size > 0, size, 1)).T:
        against = np.column_stack([basis, *kept])
        for _ in range(2):
            column = column - against @ (against.T @ column)
            length = np.linalg.norm(column)
            if length < 1e-10:
                break
            column = column / length
        else:
            column = column - against @ (against.T @ column)
            kept.append(column / np.linalg.norm(column))
    room = basis.shape[0] - basis.shape[1]
    return np.column_stack(kept[:room]) if kept and room else np.zeros((basis.shape[0], 0))


def lobpcg(product: Callable[[np.ndarray], np.ndarray], dimensions: int, wanted: int, tolerance: float, most_rounds: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """The greatest eigenvalues, their unit vectors and the greatest certified residual (over the greatest eigenvalue) of a symmetric
    operator that is known by its products with blocks only."""
    width = min(dimensions, wanted + GUARD)
    u = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimensions, width)))[0]
    image, fresh, moved = product(u), True, np.zeros((dimensions, 0))
    for _ in range(most_rounds):
        values, turn = _ritz(u, image, width)
        u, image = u @ turn, image @ turn
        residuals = image - u * values
        size = np.linalg.norm(residuals, axis=0)
        scale = max(float(values[0]), 0.0)
        if scale == 0 or size[:wanted].max() <= tolerance * scale:
            if fresh:
                return values[:wanted], u[:, :wanted], float(size[:wanted].max() / scale) if scale else 0.0
            u = np.linalg.qr(u)[0]
            image, fresh = product(u), True
            continue
        more = _beside(np.column_stack([residuals[:, size > tolerance * scale / 10], moved]), u)
        if not more.shape[1]:
            u = np.linalg.qr(u)[0]
            image, fresh = product(u), True
            continue
        basis, images = np.column_stack([u, more]), np.column_stack([image, product(more)])
        _, turn = _ritz(basis, images, width)
        u, image, moved, fresh = basis @ turn, images @ turn, more @ turn[width:], False
    raise RuntimeError(f"residuals are above {tolerance} of the greatest eigenvalue after {most_rounds} rounds")


def fit(x: DataFrame, components: int = COMPONENTS, tolerance: float = 1e-13, most_rounds: int = 500) -> Whitening | None:
    """The whitening of the rows of a lattice; None if there are no rows."""
    tune(x.sparkSession)
    n, sums = _totals(x)
    if not n:
        return None
    made = [0, 0.0]

    def product(block: np.ndarray) -> np.ndarray:
        out, trace = _product(x, n, sums, block)
        made[0] += 1
        made[1] = trace
        return out

    values, vectors, residual = lobpcg(product, len(sums), min(components, len(sums)), tolerance, most_rounds)
    there = values > len(sums) * np.finfo(float).eps * max(float(values[0]), 0.0)
    values, vectors = values[there], vectors[:, there]
    error = _identity_error(x, n, sums, vectors / np.sqrt(values)) if len(values) else 0.0
    return Whitening(n, sums, values, vectors, made[1], residual, made[0], error)


def project(x: DataFrame, w: Whitening) -> DataFrame:
    """vec_id, deviation and whitened (an array, a value for each component) of the rows of a lattice."""
    tune(x.sparkSession)

    def deviations(shifted: np.ndarray) -> list[int | None]:
        rough = (shifted.astype(np.float64) ** 2).sum(axis=1)
        if rough.size and rough.max() < 9e18 and shifted.dtype != object:
            return (shifted * shifted).sum(axis=1).tolist()
        exact = (sum(int(v) ** 2 for v in row) for row in shifted)
        return [v if v < 1 << 63 else None for v in exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                shifted = _shifted(_rows(b), w.n, w.sums)
                z = (shifted / w.n).astype(np.float64) @ w.whole
                at = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * z.shape[1])
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(deviations(shifted), type=pa.int64()), pa.ListArray.from_arrays(at, pa.array(z.ravel()))], names=["vec_id", "deviation", "whitened"])

    kind = x.schema["vec_id"].dataType.simpleString()
    return x.select("vec_id", "x").mapInArrow(tidy(run), f"vec_id {kind}, deviation long, whitened array<double>")


def report(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """For each usable row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = tune(vectors.sparkSession)
    x = lattice(vectors)
    w = fit(x, components)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    if w is None or not len(w.values):
        return spark.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    explained = F.array(*(F.lit(float(e / w.trace)) for e in w.values))
    each = project(x, w).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(w.identity_error).alias("identity_error"))
