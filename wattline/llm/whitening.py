"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation of the centred rows (operator 13).

The rows stay in Spark.  A step multiplies them by a direction, X v, and the outcome by the rows again, Xᵀu, in one
pass over the table; what comes back is a few sums.  Left vectors u are never stored: each is X w for a short
w, so their inner products with a new X v are sums of the same pass.  Both sides are fully reorthogonalised.  The
singular vectors of the small bidiagonal matrix give the components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm.vectors import by_dimension
from wattline.session import stored

SCALE, SHIFT = 64, 1_000_000
FARTHEST = float(1 << 52)
COMPONENTS = 16
LEAST = 1e-10  # eigenvalues below this part of the largest are rounding, not variance
ENTRIES = 1 << 20  # of a matrix that a task works on at once
_LONGEST = (1 << 63) - 1


def whole(x: np.ndarray) -> np.ndarray:
    """Entries (double) as the whole numbers that everything is computed from."""
    return np.floor(np.clip(SCALE * x, -FARTHEST, FARTHEST)).astype(np.int64) + SHIFT


@dataclass(frozen=True)
class Centre:
    """Exact sums of ``n`` whole vectors: a mean is ``base + rest / n``, with 0 <= rest < n."""

    n: int
    base: np.ndarray
    rest: np.ndarray

    @classmethod
    def of(cls, n: int, sums: list[int]) -> Centre:
        split = [divmod(s, n) for s in sums]
        return cls(n, np.array([q for q, _ in split], dtype=np.int64), np.array([r for _, r in split], dtype=np.int64))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base).astype(np.float64) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n x - S)^2, exact; None beyond the range of a long."""
        away = x - self.base
        most = int(max(away.max(initial=0), -away.min(initial=0))) * self.n + self.n
        if x.shape[1] * most * most <= _LONGEST:
            return ((self.n * away - self.rest) ** 2).sum(axis=1).tolist()
        rest = [int(r) for r in self.rest]
        exact = [sum((self.n * a - r) ** 2 for a, r in zip(row, rest)) for row in away.tolist()]
        return [e if e <= _LONGEST else None for e in exact]


# ---------------------------------------------------------------- passes over the distinct vectors


def matrices(batches: Iterable[pa.RecordBatch], column: int = 0) -> Iterator[np.ndarray]:
    """Columns of equally long lists of longs as matrices of at most ``ENTRIES`` numbers."""
    for batch in batches:
        lists = batch.column(column)
        if len(lists):
            x = lists.flatten().to_numpy().reshape(len(lists), -1)
            step = max(1, ENTRIES // x.shape[1])
            for at in range(0, len(x), step):
                yield x[at : at + step]


def summed(table: DataFrame, add: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The ``size`` sums of ``add`` over all rows of a table of vectors; a task adds up its own first."""

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for x in matrices(batches):
            total += add(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["at", "value"])

    sums = table.mapInArrow(partial, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(size)
    out[sums.column("at").to_numpy()] = sums.column("value").to_numpy()
    return out


def centre_of(table: DataFrame, size: int) -> Centre | None:
    """Number of rows and exact sums of each entry; None without rows."""

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in matrices(batches):
            high = x >> 32  # sums of the halves do not leave a long
            sums = np.concatenate([[len(x)], high.sum(axis=0), (x - (high << 32)).sum(axis=0)])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(sums)], ["at", "value"])

    rows = table.mapInArrow(partial, "at long, value long").groupBy("at").agg(F.sum(F.col("value").cast("decimal(28,0)")).alias("value")).collect()
    if not rows:
        return None
    sums = {r["at"]: int(r["value"]) for r in rows}
    return Centre.of(sums[0], [(sums[1 + i] << 32) + sums[1 + size + i] for i in range(size)])


# ---------------------------------------------------------------- bidiagonalisation


def away_from(x: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """``x`` without its parts along the columns of ``basis``, taken out twice."""
    for _ in range(2):
        x = x - basis @ (basis.T @ x)
    return x


def bidiagonal(
    products: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, float, np.ndarray]], size: int, steps: int, wanted: int, seed: int = 13,
) -> tuple[np.ndarray, np.ndarray]:
    """Singular values (falling) and right singular vectors (columns) of a matrix X known by its products only.

    ``products(w, v)`` gives (X w)ᵀ(X v), |X v|² and Xᵀ(X v).  Ends after ``steps`` steps, when the ``wanted`` leading
    values have settled (only where ``steps`` is less than ``size``), or when X has nothing beyond the directions
    found; a chain that ends early is taken up again in a new random direction.
    """
    rng = np.random.default_rng(seed)
    right, left = np.zeros((size, 0)), np.zeros((size, 0))  # columns v, and columns w with u = X w
    diagonal: list[float] = []
    above: list[float] = []
    scale, v = 0.0, None
    while len(diagonal) < steps:
        if v is None:  # a random direction within the rows
            v = products(left[:, :0], rng.standard_normal(size))[2]
            away = away_from(v, right)
            if np.linalg.norm(away) <= 1e-9 * max(np.linalg.norm(v), scale * scale):
                break
            v = away_from(away / np.linalg.norm(away), right)
            v /= np.linalg.norm(v)
        w = v
        along, square, back = products(left, w)
        coupling = along
        for _ in range(3):  # Xv without its parts along earlier u: again where little was left
            w = w - left @ along
            rest = square - along @ along
            if len(along) == 0 or rest > 0.1 * square:
                back = back if w is v else products(left[:, :0], w)[2]
                break
            along, square, back = products(left, w)
        length = float(np.sqrt(max(rest, 0.0)))
        scale = max(scale, float(np.sqrt(max(square, 0.0))), length)
        if length <= 1e-9 * scale:
            break
        above.append(float(coupling[-1]) if len(coupling) else 0.0)
        diagonal.append(length)
        left = np.column_stack([left, w / length])
        right = np.column_stack([right, v])
        onward = away_from(back / length, right)
        size_on = float(np.linalg.norm(onward))
        if size_on <= 1e-11 * scale:
            v = None
        else:
            v = away_from(onward / size_on, right)
            v /= np.linalg.norm(v)
            if steps < size and len(diagonal) > wanted:
                turn, values, _ = np.linalg.svd(np.diag(diagonal) + np.diag(above[1:], 1))
                if (size_on * np.abs(turn[-1, :wanted]) <= 1e-13 * values[0]).all():
                    break
    if not diagonal:
        return np.zeros(0), np.zeros((size, 0))
    _, values, turned = np.linalg.svd(np.diag(diagonal) + np.diag(above[1:], 1))
    return values, right @ turned.T


# ---------------------------------------------------------------- whitening


@dataclass(frozen=True)
class Whitener:
    """Components (columns), their eigenvalues and shares of the whole variance; ``error`` says how far the covariance
    of whitened vectors is from the identity."""

    centre: Centre
    components: np.ndarray
    values: np.ndarray
    shares: np.ndarray
    error: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.centre(x) @ (self.components / np.sqrt(self.values))


def fit_whitener(table: DataFrame, size: int, components: int = COMPONENTS, steps: int | None = None) -> Whitener | None:
    """The leading components of the rows of ``table`` (one column, lists of ``size`` longs); None without rows.

    ``steps`` bounds the passes; None takes as many as there are dimensions, which finds equal eigenvalues too.
    """
    centre = centre_of(table, size)
    if centre is None:
        return None

    def products(w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        both = np.column_stack([w, v])

        def add(x: np.ndarray) -> np.ndarray:
            rows = centre(x)
            made = rows @ both
            return np.concatenate([made.T @ made[:, -1], rows.T @ made[:, -1]])

        sums = summed(table, add, both.shape[1] + size)
        return sums[: w.shape[1]], float(sums[w.shape[1]]), sums[w.shape[1] + 1 :]

    limit = min(size, centre.n, steps or size)
    singular, vectors = bidiagonal(products, size, limit, components)
    values = singular**2 / centre.n
    keep = np.flatnonzero(values > LEAST * values[:1])[:components] if len(values) else np.zeros(0, dtype=int)
    values, vectors = values[keep], vectors[:, keep]
    largest = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.sign(vectors[largest, np.arange(len(keep))])
    k = len(keep)
    made = Whitener(centre, vectors, values, np.zeros(k), 0.0)

    def add(x: np.ndarray) -> np.ndarray:
        y, rows = made(x), centre(x)
        return np.concatenate([(y.T @ y).ravel(), y.sum(axis=0), [(rows * rows).sum()]])

    sums = summed(table, add, k * k + k + 1) / centre.n
    mean = sums[k * k : -1]
    off = sums[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)
    return Whitener(centre, vectors, values, values / sums[-1] if k else values, float(np.abs(off).max(initial=0.0)))


def _whiten(batches: Iterable[pa.RecordBatch], made: Whitener) -> Iterator[pa.RecordBatch]:
    k = len(made.values)
    for batch in batches:
        for rows, vectors in by_dimension(batch.column(1)):
            step = max(1, ENTRIES // max(vectors.shape[1], k))
            for at in range(0, len(rows), step):
                x = whole(vectors[at : at + step])
                n = len(x)
                each = np.repeat(rows[at : at + step], k)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                     pa.array(np.full(n * k, made.centre.n, dtype=np.int64)), pa.array(made.centre.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(n), k))),
                     pa.array(made(x).ravel()), pa.array(np.tile(made.shares, n)), pa.array(np.full(n * k, made.error))],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )


def whiten_vectors(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, steps: int | None = None,
) -> DataFrame:
    """One row per row and component: ``key``, component (from 1), n, deviation, whitened, explained, identity_error.

    Entries become whole numbers, floor(64 c) + 1,000,000 (beyond 2^52 in size: held there).  The components are fitted on
    the distinct whole vectors, however many rows have them, and every row is projected.  ``n`` counts the
    distinct vectors, ``deviation`` is exact (null beyond the range of a long), ``identity_error`` is one value.

    Rows whose vector is null, empty or holds a null or non-finite entry have no rows in the result.  Components
    without variance (below 1e-10 of the largest eigenvalue) are none: equal vectors, or a single one, give no rows.  Vectors of several
    lengths are as many separate fits.  Rows that share a key are separate rows; other columns are not looked at;
    an empty table gives no rows.
    """
    kind = vectors.schema[key].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    bad = F.exists("vector", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("vector")).where((F.size("vector") > 0) & ~bad)
    entry = F.transform("vector", lambda c: F.floor(F.least(F.greatest(c * float(SCALE), F.lit(-FARTHEST)), F.lit(FARTHEST))) + SHIFT)
    distinct = stored(rows.select(entry.alias("x")).distinct())
    out = None
    for size in sorted(r[0] for r in distinct.select(F.size("x")).distinct().collect()):
        made = fit_whitener(distinct.where(F.size("x") == size), size, components, steps)
        part = rows.where(F.size("vector") == size).mapInArrow(lambda b, made=made: _whiten(b, made), schema)
        out = part if out is None else out.union(part)
    if out is None:
        out = rows.mapInArrow(lambda b: iter(()), schema)
    return out.withColumnRenamed("id", key)
