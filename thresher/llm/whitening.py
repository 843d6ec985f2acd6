"""Whitening of embeddings on the principal components that contour integration finds.

Sums and covariances are aggregates over all rows, exact in whole numbers, so they do not
depend on how rows are dealt out. What reaches the driver is the covariance alone: width
squared numbers, whatever the number of rows. One task finds its components.

The components come from FEAST (Polizzi, 2009). Inertia counts of shifted factorisations cut
the upper spectrum into intervals of few eigenvalues. For each, a quadrature of complex shifted
solves along a circle projects a random block onto the eigenvectors inside, and Rayleigh-Ritz
extracts them; the block grows until as many have converged as the inertia counts say exist.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, functions as F

from thresher.session import in_task

EXACT = 2.0 ** 53           # doubles hold every integer up to here
LONG = (-(1 << 63), (1 << 63) - 1)
LARGEST = 2.0 ** 52         # entries from here on have no long x
NODES = 8                   # quadrature points on the upper half of a circle
PER_INTERVAL = 4            # eigenvalues an interval should hold at most
ROUNDS = 12                 # of filtering, before the block grows


# ---- eigenvectors of a symmetric matrix ----

def eigenvalues_above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues exceed ``shift``: the positive pivots of a Bunch-Kaufman factorisation."""
    a = matrix - shift * np.eye(len(matrix))
    alpha, positive, n = (1 + 17 ** 0.5) / 8, 0, len(a)
    while n:
        column = np.abs(a[1:, 0])
        r = int(column.argmax()) + 1 if n > 1 else 0
        top = column[r - 1] if n > 1 else 0.0
        single, swap = True, 0
        if abs(a[0, 0]) < alpha * top:
            row = np.abs(a[r])
            row[r] = 0.0
            other = row.max()
            if abs(a[0, 0]) * other < alpha * top * top:
                if abs(a[r, r]) >= alpha * other:
                    swap = r
                else:
                    single, swap = False, r
        at = 0 if single else 1
        if swap != at:
            a[[at, swap]] = a[[swap, at]]
            a[:, [at, swap]] = a[:, [swap, at]]
        if single:
            pivot = a[0, 0]
            positive += pivot > 0
            if pivot:
                a = a[1:, 1:] - np.outer(a[1:, 0] / pivot, a[1:, 0])
            else:
                a = a[1:, 1:].copy()
        else:       # such a block has one eigenvalue of either sign
            positive += 1
            a = a[2:, 2:] - a[2:, :2] @ np.linalg.solve(a[:2, :2], a[2:, :2].T)
        n = len(a)
    return int(positive)


def _between(matrix: np.ndarray, low: float, high: float, wanted: Callable[[int], bool]) -> float:
    """A shift between two, in the middle of the gap where ``wanted`` of the count above turns false."""
    for _ in range(60):
        middle = (low + high) / 2
        if not low < middle < high or high - low <= 1e-9 * abs(high):
            break
        if wanted(eigenvalues_above(matrix, middle)):
            low = middle
        else:
            high = middle
    return low


def _slices(matrix: np.ndarray, low: float, high: float, n_low: int, n_high: int
            ) -> list[tuple[float, float, int]]:
    """(low, high] cut into intervals that hold few eigenvalues each."""
    n = n_low - n_high
    if n == 0:
        return []
    if n <= PER_INTERVAL or high - low <= 1e-6 * abs(high):
        return [(low, high, n)]
    # the edges of the gap under the upper half, so that the cut is not beside an eigenvalue
    half = n_high + n // 2
    bottom = _between(matrix, low, high, lambda count: count > half)
    top = _between(matrix, bottom, high, lambda count: count >= half)
    cut = (bottom + top) / 2
    count = eigenvalues_above(matrix, cut)
    if not low < cut < high or count in (n_low, n_high):
        return [(low, high, n)]
    return [*_slices(matrix, cut, high, count, n_high), *_slices(matrix, low, cut, n_low, count)]


def _filtered(matrix: np.ndarray, block: np.ndarray, low: float, high: float) -> np.ndarray:
    """``block`` projected onto the eigenvectors of (low, high], up to the quadrature's error."""
    centre, radius = (low + high) / 2, (high - low) / 2
    out = np.zeros_like(block)
    for x, weight in zip(*np.polynomial.legendre.leggauss(NODES)):
        turn = radius * np.exp(1j * np.pi / 2 * (1 - x))
        solved = np.linalg.solve((centre + turn) * np.eye(len(matrix)) - matrix, block)
        out += weight / 2 * (turn * solved).real
    return out


def _ritz(matrix: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    q = np.linalg.qr(block)[0]
    small = q.T @ matrix @ q
    values, turn = np.linalg.eigh((small + small.T) / 2)
    return values, q @ turn


def _inside(matrix: np.ndarray, low: float, high: float, count: int, tolerance: float
            ) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs in (low, high]; none is missed, as their number is known."""
    d = len(matrix)
    size = min(d, 2 * count + 4)
    while True:
        block = np.random.default_rng(size).standard_normal((d, size))
        for _ in range(ROUNDS):
            values, block = _ritz(matrix, _filtered(matrix, block, low, high) if size < d else block)
            here = (values > low) & (values <= high)
            rest = np.linalg.norm(matrix @ block[:, here] - block[:, here] * values[here], axis=0)
            if here.sum() == count and rest.max() <= tolerance:
                return values[here], block[:, here]
            if size == d:       # the whole space: an eigenvalue on the border is all that differs
                best = np.argsort(np.maximum(low - values, values - high), kind="stable")[:count]
                return values[best], block[:, best]
        size = min(d, 2 * size)


def top_eigenpairs(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a positive semi-definite matrix, falling, and their vectors.

    Fewer where the rank, to rounding, is less. The largest entry of a vector is positive.
    """
    d = len(matrix)
    high = float(np.abs(matrix).sum(1).max()) if d else 0.0     # no eigenvalue exceeds a row's sum
    if high <= 0.0 or k < 1:
        return np.empty(0), np.empty((d, 0))
    high *= 1 + 1e-9
    floor = 16 * d * np.finfo(float).eps * high
    k = min(k, eigenvalues_above(matrix, floor))
    if k == 0:
        return np.empty(0), np.empty((d, 0))
    bottom = _between(matrix, floor, high, lambda count: count >= k)
    if bottom > floor:      # to the middle of the gap below the last one wanted, if there is one
        under = _between(matrix, floor, bottom, lambda count: count > k)
        bottom = (under + bottom) / 2 if eigenvalues_above(matrix, bottom) == k else under
    n = eigenvalues_above(matrix, bottom)
    tolerance = 64 * d * np.finfo(float).eps * high
    parts = [_inside(matrix, a, b, count, tolerance)[1]
             for a, b, count in _slices(matrix, bottom, high, n, 0)]
    values, vectors = _ritz(matrix, np.concatenate(parts, 1))
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return values, vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(k)])


# ---- aggregates over all rows ----

def _matrix(column: pa.Array, width: int, fill: int) -> np.ndarray:
    """A list column as a matrix; entries a shorter list lacks are ``fill``."""
    sizes = pa.compute.list_value_length(column).to_numpy(False)
    flat = column.flatten().to_numpy(False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.full((len(sizes), width), fill, np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _limbs(keys: list, values: list[int]) -> pa.RecordBatch:
    """Integers of any size as (key, limb, part) with parts of 32 bits, which sum as longs."""
    out = []
    for key, v in zip(keys, values):
        limb = 0
        while True:
            out.append((key, limb, v & 0xFFFFFFFF if not -(1 << 31) <= v < 1 << 31 else v))
            if -(1 << 31) <= v < 1 << 31:
                break
            v, limb = v >> 32, limb + 1
    key, limb, part = zip(*out) if out else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(key, pa.int64()), pa.array(limb, pa.int32()), pa.array(part, pa.int64())],
        names=["key", "limb", "part"])


def _totals(parts: DataFrame) -> dict[int, int]:
    """Exact sums by key, of as many keys as the matrix has cells."""
    out: dict[int, int] = {}
    for r in parts.groupBy("key", "limb").agg(F.sum("part").alias("part")).collect():
        out[r["key"]] = out.get(r["key"], 0) + (r["part"] << (32 * r["limb"]))
    return out


def _sums(fill: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows under key -1; the sum and the number of entries of dimension j under 2j, 2j + 1."""
        total: dict[int, int] = {-1: 0}
        for batch in batches:
            sizes = pa.compute.list_value_length(batch.column("x")).to_numpy(False)
            total[-1] += len(sizes)
            width = int(sizes.max()) if len(sizes) else 0
            if not width:
                continue
            x = _matrix(batch.column("x"), width, fill)
            x = np.where(np.arange(width) < sizes[:, None], x, 0)
            if max(abs(int(x.min())), abs(int(x.max()))) * len(x) >= LONG[1]:
                x = x.astype(object)
            for j, (s, n) in enumerate(zip(x.sum(0).tolist(), (sizes[:, None] > np.arange(width)).sum(0).tolist())):
                total[2 * j] = total.get(2 * j, 0) + s
                total[2 * j + 1] = total.get(2 * j + 1, 0) + n
        yield _limbs(list(total), list(total.values()))
    return run


def _products(middle: list[int], fill: int):
    """Sums of products of all pairs of dimensions, about ``middle``."""
    d = len(middle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above = np.triu_indices(d)
        total = np.zeros(len(above[0]), object)
        for batch in batches:
            x = _matrix(batch.column("x"), d, fill)
            if not len(x):
                continue
            edge = max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, middle))
            if edge >= 1 << 62:
                y = x.astype(object) - np.array(middle, object)
            else:
                y = x - np.array(middle, np.int64)
                edge = max(abs(int(y.min())), abs(int(y.max())))
            step = int(EXACT // max(1, edge * edge))
            if step < 16:       # products too large for doubles: whole numbers
                y = y.astype(object)
                total += (y.T @ y)[above]
                continue
            y = y.astype(float)
            for at in range(0, len(y), step):       # every sum is an integer that a double holds
                part = y[at:at + step]
                total += (part.T @ part)[above].astype(np.int64).astype(object)
        keys = (above[0] * d + above[1]).tolist()
        yield _limbs(keys, total.tolist())
    return run


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact."""
    edge = max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0
    if n * edge + max(map(abs, sums)) >= LONG[1]:
        return n * x.astype(object) - np.array(sums, object)
    return n * x - np.array(sums, np.int64)


def integers(vector: str | Column, factor: int = 1024, shift: int = 100_000) -> Column:
    """floor(factor * c) + shift of every component; null where the vector takes no part."""
    c = (F.col(vector) if isinstance(vector, str) else vector).cast("array<double>")
    bad = F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) >= F.lit(LARGEST)))
    return F.when(c.isNotNull() & ~bad,
                  F.transform(c, lambda v: F.floor(v * F.lit(float(factor))) + F.lit(shift)))


SCHEMA = ("component int, n long, deviation long, whitened double, explained double, "
          "identity_error double")


def whiten(vectors: DataFrame, components: int = 8, id_col: str = "vec_id",
           vector_col: str = "embedding", factor: int = 1024, shift: int = 100_000) -> DataFrame:
    """One row per vector and component: (id, component, n, deviation, whitened, explained,
    identity_error).

    x is floor(factor * c) + shift, n the number of vectors, S their sum. ``deviation`` is the
    sum over dimensions of (n x - S)^2, exact (held at the end of a long beyond it). ``whitened``
    is x - S/n on the component over the root of its eigenvalue, ``explained`` the eigenvalue's
    share of the trace. ``identity_error`` is measured on the whitened rows themselves: the
    largest absolute entry of their covariance minus the identity.

    Four narrow passes over the rows: sums, products about the mean, covariance of the whitened
    rows, the rows. Tasks send one row per cell of a matrix, and only its sums reach the driver.

    Vectors that are null or hold a null or non-finite entry take no part, nor do those with
    an entry of 2^52 or more, which has no long x. A vector shorter than the longest counts as
    filled up with c = 0. Rows that repeat, and null ids, take part as they are. Components
    whose eigenvalue is 0 to rounding cannot be whitened and are left out, so equal vectors, or
    an empty table, give no rows. Equal eigenvalues get one and the same basis for all rows.
    Further columns are left out.
    """
    id_type = vectors.schema[id_col].dataType.simpleString()
    rows = (vectors.select(F.col(id_col).alias("id"),
                           integers(vector_col, factor, shift).alias("x")).where("x is not null"))
    limbs = "key long, limb int, part long"
    found = _totals(rows.mapInArrow(_sums(shift), limbs))
    n = found.get(-1, 0)
    d = max(((key >> 1) + 1 for key in found if key >= 0), default=0)
    # what shorter vectors lack is c = 0, whose x is the shift
    sums = [found[2 * j] + (n - found[2 * j + 1]) * shift for j in range(d)]
    if not n or not d:
        return rows.sparkSession.createDataFrame([], f"{id_col} {id_type}, {SCHEMA}")
    # about the nearest whole number to the mean; what is left of the mean is taken off exactly
    middle = [(2 * s + n) // (2 * n) for s in sums]
    products = _totals(rows.mapInArrow(_products(middle, shift), limbs))
    left = [s - n * m for s, m in zip(sums, middle)]
    covariance = np.empty((d, d))
    for i in range(d):
        for j in range(i, d):
            covariance[i, j] = covariance[j, i] = (n * products[i * d + j] - left[i] * left[j]) / (n * n)
    values, vectors_of = in_task(rows.sparkSession, top_eigenpairs, covariance, components)
    k = len(values)
    if not k:
        return rows.sparkSession.createDataFrame([], f"{id_col} {id_type}, {SCHEMA}")
    project = vectors_of / np.sqrt(values)

    def whitened(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        y = _centred(_matrix(batch.column("x"), d, shift), n, sums)
        return y, (y / n).astype(float) @ project

    def covariances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            w = whitened(batch)[1]
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(total.ravel())],
                                         names=["cell", "part"])

    measured = (rows.mapInArrow(covariances, "cell long, part double").groupBy("cell")
                .agg(F.sum("part").alias("part")).collect())
    error = max(abs(r["part"] / n - (r["cell"] // k == r["cell"] % k)) for r in measured)
    explained = values / np.trace(covariance)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, w = whitened(batch)
            edge = max(abs(int(y.min())), abs(int(y.max()))) if y.size else 0
            if y.dtype != object and edge * edge * d < LONG[1]:
                deviation = (y * y).sum(1)
            else:
                y = y.astype(object)
                deviation = np.array([min(v, LONG[1]) for v in (y * y).sum(1).tolist()], np.int64)
            m = len(w)
            ids = batch.column("id").take(pa.array(np.repeat(np.arange(m), k)))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                 pa.array(np.full(m * k, n)), pa.array(np.repeat(deviation, k)),
                 pa.array(w.ravel()), pa.array(np.tile(explained, m)),
                 pa.array(np.full(m * k, error))],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(emit, f"id {id_type}, {SCHEMA}").withColumnRenamed("id", id_col)
