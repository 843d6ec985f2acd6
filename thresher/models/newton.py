"""Many regularised linear problems in step: trust-region Newton with one aggregate per step.

The problems of a grid (cells, folds, classes, models) share their rows. Their coefficients are
one matrix, a row per problem and a column per term of a cell; a step sends that matrix to all
tasks, which return sums per cell: loss and gradient, or the product of the Hessian with a
direction. So the number of jobs is that of the slowest problem, however many there are.

Each problem minimises ``sum w loss(y, x b + b0) + penalty / 2 |b|^2 + intercept / 2 b0^2`` by
Newton steps in a trust region, found with preconditioned conjugate gradients (Steihaug, 1983;
Lin and More, 1999). The hinge is smoothed by the logarithmic barrier of its dual's bounds, which
shrinks until the gap between primal and dual objective is small. The slope of the smoothed
hinge is a point of the plain dual, so the gap is a certificate, not an estimate.

Where the packed rows of every cell fit a task, a task holds those of one cell and takes all steps of a
problem by itself, so there is no job per step. Wide hinge problems are solved from their dual there (``dual.py``).
"""

from __future__ import annotations

import functools
import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, functions as F

from thresher.models.dual import Rows, ascend, row_order

LOSSES = ("logistic", "squared_hinge", "hinge", "squares")
ROWS_PER_PARTITION = 100_000
FEW_ROWS = 4_000            # rows of a partition as long as there are at most PARTITIONS
PARTITIONS = 64
ENTRIES = 1 << 18           # values a task expands at a time
INNER = 100                 # conjugate gradient steps within a Newton step
WHOLE = 1 << 24             # Hessians of so many numbers are summed whole: no pass per conjugate gradient
SMOOTHING = (1.0, 0.2)      # of the hinge: the first, and what it shrinks by
HELD = 1 << 26              # bytes of the packed rows of a cell that one task may hold
SHARED = 1 << 20            # bytes of rows times problems that are fitted in one task, side by side


@dataclass(frozen=True)
class Problem:
    """One problem for every cell: rows of ``fold`` are left out (-1: none), ``positive`` is +1."""
    loss: str
    penalty: float = 1.0
    intercept_penalty: float = 0.0
    fold: int = -1
    positive: int = 1


@dataclass
class Solution:
    weights: np.ndarray         # (problem, column)
    intercepts: np.ndarray      # (problem, cell)
    objective: np.ndarray       # (problem, cell), as the next ones
    gap: np.ndarray             # primal less dual, of hinge problems
    gradient: np.ndarray        # norm, over that at zero; 0 of problems solved from their dual
    dead: np.ndarray            # training rows of one class only: nothing is fitted
    passes: int = 0


class Layout:
    """What tasks must know of the problems, and their arithmetic on a slice of rows."""

    def __init__(self, problems: Sequence[Problem], sizes: Sequence[int],
                 class_weights: np.ndarray | None = None, dense: bool = False):
        unknown = {p.loss for p in problems} - set(LOSSES)
        if unknown:
            raise ValueError(f"unknown loss: {unknown}")
        self.losses = np.array([p.loss for p in problems])
        self.folds = np.array([p.fold for p in problems])
        self.positives = np.array([p.positive for p in problems])
        self.sizes = np.array(sizes, np.int64)
        self.starts = np.append(0, np.cumsum(self.sizes)[:-1]).astype(np.int64)
        self.columns, self.cells, self.n = int(self.sizes.sum()), len(sizes), len(problems)
        self.class_weights, self.dense = class_weights, dense


PACKED = "cell int, rows int, fold binary, label binary, weight binary, sizes binary, index binary, values binary"


def _packed(rows: DataFrame, layout: Layout) -> DataFrame:
    """``rows`` as few rows of bytes, at most ENTRIES values of one cell each: what a pass reads
    is copied, not converted value by value."""
    starts, dense = layout.starts, layout.dense

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, fold, label, weight = (batch.column(c).to_numpy() for c in ("cell", "fold", "label", "weight"))
            lists = batch.column("values")
            sizes = pa.compute.list_value_length(lists).to_numpy(False).astype(np.int64)
            ends = np.cumsum(sizes)
            values = lists.flatten().to_numpy(False)
            index = None if dense else batch.column("index").flatten().to_numpy(False)
            edges = np.append(np.flatnonzero(np.diff(cell)) + 1, len(cell))
            out, start = [], 0
            while start < len(cell):
                before = ends[start - 1] if start else 0
                end = min(int(edges[np.searchsorted(edges, start, side="right")]),
                          max(start + 1, int(np.searchsorted(ends, before + ENTRIES, side="right"))))
                v = values[before:ends[end - 1]]
                out.append((int(cell[start]), end - start, *(x.tobytes() for x in (
                    fold[start:end].astype(np.int32), label[start:end].astype(np.int32),
                    weight[start:end].astype(np.float64), sizes[start:end].astype(np.int32),
                    np.zeros(0, np.int32) if dense else (
                        index[before:ends[end - 1]] - starts[cell[start]]).astype(np.int32),
                    np.zeros(0) if (v == 1).all() and not dense else v.astype(np.float64)))))
                start = end
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), [pa.int32()] * 2 + [pa.binary()] * 6)],
                    names=["cell", "rows", "fold", "label", "weight", "sizes", "index", "values"])
    return rows.select("cell", "fold", "label", "weight", *([] if dense else ["index"]), "values").mapInArrow(run, PACKED)


class Slice:
    """Rows of one cell, and sums over them by its columns, the intercept last."""

    def __init__(self, layout: Layout, row: dict):
        self.layout, self.cell = layout, row["cell"]
        self.fold, self.label, sizes, self.index = (
            np.frombuffer(row[c], np.int32) for c in ("fold", "label", "sizes", "index"))
        self.weight, self.values = (np.frombuffer(row[c]) for c in ("weight", "values"))
        self.sizes, self.width = sizes.astype(np.int64), int(layout.sizes[self.cell])
        self.own = np.append(np.arange(layout.starts[self.cell], layout.starts[self.cell] + self.width),
                             layout.columns + self.cell)
        if layout.dense:
            self.matrix = self.values.reshape(len(sizes), self.width)
        else:
            self.filled = self.sizes > 0
            self.begins = (np.cumsum(self.sizes) - self.sizes)[self.filled]
        self.y = np.where(self.label == layout.positives[:, None], 1.0, -1.0)
        self.w = self.weight * (self.fold != layout.folds[:, None])
        if layout.class_weights is not None:
            self.w = self.w * layout.class_weights[:, self.cell, self.label]
        self.curves: list[tuple] = []       # of the last two points

    def curve(self, point: np.ndarray, smoothing: np.ndarray) -> np.ndarray:
        """(problem, row): weighted second derivatives at ``point``."""
        for at, smooth, found in self.curves:
            if np.array_equal(at, point) and np.array_equal(smooth, smoothing):
                return found
        found = self.w * self.loss(self.scores(point), smoothing)[2]
        self.keep(point, smoothing, found)
        return found

    def keep(self, point: np.ndarray, smoothing: np.ndarray, curve: np.ndarray) -> None:
        self.curves = [(point.copy(), smoothing.copy(), curve), *self.curves[:1]]

    def scores(self, point: np.ndarray) -> np.ndarray:
        """(problem, row): x b + b0."""
        start = self.layout.starts[self.cell]
        weights = point[:, start:start + self.width]
        out = np.repeat(point[:, self.layout.columns + self.cell, None], len(self.sizes), 1)
        if self.layout.dense:
            return out + weights @ self.matrix.T
        if len(self.begins):
            for q in range(self.layout.n):
                at = np.take(weights[q], self.index)
                if len(self.values):
                    at *= self.values
                out[q, self.filled] += np.add.reduceat(at, self.begins)
        return out

    def spread(self, per_row: np.ndarray, squared: bool = False) -> np.ndarray:
        """(problem, own column): sums of per_row x (or x squared), the intercept's last."""
        out = np.zeros((self.layout.n, self.width + 1))
        if self.layout.dense:
            out[:, :-1] = per_row @ (self.matrix ** 2 if squared else self.matrix)
        else:
            for q in range(self.layout.n):
                at = np.repeat(per_row[q], self.sizes)
                if len(self.values):
                    at *= self.values ** 2 if squared else self.values
                out[q, :-1] = np.bincount(self.index, at, self.width)
        out[:, -1] = per_row.sum(1)
        return out

    def outer(self, per_row: np.ndarray) -> np.ndarray:
        """(column, problem, column): sums of per_row x x', the intercept being the last column."""
        width = self.width + 1
        out = np.zeros((width, self.layout.n, width))
        step = max(1, ENTRIES * 8 // width)
        ends = np.cumsum(self.sizes)
        for at in range(0, len(self.sizes), step):
            size = self.sizes[at:at + step]
            x = np.zeros((len(size), width))
            x[:, -1] = 1
            if self.layout.dense:
                x[:, :-1] = self.matrix[at:at + step]
            else:
                inside = slice(ends[at] - size[0], ends[at + len(size) - 1])
                np.add.at(x, (np.repeat(np.arange(len(size)), size), self.index[inside]),
                          self.values[inside] if len(self.values) else 1.0)
            for q in range(self.layout.n):
                out[:, q] += (x * per_row[q, at:at + step, None]).T @ x
        return out

    def loss(self, f: np.ndarray, smoothing: np.ndarray) -> tuple[np.ndarray, ...]:
        """Loss, its first and second derivative by f; unsmoothed loss and dual variable."""
        value, slope, curve, plain, dual = (np.zeros_like(f) for _ in range(5))
        for name in np.unique(self.layout.losses):
            q = self.layout.losses == name
            y, m = self.y[q], self.y[q] * f[q]
            if name == "logistic":
                value[q], s = np.logaddexp(0, -m), np.exp(-np.logaddexp(0, m))
                slope[q], curve[q] = -y * s, s * (1 - s)
            elif name == "squared_hinge":
                a = np.maximum(0, 1 - m)
                value[q], slope[q], curve[q] = a * a, -2 * y * a, 2.0 * (a > 0)
            elif name == "squares":
                e = f[q] - y
                value[q], slope[q], curve[q] = e * e / 2, e, 1.0
            else:
                mu = smoothing[q][:, self.cell, None]
                t = 1 - m
                root = np.sqrt(t * t + 4 * mu * mu)
                less = (mu + 2 * mu * mu / (root + np.abs(t))) / (root + 2 * mu)     # of a and 1 - a
                a = np.where(t > 0, 1 - less, less)
                value[q] = a * t + mu * (np.log(less) + np.log1p(-less))
                slope[q], curve[q] = -y * a, mu / (root * (root + 2 * mu))
                plain[q], dual[q] = np.maximum(0, 1 - m), a
        return value, slope, curve, plain, dual


def _value(part: Slice, point, smoothing, direction) -> tuple[np.ndarray, np.ndarray]:
    value, slope, curve, plain, dual = part.loss(part.scores(point), smoothing)
    w = part.w
    part.keep(point, smoothing, w * curve)
    scalars = np.stack([(w * x).sum(1) for x in (value, plain, dual, part.y > 0, part.y < 0)])
    return scalars, np.stack([part.spread(w * slope), part.spread(w * curve, squared=True)])


def _value_and_hessian(part: Slice, point, smoothing, direction) -> tuple[np.ndarray, np.ndarray]:
    scalars, vectors = _value(part, point, smoothing, direction)
    return scalars, np.concatenate([vectors, part.outer(part.curve(point, smoothing))])


def _hessian(part: Slice, point, smoothing, direction) -> tuple[np.ndarray, np.ndarray]:
    return np.zeros((0, part.layout.n)), part.spread(part.curve(point, smoothing) * part.scores(direction))[None]


def _newton_steps(layout: Layout, point: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """The summed Hessians of a cell, the last of ``sums``, solved for the Newton steps."""
    width, cut = layout.columns + 1, 5 * layout.n
    slope, curve, *hessian = sums[cut:].reshape(width + 2, layout.n, width)
    hessian = np.array(hessian)
    steps = np.zeros((layout.n, width))
    for q in range(layout.n):
        free = layout.free[q] > 0
        own = layout.penalty[q]
        matrix = (hessian[:, q] + np.diag(own))[np.ix_(free, free)]
        matrix += 1e-12 * np.trace(matrix) / max(1, len(matrix)) * np.eye(len(matrix))
        steps[q, free] = -np.linalg.solve(matrix, (slope[q] + own * point[q])[free])
    return np.concatenate([sums[:cut], slope.ravel(), curve.ravel(), steps.ravel()])


def _sums(rows: DataFrame, several: bool, known, step, point, smoothing, direction=None):
    """Scalars (kind, problem, cell) and vectors (kind, problem, column) summed over all packed rows.

    A task sends one row per cell it met, so rows are best dealt by cell; those of ``several``
    tasks are merged by cell before the driver gets them.
    """
    layout = known.value
    sent = rows.sparkSession.sparkContext.broadcast((point, smoothing, direction))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                found = step(Slice(known.value, row), *sent.value)
                before = held.get(row["cell"])
                held[row["cell"]] = found if before is None else [x + y for x, y in zip(before, found)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int32()),
             pa.array([np.concatenate([x.ravel() for x in v]).tobytes() for v in held.values()], pa.binary())],
            names=["cell", "sums"])

    def finished(cell: int, sums: np.ndarray) -> np.ndarray:
        return _newton_steps(known.value, sent.value[0], sums) if step is _value_and_hessian else sums

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for cell, sums in zip(batch.column("cell").to_pylist(), batch.column("sums").to_pylist()):
                here = np.frombuffer(sums)
                held[cell] = held[cell] + here if cell in held else here
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int32()),
             pa.array([finished(c, v).tobytes() for c, v in held.items()], pa.binary())],
            names=["cell", "sums"])

    schema = "cell int, sums binary"
    sums = rows.mapInArrow(partial, schema)
    if several:
        sums = sums.repartition("cell").mapInArrow(merge, schema)
    elif step is _value_and_hessian:
        sums = sums.mapInArrow(merge, schema)
    found = sums.collect()
    sent.unpersist()
    kinds = {"_value": (5, 2), "_hessian": (0, 1),
             "_value_and_hessian": (5, 3)}[step.__name__]
    scalars = np.zeros((kinds[0], layout.n, layout.cells))
    vectors = np.zeros((kinds[1], layout.n, layout.columns + layout.cells))
    for r in found:
        c, sums = r["cell"], np.frombuffer(r["sums"])
        cut = kinds[0] * layout.n
        scalars[:, :, c] = sums[:cut].reshape(kinds[0], layout.n)
        columns = np.append(np.arange(layout.starts[c], layout.starts[c] + layout.sizes[c]), layout.columns + c)
        vectors[:, :, columns] = sums[cut:].reshape(kinds[1], layout.n, len(columns))
    return scalars, vectors


def minimise(rows: DataFrame, problems: Sequence[Problem], sizes: Sequence[int],
             mask: np.ndarray | None = None, class_weights: np.ndarray | None = None,
             dense: bool = False, tol: float = 1e-8, gap: float = 1e-3,
             max_steps: int = 500) -> Solution:
    """The minimisers of all ``problems`` on every cell.

    ``rows`` has (cell, fold, label, weight, index, values): labels from 0, ``index`` the numbers
    of the columns that are not 0 (those of cell c follow those of cell c - 1; ``sizes`` says how
    many each has, at least one), ``values`` theirs. ``dense`` rows hold every column of the one
    cell in ``values``. ``mask`` (problem, column) keeps coefficients at 0 where false;
    ``class_weights`` is (problem, cell, label). A problem ends when its gradient is ``tol`` of
    that at zero, a hinge problem when the duality gap is ``gap`` of its objective. Hessians of few
    columns are summed whole, and the task that sums them solves for the Newton step; for others
    a step is found by products of the Hessian with directions. Both end at the same point.
    """
    layout = Layout(problems, sizes, class_weights, dense)
    d = layout.columns
    layout.penalty = np.concatenate([np.repeat([[p.penalty] for p in problems], d, 1),
                                     np.repeat([[p.intercept_penalty] for p in problems], layout.cells, 1)], 1)
    layout.free = np.ones(layout.penalty.shape)
    if mask is not None:
        layout.free[:, :d] = mask
    whole = layout.cells == 1 and layout.n * (d + 1) ** 2 <= WHOLE
    rows = _packed(rows, layout).persist()
    held = {r["cell"]: r["bytes"] for r in rows.groupBy("cell").agg(F.sum(sum(
        F.length(c) for c in ("fold", "label", "weight", "sizes", "index", "values"))).alias("bytes")).collect()}
    if max(held.values(), default=0) <= HELD:
        found = _held(rows, held, problems, layout, whole, tol, gap, max_steps)
        rows.unpersist()
        return found
    several = rows.rdd.getNumPartitions() > 1
    known = rows.sparkSession.sparkContext.broadcast(layout)

    def sums(step, point, smoothing, direction=None):
        return _sums(rows, several, known, step, point, smoothing, direction)
    found = _descend(layout, sums, whole, tol, gap, max_steps)
    rows.unpersist()
    known.unpersist()
    return found


def _held(rows: DataFrame, held: dict[int, int], problems: Sequence[Problem], layout: Layout, whole: bool,
          tol: float, gap: float, max_steps: int) -> Solution:
    """``minimise`` with all steps of some problems of a cell in one task, which holds the packed rows of that cell.

    ``held`` has the bytes of each cell's rows. Problems of a cell without rows are dead.
    """
    tasks: list[tuple[int, slice]] = []
    for cell, size in sorted(held.items()):
        together = max(1, SHARED // max(1, size))
        tasks += [(cell, slice(q, q + together)) for q in range(0, layout.n, together)]
    d, starts, sizes = layout.columns, layout.starts, layout.sizes
    own = {c: np.append(np.arange(starts[c], starts[c] + sizes[c]), d + c) for c in held}
    known = rows.sparkSession.sparkContext.broadcast((problems, layout, tasks, own))

    def fit(number: int, packed: list[dict]) -> bytes:
        problems, layout, tasks, own = known.value
        cell, q = tasks[number]
        weights = layout.class_weights
        part = Layout(problems[q], [layout.sizes[cell]], None if weights is None else weights[q, cell:cell + 1], layout.dense)
        part.penalty, part.free = layout.penalty[q][:, own[cell]], layout.free[q][:, own[cell]]
        slices = [Slice(part, {**row, "cell": 0}) for row in packed]
        packed.clear()
        if not whole and (part.losses == "hinge").all() and (part.penalty[:, :-1] > 0).all():
            return pickle.dumps(_ascend(part, slices, gap))
        for x in slices:
            x.index = x.index.astype(np.intp)

        def sums(step, point, smoothing, direction=None):
            scalars, vectors = (functools.reduce(np.add, x) for x in zip(
                *(step(x, point, smoothing, direction) for x in slices)))
            if step is _value_and_hessian:
                flat = _newton_steps(part, point, np.concatenate([scalars.ravel(), vectors.ravel()]))
                vectors = flat[scalars.size:].reshape(3, part.n, -1)
            return scalars[..., None], vectors
        return pickle.dumps(_descend(part, sums, whole, tol, gap, max_steps))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, packed = None, []
        for row in chain((r for batch in batches for r in batch.to_pylist()), [{"task": None}]):
            if row["task"] != number and packed:
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([fit(number, packed)], pa.binary())],
                                                 names=["task", "found"])
                packed = []
            number = row["task"]
            packed.append(row)
    of_cell = {c: F.array(*[F.lit(i) for i, (own_cell, _) in enumerate(tasks) if own_cell == c]) for c in held}
    numbers = functools.reduce(lambda other, c: F.when(F.col("cell") == c, of_cell[c]).otherwise(other), held,
                               F.array().cast("array<int>"))
    dealt_out = rows.withColumn("task", F.explode(numbers))
    if len(tasks) > 1:
        dealt_out = dealt_out.repartitionByRange(len(tasks), "task").sortWithinPartitions("task")
    else:
        dealt_out = dealt_out.coalesce(1)
    done = dealt_out.mapInArrow(run, "task int, found binary").collect()
    known.unpersist()
    n, cells = layout.n, layout.cells
    out = Solution(np.zeros((n, d)), np.zeros((n, cells)), *(np.zeros((n, cells)) for _ in range(3)),
                   np.ones((n, cells), bool))
    for r in done:
        (cell, q), found = tasks[r["task"]], pickle.loads(r["found"])
        out.weights[q, starts[cell]:starts[cell] + sizes[cell]] = found.weights
        for name in ("intercepts", "objective", "gap", "gradient", "dead"):
            getattr(out, name)[q, cell] = getattr(found, name)[:, 0]
        out.passes = max(out.passes, found.passes)
    return out


def _ascend(layout: Layout, slices: list[Slice], gap: float) -> Solution:
    """Hinge problems of one cell, each from its dual. ``slices`` is emptied, to hold the rows once."""
    y, w = (np.concatenate([getattr(x, c) for x in slices], 1) for c in ("y", "w"))
    sizes = np.concatenate([x.sizes for x in slices])
    width = int(layout.sizes[0])
    index = (np.tile(np.arange(width, dtype=np.int32), len(sizes)) if layout.dense else
             np.concatenate([x.index for x in slices]))
    values = None
    if any(len(x.values) for x in slices) or not layout.free.all():
        values = np.concatenate([x.values if len(x.values) else np.ones(len(x.index)) for x in slices])
    slices.clear()
    n = layout.n
    out = Solution(np.zeros((n, width)), np.zeros((n, 1)), *(np.zeros((n, 1)) for _ in range(3)), np.zeros((n, 1), bool))
    order = row_order(index, values, sizes, *y, *w)
    begins, ends = np.cumsum(sizes) - sizes, np.cumsum(sizes)
    for q in range(n):
        used = order[w[q, order] > 0]
        out.dead[q] = len(np.unique(y[q, used])) < 2
        if out.dead[q, 0]:
            continue
        chosen = [slice(a, b) for a, b in zip(begins[used].tolist(), ends[used].tolist())]
        own = np.concatenate([index[x] for x in chosen])
        own_values = None if values is None else np.concatenate([values[x] for x in chosen]) * layout.free[q, own]
        rows = Rows(own, own_values, sizes[used], width)
        (out.weights[q], out.intercepts[q], out.objective[q], out.gap[q], passes) = ascend(
            rows, y[q, used], w[q, used], layout.penalty[q, 0], layout.penalty[q, -1], gap)
        out.passes = max(out.passes, passes)
    return out


def _descend(layout: Layout, sums: Callable, whole: bool, tol: float, gap: float, max_steps: int) -> Solution:
    """Steps of all problems, from what ``sums(step, point, smoothing, direction)`` gives."""
    d, starts, penalty, free = layout.columns, layout.starts, layout.penalty, layout.free
    hinge = (layout.losses == "hinge")[:, None] & np.ones(layout.cells, bool)
    smoothing = np.full((layout.n, layout.cells), SMOOTHING[0])
    passes = 0

    def dots(a, b):
        p = a * b
        return np.add.reduceat(p[:, :d], starts, axis=1) + p[:, d:]

    def wide(per_cell):
        return np.concatenate([np.repeat(per_cell, layout.sizes, axis=1), per_cell], 1)

    def value(at):
        nonlocal passes
        passes += 1
        scalars, vectors = sums(_value_and_hessian if whole else _value, at, smoothing)
        slope, curve = vectors[:2]
        f = scalars[0] + dots(penalty * at, at) / 2
        # gap of the plain hinge: primal less dual, and what the intercept's equation lacks
        norm = np.where(penalty > 0, penalty, np.inf)
        primal = scalars[1] + dots(penalty * at, at) / 2
        lacks = np.abs(slope[:, d:] * at[:, d:]) * (penalty[:, d:] == 0)
        apart = primal - scalars[2] + dots(slope * free / norm, slope * free) / 2 + lacks
        g = (slope + penalty * at) * free
        h = curve + penalty
        # an intercept without curvature must not outrun the weights
        level = dots(h, np.ones(h.shape)) / (layout.sizes + 1)
        return f, g, np.maximum(h, wide(np.maximum(0.1 * level, 1e-12))), apart, primal, vectors[-1], scalars[3:]

    def product(at, direction):
        nonlocal passes
        passes += 1
        found = sums(_hessian, at, smoothing, direction)[1][0]
        return (found + penalty * direction) * free

    x = np.zeros(penalty.shape)
    f, g, h, apart, primal, step, counts = value(x)
    dead = (counts == 0).any(0)
    first = np.sqrt(dots(g, g))
    active = ~dead & (first > 0)
    radius, length = np.sqrt(dots(g, g / h)), np.ones(first.shape)
    slope_norm = first.copy()

    def loosest():      # a smoothing that is not the last one needs no sharp optimum
        return np.where(hinge, np.clip(0.01 * smoothing, 1e-5, 1e-2), tol)
    fresh = True
    with np.errstate(divide="ignore", invalid="ignore"):
        for _ in range(max_steps):
            if not active.any():
                break
            if whole:       # the step is known: halve it until the objective falls
                s = step * wide(length * active)
                hoped = -1e-4 * dots(g, s)
                new = value(x + s)
                gained, size = f - new[0], np.sqrt(dots(s, s))
                taken = active & (gained >= hoped)
                length = np.where(taken, 1.0, length * 0.5)
            else:
                # conjugate gradients of all problems side by side; those that have ended wait
                s = np.zeros_like(x)
                r = -g * wide(active)
                z = r / h
                direction, rz = z.copy(), dots(r, z)
                target = np.minimum(0.1, np.sqrt(slope_norm / first)) * np.sqrt(rz)
                going = active & (rz > 0)
                for _ in range(INNER):
                    if not going.any():
                        break
                    asked = direction * wide(going)
                    image = product(x, asked)
                    bend = dots(asked, image)
                    length = np.where(going & (bend > 0), rz / bend, 0.0)
                    tried = s + wide(length) * asked
                    over = going & ((dots(tried * h, tried) > radius ** 2) | (bend <= 0))
                    if over.any():      # as far as the border of the region
                        sd, dd, ss = dots(s * h, asked), dots(asked * h, asked), dots(s * h, s)
                        room = np.maximum(radius ** 2 - ss, 0)
                        to_border = room / (sd + np.sqrt(np.maximum(sd * sd + dd * room, 0)))
                        length = np.where(over, np.nan_to_num(to_border), length)
                    s += wide(length) * asked
                    r -= wide(length) * image
                    z = r / h
                    now = dots(r, z)
                    going &= ~over & (np.sqrt(now) > target)
                    direction = z + wide(np.nan_to_num(now / rz)) * direction
                    rz = now
                gs = dots(g, s)
                hoped = -0.5 * (gs - dots(s, r))
                new = value(x + s)
                gained = f - new[0]
                size = np.sqrt(dots(s * h, s))
                if fresh:
                    radius, fresh = np.where(active, np.minimum(radius, size), radius), False
                shape = new[0] - f - gs
                pull = np.where(shape <= 0, 4.0, np.maximum(0.25, -0.5 * gs / shape)) * size
                radius = np.where(
                    gained < 1e-4 * hoped, np.minimum(pull, 0.5 * radius), np.where(
                        gained < 0.25 * hoped, np.maximum(0.25 * radius, np.minimum(pull, 0.5 * radius)), np.where(
                            gained < 0.75 * hoped, np.maximum(0.25 * radius, np.minimum(pull, 4 * radius)),
                            np.maximum(radius, np.minimum(pull, 4 * radius)))))
                taken = active & (gained > 1e-4 * hoped)
            x = np.where(wide(taken), x + s, x)
            f, apart, primal = (np.where(taken, b, a) for a, b in zip((f, apart, primal), (new[0], new[3], new[4])))
            g, h = np.where(wide(taken), new[1], g), np.where(wide(taken), new[2], h)
            if whole:
                step = np.where(wide(taken), new[5], step)
            slope_norm = np.sqrt(dots(g, g))
            stuck = (np.abs(gained) <= 1e-14 * np.abs(f)) & (np.abs(hoped) <= 1e-14 * np.abs(f))
            certain = hinge & (apart <= gap * primal)       # whatever is left of the gradient
            ended = active & ((slope_norm <= loosest() * first) | stuck | (size == 0) | certain)
            wide_gap = ended & hinge & (apart > gap * np.maximum(primal, 1e-300)) & (smoothing > 1e-9)
            active &= ~ended | wide_gap
            if wide_gap.any():      # less smoothing: the same point under a sharper loss
                smoothing = np.where(wide_gap, smoothing * SMOOTHING[1], smoothing)
                f, g, h, apart, primal, step, _ = value(x)
                slope_norm = np.sqrt(dots(g, g))
                radius = np.where(wide_gap, np.sqrt(dots(g, g / h)), radius)
                length = np.where(wide_gap, 1.0, length)
    return Solution(x[:, :d], x[:, d:], f, np.where(hinge, apart, 0.0),
                    np.where(first > 0, slope_norm / np.where(first > 0, first, 1), 0), dead, passes)


# ---- rows ----

def parts_of(features: str | Column = "features") -> tuple[Column, Column]:
    """Indices and values of a vector column: those stored of a sparse one, all of a dense one."""
    inner = F.unwrap_udt(features)
    full = F.when(F.size(inner["values"]) > 0, F.sequence(F.lit(0), F.size(inner["values"]) - 1)).otherwise(
        F.array().cast("array<int>"))
    return F.coalesce(inner["indices"], full), inner["values"]


def dealt(rows: DataFrame, n: int, by: Sequence[str] = ("cell",)) -> DataFrame:
    """Rows in partitions of a fixed number of rows, one cell beside the next."""
    parts = max(1, -(-n // ROWS_PER_PARTITION), min(PARTITIONS, -(-n // FEW_ROWS)))
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(parts))
    return rows.repartition(parts, *by, salt).sortWithinPartitions(*by)


def linear_scores(weights: np.ndarray, intercepts: np.ndarray, features: str = "features") -> Column:
    """array<double> of x b + b0 per row of ``weights``, for a vector column."""
    return margins_of(weights, intercepts, *parts_of(features))


def margins_of(weights: np.ndarray, intercepts: np.ndarray, index: Column, values: Column) -> Column:
    """array<double> of x b + b0 per row of ``weights``, by Arrow batches."""
    import pandas as pd

    def score(index, values):
        out = np.tile(intercepts[:, None], len(values))
        if not len(values):
            return pd.Series([], dtype="object")
        sizes = values.map(len).to_numpy()
        filled = sizes > 0
        if filled.any():
            flat = np.concatenate(index.to_numpy()[filled])
            begins = (np.cumsum(sizes) - sizes)[filled]
            out[:, filled] += np.add.reduceat(
                weights[:, flat] * np.concatenate(values.to_numpy()[filled]), begins, axis=1)
        return pd.Series(list(out.T))
    score.__annotations__ = {"index": pd.Series, "values": pd.Series, "return": pd.Series}
    return F.pandas_udf(score, "array<double>")(index, values)
