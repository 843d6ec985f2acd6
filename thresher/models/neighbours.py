"""Exact k nearest neighbours by cells, the triangle inequality and cheap lower bounds.

Rows are assigned to the nearest of a bounded set of pivots. A query visits only
cells that can hold one of its k nearest rows: the cell radius and row counts
give a safe upper bound of the k-th distance. Visits are an equi-join on the
cell; large cells are split on both sides, so no task sees an unbounded group, and
a task emits at most k rows per query. Cells are as large as a task takes, because
in many dimensions a query visits nearly all of them.

Within a task all pairs get a lower bound of their distance, by a matrix product in
single precision (euclidean) or on 16-bit steps (manhattan), both less what rounding
can add. Only pairs whose bound is within the k-th distance so far are measured.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window, functions as F

from thresher.models.base import Context, Fitted, Model, argmax_class

METRICS = ("euclidean", "manhattan")
MAX_PIVOTS = 256
BLOCK_CELLS = 2_000_000         # numbers held per block of one side
NARROW = 8                      # columns in which small cells rule rows out
MAX_TASKS = 4096
TILE = 256                      # queries whose bounds are held at a time
FIRST = 256                     # rows that give the first limit of a query
CACHED = 32                     # queries whose sums of steps stay in the processor's cache
MEASURED = 1 << 16              # pairs measured at a time
STEPS = 65_535                  # sum of steps that 16 bits hold


def _distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Between the rows of ``a`` and those of ``b``, each with each."""
    out = np.empty((len(a), len(b)))
    step = max(1, 2_000_000 // max(1, b.size))
    for i in range(0, len(a), step):
        out[i:i + step] = _measured(a[i:i + step, None, :], b[None, :, :], metric)
    return out


def _measured(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    diff = a - b
    return np.abs(diff).sum(axis=-1) if metric == "manhattan" else np.sqrt((diff * diff).sum(axis=-1))


class _Products:
    """Lower bounds of squared euclidean distances, from inner products about the rows' mean."""
    columns = 8192              # rows compared at a time

    def __init__(self, a: np.ndarray, b: np.ndarray):
        centre = b.mean(axis=0)
        a, b = a - centre, b - centre
        largest = max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0))
        kind = np.float32 if 1e-12 < largest < 1e12 else np.float64
        self.a, self.b = a.astype(kind), np.ascontiguousarray(b.astype(kind).T)
        self.squares = (a * a).sum(axis=1).astype(kind), (b * b).sum(axis=1).astype(kind)
        norms = [float(x.max(initial=0)) ** 0.5 for x in self.squares]
        # of every sum of products, its terms and the numbers rounded
        self.lost = 4 * (a.shape[1] + 8) * float(np.finfo(kind).eps) * (norms[0] + norms[1]) ** 2 + 1e-300

    def bounds(self, i: slice, j: slice) -> np.ndarray:
        out = self.a[i] @ self.b[:, j]
        out *= -2
        out += self.squares[1][j]
        out += self.squares[0][i, None]
        return out

    def limit(self, distance: np.ndarray, i: slice) -> np.ndarray:
        """Pairs of a higher bound are farther than ``distance``."""
        return (distance * distance * (1 + 1e-6) + self.lost).astype(self.a.dtype)[:, None]

    def at_most(self, bounds: np.ndarray, i: slice) -> np.ndarray:
        """Distances that pairs of such bounds do not exceed."""
        return np.sqrt(np.maximum(bounds, 0) + self.lost) * (1 + 1e-6)


class _Steps:
    """Lower bounds of manhattan distances: sums of whole steps between rounded components."""
    columns = 4096

    def __init__(self, a: np.ndarray, b: np.ndarray):
        centre = b.mean(axis=0)
        a, b = a - centre, b - centre
        spread = float(np.sqrt((b * b).mean())) if b.size else 0.0
        largest = max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0))
        self.edge = min(largest, 6 * spread) or largest or 1.0      # beyond it rows are taken as at it
        levels = max(1, min(16_000, STEPS // max(1, a.shape[1])) // 2)
        self.step = self.edge / levels
        self.a, own = self._rounded(a)
        self.b, other = self._rounded(b)
        self.b = np.ascontiguousarray(self.b.T)
        self.below, self.other = own, float(other.max(initial=0.0))
        # components beyond the edge are farther apart than their steps say
        self.above = np.abs(a - self.a * self.step).sum(axis=1), np.abs(b - self.b.T * self.step).sum(axis=1)
        self.wide = 2 * levels * a.shape[1] > STEPS

    def _rounded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        held = np.clip(x, -self.edge, self.edge)
        steps = np.rint(held / self.step).astype(np.int16)
        return steps, np.abs(held - steps * self.step).sum(axis=1)

    def bounds(self, i: slice, j: slice) -> np.ndarray:
        a, b = self.a[i], self.b[:, j]
        out = np.zeros((len(a), b.shape[1]), np.uint32 if self.wide else np.uint16)
        part = np.empty((CACHED, b.shape[1]), np.int16)
        for at in range(0, len(a), CACHED):
            rows, total = a[at:at + CACHED], out[at:at + CACHED]
            diff = part[:len(rows)]
            for d in range(len(b)):
                np.subtract(rows[:, d, None], b[d], out=diff)
                np.abs(diff, out=diff)
                np.add(total, diff.view(np.uint16), out=total)
        return out

    def limit(self, distance: np.ndarray, i: slice) -> np.ndarray:
        steps = (distance * (1 + 1e-9) + self.below[i] + self.other) / self.step + 1
        return np.minimum(steps, np.iinfo(np.uint32).max).astype(np.uint32)[:, None] if self.wide else (
            np.minimum(steps, STEPS).astype(np.uint16)[:, None])

    def at_most(self, bounds: np.ndarray, i: slice) -> np.ndarray:
        return (bounds * self.step + self.above[0][i] + self.above[1].max(initial=0.0)) * (1 + 1e-9)


def _first_of(keys: np.ndarray) -> np.ndarray:
    """The place of each of the sorted ``keys`` among those equal to it, from 0."""
    at = np.arange(len(keys))
    return at - np.maximum.accumulate(np.where(np.r_[True, keys[1:] != keys[:-1]][:len(keys)], at, 0))


def _best(a: np.ndarray, a_fold: np.ndarray, b: np.ndarray, b_fold: np.ndarray, k: int, metric: str
          ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of ``a``, row of ``b``, distance): the ``k`` nearest rows of other folds, the first of equals.

    Bounds of a tile of pairs are compared with the k-th distance so far; the first rows give an
    upper bound of it. Equal rows of ``b`` beyond the first ``k`` of a fold are left out.
    """
    group = np.unique(np.column_stack([b, b_fold]), axis=0, return_inverse=True)[1].ravel()
    order = np.argsort(group, kind="stable")
    kept = np.sort(order[_first_of(group[order]) < k])
    b, b_fold = b[kept], b_fold[kept]
    sides = (_Steps if metric == "manhattan" else _Products)(a, b)
    for start in range(0, len(a), TILE):
        i = slice(start, min(start + TILE, len(a)))
        own = a_fold[i]
        first = sides.bounds(i, slice(0, FIRST)).astype(float)
        first[own[:, None] == b_fold[:FIRST]] = np.inf
        edge = np.full(len(own), np.inf)
        if first.shape[1] >= k:
            edge = sides.at_most(np.partition(first, k - 1, axis=1)[:, k - 1], i)
        found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        begin, ends = 0, 2 * FIRST
        while begin < len(b):       # wider as the limit gets closer
            j = slice(begin, min(ends, len(b)))
            flat = np.flatnonzero(sides.bounds(i, j) <= sides.limit(edge, i))
            for at in range(0, len(flat), MEASURED):
                q, t = np.divmod(flat[at:at + MEASURED], j.stop - j.start)
                other = own[q] != b_fold[begin + t]
                q, t = q[other], begin + t[other]
                d = _measured(a[start + q], b[t], metric)
                inside = (d <= edge[q]) & np.isfinite(d)
                q, t, d = (np.concatenate(x) for x in zip(found, (q[inside], t[inside], d[inside])))
                order = np.lexsort((t, d, q))
                q, t, d = q[order], t[order], d[order]
                place = _first_of(q)
                edge[q[place == k - 1]] = d[place == k - 1]
                found = tuple(x[place < k] for x in (q, t, d))
            begin, ends = j.stop, min(3 * j.stop, j.stop + sides.columns)
        q, t, d = found
        yield start + q, kept[t], d


def nearest(queries: DataFrame, train: DataFrame, k: int, metric: str = "euclidean",
            by_fold: bool = False, block_rows: int | None = None,
            max_pivots: int = MAX_PIVOTS) -> DataFrame:
    """(id, neighbour, distance, label, rank): the k nearest training rows of each query.

    Both sides have (id, vec array<double>), train also ``label``. With
    ``by_fold`` both have ``fold`` and a query only sees rows of other folds.
    Ties in distance go to the smaller id.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    if not by_fold:
        queries = queries.withColumn("fold", F.lit(-1))
        train = train.withColumn("fold", F.lit(0))
    queries = queries.select("id", "fold", F.col("vec").cast("array<double>").alias("vec"))
    train = train.select("id", "fold", F.col("label").cast("int").alias("label"),
                         F.col("vec").cast("array<double>").alias("vec"))
    n_train = train.count()
    drawn = train.orderBy(F.xxhash64("id"), "id")
    width = max(1, len((drawn.first() or {"vec": []})["vec"]))
    if block_rows is None:
        block_rows = max(64, min(BLOCK_CELLS // width, max(2048, n_train // 8)))
    few = math.isqrt(n_train) if width <= NARROW else n_train // block_rows
    pivots = [r["vec"] for r in drawn.limit(max(1, min(max_pivots, few))).collect()]

    def assign(batches):
        centres = np.array(pivots, dtype=float)
        for pdf in batches:
            if len(pdf):
                d = _distances(np.stack(pdf["vec"].to_numpy()), centres, metric)
                yield pdf.assign(cell=d.argmin(axis=1).astype("int32"), far=d.min(axis=1))

    placed = train.mapInPandas(
        assign, "id long, fold int, label int, vec array<double>, cell int, far double")
    cells = (placed.groupBy("cell", "fold").agg(F.count("*").alias("n"), F.max("far").alias("r"))
             .collect())                                    # pivots x folds rows
    radius, count = {}, {}
    for c in cells:
        radius[c["cell"]] = max(radius.get(c["cell"], 0.0), c["r"])
        count[(c["cell"], c["fold"])] = c["n"]
    names = sorted(radius)
    train_parts = {c: math.ceil(sum(n for (cc, _), n in count.items() if cc == c) / block_rows)
                   for c in names}

    def visit(batches):
        import pandas as pd
        centres = np.array([pivots[c] for c in names], dtype=float)
        rad = np.array([radius[c] for c in names])
        cell_no = np.array(names, dtype="int32")
        slack = 1e-9 * (1.0 + rad)      # never loses a row to rounding
        for pdf in batches:
            if not len(pdf):
                continue
            d = _distances(np.stack(pdf["vec"].to_numpy()), centres, metric)
            upper, lower = d + rad + slack, d - rad - slack
            order = upper.argsort(axis=1)
            bound = np.full(len(pdf), np.inf)
            folds = pdf["fold"].to_numpy()
            for f in np.unique(folds):
                rows = np.flatnonzero(folds == f)
                n = np.array([sum(v for (cc, g), v in count.items() if cc == c and g != f)
                              for c in names])
                running = n[order[rows]].cumsum(axis=1)
                full = running >= k
                first = full.argmax(axis=1)
                edge = np.take_along_axis(upper[rows], order[rows], axis=1)[
                    np.arange(len(rows)), first]
                bound[rows] = np.where(full.any(axis=1), edge, np.inf)
            hit_q, hit_c = np.nonzero(lower <= bound[:, None])
            yield pd.DataFrame({"id": pdf["id"].to_numpy()[hit_q], "fold": folds[hit_q],
                                "vec": pdf["vec"].to_numpy()[hit_q], "cell": cell_no[hit_c]})

    visits = queries.mapInPandas(visit, "id long, fold int, vec array<double>, cell int")
    visitors = {r["cell"]: r["n"] for r in                   # at most one row per pivot
                visits.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    query_parts = {c: math.ceil(n / block_rows) for c, n in visitors.items()}

    def split(df: DataFrame, mine: dict, theirs: dict, own: str, other: str) -> DataFrame:
        """A row goes to one part of its own side and to every part of the other."""
        def lookup(d):
            return F.element_at(F.create_map(*[x for c in sorted(d) for x in (
                F.lit(c), F.lit(max(1, d[c])))]), F.col("cell"))
        here = F.pmod(F.xxhash64("id"), lookup(mine)).cast("int")
        return (df.where(F.col("cell").isin(sorted(set(mine) & set(theirs))))
                .withColumn(own, here)
                .withColumn(other, F.explode(F.sequence(F.lit(0), lookup(theirs) - 1))))

    q = split(visits, query_parts, train_parts, "qpart", "tpart")
    t = split(placed.drop("far"), train_parts, query_parts, "tpart", "qpart")
    keys = ["cell", "qpart", "tpart"]
    tiles = sum(query_parts[c] * max(1, train_parts[c]) for c in query_parts)
    parts = min(MAX_TASKS, 2 * tiles - 1)

    def match(left, right):
        import pandas as pd
        left, right = (side[[bool(np.isfinite(v).all()) for v in side["vec"]]] for side in (left, right))
        right = right.sort_values("id", kind="stable")
        out = []
        if len(left) and len(right):
            ids, other, label = left["id"].to_numpy(), right["id"].to_numpy(), right["label"].to_numpy()
            for q, t, d in _best(np.stack(left["vec"].to_numpy()), left["fold"].to_numpy(),
                                 np.stack(right["vec"].to_numpy()), right["fold"].to_numpy(), k, metric):
                out.append(pd.DataFrame({"id": ids[q], "neighbour": other[t], "distance": d, "label": label[t]}))
        return pd.concat(out) if out else pd.DataFrame(
            {"id": [], "neighbour": [], "distance": [], "label": []})

    found = q.repartition(parts, *keys).groupBy(*keys).cogroup(
        t.repartition(parts, *keys).groupBy(*keys)).applyInPandas(
        match, "id long, neighbour long, distance double, label int")
    w = Window.partitionBy("id").orderBy("distance", "neighbour")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def vote(neighbours: DataFrame, classes: Sequence[int]) -> DataFrame:
    """(id, pred, proba): votes weighted by 1 / distance; exact matches, if any, vote alone."""
    exact = F.max((F.col("distance") == 0).cast("int")).over(Window.partitionBy("id"))
    w = (F.when(F.col("_exact") == 1, (F.col("distance") == 0).cast("double"))
         .otherwise(F.lit(1.0) / F.col("distance")))
    sums = neighbours.withColumn("_exact", exact).withColumn("_w", w).groupBy("id").agg(*[
        F.sum(F.when(F.col("label") == c, F.col("_w")).otherwise(0.0)).alias(f"_c{i}")
        for i, c in enumerate(classes)])
    votes = F.array(*[F.round(F.col(f"_c{i}"), 6) for i in range(len(classes))])
    total = sum((F.col(f"_c{i}") for i in range(1, len(classes))), F.col("_c0"))
    return sums.select("id", argmax_class(votes, classes).alias("pred"),
                       F.array(*[F.col(f"_c{i}") / total for i in range(len(classes))])
                       .alias("proba"))


class NearestNeighbours(Model):
    def __init__(self, k: int = 5, metric: str = "euclidean"):
        self.k, self.metric = k, metric

    def fit(self, train: DataFrame, ctx: Context) -> "FittedNeighbours":
        rows = train.select("id", "label", vector_to_array("features").alias("vec"))
        return FittedNeighbours(rows, ctx.classes, self.k, self.metric)


class FittedNeighbours(Fitted):
    narrow = False

    def __init__(self, train, classes, k, metric):
        self.train, self.classes, self.k, self.metric = train, classes, k, metric

    def predict(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        q = df.select("id", vector_to_array("features").alias("vec"))
        voted = vote(nearest(q, self.train, self.k, self.metric), self.classes)
        score = F.col("proba")[1] if len(self.classes) == 2 else F.lit(None)
        return (df.select("id", *keep).join(voted, "id")
                .select("id", *keep, "pred", "proba", score.cast("double").alias("score")))
