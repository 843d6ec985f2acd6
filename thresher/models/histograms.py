"""Trees from distributed histograms: second-order boosting and extremely randomised trees.

Columns are cut into bins once; a row keeps the codes that differ from its columns' code of 0.
A level of all trees is one job. Tasks sum row statistics by (tree, node, bin) and send one
packed row per node; the task that merges a node finds its split and returns a single row. What
is sent grows with nodes and columns, not with rows, and the driver gets splits only.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, functions as F

from thresher.models.base import Context, Fitted, Model, WEIGHT, weighted
from thresher.models.linear_grid import decision
from thresher.models.newton import ROWS_PER_PARTITION, parts_of
from thresher.session import cut_lineage

MAX_BINS = 64
ENTRIES = 1 << 18           # codes a task expands at a time
DIGITS = 9                  # gains are compared to so many places, so that sums in any order agree


def mix(*parts) -> np.ndarray:
    """A hash of integers, element by element, in [0, 2^64)."""
    out = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for p in parts:
            x = np.asarray(p).astype(np.int64).view(np.uint64) if np.ndim(p) else np.uint64(int(p) % 2 ** 64)
            out = (out ^ x) * np.uint64(0xBF58476D1CE4E5B9)
            out = out ^ (out >> np.uint64(29))
            out = out * np.uint64(0x94D049BB133111EB)
            out = out ^ (out >> np.uint64(32))
    return out


def uniform(*parts) -> np.ndarray:
    return (mix(*parts) >> np.uint64(11)) / 2.0 ** 53


# ---- bins ----

@dataclass
class Bins:
    """Thresholds of all columns in one array; code c of a column: above c of its thresholds."""
    first: np.ndarray           # where a column's thresholds begin
    thresholds: np.ndarray
    values: np.ndarray          # a value of every bin: bins of column j begin at first[j] + j

    @property
    def columns(self) -> int:
        return len(self.first) - 1

    def __post_init__(self):
        n = np.diff(self.first)
        self.begin = self.first[:-1] + np.arange(self.columns)      # first bin of a column
        self.total = len(self.thresholds) + self.columns
        self.column_of = np.repeat(np.arange(self.columns), n + 1)
        self.zero = self.codes(np.arange(self.columns), np.zeros(self.columns))

    def codes(self, column: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many of its column's thresholds a value exceeds: a binary search side by side."""
        low, high = self.first[column].copy(), self.first[column + 1].copy()
        if not len(self.thresholds):
            return np.zeros(len(column), np.int64)
        while (low < high).any():
            middle = (low + high) // 2
            inside = low < high
            above = inside & (self.thresholds[np.minimum(middle, len(self.thresholds) - 1)] < value)
            low, high = np.where(above, middle + 1, low), np.where(inside & ~above, middle, high)
        return low - self.first[column]

    @staticmethod
    def fit(rows: DataFrame, n_features: int, max_bins: int = MAX_BINS) -> "Bins":
        """From rows (index, values): all distinct values of a column if they are at most
        ``max_bins``, else as many quantiles of those that are not 0; and 0. Thresholds lie halfway."""
        cells = rows.select(F.explode(F.arrays_zip("index", "values")).alias("e")).select(
            F.col("e.index").alias("column"), F.col("e.values").alias("value"))
        counts = cells.groupBy("column", "value").agg(F.count("*").alias("n"))
        few = counts.groupBy("column").agg(F.count("*").alias("distinct"))
        shares = F.array(*[F.lit(i / (max_bins - 1)) for i in range(max_bins)])
        exact = (counts.join(few.where(F.col("distinct") <= max_bins), "column")
                 .groupBy("column").agg(F.collect_list("value").alias("values")))
        rough = (cells.join(few.where(F.col("distinct") > max_bins), "column")
                 .groupBy("column").agg(F.percentile_approx("value", shares, F.lit(10_000)).alias("values")))
        thresholds, values, first = [], [], [0]
        found = {r["column"]: r["values"] for r in exact.unionByName(rough).collect()}   # max_bins a column
        for j in range(n_features):
            own = np.unique(np.append(found.get(j, []), 0.0))
            thresholds.append((own[1:] + own[:-1]) / 2)
            values.append(own)
            first.append(first[-1] + len(own) - 1)
        return Bins(np.array(first), np.concatenate(thresholds) if thresholds else np.zeros(0),
                    np.concatenate(values) if values else np.zeros(0))


def binned(train: DataFrame, ctx: Context, bins: Bins, label: Column) -> DataFrame:
    """(key, label, weight, column, code): the codes that are not their column's code of 0."""
    index, values = parts_of("features")
    rows = train.select(F.xxhash64("id").alias("key"), label.cast("int").alias("label"),
                        F.col(WEIGHT).cast("double").alias("weight"), index.alias("index"), values.alias("values"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.compute.list_value_length(batch.column("values")).to_numpy(False).astype(np.int64)
            column = batch.column("index").flatten().to_numpy(False)
            code = bins.codes(column, batch.column("values").flatten().to_numpy(False))
            keep = code != bins.zero[column]
            kept = np.append(0, np.cumsum(keep))[np.append(0, np.cumsum(sizes))].astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(kept), pa.array(x[keep].astype(np.int32)))
                     for x in (column, code)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("key", "label", "weight")), *lists],
                names=["key", "label", "weight", "column", "code"])
    coded = rows.mapInArrow(encode, "key long, label int, weight double, column array<int>, code array<int>")
    return coded.repartition(max(1, -(-ctx.held // ROWS_PER_PARTITION)), "key")


# ---- trees ----

@dataclass
class Tree:
    """Nodes in arrays; a row goes left where its code is at most ``code``."""
    column: list = field(default_factory=lambda: [-1])
    code: list = field(default_factory=lambda: [0])
    left: list = field(default_factory=lambda: [-1])
    right: list = field(default_factory=lambda: [-1])
    value: list = field(default_factory=lambda: [0.0])

    def split(self, node: int, column: int, code: int) -> tuple[int, int]:
        at = len(self.column)
        for kept in (self.column, self.code, self.left, self.right):
            kept += [-1, -1]
        self.value += [self.value[node], self.value[node]]
        self.column[node], self.code[node], self.left[node], self.right[node] = column, code, at, at + 1
        return at, at + 1


class Forest:
    """Trees as matrices (tree, node), for many rows at a time."""

    def __init__(self, trees: Sequence[Tree]):
        width = max((len(t.column) for t in trees), default=1)

        def matrix(name, fill):
            return np.array([np.append(getattr(t, name), np.full(width - len(t.column), fill)) for t in trees]).reshape(len(trees), width)
        self.column, self.code, self.left, self.right = (
            matrix(c, -1).astype(np.int64) for c in ("column", "code", "left", "right"))
        self.used = np.unique(self.column[self.column >= 0])
        depth, at = np.zeros(self.column.shape, np.int64), np.arange(len(trees))
        for node in range(width):       # children come after their node
            inner = at[self.column[:, node] >= 0]
            for child in (self.left, self.right):
                depth[inner, child[inner, node]] = depth[inner, node] + 1
        self.depth = int(depth.max()) if depth.size else 0

    def leaves(self, column: np.ndarray, code: np.ndarray, sizes: np.ndarray, zero: np.ndarray) -> np.ndarray:
        """(row, tree): the node every row ends in, from its codes that are not those of 0."""
        place = np.full(len(zero), -1)
        place[self.used] = np.arange(len(self.used))
        codes = np.tile(zero[self.used], (len(sizes), 1))
        row, at = np.repeat(np.arange(len(sizes)), sizes), place[column]
        codes[row[at >= 0], at[at >= 0]] = code[at >= 0]
        trees = np.arange(len(self.column))
        node = np.zeros((len(sizes), len(trees)), np.int64)
        for _ in range(self.depth):
            c = self.column[trees, node]
            inner = c >= 0
            own = codes[np.arange(len(sizes))[:, None], place[np.maximum(c, 0)]] if len(self.used) else c
            down = np.where(own <= self.code[trees, node], self.left[trees, node], self.right[trees, node])
            node = np.where(inner, down, node)
        return node


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(key, label, weight, column, code, sizes, margin if there) of a batch, some codes at a time."""
    sizes = pa.compute.list_value_length(batch.column("column")).to_numpy(False).astype(np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + ENTRIES, side="right")))
        part = batch.slice(start, end - start)
        yield (*(part.column(c).to_numpy() for c in ("key", "label", "weight")),
               *(part.column(c).flatten().to_numpy(False) for c in ("column", "code")), sizes[start:end],
               *([np.array(part.column("margin").flatten().to_numpy(False)).reshape(part.num_rows, -1)]
                 if "margin" in batch.schema.names else []))
        start = end


def level(rows: DataFrame, several: bool, bins: Bins, route: Callable, statistics: int, split: Callable,
          chosen: dict | None = None, per_tree: bool = False) -> list:
    """One job: what ``split`` finds for every open node of every tree (``several``: partitions).

    ``route(part)`` gives, for a slice of rows, the tree numbers, the nodes (row, tree; -1 where
    a row does not count) and the statistics (row, tree, statistic). ``chosen`` restricts a node
    to some columns. ``split(nodes, totals, sums)`` gets the nodes of a key (one, or all of a
    tree), their totals and sums (node, bin, statistic), and returns rows to send on.
    """
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[np.ndarray, dict]] = {}
        for batch in batches:
            for part in _rows(batch):
                column, code, sizes = part[3:6]
                cells = bins.begin[column] + code if len(column) else np.zeros(0, np.int64)
                row = np.repeat(np.arange(len(sizes)), sizes)
                trees, nodes, stats = route(part)
                for t, tree in enumerate(trees):
                    for node in np.unique(nodes[:, t]):
                        if node < 0:
                            continue
                        here = nodes[:, t] == node
                        total, sums = held.get((tree, int(node)), (np.zeros(statistics), {}))
                        total = total + stats[here, t].sum(0)
                        inside = here[row]
                        if chosen is not None:
                            inside &= np.isin(column, chosen[tree, int(node)])
                        bin_of, at = np.unique(cells[inside], return_inverse=True)
                        values = np.stack([np.bincount(at, stats[row[inside], t, s], len(bin_of))
                                           for s in range(statistics)], 1)
                        for b, v in zip(bin_of.tolist(), values):
                            sums[b] = sums[b] + v if b in sums else v
                        held[tree, int(node)] = total, sums
        keys = sorted(held)
        yield pa.RecordBatch.from_arrays([
            pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()),
            pa.array([np.concatenate([held[k][0], *held[k][1].values()]).tobytes() for k in keys], pa.binary()),
            pa.array([np.fromiter(held[k][1], np.int64, len(held[k][1])).tobytes() for k in keys], pa.binary())],
            names=["tree", "node", "sums", "bins"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows are sorted: the nodes of one key are held at a time
        key, held = None, {}

        def done():
            nodes = sorted(held)
            totals = np.array([held[n][0] for n in nodes])
            sums = np.stack([held[n][1] for n in nodes])
            # the code of 0 has what the others of its column leave
            columns = np.add.reduceat(sums, bins.begin, axis=1)
            sums[:, bins.begin + bins.zero] += totals[:, None] - columns
            found = split(key[0], nodes, totals, sums)
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]] * len(found), pa.int32()), pa.array([f[0] for f in found], pa.int32()),
                 pa.array([np.array(f[1:], float).tobytes() for f in found], pa.binary())],
                names=["tree", "node", "found"])
        for batch in batches:
            for tree, node, sums, at in zip(*(batch.column(c).to_pylist() for c in ("tree", "node", "sums", "bins"))):
                own = (tree, 0 if per_tree else node)
                if key is not None and own != key:
                    yield done()
                    held = {}
                key = own
                values = np.frombuffer(sums)
                if node not in held:
                    held[node] = np.zeros(statistics), np.zeros((bins.total, statistics))
                held[node][0][:] += values[:statistics]
                held[node][1][np.frombuffer(at, np.int64)] += values[statistics:].reshape(-1, statistics)
        if key is not None:
            yield done()

    sent = rows.mapInArrow(partial, "tree int, node int, sums binary, bins binary")
    by = ["tree"] if per_tree else ["tree", "node"]
    if several:
        sent = sent.repartition(*by).sortWithinPartitions("tree", "node")
    found = sent.mapInArrow(merge, "tree int, node int, found binary").collect()
    return sorted((r["tree"], r["node"], *np.frombuffer(r["found"]).tolist()) for r in found)


# ---- boosting ----

def gains(totals: np.ndarray, sums: np.ndarray, bins: Bins, l2: float, l1: float,
          min_hessian: float, min_rows: float) -> np.ndarray:
    """(node, bin): what a cut above a bin gains; -inf where there is none.

    Statistics are gradient, hessian and rows. Half of G^2 / (H + l2) is what a leaf gains, with
    G drawn towards 0 by l1.
    """
    before = np.cumsum(sums, axis=1)
    start = before[:, bins.begin] - sums[:, bins.begin]
    left = before - start[:, bins.column_of]
    right = totals[:, None] - left

    def leaf(s):
        g = np.maximum(np.abs(s[..., 0]) - l1, 0)
        return g * g / np.maximum(s[..., 1] + l2, 1e-300) / 2
    gain = leaf(left) + leaf(right) - leaf(totals)[:, None]
    last = np.append(bins.column_of[1:] != bins.column_of[:-1], True)
    allowed = ~last & (np.minimum(left[..., 1], right[..., 1]) >= min_hessian) & (
        np.minimum(left[..., 2], right[..., 2]) >= max(min_rows, 1e-9))
    return np.where(allowed, np.round(gain, DIGITS), -np.inf)


@dataclass(frozen=True)
class BoostSettings:
    rounds: int = 100
    rate: float = 0.1
    max_depth: int = 6
    leaves: int = 0                 # at most so many, best gain first; 0: no bound but the depth
    l2: float = 1.0
    l1: float = 0.0
    min_hessian: float = 1.0
    min_rows: float = 1.0
    subsample: float = 1.0
    column_share: float = 1.0
    symmetric: bool = False         # one cut for all nodes of a level
    from_average: bool = False      # start at the log odds instead of 0
    max_bins: int = MAX_BINS


class SecondOrderBoosting(Model):
    """Boosted trees on gradients and hessians of the logistic loss, one against the rest
    beyond two classes; all classes of a round share their jobs.

    A tree is grown level by level. With ``leaves`` the cuts that a best-first search would make
    are then kept: a node's cut does not depend on the order, so the search runs on gains alone.
    Rows and columns of a round are drawn by hashes, so a lost partition is recomputed to the
    same. Margins are written every ``cut_every`` rounds.
    """

    def __init__(self, settings: BoostSettings = BoostSettings(), cut_every: int = 10, input: str = "bow"):
        self.settings, self.cut_every, self.input = settings, cut_every, input
        self.mergeable = settings.subsample >= 1        # else rows are drawn one by one

    def fit(self, train: DataFrame, ctx: Context) -> "FittedBoosting":
        s = self.settings
        index, values = parts_of("features")
        rows = weighted(train, ctx)
        bins = Bins.fit(rows.select(index.alias("index"), values.alias("values")), ctx.n_features, s.max_bins)
        wanted = [1] if ctx.k == 2 else list(range(ctx.k))
        label = F.array_position(F.array(*[F.lit(int(c)) for c in ctx.classes]), F.col("label").cast("int")) - 1
        base = [float(np.log(ctx.class_counts[c] / (ctx.n - ctx.class_counts[c]))) if s.from_average else 0.0
                for c in wanted]
        coded = binned(rows, ctx, bins, label).persist()
        state, several = coded.withColumn("margin", F.array(*[F.lit(b) for b in base])), coded.rdd.getNumPartitions() > 1
        trees: list[list[Tree]] = []
        fresh = 0       # rounds that the stored margins lack
        for number in range(s.rounds):
            grown = [Tree() for _ in wanted]
            self._grow(state, several, bins, ctx, wanted, trees[len(trees) - fresh:] if fresh else [], grown, number)
            if all(len(t.column) == 1 and t.value[0] == 0.0 for t in grown):
                break
            trees.append(grown)
            fresh += 1
            if fresh == self.cut_every and number + 1 < s.rounds:
                old, state = state, cut_lineage(_with_margins(state, bins, trees[-fresh:])).persist()
                if old is not coded:
                    old.unpersist()
                fresh = 0
        state.unpersist()
        coded.unpersist()
        return FittedBoosting(bins, [t for r in trees for t in r], base, ctx.classes)

    def _grow(self, state, several, bins, ctx, wanted, recent, grown, number) -> None:
        s, k, seed = self.settings, len(wanted), ctx.seed
        past = Forest([t for r in recent for t in r]) if recent else None
        values = [np.asarray(t.value) for r in recent for t in r]
        keep = uniform(seed, number, np.arange(bins.columns)) < s.column_share
        allowed = (keep if keep.any() else ~keep)[bins.column_of]
        found: dict[tuple[int, int], float] = {}
        open_nodes: list[list[int]] = [[0] for _ in wanted]
        for _ in range(s.max_depth):
            current, asked = Forest(grown), open_nodes

            def route(part):
                key, label, weight, column, code, sizes, margin = part
                if past is not None:
                    leaf = past.leaves(column, code, sizes, bins.zero)
                    for i, v in enumerate(values):
                        margin[:, i % k] += v[leaf[:, i]]
                p = 1 / (1 + np.exp(-margin))
                hit = label[:, None] == np.array(wanted)
                stats = np.stack([p - hit, p * (1 - p), np.ones(p.shape)], 2) * weight[:, None, None]
                node = current.leaves(column, code, sizes, bins.zero)
                drawn = uniform(seed, number + 1_000_003, key) < s.subsample
                for t in range(k):
                    node[~np.isin(node[:, t], asked[t]) | ~drawn, t] = -1
                return list(range(k)), node, stats

            def weight_of(total):
                return -np.sign(total[0]) * max(abs(total[0]) - s.l1, 0) / max(total[1] + s.l2, 1e-300) * s.rate

            def split(tree, nodes, totals, sums):
                gain = gains(totals, sums, bins, s.l2, s.l1, s.min_hessian, s.min_rows)
                gain[:, ~allowed] = -np.inf
                if s.symmetric:
                    both = np.where(np.isfinite(gain), gain, 0.0).sum(0)
                    gain = np.where(np.isfinite(gain).any(0), both, -np.inf)[None].repeat(len(nodes), 0)
                out = []
                for i, node in enumerate(nodes):
                    best = int(np.argmax(gain[i]))      # the first of equals: least column and code
                    column = bins.column_of[best]
                    left = sums[i, bins.begin[column]:best + 1].sum(0)
                    out.append((node, gain[i, best], column, best - bins.begin[column], weight_of(totals[i]),
                                weight_of(left), weight_of(totals[i] - left)))
                return out

            open_nodes = [[] for _ in wanted]
            for tree, node, gain, column, code, value, left, right in level(
                    state, several, bins, route, 3, split, per_tree=s.symmetric):
                grown[tree].value[node] = value
                found[tree, node] = gain
                if gain > 0:
                    children = grown[tree].split(node, int(column), int(code))
                    for child, v in zip(children, (left, right)):
                        grown[tree].value[child] = v
                    open_nodes[tree] += children
            if not any(open_nodes):
                break
        if s.leaves:
            for t in range(k):
                grown[t] = _best_first(grown[t], {n: g for (tree, n), g in found.items() if tree == t}, s.leaves)


def _best_first(tree: Tree, found: dict, leaves: int) -> Tree:
    """The tree that always cuts the leaf of highest gain next, until it has so many leaves."""
    out, waiting, n = Tree(), [], 1
    out.value[0] = tree.value[0]

    def offer(node, own):
        if tree.column[node] >= 0:
            heapq.heappush(waiting, (-found[node], own, node))
    offer(0, 0)
    while waiting and n < leaves:
        _, own, node = heapq.heappop(waiting)
        for child, at in zip((tree.left[node], tree.right[node]), out.split(own, tree.column[node], tree.code[node])):
            out.value[at] = tree.value[child]
            offer(child, at)
        n += 1
    return out


def _with_margins(state: DataFrame, bins: Bins, rounds: Sequence[Sequence[Tree]]) -> DataFrame:
    forest, k = Forest([t for r in rounds for t in r]), len(rounds[0])
    values = [np.asarray(t.value) for r in rounds for t in r]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in _rows(batch):
                column, code, sizes, margin = part[3:]
                leaf = forest.leaves(column, code, sizes, bins.zero)
                for i, v in enumerate(values):
                    margin[:, i % k] += v[leaf[:, i]]
                here = batch.slice(at, len(sizes))
                at += len(sizes)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * k),
                                                 pa.array(margin.ravel()))
                yield pa.RecordBatch.from_arrays([*here.columns[:5], lists], names=here.schema.names)
    return state.mapInArrow(
        add, "key long, label int, weight double, column array<int>, code array<int>, margin array<double>")


class FittedBoosting(Fitted):
    def __init__(self, bins: Bins, trees: Sequence[Tree], base: Sequence[float], classes: Sequence[int]):
        self.bins, self.trees, self.base, self.classes = bins, list(trees), list(base), classes

    def columns(self, df: DataFrame):
        k = len(self.base)
        values = [np.asarray(t.value) for t in self.trees]

        def score(leaf: np.ndarray) -> np.ndarray:
            out = np.tile(self.base, (len(leaf), 1))
            for i, v in enumerate(values):
                out[:, i % k] += v[leaf[:, i]]
            return out
        scored = df.withColumn("_scores", _leaf_scores(self.bins, self.trees, score))
        proba, own, decide = decision(F.col("_scores"), self.classes, True)
        return scored, proba, own, decide


def _leaf_scores(bins: Bins, trees: Sequence[Tree], score: Callable) -> Column:
    """array<double> per row from the nodes it ends in, by Arrow batches."""
    import pandas as pd
    forest = Forest(trees) if trees else None

    def run(index, values):
        if not len(values):
            return pd.Series([], dtype="object")
        sizes = values.map(len).to_numpy()
        column = np.concatenate(index.to_numpy()).astype(np.int64) if sizes.sum() else np.zeros(0, np.int64)
        value = np.concatenate(values.to_numpy()) if sizes.sum() else np.zeros(0)
        if forest is None:
            return pd.Series(list(score(np.zeros((len(values), 0), np.int64))))
        leaf = forest.leaves(column, bins.codes(column, value), sizes, bins.zero)
        return pd.Series(list(score(leaf)))
    run.__annotations__ = {"index": pd.Series, "values": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<double>")(*parts_of("features"))


# ---- extremely randomised trees ----

class ExtraTrees(Model):
    """Averaged trees whose cuts are drawn: a node looks at root-many columns in hash order, one
    threshold each, uniform between its least and largest value there, and takes the purest.

    Where all drawn columns are constant in a node, the next ones are drawn. All trees grow a
    level per job. Thresholds lie between the bins of a column: between all its distinct values
    if it has at most ``max_bins``. ``bootstrap`` draws rows by a Poisson number from a hash.
    """

    def __init__(self, trees: int = 100, max_depth: int = 10, min_leaf: int = 1, min_split: int = 2,
                 balanced: bool = False, bootstrap: bool = False, max_bins: int = MAX_BINS, input: str = "bow"):
        self.trees, self.max_depth, self.min_leaf, self.min_split = trees, max_depth, min_leaf, min_split
        self.balanced, self.bootstrap, self.max_bins, self.input = balanced, bootstrap, max_bins, input

    def fit(self, train: DataFrame, ctx: Context) -> "FittedTrees":
        rows = weighted(train, ctx)
        index, values = parts_of("features")
        bins = Bins.fit(rows.select(index.alias("index"), values.alias("values")), ctx.n_features, self.max_bins)
        label = F.array_position(F.array(*[F.lit(int(c)) for c in ctx.classes]), F.col("label").cast("int")) - 1
        coded = binned(rows, ctx, bins, label).persist()
        several = coded.rdd.getNumPartitions() > 1
        grown = [Tree() for _ in range(self.trees)]
        for t in grown:
            t.value = [[0.0] * ctx.k]
        balance = np.array([ctx.n / (ctx.k * n) for n in ctx.class_counts]) if self.balanced else np.ones(ctx.k)
        width = max(1, int(bins.columns ** 0.5))
        draws = {(t, 0): 0 for t in range(self.trees)}      # open node -> how often it has drawn
        # a node's place in the full binary tree, root 1: what its draws depend on
        place = {(t, 0): 1 for t in range(self.trees)}
        while draws:
            chosen = {(t, n): drawn_columns(ctx.seed, t, place[t, n], bins.columns, width, turn)
                      for (t, n), turn in draws.items()}
            found = self._level(coded, several, bins, ctx, grown, chosen, {key: place[key] for key in draws}, balance)
            nxt: dict[tuple[int, int], int] = {}
            for tree, node, state, column, code, *counts in found:
                grown[tree].value[node] = counts
                if state == 1.0:
                    for side, child in enumerate(grown[tree].split(node, int(column), int(code))):
                        place[tree, child] = 2 * place[tree, node] + side
                        nxt[tree, child] = 0
                elif state == 2.0 and (draws[tree, node] + 1) * width < bins.columns:
                    nxt[tree, node] = draws[tree, node] + 1
            draws = nxt
        coded.unpersist()
        return FittedTrees(bins, grown, ctx.classes)

    def _level(self, coded, several, bins, ctx, grown, chosen, place, balance):
        forest, k, seed = Forest(grown), ctx.k, ctx.seed
        open_nodes = [[n for (t, n) in chosen if t == tree] for tree in range(self.trees)]
        # nodes at the last level are counted, not cut: they look at no column
        deep = {key: at >= 2 ** self.max_depth for key, at in place.items()}
        seen = {key: (chosen[key] if not deep[key] else chosen[key][:0]) for key in chosen}
        bootstrap, min_leaf, min_split, n_trees = self.bootstrap, self.min_leaf, self.min_split, self.trees

        def route(part):
            key, label, weight, column, code, sizes = part[:6]
            node = forest.leaves(column, code, sizes, bins.zero)
            for t in range(n_trees):
                node[~np.isin(node[:, t], open_nodes[t]), t] = -1
            one = np.zeros((len(key), k + 1))
            one[np.arange(len(key)), label] = weight * balance[label]
            one[:, k] = weight
            if not bootstrap:
                return list(range(n_trees)), node, np.broadcast_to(one[:, None], (len(key), n_trees, k + 1))
            times = np.stack([_poisson(uniform(seed, 7919 + t, key)) for t in range(n_trees)], 1)
            return list(range(n_trees)), node, one[:, None] * times[:, :, None]

        def split(tree, nodes, totals, sums):
            return [(node, *random_cut(bins, seed, tree, place[tree, node], seen[tree, node], total, own, min_leaf, min_split, deep[tree, node]),
                     *total[:k]) for node, total, own in zip(nodes, totals, sums)]

        return level(coded, several, bins, route, k + 1, split, chosen=seen)


def drawn_columns(seed: int, tree: int, node: int, columns: int, width: int, turn: int) -> np.ndarray:
    """The ``turn``-th ``width`` columns in the hash order of a node."""
    order = np.argsort(mix(seed, tree, node, np.arange(columns)), kind="stable")
    return order[turn * width:(turn + 1) * width]


def random_cut(bins: Bins, seed: int, tree: int, node: int, columns: Sequence[int], total: np.ndarray,
               sums: np.ndarray, min_leaf: float, min_split: float, deep: bool) -> tuple[float, int, int]:
    """(state, column, code): 1 cut, 0 leaf, 2 all drawn columns are constant.

    Statistics are class weights and, last, rows. Of equal impurities the first drawn stays.
    """
    classes = total[:-1]
    if deep or total[-1] < min_split or (classes > 0).sum() < 2:
        return 0.0, -1, 0
    best, varied = (np.inf, -1, 0), False
    for j in columns:
        at = slice(bins.begin[j], bins.begin[j] + int(bins.first[j + 1] - bins.first[j]) + 1)
        own = sums[at]
        there = np.flatnonzero(own[:, -1] > 1e-9)
        if len(there) < 2:
            continue
        varied = True
        values = bins.values[at]
        low, high = values[there[0]], values[there[-1]]
        cut = low + float(uniform(seed, tree, node, int(j), 1)) * (high - low)
        code = int(np.clip(np.searchsorted(bins.thresholds[bins.first[j]:bins.first[j + 1]], cut, side="left"),
                           there[0], there[-1] - 1))
        left = own[:code + 1].sum(0)
        right = total - left
        if min(left[-1], right[-1]) < min_leaf:
            continue
        impurity = sum(s[:-1].sum() - (s[:-1] ** 2).sum() / s[:-1].sum() for s in (left, right))
        impurity = round(float(impurity), DIGITS)
        if impurity < best[0]:
            best = (impurity, int(j), code)
    if best[1] >= 0:
        return 1.0, best[1], best[2]
    return (0.0 if varied else 2.0), -1, 0


def _poisson(u: np.ndarray) -> np.ndarray:
    """The Poisson number of mean 1 that belongs to a uniform one."""
    out, term, below = np.zeros(u.shape), np.exp(-1.0), np.exp(-1.0)
    for n in range(1, 20):
        out += u >= below
        term /= n
        below += term
    return out


class FittedTrees(Fitted):
    """Mean class shares of the leaves."""

    def __init__(self, bins: Bins, trees: Sequence[Tree], classes: Sequence[int]):
        self.bins, self.trees, self.classes = bins, list(trees), classes

    def columns(self, df: DataFrame):
        shares = []
        for t in self.trees:
            v = np.asarray(t.value, float)
            shares.append(v / np.maximum(v.sum(1, keepdims=True), 1e-300))

        def score(leaf: np.ndarray) -> np.ndarray:
            return sum(s[leaf[:, i]] for i, s in enumerate(shares)) / len(shares)
        scored = df.withColumn("_shares", _leaf_scores(self.bins, self.trees, score))
        return scored, F.col("_shares"), None, F.transform("_shares", lambda x: F.round(x, 9))
