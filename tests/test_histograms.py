"""Trees from distributed histograms against builders written out row by row."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from thresher.models import registry
from thresher.models.base import describe
from thresher.models.histograms import (Bins, BoostSettings, ExtraTrees, SecondOrderBoosting, drawn_columns,
                                        uniform)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.integers(0, 2, (150, 5)), rng.integers(-2, 6, (150, 2)), np.ones((150, 1))], 1).astype(float)
    y = ((x[:, 0] + x[:, 5] + rng.normal(size=150) > 3).astype(int) + (x[:, 1] * x[:, 6] > 3)).astype(int)
    rows = [(i, int(b), Vectors.sparse(8, np.flatnonzero(a).tolist(), a[a != 0].tolist()) if i % 2 else Vectors.dense(a))
            for i, (a, b) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(rows, ["id", "label", "features"]).persist()


def plain_extra_tree(x, y, k, bins, seed, tree, max_depth, min_leaf, min_split):
    """The same tree over numpy rows, nodes numbered as in a full binary tree."""
    columns, width = x.shape[1], max(1, int(x.shape[1] ** 0.5))
    cuts, queue = {}, [(1, np.arange(len(y)), 0)]
    while queue:
        node, rows, depth = queue.pop(0)
        counts = np.bincount(y[rows], minlength=k)
        if depth >= max_depth or len(rows) < min_split or (counts > 0).sum() < 2:
            continue
        for turn in range(-(-columns // width)):
            best, varied = None, False
            for j in drawn_columns(seed, tree, node, columns, width, turn):
                v = x[rows, j]
                if v.min() == v.max():
                    continue
                varied = True
                u = v.min() + float(uniform(seed, tree, node, int(j), 1)) * (v.max() - v.min())
                # between two values that the whole column has
                t = bins.thresholds[bins.first[j]:bins.first[j + 1]]
                below, above = t[t < u], t[t >= u]
                cut = above[0] if len(above) and (v <= above[0]).any() and (v > above[0]).any() else None
                if cut is None:
                    inside = [c for c in t if (v <= c).any() and (v > c).any()]
                    cut = max(inside) if u > max(inside) else min(inside)
                left = v <= cut
                if min(left.sum(), (~left).sum()) < min_leaf:
                    continue
                impurity = 0.0
                for part in (rows[left], rows[~left]):
                    c = np.bincount(y[part], minlength=k)
                    impurity += len(part) - (c ** 2).sum() / len(part)
                if best is None or round(impurity, 9) < best[0]:
                    best = (round(impurity, 9), int(j), float(cut), left)
            if varied:
                break
        if best is not None:
            cuts[node] = best[1:3]
            queue += [(2 * node, rows[best[3]], depth + 1), (2 * node + 1, rows[~best[3]], depth + 1)]
    return cuts


@pytest.mark.parametrize("parts", [1, 6])
def test_extra_trees_equal_a_plain_builder(spark, data, parts):
    x, y, df = data
    model = ExtraTrees(trees=5, max_depth=4, min_leaf=2, min_split=5)
    fitted = model.fit(df.repartition(parts), describe(df, 8))
    bins = fitted.bins
    for t, tree in enumerate(fitted.trees):
        place = {0: 1}
        for n in range(len(tree.column)):
            if tree.column[n] >= 0:
                place[tree.left[n]], place[tree.right[n]] = 2 * place[n], 2 * place[n] + 1
        found = {place[n]: (tree.column[n], float(bins.thresholds[bins.first[tree.column[n]] + tree.code[n]]))
                 for n in range(len(tree.column)) if tree.column[n] >= 0}
        assert found == plain_extra_tree(x, y, 3, bins, 42, t, 4, 2, 5)
    rows = fitted.predict(df, ["label"]).collect()
    assert sum(r["pred"] == r["label"] for r in rows) > 90
    assert all(abs(sum(r["proba"]) - 1) < 1e-9 for r in rows)


def test_bins(spark, data):
    x, _, df = data
    from thresher.models.newton import parts_of
    index, values = parts_of("features")
    bins = Bins.fit(df.select(index.alias("index"), values.alias("values")), 8)
    for j in range(8):
        own = np.unique(np.append(x[:, j], 0.0))
        assert np.allclose(bins.thresholds[bins.first[j]:bins.first[j + 1]], (own[1:] + own[:-1]) / 2)
        assert (bins.codes(np.full(150, j), x[:, j]) == np.searchsorted(own, x[:, j])).all()
    rough = Bins.fit(df.select(index.alias("index"), values.alias("values")), 8, max_bins=4)
    assert all(rough.first[j + 1] - rough.first[j] <= 4 for j in range(8))


def plain_boosting(x, y, s):
    """Scores of one against the rest for class 1, trees cut best first over all thresholds."""
    margin, scores = np.zeros(len(y)), None
    for _ in range(s.rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)

        def weight(rows):
            a = g[rows].sum()
            return -np.sign(a) * max(abs(a) - s.l1, 0) / (h[rows].sum() + s.l2) * s.rate

        def gain(rows):
            return max(abs(g[rows].sum()) - s.l1, 0) ** 2 / (h[rows].sum() + s.l2) / 2

        def best(rows, depth):
            found = (0.0, None)
            for j in range(x.shape[1]) if depth < s.max_depth else ():
                own = np.unique(np.append(x[:, j], 0.0))
                for t in (own[1:] + own[:-1]) / 2:
                    left = x[rows, j] <= t
                    a, b = rows[left], rows[~left]
                    if min(len(a), len(b)) < 1 or min(h[a].sum(), h[b].sum()) < s.min_hessian:
                        continue
                    value = round(gain(a) + gain(b) - gain(rows), 9)
                    if value > found[0]:
                        found = (value, (a, b))
            return found
        leaves = [(np.arange(len(y)), 0)]
        while not s.leaves or len(leaves) < s.leaves:
            options = [(*best(rows, depth), i) for i, (rows, depth) in enumerate(leaves)]
            value, parts, i = max(options, key=lambda o: o[0])
            if value <= 0:
                break
            depth = leaves.pop(i)[1]
            leaves += [(part, depth + 1) for part in parts]
        for rows, _ in leaves:
            margin[rows] += weight(rows)
    return 1 / (1 + np.exp(-margin))


@pytest.mark.parametrize("leaves", [0, 4])
def test_boosting_equals_a_plain_builder(spark, data, leaves):
    x, y, df = data
    two = df.selectExpr("id", "cast(label > 0 as int) AS label", "features")
    s = BoostSettings(rounds=4, rate=0.3, max_depth=3, leaves=leaves, l1=0.05)
    wanted = plain_boosting(x, (y > 0).astype(int), s)
    for parts, cut_every in ((1, 10), (5, 2)):
        fitted = SecondOrderBoosting(s, cut_every).fit(two.repartition(parts), describe(two, 8))
        found = {r["id"]: r["score"] for r in fitted.predict(two).collect()}
        assert max(abs(found[i] - wanted[i]) for i in range(150)) < 1e-9


def test_families_and_shares(spark, data):
    x, y, df = data
    for s in (BoostSettings(rounds=5, max_depth=3, symmetric=True, min_hessian=0.0),
              BoostSettings(rounds=5, max_depth=3, subsample=0.7, column_share=0.6, from_average=True)):
        found = [{r["id"]: r["proba"] for r in SecondOrderBoosting(s).fit(df.repartition(p), describe(df, 8)).predict(df).collect()}
                 for p in (1, 4)]
        assert max(abs(a - b) for i in found[0] for a, b in zip(found[0][i], found[1][i])) < 1e-9
        assert all(abs(sum(p) - 1) < 1e-9 for p in found[0].values())
    symmetric = SecondOrderBoosting(BoostSettings(rounds=1, max_depth=2, symmetric=True, min_hessian=0.0)).fit(
        df, describe(df, 8)).trees[0]
    level = [n for n in range(len(symmetric.column)) if n in (symmetric.left[0], symmetric.right[0])]
    assert len({(symmetric.column[n], symmetric.code[n]) for n in level}) == 1
    assert {type(m).__name__ for m in registry.external_boosters().values()} == {"SecondOrderBoosting"}
