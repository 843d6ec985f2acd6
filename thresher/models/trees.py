"""Trees, forests and boosting on Spark ML."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier,
                                       RandomForestClassifier)
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from thresher.models.base import (Context, Fitted, Model, WEIGHT, as_predictions, in_parallel,
                                  softmax, weighted)
from thresher.models.linear import FittedProbabilities, FittedScores, _probability_of_one, each_class
from thresher.session import cut_lineage


def indexed(df: DataFrame, classes: Sequence[int]) -> DataFrame:
    """Labels as 0..k-1 doubles in class order, as Spark ML wants them."""
    index = F
    for i, c in enumerate(classes):
        index = index.when(F.col("label") == c, F.lit(float(i)))
    return df.withColumn("label", index)


class Tree(Model):
    """On merged rows the leaf size becomes a share of the total weight."""
    mergeable = True

    def __init__(self, max_depth: int = 10, min_leaf: int = 1, balanced: bool = False):
        self.max_depth, self.min_leaf, self.balanced = max_depth, min_leaf, balanced

    def fit(self, train, ctx):
        rows = weighted(indexed(train, ctx.classes), ctx)
        if self.balanced:
            factor = F
            for i, n in enumerate(ctx.class_counts):
                factor = factor.when(F.col("label") == i, F.lit(ctx.n / (ctx.k * n)))
            rows = rows.withColumn(WEIGHT, F.col(WEIGHT) * factor)
        est = DecisionTreeClassifier(
            maxDepth=self.max_depth, impurity="gini", weightCol=WEIGHT, seed=ctx.seed,
            minWeightFractionPerNode=min(0.49, self.min_leaf / ctx.n))
        return FittedProbabilities(est.fit(rows), ctx.classes)


class Forest(Model):
    def __init__(self, trees: int = 100, max_depth: int = 10, min_leaf: int = 1,
                 balanced: bool = False, bootstrap: bool = True, max_bins: int = 32,
                 input: str = "bow"):
        self.trees, self.max_depth, self.min_leaf = trees, max_depth, min_leaf
        self.balanced, self.bootstrap, self.max_bins, self.input = balanced, bootstrap, max_bins, input

    def fit(self, train, ctx):
        rows = indexed(weighted(train, ctx, self.balanced), ctx.classes)
        est = RandomForestClassifier(
            numTrees=self.trees, maxDepth=self.max_depth, minInstancesPerNode=self.min_leaf,
            featureSubsetStrategy="sqrt", weightCol=WEIGHT, seed=ctx.seed,
            bootstrap=self.bootstrap, maxBins=self.max_bins)
        return FittedProbabilities(est.fit(rows), ctx.classes)


class Boosting(Model):
    """Gradient boosted trees; one against the rest beyond two classes.

    Unless rows or columns are drawn, equal rows can be merged: a leaf needs ``min_leaf`` by weight.
    """

    def __init__(self, rounds: int = 100, rate: float = 0.1, max_depth: int = 3,
                 min_leaf: int = 1, subsample: float = 1.0, feature_subset: str = "all"):
        self.rounds, self.rate, self.max_depth = rounds, rate, max_depth
        self.min_leaf, self.subsample, self.feature_subset = min_leaf, subsample, feature_subset
        self.mergeable = subsample >= 1 and feature_subset == "all"

    def fit(self, train, ctx):
        def one(rows, c):
            # half a row less, so that rounding of the share leaves no row out
            least = (dict(minWeightFractionPerNode=min(0.49, (self.min_leaf - 0.5) / c.n)) if self.mergeable
                     else dict(minInstancesPerNode=self.min_leaf))
            est = GBTClassifier(maxIter=self.rounds, stepSize=self.rate, maxDepth=self.max_depth, **least,
                                subsamplingRate=self.subsample, weightCol=WEIGHT, seed=c.seed,
                                featureSubsetStrategy=self.feature_subset)
            return _probability_of_one(est.fit(rows))
        return FittedScores(each_class(weighted(train, ctx), ctx, one), ctx.classes, True)


class AdaBoost(Model):
    """SAMME over weighted trees; weights are a column, updated by an expression per round."""
    mergeable = True

    def __init__(self, rounds: int = 50, rate: float = 1.0, max_depth: int = 1,
                 cut_every: int = 10):
        self.rounds, self.rate, self.max_depth, self.cut_every = rounds, rate, max_depth, cut_every

    def fit(self, train, ctx):
        rows = cut_lineage(weighted(indexed(train, ctx.classes), ctx)
                           .select("label", "features", WEIGHT)).persist()
        total, old = ctx.n, rows
        members = []
        for i in range(self.rounds):
            tree = DecisionTreeClassifier(maxDepth=self.max_depth, weightCol=WEIGHT,
                                          seed=ctx.seed + i).fit(rows)
            scored = tree.transform(rows).drop("rawPrediction", "probability")
            wrong = F.col("prediction") != F.col("label")
            error = scored.agg(F.sum(F.when(wrong, F.col(WEIGHT)).otherwise(0.0))).first()[0] / total
            if old is not rows:     # this round's rows are stored by now
                old.unpersist()
                old = rows
            if error >= 1 - 1.0 / ctx.k:
                break
            if error <= 0:
                members.append((tree, 1.0))
                break
            alpha = self.rate * (math.log((1 - error) / error) + math.log(ctx.k - 1))
            members.append((tree, alpha))
            boosted = F.col(WEIGHT) * F.when(wrong, F.lit(math.exp(alpha))).otherwise(1.0)
            # the new total follows from the error, so no further pass is needed
            grown = total * (1 - error) + total * error * math.exp(alpha)
            rows = scored.withColumn(WEIGHT, boosted * F.lit(ctx.n / grown)).drop("prediction")
            total = ctx.n
            rows = (cut_lineage(rows) if (i + 1) % self.cut_every == 0 else rows).persist()
        if not members:
            raise ValueError("no tree is better than chance")
        return FittedAdaBoost(members, ctx.classes)


class FittedAdaBoost(Fitted):
    def __init__(self, members, classes):
        self.members, self.classes = members, classes

    def columns(self, df):
        k = len(self.classes)
        total = sum(a for _, a in self.members)
        cols = [F.lit(0.0)] * k
        for i, (tree, alpha) in enumerate(self.members):
            name = f"_vote{i}"
            df = (tree.transform(df).withColumnRenamed("prediction", name)
                  .drop("rawPrediction", "probability"))
            cols = [c + F.when(F.col(name) == j, alpha).otherwise(0.0)
                    for j, c in enumerate(cols)]
        share = F.array(*[c / F.lit(total) for c in cols])
        return df, softmax(F.transform(share, lambda x: x / (k - 1))), None, None


def poisson_weight(id_col: str, seed: int, rate: float) -> Column:
    """How often a bootstrap of rate x n rows draws this row: Poisson, from a hash of the id.

    Unlike ``sample`` it gives the same draw when a lost partition is recomputed.
    """
    u = F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(2 ** 31)) / F.lit(float(2 ** 31))
    out, term, cdf, n = F, math.exp(-rate), math.exp(-rate), 0
    while cdf < 1 - 2.0 ** -31 and n < 10 * rate + 40:     # as far as a draw can reach
        out = out.when(u < cdf, F.lit(float(n)))
        n += 1
        term *= rate / n
        cdf += term
    return out.otherwise(float(n))


class Bagging(Model):
    """Models on bootstrap weights and feature subsets; probabilities are averaged."""

    def __init__(self, members: int = 50, rows: float = 0.8, columns: float = 0.8,
                 base: Model | None = None):
        self.members, self.rows, self.columns = members, rows, columns
        # meant to be unlimited; Spark ML trees stop at depth 30
        self.base = base or Tree(max_depth=30)

    def fit(self, train, ctx):
        import numpy as np
        base = weighted(train, ctx)
        n_cols = max(1, int(self.columns * ctx.n_features))

        def member(i):
            def run():
                rng = np.random.default_rng(ctx.seed + i)
                chosen = sorted(rng.choice(ctx.n_features, n_cols, replace=False).tolist())
                cut = VectorSlicer(inputCol="features", outputCol="_cut", indices=chosen)

                def prepare(df):
                    return cut.transform(df).drop("features").withColumnRenamed("_cut", "features")
                rows = prepare(base.withColumn(
                    WEIGHT, F.col(WEIGHT) * poisson_weight("id", ctx.seed + i, self.rows))
                    .where(F.col(WEIGHT) > 0))
                return prepare, self.base.fit(rows, _refreshed(rows, ctx, n_cols))
            return run
        fitted = in_parallel([member(i) for i in range(self.members)], ctx.parallelism)
        return FittedAverage(fitted, ctx.classes)


def _refreshed(rows: DataFrame, ctx: Context, n_features: int) -> Context:
    from dataclasses import replace
    counted = {int(r["label"]): r["n"] for r in
               rows.groupBy("label").agg(F.sum(WEIGHT).alias("n")).collect()}
    counts = tuple(counted.get(c, 0.0) or 1e-9 for c in ctx.classes)
    return replace(ctx, n=sum(counts), class_counts=counts, n_features=n_features)


def soft_vote(preds: DataFrame, keys: Sequence[str], classes: Sequence[int],
              weight: str | None = None) -> DataFrame:
    """Mean probability per class over the members' predictions of each row."""
    w = F.col(weight) if weight else F.lit(1.0)
    mean = preds.groupBy(*keys).agg(F.sum(w).alias("_w"), *[
        F.sum(F.col("proba")[i] * w).alias(f"_p{i}") for i in range(len(classes))])
    p = [F.col(f"_p{i}") / F.col("_w") for i in range(len(classes))]
    decide = F.array(*[F.round(x, 9) for x in p])
    return as_predictions(mean, [k for k in keys if k != "id"], F.array(*p), classes,
                          decide=decide)


class FittedAverage(Fitted):
    """Members as (prepare, fitted). Narrow members are averaged inside the row;
    the others meet them in one aggregate per row id."""

    def __init__(self, members, classes):
        self.members, self.classes = members, classes
        self.narrow = all(m.narrow for _, m in members)

    def _inside(self, df: DataFrame, members, out: str) -> DataFrame:
        kept = df.columns
        total = None
        for i, (prepare, m) in enumerate(members):
            df = df.withColumn("_kept", F.col("features"))
            df = m.with_probabilities(prepare(df), f"_member{i}").drop("features")
            df = df.withColumnRenamed("_kept", "features")
            p = F.col(f"_member{i}")
            total = [p[j] if total is None else total[j] + p[j]
                     for j in range(len(self.classes))]
        mean = F.array(*[t / F.lit(float(len(members))) for t in total])
        return df.withColumn(out, mean).select(*kept, out)

    def columns(self, df):
        rows = self._inside(df, self.members, "_mean")
        return rows, F.col("_mean"), None, F.transform("_mean", lambda x: F.round(x, 9))

    def predict(self, df, keep=()):
        if self.narrow:
            return super().predict(df, keep)
        inside = [(p, m) for p, m in self.members if m.narrow]
        parts = [m.predict(p(df), keep).select("id", *keep, "proba", F.lit(1.0).alias("_w"))
                 for p, m in self.members if not m.narrow]
        if inside:
            parts.append(self._inside(df, inside, "proba").select(
                "id", *keep, "proba", F.lit(float(len(inside))).alias("_w")))
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        return soft_vote(rows, ["id", *keep], self.classes, "_w")
