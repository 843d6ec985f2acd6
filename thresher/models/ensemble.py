"""Soft voting, stacking and ensembles by type."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from thresher.models.base import Context, Fitted, Model, describe, fit_merged, in_parallel, settled
from thresher.models.bayes import NaiveBayes, cross_validated_bayes
from thresher.models.linear import Logistic, SupportVector
from thresher.models.trees import Bagging, FittedAverage, Forest
from thresher.operators.folds import stratified_folds
from thresher.session import cut_lineage, released

AT_ONCE = 2                 # fits of a stacking side by side


class Voting(Model):
    """Mean of the members' class probabilities."""

    def __init__(self, members: dict[str, Model], input: str = "bow"):
        self.members, self.input = members, input

    def fit(self, train: DataFrame, ctx: Context) -> FittedAverage:
        fitted = in_parallel([lambda m=m: fit_merged(m, train, ctx) for m in self.members.values()],
                             ctx.parallelism)
        return FittedAverage([(_same, m) for m in fitted], ctx.classes)


def _same(df: DataFrame) -> DataFrame:
    return df


def meta_features(parts: Sequence[DataFrame], names: Sequence[str], keep: Sequence[str],
                  n_classes: int) -> DataFrame:
    """(id, keep, features): the members' probabilities side by side, by one shuffle on id."""
    rows = None
    for name, p in zip(names, parts):
        p = p.select("id", *keep, "proba", F.lit(name).alias("_member"))
        rows = p if rows is None else rows.unionByName(p)
    wide = rows.groupBy("id", *keep).agg(*[
        F.max(F.when(F.col("_member") == n, F.col("proba")[i])).alias(f"_{j}_{i}")
        for j, n in enumerate(names)
        for i in (range(1, 2) if n_classes == 2 else range(n_classes))])
    cols = [c for c in wide.columns if c not in ("id", *keep)]
    return wide.select("id", *keep, array_to_vector(F.array(*cols)).alias("features"))


class Stacking(Model):
    """A meta-model on out-of-fold probabilities of the members; members are refitted on all rows."""

    def __init__(self, members: dict[str, Model], meta: Model, folds: int = 5):
        self.members, self.meta, self.folds = members, meta, folds

    def fit(self, train: DataFrame, ctx: Context) -> "FittedStacking":
        names = list(self.members)
        # every plan of every member's fits holds what came before, also where that is cached
        train = cut_lineage(train)
        folded = settled(stratified_folds(train, "id", "label", self.folds, ctx.seed),
                         ctx.n)
        folded = cut_lineage(folded).persist()      # stored before several fits read it at once
        inner = replace(ctx, parallelism=1)
        facts = [replace(describe(folded.where(F.col("fold") != f), ctx.n_features, ctx.seed), parallelism=1)
                 for f in range(self.folds)]

        def held_out(model: Model, f: int) -> Callable[[], DataFrame]:
            def run():
                fitted = fit_merged(model, folded.where(F.col("fold") != f), facts[f])
                released(train.sparkSession)
                return fitted.predict(folded.where(F.col("fold") == f), ["label"])
            return run
        bayes = {n: m for n, m in self.members.items() if isinstance(m, NaiveBayes)}
        others = {n: m for n, m in self.members.items() if n not in bayes}
        # few at once: more, of thousands of small jobs, filled the driver's memory
        at_once = min(ctx.parallelism, AT_ONCE)
        done = in_parallel([held_out(m, f) for m in others.values() for f in range(self.folds)], at_once)
        parts = {n: cross_validated_bayes(folded, m.kind, m.alpha, self.folds,
                                          max_features=m.max_features, classes=ctx.classes)
                 for n, m in bayes.items()}         # all folds in one plan
        for i, n in enumerate(others):
            parts[n] = done[i * self.folds]
            for p in done[i * self.folds + 1:(i + 1) * self.folds]:
                parts[n] = parts[n].unionByName(p)
        meta_train = cut_lineage(meta_features([parts[n] for n in names], names, ["label"], ctx.k))
        width = len(names) * (1 if ctx.k == 2 else ctx.k)
        meta = self.meta.fit(meta_train, replace(ctx, n_features=width))

        def refitted(model: Model) -> Fitted:
            released(train.sparkSession)
            return fit_merged(model, train, inner)
        members = in_parallel([lambda m=m: refitted(m) for m in self.members.values()], at_once)
        folded.unpersist()
        return FittedStacking(names, members, meta, ctx.k)


class FittedStacking(Fitted):
    narrow = False

    def __init__(self, names, members, meta, n_classes):
        self.names, self.members, self.meta, self.n_classes = names, members, meta, n_classes

    def predict(self, df, keep=()):
        parts = [m.predict(df, keep) for m in self.members]
        return self.meta.predict(meta_features(parts, self.names, keep, self.n_classes), keep)


def default_members() -> dict[str, Model]:
    return {"lr": Logistic(), "rf": Forest(50, max_depth=30), "svm": SupportVector("rbf"),
            "nb": NaiveBayes()}


def build_ensemble(kind: str = "voting", members: dict[str, Model] | None = None,
                   meta: Model | None = None) -> Model:
    """An ensemble by type. Bagging uses ten copies of the first member per member."""
    members = members or default_members()
    if kind == "voting":
        return Voting(members)
    if kind == "stacking":
        return Stacking(members, meta or Logistic())
    if kind == "bagging":
        return Bagging(10 * len(members), rows=1.0, columns=1.0, base=next(iter(members.values())))
    raise ValueError(f"unknown ensemble type: {kind}")
