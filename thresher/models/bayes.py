"""Naive Bayes as aggregates: term counts per class, a weight table, sums per document.

All cells (extractions) and folds are trained and scored in one plan: counts are
taken once per fold, and a training set is the sum over the other folds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from thresher.functions.columns import distinct_terms
from thresher.models.base import (Context, Fitted, Model, WEIGHT, as_predictions, class_list,
                                  softmax)
from thresher.operators.vectors import MAX_FEATURES, keyed_vocabulary
from thresher.session import cut_lineage

KINDS = ("multinomial", "bernoulli", "complement")

# A weight table of at most this many rows (some 50 MB) is broadcast.
MAX_BROADCAST_ROWS = 400_000


def _counts(docs: DataFrame, keys: Sequence[str], text: str) -> tuple[DataFrame, DataFrame]:
    weight = F.sum(WEIGHT) if WEIGHT in docs.columns else F.count("*").cast("double")
    keep = [*keys, "label", *([WEIGHT] if WEIGHT in docs.columns else [])]
    by_term = (docs.select(*keep, F.explode(distinct_terms(text)).alias("term"))
               .groupBy(*keys, "label", "term").agg(weight.alias("n")))
    return by_term, docs.groupBy(*keys, "label").agg(weight.alias("n"))


def _other_folds(counts: DataFrame, group: Sequence[str], k: int) -> DataFrame:
    """Counts of the training rows of each fold: the sum over all other folds."""
    folds = F.array(*[F.lit(i) for i in range(k)])
    return (counts.withColumn("_for", F.explode(F.filter(folds, lambda f: f != F.col("fold"))))
            .groupBy(*group, F.col("_for").alias("fold")).agg(F.sum("n").alias("n")))


def weight_table(by_term: DataFrame, by_class: DataFrame, keys: Sequence[str],
                 classes: Sequence[int], kind: str, alpha: float,
                 max_features: int) -> tuple[DataFrame, DataFrame]:
    """(keys, term, w) and (keys, base): per-class log weights as arrays in class order."""
    rows, facts = _vocabulary_counts(by_term, by_class, keys, classes, max_features)
    return _log_weights(rows, facts, keys, classes, kind, alpha)


def _vocabulary_counts(by_term: DataFrame, by_class: DataFrame, keys: Sequence[str], classes: Sequence[int],
                       max_features: int) -> tuple[DataFrame, DataFrame]:
    """Counts that all kinds share: of the vocabulary's terms and, beside them and alone, of the keys."""
    keys = list(keys)
    ks = range(len(classes))

    def per_class(c: int) -> Column:
        return F.coalesce(F.sum(F.when(F.col("label") == classes[c], F.col("n"))), F.lit(0.0))

    wide = by_term.groupBy(*keys, "term").agg(
        *[per_class(i).alias(f"n{i}") for i in ks], F.sum("n").alias("df"))
    kept = keyed_vocabulary(wide, keys, max_features)
    totals = kept.groupBy(*keys).agg(F.count("*").alias("_v"), F.sum("df").alias("_t"),
                                     *[F.sum(f"n{i}").alias(f"_t{i}") for i in ks])
    docs = by_class.groupBy(*keys).agg(F.sum("n").alias("_d"),
                                       *[per_class(i).alias(f"_d{i}") for i in ks])
    facts = docs.join(totals, keys, "left")
    return kept.join(facts, keys), facts


def _log_weights(rows: DataFrame, facts: DataFrame, keys: Sequence[str], classes: Sequence[int], kind: str,
                 alpha: float) -> tuple[DataFrame, DataFrame]:
    if kind not in KINDS:
        raise ValueError(f"unknown kind: {kind}")
    keys = list(keys)
    ks = range(len(classes))
    a = F.lit(float(alpha))
    prior = [F.when(F.col(f"_d{i}") > 0, F.log(F.col(f"_d{i}") / F.col("_d")))
             .otherwise(F.lit(float("-inf"))) for i in ks]
    if kind == "multinomial":
        w = [F.log((F.col(f"n{i}") + a) / (F.col(f"_t{i}") + a * F.col("_v"))) for i in ks]
    elif kind == "complement":
        w = [-F.log((F.col("df") - F.col(f"n{i}") + a)
                    / (F.col("_t") - F.col(f"_t{i}") + a * F.col("_v"))) for i in ks]
        prior = [F.lit(0.0) for _ in ks]
    else:
        p = [(F.col(f"n{i}") + a) / (F.col(f"_d{i}") + 2 * a) for i in ks]
        off = rows.groupBy(*keys).agg(*[F.sum(F.log(1 - p[i])).alias(f"_off{i}") for i in ks])
        facts = facts.join(off, keys, "left")
        prior = [prior[i] + F.coalesce(F.col(f"_off{i}"), F.lit(0.0)) for i in ks]
        w = [F.log(p[i]) - F.log(1 - p[i]) for i in ks]
    return (rows.select(*keys, "term", F.array(*w).alias("w")),
            facts.select(*keys, F.array(*prior).alias("base")))


def log_scores(docs: DataFrame, weights: DataFrame, base: DataFrame, keys: Sequence[str],
               carry: Sequence[str], n_classes: int, text: str,
               broadcast_rows: int | None) -> DataFrame:
    """(keys, carry, jll): joint log likelihoods, 6 places, for every document."""
    keys = list(keys)
    if broadcast_rows is not None and broadcast_rows * n_classes <= 2 * MAX_BROADCAST_ROWS:
        weights = F.broadcast(weights)
    exploded = docs.select(*keys, *carry, F.explode_outer(distinct_terms(text)).alias("term"))
    summed = exploded.join(weights, [*keys, "term"], "left").groupBy(*keys, *carry).agg(
        *[F.coalesce(F.sum(F.col("w")[i]), F.lit(0.0)).alias(f"_s{i}")
          for i in range(n_classes)])
    out = summed.join(base, keys)
    jll = F.array(*[F.round(F.col(f"_s{i}") + F.col("base")[i], 6) for i in range(n_classes)])
    return out.select(*keys, *carry, jll.alias("jll"))


def cross_validated_bayes(docs: DataFrame, kind: str = "multinomial", alpha: float = 1.0,
                          k: int = 5, cells: Sequence[str] = (), n_cells: int = 1,
                          max_features: int = MAX_FEATURES, text: str = "text",
                          classes: Sequence[int] | None = None) -> DataFrame:
    """Out-of-fold predictions of (cells, id, fold, label, text) for all cells and folds at once.

    The vocabulary of each fold comes from its own training rows.
    """
    return cross_validated_kinds(docs, [kind], alpha, k, cells, n_cells, max_features, text, classes)[0]


def cross_validated_kinds(docs: DataFrame, kinds: Sequence[str] = KINDS, alpha: float = 1.0, k: int = 5,
                          cells: Sequence[str] = (), n_cells: int = 1, max_features: int = MAX_FEATURES,
                          text: str = "text", classes: Sequence[int] | None = None) -> list[DataFrame]:
    """``cross_validated_bayes`` of several kinds. The texts are counted once and scored once, with the
    weights of all kinds side by side."""
    classes = tuple(classes or class_list(docs))
    by_term, by_class = _counts(docs, [*cells, "fold"], text)
    keys = [*cells, "fold"]
    rows, facts = _vocabulary_counts(_other_folds(by_term, [*cells, "label", "term"], k),
                                     _other_folds(by_class, [*cells, "label"], k), keys, classes, max_features)
    if len(kinds) > 1:
        rows, facts = cut_lineage(rows), cut_lineage(facts)
    tables = [_log_weights(rows, facts, keys, classes, kind, alpha) for kind in kinds]
    weights, base = tables[0]
    for w, b in tables[1:]:
        weights = weights.join(w.withColumnRenamed("w", "_more"), [*keys, "term"]).select(
            *keys, "term", F.concat("w", "_more").alias("w"))
        base = base.join(b.withColumnRenamed("base", "_more"), keys).select(
            *keys, F.concat("base", "_more").alias("base"))
    width = len(classes)
    jll = log_scores(docs, weights, base, keys, ["id", "label"], width * len(kinds), text,
                     max_features * k * n_cells)
    if len(kinds) > 1:
        jll = cut_lineage(jll)
    out = []
    for i in range(len(kinds)):
        own = jll if len(kinds) == 1 else jll.withColumn("jll", F.slice("jll", 1 + i * width, width))
        out.append(as_predictions(own, ["fold", "label", *cells, "jll"], softmax(F.col("jll")), classes,
                                  decide=F.col("jll")))
    return out


class NaiveBayes(Model):
    """Naive Bayes on binary term features."""
    input = "text"
    mergeable = True

    def __init__(self, kind: str = "multinomial", alpha: float = 1.0,
                 max_features: int = MAX_FEATURES):
        self.kind, self.alpha, self.max_features = kind, alpha, max_features

    def fit(self, train: DataFrame, ctx: Context) -> "FittedBayes":
        by_term, by_class = _counts(train.withColumn("_one", F.lit(1)), ["_one"], "text")
        weights, base = weight_table(by_term, by_class, ["_one"], ctx.classes, self.kind,
                                     self.alpha, self.max_features)
        return FittedBayes(weights, base, ctx.classes, self.max_features)


class FittedBayes(Fitted):
    narrow = False

    def __init__(self, weights, base, classes, max_features):
        self.weights, self.base = weights.persist(), base.persist()
        self.classes, self.max_features = classes, max_features

    def predict(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        jll = log_scores(df.withColumn("_one", F.lit(1)), self.weights, self.base, ["_one"],
                         ["id", *keep], len(self.classes), "text", self.max_features)
        return as_predictions(jll, keep, softmax(F.col("jll")), self.classes,
                              decide=F.col("jll"))
