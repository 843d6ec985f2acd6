"""Cross-validation of linear models over all cells, folds and classes in one fit."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, Window, functions as F

from thresher.functions.columns import distinct_terms
from thresher.models.base import (DegenerateTraining, argmax_class, as_predictions, class_list,
                                  normalised, one_hot)
from thresher.models.newton import Problem, dealt, linear_scores, minimise, parts_of
from thresher.operators.vectors import MAX_FEATURES, keyed_vocabulary


@dataclass(frozen=True)
class LinearSpec:
    """A linear model by its loss. ``probabilities``: scores are turned into them by a logistic curve."""
    loss: str
    penalty: float = 1.0
    intercept_penalty: float = 0.0
    balanced: bool = False
    probabilities: bool = False


def decision(scores: Column, classes: Sequence[int], probabilities: bool
             ) -> tuple[Column, Column | None, Column]:
    """(probabilities, score of class 1, what is decided on) from scores against the rest."""
    if probabilities:
        scores = F.transform(scores, lambda s: F.coalesce(1 / (1 + F.exp(-s)), F.lit(0.0)))
    else:
        scores = F.transform(scores, lambda s: F.coalesce(s, F.lit(float("-inf"))))
    if len(classes) == 2:
        s = scores[0]
        decide = F.array((1 - s) if probabilities else -s, s)
    else:
        s, decide = None, scores
    if not probabilities:
        proba = one_hot(argmax_class(decide, classes), classes)
    else:
        proba = decide if s is not None else normalised(decide)
    return proba, s, decide


def _vocabularies(docs: DataFrame, k: int, max_features: int, scope: str) -> DataFrame:
    """(cell, term, folds): the terms of each cell, and in which folds' training vocabularies they are."""
    counts = (docs.select("cell", "fold", F.explode(distinct_terms("text")).alias("term"))
              .groupBy("cell", "fold", "term").agg(F.count("*").alias("n")))
    if scope == "all":
        counts = counts.groupBy("cell", "term").agg(F.sum("n").alias("df")).withColumn("fold", F.lit(-1))
        kept = keyed_vocabulary(counts, ["cell"], max_features)
        return kept.select("cell", "term", F.lit((1 << k) - 1).alias("folds"))
    folds = F.array(*[F.lit(i) for i in range(k)])
    others = (counts.withColumn("_for", F.explode(F.filter(folds, lambda f: f != F.col("fold"))))
              .groupBy("cell", "term", F.col("_for").alias("fold")).agg(F.sum("n").alias("df")))
    kept = keyed_vocabulary(others, ["cell", "fold"], max_features)
    return kept.groupBy("cell", "term").agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("fold").cast("int"))).alias("folds"))


def cross_validated_linear(folded: DataFrame, models: dict[str, LinearSpec], k: int = 5,
                           cells: Sequence[str] = (), max_features: int = MAX_FEATURES,
                           classes: Sequence[int] | None = None, scope: str = "fold"
                           ) -> DataFrame:
    """Out-of-fold predictions (cells, id, fold, model, label, pred, proba, score) of all models.

    ``folded`` has (cells, id, fold, label, text). Every cell has its own vocabulary, fitted on
    the training rows of each fold (``scope`` 'fold') or on all rows ('all'). The number of jobs
    does not depend on the number of cells, folds, classes or models: coefficients are one
    matrix and every step is one aggregate over the distinct rows. That matrix, on the driver
    and in every task, has at most models x folds x classes rows and cells x folds x
    ``max_features`` columns.
    """
    classes = tuple(classes or class_list(folded))
    wanted = list(range(1, 2)) if len(classes) == 2 else list(range(len(classes)))
    cells = list(cells)
    # a number for each cell; a grid has few
    keys = [tuple(r) for r in folded.select(*cells).distinct().collect()] if cells else [()]
    keys.sort(key=str)
    label = F.array_position(F.array(*[F.lit(int(c)) for c in classes]), F.col("label").cast("int")) - 1
    cell = F.lit(0)
    for i, key in enumerate(keys[1:], 1):
        same = functools.reduce(operator.and_, [F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(cells, key)])
        cell = F.when(same, F.lit(i)).otherwise(cell)
    docs = folded.withColumn("cell", cell.cast("int")).withColumn("_label", label.cast("int"))
    number_of = Window.partitionBy("cell").orderBy("term")
    vocabulary = (_vocabularies(docs, k, max_features, scope)
                  .withColumn("column", F.row_number().over(number_of))
                  .orderBy("cell", "column").toPandas())
    sizes = np.maximum(np.bincount(vocabulary["cell"], minlength=len(keys)), 1)
    starts = np.cumsum(sizes) - sizes
    columns = starts[vocabulary["cell"]] + vocabulary["column"].to_numpy() - 1
    # a term of a cell is a word of one joint vocabulary; a cell without terms keeps a column
    words = [f"{c}\x01" for c in range(len(keys)) for _ in range(sizes[c])]
    for at, c, term in zip(columns, vocabulary["cell"], vocabulary["term"]):
        words[at] = f"{c}\x01{term}"
    joint = CountVectorizerModel.from_vocabulary(words, inputCol="_terms", outputCol="features")
    joint.setBinary(True)

    def encoded(rows: DataFrame) -> DataFrame:
        prefix = F.concat(F.col("cell").cast("string"), F.lit("\x01"))
        named = rows.withColumn("_terms", F.transform(distinct_terms("text"), lambda t: F.concat(prefix, t)))
        return joint.transform(named).drop("_terms")

    index, values = parts_of("features")
    merged = docs.groupBy("cell", "fold", "_label", "text").agg(F.count("*").cast("double").alias("weight"))
    rows = encoded(merged).select("cell", F.col("fold").cast("int").alias("fold"), F.col("_label").alias("label"),
                                  "weight", index.alias("index"), values.alias("values")).persist()
    facts = rows.groupBy("cell", "fold", "label").agg(
        F.sum("weight").alias("n"), F.count("*").alias("rows")).collect()   # cells x folds x classes
    even = dealt(rows, sum(r["rows"] for r in facts)).persist()
    counted = np.zeros((len(keys), k, len(classes)))
    for r in facts:
        counted[r["cell"], r["fold"], r["label"]] = r["n"]
    training = counted.sum(1, keepdims=True) - counted       # (cell, fold, class)
    if ((training > 0).sum(2) < 2).any():
        even.unpersist(), rows.unpersist()
        raise DegenerateTraining("fewer than two classes")

    problems, weights = [], []
    for spec in models.values():
        for fold in range(k):
            for c in wanted:
                problems.append(Problem(spec.loss, spec.penalty, spec.intercept_penalty, fold, c))
                n = training[:, fold]
                balance = n.sum(1, keepdims=True) / ((n > 0).sum(1, keepdims=True) * np.maximum(n, 1))
                weights.append(balance if spec.balanced else np.ones(n.shape))
    in_fold = (vocabulary["folds"].to_numpy()[None, :] >> np.arange(k)[:, None]) & 1
    mask = np.zeros((len(problems), int(sizes.sum())))
    for q, p in enumerate(problems):
        mask[q, columns] = in_fold[p.fold]
    found = minimise(even, problems, sizes.tolist(), mask, np.array(weights), tol=1e-7)
    even.unpersist()
    rows.unpersist()

    parts, per_model = [], k * len(wanted)
    scored = encoded(docs)
    for m, (name, spec) in enumerate(models.items()):
        q = slice(m * per_model, (m + 1) * per_model)
        coefficients = found.weights[q]
        # the intercepts of a row's cell, and null for a class its training rows lack
        offsets = np.where(found.dead[q], np.nan, found.intercepts[q])
        flat = F.transform(F.split(F.lit(",".join(map(repr, offsets.T.ravel().tolist()))), ","),
                           lambda v: v.cast("double"))
        at = F.col("cell") * per_model + F.col("fold") * len(wanted)
        own = F.slice(linear_scores(coefficients, np.zeros(per_model)), F.col("fold") * len(wanted) + 1, len(wanted))
        both = F.zip_with("_own", F.slice(flat, at + 1, len(wanted)), lambda s, b: F.nullif(s + b, F.lit(float("nan"))))
        with_scores = scored.withColumn("_own", own).withColumn("_scores", both)
        proba, score, decide = decision(F.col("_scores"), classes, spec.probabilities)
        parts.append(as_predictions(with_scores, ["fold", "label", *cells], proba, classes, score, decide)
                     .withColumn("model", F.lit(name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
