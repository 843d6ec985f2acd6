"""Cross-validated evaluation: one set of fits per model, all metrics from its predictions."""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from thresher.models.base import (DegenerateTraining, Model, class_list, describe, in_parallel,
                                  merge_rows, settled)
from thresher.models.bayes import NaiveBayes, cross_validated_bayes
from thresher.models.linear_grid import cross_validated_linear
from thresher.operators.folds import stratified_folds
from thresher.operators.metrics import fold_metrics
from thresher.operators.ranking import (best_overall, best_per_category,
                                        best_per_level, cross_validated, evaluation_count,
                                        improvements, model_category)
from thresher.operators.text import extraction_aliases, extraction_grid, grid_cells
from thresher.operators.vectors import BagOfWords, MAX_FEATURES
from thresher.session import cut_lineage

KEYS = ("model", "level", "size")
PREDICTION_COLUMNS = ("id", "fold", "model", "label", "pred", "proba", "score")


def fit_model(model: Model, train: DataFrame, bag: BagOfWords | None, ctx):
    if model.mergeable and model.input != "embedding":
        merged = merge_rows(train).persist()
        ctx = replace(ctx, rows=merged.count())
    else:
        merged = train
    rows = settled(merged if model.input == "text" else bag.transform(merged), ctx.held).persist()
    try:
        return model.fit(rows, ctx)
    finally:
        rows.unpersist()
        if merged is not train:
            merged.unpersist()


def cross_validated_predictions(data: DataFrame, models: dict[str, Model], k: int = 5,
                                seed: int = 42, vocab_scope: str = "fold",
                                max_features: int = 5000, parallelism: int = 4) -> DataFrame:
    """Out-of-fold predictions (id, fold, model, label, pred, proba, score).

    ``data`` has (id, text, label). The vocabulary is fitted on the training
    rows of each fold, or on all rows with ``vocab_scope='all'``. Naive Bayes
    models need no fit per fold: they are one plan over all folds. Linear models with a
    ``spec`` are one fit over all folds.
    """
    if vocab_scope not in ("fold", "all"):
        raise ValueError(f"unknown vocab_scope: {vocab_scope}")
    folded = stratified_folds(data.select("id", "text", "label"), "id", "label", k, seed).persist()
    classes = class_list(folded)
    if len(classes) < 2:
        raise DegenerateTraining("fewer than two classes")
    parts, fitted = [], {}
    for name, m in models.items():
        if isinstance(m, NaiveBayes) and vocab_scope == "fold":
            p = cross_validated_bayes(folded, m.kind, m.alpha, k, max_features=m.max_features,
                                      classes=classes)
            parts.append(p.withColumn("model", F.lit(name)).select(*PREDICTION_COLUMNS))
        else:
            fitted[name] = m
    linear = {n: fitted.pop(n) for n in list(fitted) if hasattr(fitted[n], "spec")}
    if linear:
        p = cross_validated_linear(folded, {n: m.spec() for n, m in linear.items()}, k,
                                   max_features=max_features, classes=classes, scope=vocab_scope)
        parts.append(p.select(*PREDICTION_COLUMNS))
    shared = BagOfWords(max_features).fit(folded) if vocab_scope == "all" and fitted else None

    def fold_job(f: int):
        def run():
            train = folded.where(F.col("fold") != f)
            test = folded.where(F.col("fold") == f)
            bag = shared or BagOfWords(max_features).fit(train)
            ctx = replace(describe(train, len(bag.terms), seed), parallelism=1)
            scored = bag.transform(test).persist()
            out = []
            for name, m in fitted.items():
                p = fit_model(m, train, bag, ctx).predict(scored, ["fold", "label"])
                out.append(p.withColumn("model", F.lit(name)).select(*PREDICTION_COLUMNS))
            return out
        return run
    if fitted:
        for done in in_parallel([fold_job(f) for f in range(k)], parallelism):
            parts += done
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def evaluate_model(data: DataFrame, name: str, model: Model, k: int = 5, seed: int = 42,
                   **options) -> DataFrame:
    """Long results (model, fold, metric, value, status) of one model."""
    return evaluate_models(data, {name: model}, k, seed, **options)


def evaluate_models(data: DataFrame, models: dict[str, Model], k: int = 5, seed: int = 42,
                    **options) -> DataFrame:
    """Results of several models. A model that cannot be trained is one 'failed' row,
    never a score of 0, unless it is the only one: then its error is raised."""
    parts, errors = [], []
    for name, m in models.items():
        try:
            # predictions are scored once; every metric reads the stored table
            p = cut_lineage(cross_validated_predictions(data, {name: m}, k, seed, **options)
                            .drop("proba"))
            parts.append(fold_metrics(p, ["model"]))
        except Exception as e:          # recorded per model, see above
            if len(models) == 1:
                raise
            errors.append((name, None, "all", None, f"failed: {type(e).__name__}"))
    if errors:
        parts.append(data.sparkSession.createDataFrame(
            errors, "model string, fold int, metric string, value double, status string"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sorted_models(results: DataFrame) -> DataFrame:
    """Mean and std per metric as columns, best accuracy first."""
    summary = cross_validated(results, ["model"])
    names = ("accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc")
    wide = summary.groupBy("model").agg(*[
        F.max(F.when(F.col("metric") == n, F.col(c))).alias(f"{n}_{c}")
        for n in names for c in ("mean", "std")])
    return wide.orderBy(F.desc("accuracy_mean"), F.asc("model"))


def evaluate_extractions(texts: DataFrame, models: dict[str, Model], sizes=None,
                         baseline: bool = True, k: int = 5, seed: int = 42,
                         **options) -> DataFrame:
    """Results (model, level, size, size_ord, fold, metric, value, status) for all cells.

    ``texts`` has (id, text, label). Each distinct extraction is evaluated once
    and its scores are given to all cells that equal it. Naive Bayes and linear models are
    fitted for all cells and folds together; the number of jobs does not grow with the cells.
    """
    texts = texts.select("id", "text", "label").persist()
    aliases = extraction_aliases(texts, sizes, baseline)
    source = {}
    for level, size, _, src in aliases:
        source.setdefault(src, (level, size))
    grid = extraction_grid(texts, sizes=sizes, baseline=baseline)
    cells = functools.reduce(lambda c, x: F.when(
        (F.col("level") == x[1][0]) & (F.col("size") == x[1][1]), F.lit(x[0])).otherwise(c),
        source.items(), F.lit(None))
    grid = grid.withColumn("_source", cells).where("_source is not null")
    together, others = {}, dict(models)
    if options.get("vocab_scope", "fold") == "fold":
        together = {n: others.pop(n) for n in list(others)
                    if isinstance(others[n], NaiveBayes) or hasattr(others[n], "spec")}
    parts = []
    if together:
        try:
            p = _predictions_of_cells(grid, together, len(source), k, seed, options.get("max_features", MAX_FEATURES))
            p = cut_lineage(p.drop("proba"))
            parts.append(fold_metrics(p, ["model", "_source"]))
        except DegenerateTraining:
            if len(models) == 1:
                raise
            parts.append(texts.sparkSession.createDataFrame(
                [(n, src, None, "all", None, "failed: DegenerateTraining") for n in together for src in source],
                "model string, _source string, fold int, metric string, value double, status string"))
    for src in source if others else ():
        cell = grid.where(F.col("_source") == src)
        r = evaluate_models(cell.select("id", "text", "label"), others, k, seed, **options)
        parts.append(r.withColumn("_source", F.lit(src)))
    done = parts[0]
    for p in parts[1:]:
        done = done.unionByName(p)
    names = texts.sparkSession.createDataFrame(
        aliases, "level string, size string, size_ord int, _source string")
    return (done.join(F.broadcast(names), "_source")            # one row per cell
            .select("model", "level", "size", "size_ord", "fold", "metric", "value", "status"))


def _predictions_of_cells(grid: DataFrame, models: dict[str, Model], n_cells: int, k: int, seed: int,
                          max_features: int) -> DataFrame:
    """(_source, id, fold, model, label, pred, proba, score) of models that take all cells at once."""
    folds = stratified_folds(grid.select("id", "label").distinct(), "id", "label", k, seed)
    folded = grid.select("_source", "id", "label", "text").join(folds, ["id", "label"]).persist()
    classes = class_list(folded)
    if len(classes) < 2:
        raise DegenerateTraining("fewer than two classes")
    columns = ["_source", *PREDICTION_COLUMNS]
    parts = [cross_validated_bayes(folded, m.kind, m.alpha, k, ["_source"], n_cells, m.max_features, classes=classes)
             .withColumn("model", F.lit(n)).select(*columns)
             for n, m in models.items() if isinstance(m, NaiveBayes)]
    linear = {n: m.spec() for n, m in models.items() if not isinstance(m, NaiveBayes)}
    if linear:
        parts.append(cross_validated_linear(folded, linear, k, ["_source"], max_features, classes).select(*columns))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def bayes_over_extractions(texts: DataFrame, name: str, model: NaiveBayes, sizes=None,
                           baseline: bool = True, k: int = 5, seed: int = 42) -> DataFrame:
    """Predictions of one naive Bayes model for every cell and fold in a single plan."""
    folded = stratified_folds(texts.select("id", "text", "label"), "id", "label", k, seed)
    grid = extraction_grid(folded, sizes=sizes, baseline=baseline)
    cells = len(grid_cells(sizes, baseline))
    preds = cross_validated_bayes(grid, model.kind, model.alpha, k, ["level", "size", "size_ord"],
                                  cells, model.max_features)
    return preds.withColumn("model", F.lit(name))


def cell_scores(results: DataFrame, models: Sequence[str], metric: str = "accuracy") -> DataFrame:
    """(model, model_ord, level, size, size_ord, score) for ranking."""
    order = F.create_map(*[x for i, m in enumerate(models) for x in (F.lit(m), F.lit(i))])
    return (cross_validated(results.where(F.col("metric") == metric),
                            ["model", "level", "size", "size_ord"])
            .select("model", order[F.col("model")].alias("model_ord"), "level", "size",
                    "size_ord", F.round("mean", 6).alias("score")))


def benchmark(texts: DataFrame, models: dict[str, Model], sizes=None, k: int = 5,
              seed: int = 42, **options) -> dict[str, DataFrame]:
    """All tables of the full comparison of models over levels and sizes."""
    if "label" not in texts.columns:
        raise ValueError("no labels available for evaluation")
    results = evaluate_extractions(texts, models, sizes, True, k, seed, **options).persist()
    scores = cell_scores(results, list(models)).persist()
    categories = texts.sparkSession.createDataFrame([(m,) for m in models], "model string")
    return {
        "extraction_results": results, "scores": scores,
        "evaluations": evaluation_count(scores), "best_overall": best_overall(scores),
        "extraction_best": best_per_level(scores), "best_models": best_per_category(scores),
        "improvement_metrics": improvements(scores),
        "model_categories": categories.withColumn("category", model_category()),
    }
