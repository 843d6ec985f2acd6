"""Summaries and winners over results tables.

``results``: (model, level, size, size_ord, metric, fold, value, status)
``scores``:  (model, model_ord, level, size, size_ord, score), one row per cell
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

# Level order of the benchmark, and the words that decide a category.
LEVEL_ORDER = ("paragraph", "sentence", "word")
BERT_WORDS = ("BERT", "bert", "Bert")
ENSEMBLE_WORDS = ("RandomForest", "GradientBoosting", "AdaBoost", "ExtraTrees", "Voting",
                  "Bagging", "XGB", "LGBM", "CatBoost")
KEY_METRICS = ("accuracy", "f1", "roc_auc")


def cross_validated(results: DataFrame, keys: Sequence[str] = ("model", "level", "size")) -> DataFrame:
    """Fold mean and population std per metric, over folds with status 'ok'."""
    return (results.where(F.col("status") == "ok").groupBy(*keys, "metric")
            .agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
                 F.count("*").alias("folds")))


def model_category(model: str | Column = "model") -> Column:
    """bert_based, ensemble or classical, by the first kind of word found in the name."""
    model = F.col(model) if isinstance(model, str) else model

    def any_of(words: Sequence[str]) -> Column:
        out = model.contains(words[0])
        for w in words[1:]:
            out = out | model.contains(w)
        return out

    return (F.when(any_of(BERT_WORDS), "bert_based")
            .when(any_of(ENSEMBLE_WORDS), "ensemble").otherwise("classical"))


def level_order(level: str = "level") -> Column:
    out = F
    for i, lv in enumerate(LEVEL_ORDER):
        out = out.when(F.col(level) == lv, i)
    return out.otherwise(len(LEVEL_ORDER))


def _winner(order: Sequence[Column]) -> Column:
    """The row with the largest score; ties go to the smallest of ``order``."""
    return F.max_by(F.struct("model", "level", "size", "score"),
                    F.struct("score", *[-c for c in order]))


def _best(scores: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    ranked = scores.withColumn("level_ord", level_order())
    cols = [F.col(c) for c in order]
    return (ranked.groupBy(*keys).agg(_winner(cols).alias("w"))
            .where(F.col("w").isNotNull())
            .select(*[k for k in keys if k != "level"], "w.*"))


def best_per_level(scores: DataFrame) -> DataFrame:
    """Ties: first size, then first model."""
    return _best(scores, ["level"], ["size_ord", "model_ord"])


def best_overall(scores: DataFrame) -> DataFrame:
    """Ties: first level in benchmark order, then first size, then first model."""
    return _best(scores, [], ["level_ord", "size_ord", "model_ord"])


def report_best(scores: DataFrame) -> DataFrame:
    """The report's winner: ties go to the first level, first model, first size."""
    return _best(scores, [], ["level_ord", "model_ord", "size_ord"])


def best_per_category(scores: DataFrame) -> DataFrame:
    tagged = scores.withColumn("category", model_category())
    return _best(tagged, ["category"], ["level_ord", "model_ord", "size_ord"])


def report_level_best(scores: DataFrame) -> DataFrame:
    """Best of each level with the report's tie rule (model before size)."""
    return _best(scores, ["level"], ["model_ord", "size_ord"])


def best_per_model(scores: DataFrame) -> DataFrame:
    return scores.groupBy("model").agg(F.max("score").alias("best_score"))


def improvements(scores: DataFrame) -> DataFrame:
    """bert_vs_classical and ensemble_vs_classical; rows only if both sides have a score
    and the classical one is positive."""
    best = scores.groupBy().agg(*[
        F.max(F.when(model_category() == c, F.col("score"))).alias(c)
        for c in ("classical", "bert_based", "ensemble")])
    rows = [F.struct(F.lit(name).alias("comparison"), F.col("classical").alias("classical_best"),
                     F.col(side).alias("other_best"))
            for name, side in (("bert_vs_classical", "bert_based"),
                               ("ensemble_vs_classical", "ensemble"))]
    gain = F.col("other_best") - F.col("classical_best")
    return (best.select(F.inline(F.array(*rows)))
            .where((F.col("classical_best") > 0) & F.col("other_best").isNotNull())
            .select("comparison", "classical_best", "other_best",
                    gain.alias("absolute_improvement"),
                    (gain / F.col("classical_best") * F.lit(100.0)).alias("relative_improvement")))


def evaluation_count(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count("*").alias("total_model_evaluations"))


def metric_statistics(summary: DataFrame) -> DataFrame:
    """Mean, sample std, min, max and range of each metric over models."""
    return summary.groupBy("metric").agg(
        F.avg("mean").alias("mean"), F.stddev_samp("mean").alias("std"),
        F.min("mean").alias("min"), F.max("mean").alias("max"),
        (F.max("mean") - F.min("mean")).alias("range"))


def model_ranking(summary: DataFrame, metrics: Sequence[str] | None = None) -> DataFrame:
    """Rank of each model per metric; the summary has one row per model and metric."""
    src = summary if metrics is None else summary.where(F.col("metric").isin(list(metrics)))
    w = Window.partitionBy("metric").orderBy(F.desc("mean"))
    return src.select("metric", "model", "mean", F.rank().over(w).alias("rank"))


def sort_models(summary: DataFrame, metric: str = "accuracy") -> DataFrame:
    return summary.where(F.col("metric") == metric).orderBy(F.desc("mean"), F.asc("model"))


def top_models(summary: DataFrame, k: int = 5, metric: str = "accuracy") -> DataFrame:
    """The k best models by a metric; an unknown metric is an error."""
    if summary.where(F.col("metric") == metric).isEmpty():
        raise ValueError(f"unknown metric: {metric}")
    return sort_models(summary, metric).limit(k)


def compare_models(summary: DataFrame, models: Sequence[str] | None = None,
                   metrics: Sequence[str] | None = None) -> DataFrame:
    """Keep the named models, and metrics whose name contains one of the words.
    A filter that would keep nothing is ignored."""
    def apply(df: DataFrame, cond: Column) -> DataFrame:
        hits = df.agg(F.coalesce(F.max(cond.cast("int")), F.lit(0)).alias("n")).scalar()
        return df.where((hits == 0) | cond)

    out = summary
    if models:
        out = apply(out, F.col("model").isin(list(models)))
    if metrics:
        cond = F.col("metric").contains(metrics[0])
        for m in metrics[1:]:
            cond = cond | F.col("metric").contains(m)
        out = apply(out, cond)
    return out


def summary_report(summary: DataFrame) -> DataFrame:
    """(section, item, statistic, value): counts, best model, statistics, rankings."""
    def rows(df: DataFrame, *cols: Column) -> DataFrame:
        return df.select(F.inline(F.array(*cols)))

    def cell(section, item, statistic, value) -> Column:
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(lit(section).alias("section"), lit(item).alias("item"),
                        lit(statistic).alias("statistic"),
                        lit(value).cast("double").alias("value"))

    counts = summary.agg(F.count_distinct("model").alias("m"), F.count_distinct("metric").alias("k"))
    best = summary.where(F.col("metric") == "accuracy").agg(
        F.min_by(F.struct("model", "mean", "std"),
                 F.struct((-F.col("mean")).alias("a"), F.col("model").alias("b"))).alias("w"))
    stats = metric_statistics(summary)
    ranks = model_ranking(summary, KEY_METRICS)
    return (rows(counts, cell("totals", "", "models", F.col("m")),
                 cell("totals", "", "metrics", F.col("k")))
            .unionByName(rows(best, cell("best_model", F.col("w.model"), "accuracy", F.col("w.mean")),
                              cell("best_model", F.col("w.model"), "std", F.col("w.std"))))
            .unionByName(rows(stats, *[cell("statistics", F.col("metric"), s, F.col(s))
                                       for s in ("mean", "std", "min", "max", "range")]))
            .unionByName(rows(ranks, cell(F.concat(F.lit("ranking_"), "metric"), F.col("model"),
                                          "rank", F.col("rank")))))


def flatten_summary(scores: DataFrame, task_type: str = "binary") -> DataFrame:
    """(category, metric, value) text rows of the benchmark summary.

    Nested parts give one row per field; plain values have the metric 'value'.
    """
    def text(c: Column) -> Column:
        return c.cast("string")

    def rows(df: DataFrame, items) -> DataFrame:
        return df.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("category") if isinstance(c, str) else c.alias("category"),
                     F.lit(m).alias("metric") if isinstance(m, str) else m.alias("metric"),
                     text(v).alias("value")) for c, m, v in items])))

    total = evaluation_count(scores)
    levels = scores.select("level", level_order().alias("o")).distinct().agg(
        F.concat_ws(", ", F.transform(F.array_sort(F.collect_list(F.struct("o", "level"))),
                                      lambda s: s["level"])).alias("v"))
    overall = best_overall(scores)
    per_level = best_per_level(scores)
    score = lambda: F.format_string("%.6f", F.col("score"))
    return (rows(total, [("task_type", "value", F.lit(task_type)),
                         ("total_model_evaluations", "value", F.col("total_model_evaluations"))])
            .unionByName(rows(levels, [("extraction_methods_evaluated", "value", F.col("v"))]))
            .unionByName(rows(overall, [
                ("best_overall", "model", F.col("model")),
                ("best_overall", "extraction_type", F.col("level")),
                ("best_overall", "extraction_size", F.col("size")),
                ("best_overall", "score", score())]))
            .unionByName(rows(per_level, [
                ("extraction_best", F.concat("level", F.lit(".model")), F.col("model")),
                ("extraction_best", F.concat("level", F.lit(".extraction_size")), F.col("size")),
                ("extraction_best", F.concat("level", F.lit(".score")), score())])))


def benchmark_report(scores: DataFrame) -> DataFrame:
    """The report as rows (line_no, line), ready for a text sink once ordered."""
    rule = "=" * 80
    # section, position inside it, line within the item
    def lines(df: DataFrame, section: int, item: Column, texts: Sequence) -> DataFrame:
        return df.select(F.inline(F.array(*[
            F.struct(F.lit(section).alias("s"), item.cast("int").alias("i"), F.lit(j).alias("j"),
                     (F.lit(t) if isinstance(t, str) else t).alias("line"))
            for j, t in enumerate(texts)])))

    one = F.lit(0)
    total = evaluation_count(scores)
    levels = scores.select("level", level_order().alias("o")).distinct().agg(
        F.concat_ws(", ", F.transform(F.array_sort(F.collect_list(F.struct("o", "level"))),
                                      lambda s: F.concat(F.lit("'"), s["level"], F.lit("'")))).alias("v"))
    cat_order = (F.when(F.col("category") == "classical", 0)
                 .when(F.col("category") == "ensemble", 1).otherwise(2))
    parts = [
        lines(total, 0, one, [rule, "TOPIC BENCHMARK REPORT", rule, "",
              F.format_string("Total Model Evaluations: %d", "total_model_evaluations")]),
        lines(levels, 1, one, [F.format_string("Extraction Methods: [%s]", "v"), ""]),
        lines(report_best(scores), 2, one, [
            "BEST OVERALL PERFORMANCE:", F.format_string("  Model: %s", "model"),
            F.format_string("  Extraction: %s (size: %s)", "level", "size"),
            F.format_string("  Score: %.4f", "score"), ""]),
        lines(total, 3, F.lit(-1), ["BEST PERFORMANCE BY CATEGORY:"]),
        lines(best_per_category(scores), 3, cat_order, [
            F.format_string("  %s:", F.upper("category")),
            F.format_string("    Model: %s", "model"),
            F.format_string("    Score: %.4f", "score"),
            F.format_string("    Extraction: %s (size: %s)", "level", "size")]),
        lines(total, 4, F.lit(-1), ["", "EXTRACTION METHOD COMPARISON:"]),
        lines(report_level_best(scores), 4, level_order(), [
            F.format_string("  %s:", F.upper("level")),
            F.format_string("    Best Score: %.4f", "score"),
            F.format_string("    Best Model: %s", "model"),
            F.format_string("    Best Size: %s", "size")]),
        lines(total, 5, F.lit(-1), [""]),
        lines(improvements(scores).agg(F.count("*").alias("n")).where("n > 0"), 6, F.lit(-1),
              ["IMPROVEMENT ANALYSIS:"]),
        lines(improvements(scores), 6,
              F.when(F.col("comparison") == "bert_vs_classical", 0).otherwise(1), [
            F.format_string("  %s:", F.upper("comparison")),
            F.format_string("    Absolute Improvement: %.4f", "absolute_improvement"),
            F.format_string("    Relative Improvement: %.2f%%", "relative_improvement")]),
        lines(improvements(scores).agg(F.count("*").alias("n")).where("n > 0"), 7, one, [""]),
        lines(total, 8, one, [rule]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    w = Window.orderBy("s", "i", "j")       # a report has a few dozen lines
    return out.select(F.row_number().over(w).alias("line_no"), "line")
