"""Exact classification metrics as aggregates over a predictions table.

Predictions have one row per scored row: grouping keys (model, level, size,
fold, ...), ``label``, ``pred`` and, for ranking metrics, ``score``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from thresher.functions.columns import ratio
from thresher.operators.ordering import running_sums

SCORING = ("accuracy", "precision", "recall", "f1", "roc_auc")


def confusion_counts(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Observed (label, pred) counts: the small table all class metrics start from."""
    return preds.groupBy(*keys, "label", "pred").agg(F.count("*").alias("n"))


def confusion_matrix(preds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts over the full grid of classes seen as label or prediction."""
    seen = confusion_counts(preds, keys)
    keys = list(keys)
    grouped = seen.groupBy(*keys).agg(
        F.array_sort(F.array_union(F.collect_set("label"), F.collect_set("pred"))).alias("_classes"),
        F.map_from_entries(F.collect_list(F.struct(F.struct("label", "pred"), "n"))).alias("_n"))
    cells = (grouped.select(*keys, "_n", "_classes", F.explode("_classes").alias("label"))
             .select(*keys, "_n", "label", F.explode("_classes").alias("pred")))
    cell = F.try_element_at("_n", F.struct("label", "pred"))
    return cells.select(*keys, "label", "pred", F.coalesce(cell, F.lit(0)).alias("n"))


def per_class(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, class, precision, recall, f1, support) for each class."""
    keys = list(keys)
    counts = confusion_counts(preds, keys)
    sides = counts.select(*keys, F.explode(F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("support"),
                 F.lit(0).cast("long").alias("predicted"),
                 F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("pred").alias("class"), F.lit(0).cast("long").alias("support"),
                 F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hit"))
    )).alias("s")).select(*keys, "s.*")
    t = sides.groupBy(*keys, "class").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"),
        F.sum("hit").alias("hit"))
    return t.select(*keys, "class",
                    ratio(F.col("hit"), F.col("predicted")).alias("precision"),
                    ratio(F.col("hit"), F.col("support")).alias("recall"),
                    ratio(2 * F.col("hit"), F.col("support") + F.col("predicted")).alias("f1"),
                    "support", "hit")


def classification_report(preds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per-class rows, then accuracy, macro average and support-weighted average."""
    keys = list(keys)
    rows = per_class(preds, keys)
    names = ("precision", "recall", "f1")
    total = F.sum("support")
    accuracy = ratio(F.sum("hit"), total)
    summary = rows.groupBy(*keys).agg(
        F.struct(F.lit("accuracy").alias("row"), accuracy.alias("precision"),
                 accuracy.alias("recall"), accuracy.alias("f1"),
                 total.alias("support")).alias("a"),
        F.struct(F.lit("macro avg").alias("row"), *[F.avg(c).alias(c) for c in names],
                 total.alias("support")).alias("m"),
        F.struct(F.lit("weighted avg").alias("row"),
                 *[ratio(F.sum(F.col(c) * F.col("support")), total).alias(c) for c in names],
                 total.alias("support")).alias("w"))
    return rows.select(*keys, F.col("class").cast("string").alias("row"), *names,
                       "support").unionByName(
        summary.select(*keys, F.inline(F.array("a", "m", "w"))))


def threshold_metrics(preds: DataFrame, keys: Sequence[str], average: str = "auto",
                      positive: int = 1) -> DataFrame:
    """(keys, accuracy, precision, recall, f1).

    ``auto`` scores the positive class when labels and predictions are 0/1 and
    averages over classes otherwise; ``binary``, ``macro`` and ``weighted``
    force one.
    """
    if average not in ("auto", "binary", "macro", "weighted"):
        raise ValueError(f"unknown average: {average}")
    keys = list(keys)
    rows = per_class(preds, keys)
    names = ("precision", "recall", "f1")
    total = F.sum("support")
    macro = {c: F.avg(c) for c in names}
    weighted = {c: ratio(F.sum(F.col(c) * F.col("support")), total) for c in names}
    binary = {c: F.coalesce(F.max(F.when(F.col("class") == positive, F.col(c))), F.lit(0.0))
              for c in names}
    is_binary = F.max("class") <= 1

    def pick(c: str) -> Column:
        if average == "auto":
            return F.when(is_binary, binary[c]).otherwise(macro[c])
        return {"binary": binary, "macro": macro, "weighted": weighted}[average][c]

    return rows.groupBy(*keys).agg(ratio(F.sum("hit"), total).alias("accuracy"),
                                   *[pick(c).alias(c) for c in names])


def ranking_metrics(preds: DataFrame, keys: Sequence[str], score: str = "score",
                    positive: int = 1) -> DataFrame:
    """(keys, roc_auc, pr_auc): exact, ties counted half, NULL with only one class.

    Rows are merged to distinct scores first; one pass of running sums serves
    both the rank statistic and the step-wise average precision.
    """
    keys = list(keys)
    hit = (F.col("label") == positive).cast("long")
    counts = (preds.where(F.col(score).isNotNull()).groupBy(*keys, score)
              .agg(F.sum(hit).alias("pos"), F.sum(1 - hit).alias("neg")))
    r = running_sums(counts, keys, score, ["pos", "neg"])
    pairs = F.col("pos_total") * F.col("neg_total")
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") * F.lit(0.5)))
    above = F.col("pos_total") - F.col("pos_before")
    selected = above + F.col("neg_total") - F.col("neg_before")
    steps = F.sum(F.col("pos") * F.try_divide(above.cast("double"), selected.cast("double")))
    return r.groupBy(*keys).agg(
        F.try_divide(wins, F.max(pairs).cast("double")).alias("roc_auc"),
        F.when(F.max("neg_total") > 0,
               F.try_divide(steps, F.max("pos_total").cast("double"))).alias("pr_auc"))


def fold_metrics(preds: DataFrame, keys: Sequence[str] = ("model", "level", "size"),
                 average: str = "auto") -> DataFrame:
    """Long results (keys, fold, metric, value, status) from out-of-fold predictions.

    A metric that a fold cannot have (one class only) is 'degenerate', not 0.
    """
    by = [*keys, "fold"]
    wide = threshold_metrics(preds, by, average)
    if "score" in preds.columns:
        wide = wide.join(ranking_metrics(preds, by), by, "left")
        names = [*SCORING, "pr_auc"]
    else:
        names = list(SCORING[:4])
    long = wide.unpivot(by, names, "metric", "value")
    return long.withColumn("status", F.when(F.col("value").isNull(), "degenerate")
                           .otherwise("ok"))
