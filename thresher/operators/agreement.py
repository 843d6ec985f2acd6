"""Diversity of the members of an ensemble, from their predictions on the same rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def model_pairs(preds: DataFrame, id_col: str = "id", keys: Sequence[str] = ()) -> DataFrame:
    """Counts per model pair: rows where they differ, and n11, n10, n01, n00 of correctness.

    Models of one row are gathered into one small array (one entry per model),
    and pairs are formed inside it, so rows are never joined with each other.
    """
    keys = list(keys)
    per_row = preds.groupBy(*keys, id_col).agg(F.array_sort(F.collect_list(F.struct(
        "model", "pred", (F.col("pred") == F.col("label")).alias("ok")))).alias("_m"))
    # rows with the same votes are merged before pairs are formed
    merged = per_row.groupBy(*keys, "_m").agg(F.count("*").alias("_rows"))
    # outer forms: no inferred test of the array below the merge
    left = merged.select(*keys, "_m", "_rows", F.posexplode_outer("_m").alias("_i", "_a"))
    pair = left.select(*keys, "_rows", "_a", F.explode_outer(
        F.slice("_m", F.col("_i") + 2, F.size("_m"))).alias("_b")).where(
        F.col("_b").isNotNull())
    n = lambda cond: F.sum(F.when(cond, F.col("_rows")).otherwise(0))
    a, b = F.col("_a.ok"), F.col("_b.ok")
    return pair.groupBy(*keys, F.col("_a.model").alias("model_a"),
                        F.col("_b.model").alias("model_b")).agg(
        F.sum("_rows").alias("n"), n(F.col("_a.pred") != F.col("_b.pred")).alias("differ"),
        n(a & b).alias("n11"), n(a & ~b).alias("n10"), n(~a & b).alias("n01"),
        n(~a & ~b).alias("n00"))


def pairwise_diversity(pairs: DataFrame) -> DataFrame:
    """Disagreement and |Q| per pair; Q is NULL on a zero denominator."""
    up = F.col("n11") * F.col("n00")
    down = F.col("n01") * F.col("n10")
    return pairs.withColumns({
        "disagreement": F.col("differ").cast("double") / F.col("n"),
        "q_statistic": F.abs(F.try_divide((up - down).cast("double"),
                                          (up + down).cast("double")))})


def disagreement(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return pairwise_diversity(pairs).groupBy(*keys).agg(
        F.avg("disagreement").alias("average_disagreement"),
        F.max("disagreement").alias("max_disagreement"),
        F.min("disagreement").alias("min_disagreement"))


def yule_q(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return pairwise_diversity(pairs).groupBy(*keys).agg(
        F.coalesce(F.avg("q_statistic"), F.lit(0.0)).alias("average_q_statistic"))


def model_accuracies(preds: DataFrame) -> DataFrame:
    return preds.groupBy("model").agg(
        F.avg((F.col("pred") == F.col("label")).cast("double")).alias("accuracy"))


def accuracy_spread(preds: DataFrame) -> DataFrame:
    """Models and the population std of their accuracies; fewer than two is an error."""
    few = F.raise_error(F.lit("need at least 2 models for diversity"))
    return model_accuracies(preds).agg(
        F.count("*").alias("models"), F.stddev_pop("accuracy").alias("accuracy_std")).select(
        F.when(F.col("models") < 2, few.cast("long")).otherwise(F.col("models")).alias("models"),
        "accuracy_std")


def diversity(preds: DataFrame, id_col: str = "id") -> DataFrame:
    """All diversity measures in one row."""
    pairs = model_pairs(preds, id_col)
    spread = accuracy_spread(preds)
    return disagreement(pairs).withColumns({
        "average_q_statistic": yule_q(pairs).scalar(),
        "models": spread.select("models").scalar(),
        "accuracy_std": spread.select("accuracy_std").scalar()})
