"""Stratified cross-validation folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from thresher.operators.ordering import shuffled_row_number


def stratified_folds(df: DataFrame, id_col: str, label: str, k: int = 5,
                     seed: int = 42) -> DataFrame:
    """Adds ``fold`` in 0..k-1; sizes per class differ by at most one."""
    numbered = shuffled_row_number(df, [label], id_col, seed, "_row")
    return numbered.withColumn("fold", ((F.col("_row") - 1) % k).cast("int")).drop("_row")
