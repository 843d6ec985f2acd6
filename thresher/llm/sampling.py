"""Bounded samples of labelled rows for fitting a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

LARGEST = (1 << 63) - 1


def drawn(share: float, *columns: str | Column) -> Column:
    """True for about ``share`` of all values of ``columns``, by 63 bits of their hash: a share
    above zero never rounds to none, however many rows there are."""
    return F.xxhash64(*columns).bitwiseAND(F.lit(LARGEST)) <= F.lit(min(LARGEST, int(share * 2.0 ** 63)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, most: int,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``text`` and ``label`` of about ``most`` labelled documents, chosen by a hash of the id.

    The chosen labels, at most that many rows, go to all tasks; texts are not shuffled.
    Labels that are null are left out. Ids labelled twice count with their largest label.
    """
    found = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
             .groupBy(id_col).agg(F.max(label_col).cast("int").alias("label")))
    share = min(1.0, most / max(1, found.count()))
    chosen = found.where(drawn(share, F.lit(label_col), id_col))
    return (docs.select(id_col, F.col(text_col).cast("string").alias("text"))
            .join(F.broadcast(chosen), id_col).select("text", "label"))
