"""Ranks, running sums and exact quantiles that never send a whole group to one task.

A window ordered over all rows of a group runs in one task per group. The
functions here first cut the group into ordered buckets, sum the buckets, and
order rows only inside a bucket; results are the same as with one big window.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def digest(id_col: str | Column, seed: int) -> Column:
    """A portable pseudo-random order: md5 of ``id:seed``."""
    id_col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(id_col.cast("string"), F.lit(f":{seed}")))


def shuffled_row_number(df: DataFrame, keys: Sequence[str], id_col: str, seed: int,
                        out: str, digits: int = 3) -> DataFrame:
    """1-based position of each row in the md5 order of its group.

    The first ``digits`` hex digits are the bucket (4096 by default): evenly
    filled whatever the group, and sorted like the full digest.
    """
    d = df.withColumn("_digest", digest(id_col, seed))
    d = d.withColumn("_bucket", F.substring("_digest", 1, digits))
    sizes = d.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = (F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bucket")
                               .rowsBetween(Window.unboundedPreceding, -1)))
    starts = sizes.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate([*keys, "_bucket"])],
                          F.coalesce(before, F.lit(0)).alias("_start"))
    on = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate([*keys, "_bucket"])]
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_digest", id_col)
    position = (F.col("_start") + F.row_number().over(inside)).cast("long")
    return (d.join(starts, on).withColumn(out, position)
            .drop("_digest", "_bucket", "_start", *[f"_k{i}" for i in range(len(on))]))


# Rows that one task orders, on average, and borders that are sent to all tasks.
BUCKET_ROWS = 50_000
MAX_BROADCAST_BORDERS = 1 << 20


def running_sums(counts: DataFrame, keys: Sequence[str], order: str,
                 sums: Sequence[str], splitters: int | None = None,
                 keep: Callable[[], Column] | None = None) -> DataFrame:
    """Adds ``<c>_before`` (sum over smaller ``order`` values of the group) and
    ``<c>_total`` for every column in ``sums``.

    ``counts`` has one row per (keys, order) and no missing value in them.
    Bucket borders are the values whose hash falls in a residue class chosen
    from the group's size: about ``splitters`` of them, spread like the data,
    and the same on every recomputation. Without ``splitters`` there are as many as
    the largest group needs for buckets of BUCKET_ROWS rows, 64 at least: one more
    count. Borders and bucket sums are broadcast as long as they are at most
    MAX_BROADCAST_BORDERS, so rows are not shuffled by group. ``keep`` may drop whole
    buckets before rows are ordered, by ``_o_<c>`` (sum before the bucket), ``_s_<c>``
    (sum of the bucket) and ``<c>_total``.
    """
    keys = list(keys)
    sizes = counts.groupBy(*keys).agg(F.count("*").alias("_n"))
    groups, largest = sizes.agg(F.count("*"), F.max("_n")).first()
    if splitters is None:
        splitters = 64
        while splitters * BUCKET_ROWS < (largest or 0):
            splitters *= 2
    if splitters & (splitters - 1):
        raise ValueError("splitters must be a power of two")
    few = F.broadcast if groups * splitters <= MAX_BROADCAST_BORDERS else (lambda df: df)
    step = F.ceil(F.col("_n") / F.lit(float(splitters)))
    cuts = (counts.select(*keys, order).join(few(sizes), keys)
            .where(F.pmod(F.xxhash64(order), step) == 0)
            .groupBy(*keys).agg(F.sort_array(F.collect_list(order)).alias("_cuts")))
    # as many borders for every group, then a binary search in generated code
    at = F.transform(F.sequence(F.lit(1), F.lit(splitters - 1)),
                     lambda i: F.floor(i * F.size("_cuts") / F.lit(float(splitters))).cast("int"))
    cuts = cuts.select(*keys, F.transform(at, lambda i: F.get("_cuts", i)).alias("_cuts"))
    bucketed = counts.join(few(cuts), keys, "left").withColumn("_bucket", F.lit(0))
    step = splitters // 2
    while step:
        higher = F.get("_cuts", F.col("_bucket") + (step - 1)) < F.col(order)
        bucketed = bucketed.withColumn(
            "_bucket", F.col("_bucket") + F.when(higher, step).otherwise(0))
        step //= 2
    bucketed = bucketed.drop("_cuts")
    totals = bucketed.groupBy(*keys, "_bucket").agg(
        *[F.sum(c).alias(f"_s_{c}") for c in sums])
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = totals.select(
        *keys, "_bucket",
        *[F.coalesce(F.sum(f"_s_{c}").over(earlier), F.lit(0)).alias(f"_o_{c}") for c in sums],
        *[f"_s_{c}" for c in sums],
        *[F.sum(f"_s_{c}").over(whole).alias(f"{c}_total") for c in sums])
    if keep is not None:
        offsets = offsets.where(keep())
    inside = Window.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(
        Window.unboundedPreceding, -1)
    out = bucketed.join(few(offsets), [*keys, "_bucket"])
    return out.select(
        *counts.columns,
        *[(F.col(f"_o_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(f"{c}_before")
          for c in sums],
        *[f"{c}_total" for c in sums])


def exact_quantiles(values: DataFrame, keys: Sequence[str], value: str,
                    probabilities: dict[str, float]) -> DataFrame:
    """Exact, linearly interpolated quantiles: one row per group, one column per name."""
    counts = (values.where(F.col(value).isNotNull()).groupBy(*keys, value)
              .agg(F.count("*").alias("n")))

    def at(p: float) -> Column:
        return (F.col("n_total") - 1) * F.lit(float(p))

    def wanted() -> Column:
        """The bucket holds a row that some quantile needs."""
        tests = [(F.col("_o_n") <= index) & (index < F.col("_o_n") + F.col("_s_n"))
                 for p in probabilities.values() for index in (F.floor(at(p)), F.ceil(at(p)))]
        return functools.reduce(operator.or_, tests)

    ranked = running_sums(counts, keys, value, ["n"], keep=wanted)
    aggs = []
    for name, p in probabilities.items():
        for side, index in (("lo", F.floor(at(p))), ("hi", F.ceil(at(p)))):
            holds = (F.col("n_before") <= index) & (index < F.col("n_before") + F.col("n"))
            aggs.append(F.max(F.when(holds, F.col(value))).alias(f"_{name}_{side}"))
        aggs.append(F.max(at(p) - F.floor(at(p))).alias(f"_{name}_part"))
    per_group = ranked.groupBy(*keys).agg(*aggs)
    return per_group.select(*keys, *[
        (F.col(f"_{q}_lo") + (F.col(f"_{q}_hi") - F.col(f"_{q}_lo")) * F.col(f"_{q}_part"))
        .alias(q) for q in probabilities])
