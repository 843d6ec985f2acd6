"""Table preparation and profile: cleaning, validation, summaries, splits."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from thresher.functions.columns import FLOATING
from thresher.operators.ordering import exact_quantiles, shuffled_row_number


def normalise_missing(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating column, so there is one missing value."""
    return df.select([
        F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name)
        if isinstance(f.dataType, FLOATING) else F.col(f.name)
        for f in df.schema.fields])


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Full-row distinct; copies are merged before the shuffle."""
    return normalise_missing(df).dropDuplicates()


def drop_missing(df: DataFrame) -> DataFrame:
    return normalise_missing(df).na.drop("any")


def fill_missing(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Median for long and double columns, mode (smallest on a tie) for the rest.

    A filled long column becomes double, as its median may lie between two
    values. Medians and modes are one row each, computed from value counts.
    """
    df = normalise_missing(df)
    columns = [c for c in df.columns if columns is None or c in columns]
    types = {f.name: f.dataType for f in df.schema.fields}
    medians = [c for c in columns if isinstance(types[c], (T.LongType, T.DoubleType))]
    modes = [c for c in columns if c not in medians]
    fills: dict[str, Column] = {}
    if medians:
        long = df.select([F.col(c).cast("double").alias(c) for c in medians]).unpivot(
            [], medians, "column", "value")
        q = exact_quantiles(long, ["column"], "value", {"median": 0.5})
        row = q.groupBy().agg(F.struct(*[
            F.max(F.when(F.col("column") == c, F.col("median"))).alias(f"m{i}")
            for i, c in enumerate(medians)]).alias("row")).scalar()
        fills.update({c: row.getField(f"m{i}") for i, c in enumerate(medians)})
    for c in modes:
        counted = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("_n"))
        fills[c] = counted.agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(c).alias("v")))
                               .getField("v").alias("v")).scalar()
    out = []
    for c in df.columns:
        if c not in fills:
            out.append(F.col(c))
            continue
        fill = fills[c]
        if isinstance(types[c], T.StringType):
            fill = F.coalesce(fill, F.lit("unknown"))
        kept = F.col(c).cast("double") if c in medians else F.col(c)
        out.append(F.coalesce(kept, fill).alias(c))
    return df.select(out)


def cast_label(df: DataFrame, label: str) -> DataFrame:
    """A floating label is truncated to int; a missing one is an error."""
    if not isinstance(df.schema[label].dataType, FLOATING):
        return df
    missing = F.col(label).isNull() | F.isnan(label)
    value = F.when(missing, F.raise_error(F.lit(f"missing label in {label}")).cast("int"))
    return df.withColumn(label, value.otherwise(F.col(label).cast("int")))


def preprocess(df: DataFrame, handle_missing: str = "drop", remove_duplicates: bool = True,
               label: str | None = None) -> DataFrame:
    """Distinct, then missing cells ('drop', 'fill' or 'ignore'), then the label cast."""
    df = normalise_missing(df)
    if remove_duplicates:
        df = drop_duplicates(df)
    if handle_missing == "drop":
        df = drop_missing(df)
    elif handle_missing == "fill":
        df = fill_missing(df)
    elif handle_missing != "ignore":
        raise ValueError(f"unknown handle_missing: {handle_missing}")
    return cast_label(df, label) if label and label in df.columns else df


def entity_features(log: DataFrame, entity: str, value: str, prefix: str = "v") -> DataFrame:
    """max, min, avg, range and sample std of a measurement per entity; one shuffle."""
    return (log.groupBy(entity).agg(
        F.max(value).alias(f"{prefix}_max"), F.min(value).alias(f"{prefix}_min"),
        F.avg(value).alias(f"{prefix}_avg"),
        (F.max(value) - F.min(value)).alias(f"{prefix}_range"),
        F.stddev_samp(value).alias(f"{prefix}_std")))


def _missing_counts(df: DataFrame) -> list[Column]:
    return [F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows minus distinct rows; NULLs are equal to each other."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return normalise_missing(df).agg(
        (F.count("*") - F.count_distinct(row)).alias("duplicates"))


def validate(df: DataFrame) -> DataFrame:
    """(column, statistic, value): table size, duplicates, type and missing count per column."""
    df = normalise_missing(df)
    wide = df.agg(F.count("*").alias("_rows"), *_missing_counts(df))
    missing = wide.select("_rows", *[F.col(c) for c in df.columns])
    parts = [F.struct(F.lit("").alias("column"), F.lit("rows").alias("statistic"),
                      F.col("_rows").cast("string").alias("value")),
             F.struct(F.lit("").alias("column"), F.lit("columns").alias("statistic"),
                      F.lit(str(len(df.columns))).alias("value"))]
    for f in df.schema.fields:
        parts.append(F.struct(F.lit(f.name).alias("column"), F.lit("missing").alias("statistic"),
                              F.col(f.name).cast("string").alias("value")))
        parts.append(F.struct(F.lit(f.name).alias("column"), F.lit("type").alias("statistic"),
                              F.lit(f.dataType.simpleString()).alias("value")))
    rows = missing.select(F.inline(F.array(*parts)))
    dup = duplicate_count(df).select(
        F.lit("").alias("column"), F.lit("duplicates").alias("statistic"),
        F.col("duplicates").cast("string").alias("value"))
    return rows.unionByName(dup)


def missing_required(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Names in ``required`` that the table lacks, as a one-column table."""
    lacking = [c for c in required if c not in df.columns]
    return df.sparkSession.createDataFrame([(c,) for c in lacking], "column string")


def missing_summary(df: DataFrame) -> DataFrame:
    """Missing count and percentage per column, and the total (column '')."""
    df = normalise_missing(df)
    wide = df.agg(F.count("*").alias("_rows"), *_missing_counts(df))
    total = sum((F.col(c) for c in df.columns), F.lit(0))
    parts = [F.struct(F.lit(c).alias("column"), F.col(c).alias("missing"),
                      (F.try_divide(F.col(c) * F.lit(100.0), F.col("_rows"))).alias("missing_pct"))
             for c in df.columns]
    parts.append(F.struct(F.lit("").alias("column"), total.cast("long").alias("missing"),
                          F.lit(None).cast("double").alias("missing_pct")))
    return wide.select(F.inline(F.array(*parts)))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def numeric_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, mean, std, min, exact quartiles and max per numeric column."""
    columns = list(columns or numeric_columns(df))
    df = normalise_missing(df.select([F.col(c).cast("double").alias(c) for c in columns]))
    long = df.unpivot([], columns, "column", "value")
    basic = long.groupBy("column").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"))
    quartiles = exact_quantiles(long, ["column"], "value",
                                {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return basic.join(quartiles, "column", "left").select(
        "column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def categorical_summary(df: DataFrame, columns: Sequence[str] | None = None,
                        top: int = 10) -> DataFrame:
    """Distinct non-null values and the ``top`` most frequent ones per text column.

    The limit is applied before the shuffle to the ranking window, so a column
    of unique values still sends only ``top`` rows per task.
    """
    columns = list(columns or [f.name for f in df.schema.fields
                               if isinstance(f.dataType, T.StringType)])
    long = df.select(columns).unpivot([], columns, "column", "value")
    counts = (long.where(F.col("value").isNotNull()).groupBy("column", "value")
              .agg(F.count("*").alias("n")))
    w = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    best = (counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top))
    distinct = counts.groupBy("column").agg(F.count("*").alias("unique_values"))
    return best.join(distinct, "column").select(
        "column", "unique_values", "rank", "value", "n")


def target_distribution(df: DataFrame, label: str) -> DataFrame:
    return (normalise_missing(df.select(label)).where(F.col(label).isNotNull())
            .groupBy(label).agg(F.count("*").alias("n")))


def feature_columns(df: DataFrame, configured: Sequence[str] | None = None,
                    label: str | None = None, id_col: str | None = None) -> list[str]:
    """Configured columns that exist, else all numeric ones but label and id."""
    if configured is not None:
        return [c for c in configured if c in df.columns]
    return [c for c in numeric_columns(df) if c not in (label, id_col)]


def select_features(df: DataFrame, id_col: str, label: str | None = None,
                    configured: Sequence[str] | None = None) -> DataFrame:
    keep = feature_columns(df, configured, label, id_col)
    return df.select(id_col, *keep, *([label] if label else []))


def train_test_split(df: DataFrame, id_col: str, label: str | None = None,
                     test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``split``: the first round(n * test_size) rows per class are 'test'."""
    keyed = df.withColumn("_class", F.col(label) if label else F.lit(0))
    sizes = keyed.groupBy(F.col("_class").alias("_of")).agg(
        F.round(F.count("*") * F.lit(float(test_size))).cast("long").alias("_n_test"))
    numbered = shuffled_row_number(keyed, ["_class"], id_col, seed, "_row")
    return numbered.join(sizes, F.col("_class").eqNullSafe(F.col("_of"))).select(
        *df.columns,
        F.when(F.col("_row") <= F.col("_n_test"), "test").otherwise("train").alias("split"))


def weighted_score(weights: dict[str, float]) -> Column:
    parts = [F.col(c) * F.lit(float(w)) for c, w in weights.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def cut(value: str | Column, bins: Sequence[float], labels: Sequence[str]) -> Column:
    """Bins are open on the left and closed on the right; outside is NULL."""
    if len(labels) != len(bins) - 1:
        raise ValueError("one label per bin")
    value = F.col(value) if isinstance(value, str) else value
    out = F
    for lo, hi, name in zip(bins, bins[1:], labels):
        out = out.when((value > F.lit(float(lo))) & (value <= F.lit(float(hi))), name)
    return out


def engineer(df: DataFrame, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Hook for a user's own feature step."""
    return df.transform(fn)


def composite_label(conditions: Sequence[Column], steps: Sequence[int] = (2,)) -> Column:
    """Number of the last step reached by the count of true conditions.

    ``steps=(2,)`` gives 0/1, ``steps=(2, 4)`` gives 0/1/2.
    """
    n = F.lit(0)
    for c in conditions:
        n = n + F.coalesce(c.cast("int"), F.lit(0))
    out = F.lit(0)
    for s in steps:
        out = out + (n >= s).cast("int")
    return out
