"""What every model shares: context, fitted form, one-vs-rest, class weights."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MAX_CLASSES = 1000
WEIGHT = "weight"


class DegenerateTraining(ValueError):
    """The training rows hold fewer than two classes."""


@dataclass(frozen=True)
class Context:
    """Facts about one training set. ``n`` counts rows by weight."""
    n: float
    classes: tuple[int, ...]
    n_features: int = 0
    class_counts: tuple[float, ...] = ()
    seed: int = 42
    parallelism: int = 4
    rows: int = 0           # of a training set whose equal rows are merged

    @property
    def held(self) -> int:
        """Rows that are there, by which partitions are counted."""
        return self.rows or int(self.n)

    @property
    def k(self) -> int:
        return len(self.classes)


def class_list(df: DataFrame, label: str = "label") -> tuple[int, ...]:
    rows = df.select(label).distinct().limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    return tuple(sorted(int(r[0]) for r in rows))


def describe(train: DataFrame, n_features: int = 0, seed: int = 42,
             parallelism: int = 4) -> Context:
    """Row count and class counts of a training set in one small aggregate."""
    weight = F.sum(WEIGHT) if WEIGHT in train.columns else F.count("*").cast("double")
    rows = (train.groupBy("label").agg(weight.alias("n")).orderBy("label")
            .limit(MAX_CLASSES + 1).collect())
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    if len(rows) < 2:
        raise DegenerateTraining("fewer than two classes")
    return Context(sum(r["n"] for r in rows), tuple(int(r["label"]) for r in rows),
                   n_features, tuple(r["n"] for r in rows), seed, parallelism)


def in_parallel(tasks: Sequence[Callable[[], object]], parallelism: int = 4) -> list:
    """Runs independent fits from a few driver threads; the work itself is Spark jobs."""
    if len(tasks) == 1 or parallelism <= 1:
        return [t() for t in tasks]
    inherit = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(min(parallelism, len(tasks))) as pool:
        return [f.result() for f in [pool.submit(inherit(t)) for t in tasks]]


def argmax_class(scores: Column, classes: Sequence[int]) -> Column:
    """The class of the largest entry, the smallest class on a tie."""
    at = F.array_position(scores, F.array_max(scores)).cast("int")
    return F.element_at(F.array(*[F.lit(int(c)) for c in classes]), at).cast("int")


def one_hot(pred: Column, classes: Sequence[int]) -> Column:
    return F.array(*[(pred == F.lit(int(c))).cast("double") for c in classes])


def normalised(scores: Column) -> Column:
    """Non-negative scores divided by their sum."""
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)
    return F.transform(scores, lambda x: F.coalesce(F.try_divide(x, total), F.lit(0.0)))


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    return normalised(F.transform(scores, lambda x: F.exp(x - top)))


def as_predictions(df: DataFrame, keep: Sequence[str], proba: Column, classes: Sequence[int],
                   score: Column | None = None, decide: Column | None = None) -> DataFrame:
    """(id, keep..., pred, proba, score). ``score`` ranks class 1 and is NULL beyond two classes."""
    src = df.withColumn("_proba", proba)
    src = src.withColumn("_decide", decide if decide is not None else F.col("_proba"))
    if len(classes) != 2:
        score = F.lit(None).cast("double")
    elif score is None:
        score = F.col("_proba")[1]
    return src.select("id", *keep, argmax_class(F.col("_decide"), classes).alias("pred"),
                      F.col("_proba").alias("proba"), score.cast("double").alias("score"))


class Fitted:
    """A trained model. ``narrow`` ones score a row without a shuffle."""
    narrow = True
    classes: Sequence[int] = ()

    def columns(self, df: DataFrame) -> tuple[DataFrame, Column, Column | None, Column | None]:
        """Narrow models: (rows, probabilities, score, what the decision is taken on)."""
        raise NotImplementedError

    def predict(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """(id, keep..., pred, proba, score) for every row of ``df``."""
        rows, proba, score, decide = self.columns(df)
        return as_predictions(rows, keep, proba, self.classes, score, decide)

    def with_probabilities(self, df: DataFrame, out: str) -> DataFrame:
        rows, proba, _, _ = self.columns(df)
        return rows.withColumn(out, proba).select(*df.columns, out)


ROWS_PER_PARTITION = 20_000


def settled(train: DataFrame, n: float) -> DataFrame:
    """The same ``n`` rows in the same partitions and order, however they arrived.

    Spark ML draws its samples by partition and row. Dealt by a hash of the id into partitions
    of a fixed number of rows, and sorted, they depend on the rows only. The shuffle leaves the
    work that made the rows as parallel as it was.
    """
    parts = max(1, -(-int(n) // ROWS_PER_PARTITION))
    return train.repartition(parts, "id").sortWithinPartitions("id")


def merge_rows(train: DataFrame, *keys: str) -> DataFrame:
    """Distinct (text, label, keys) rows with their weight: R rules give at most 2^R texts.

    ``features``, if there, belong to the text."""
    weight = F.sum(WEIGHT) if WEIGHT in train.columns else F.count("*").cast("double")
    features = [F.first("features").alias("features")] if "features" in train.columns else []
    return train.groupBy("text", "label", *keys).agg(weight.alias(WEIGHT), F.min("id").alias("id"), *features)


def fit_merged(model: "Model", train: DataFrame, ctx: Context) -> "Fitted":
    """The fit of ``model`` on ``train``; equal rows are merged for a model that allows it."""
    if not (model.mergeable and "text" in train.columns):
        return model.fit(train, ctx)
    merged = merge_rows(train).persist()
    n = merged.count()
    rows = settled(merged, n).persist()
    try:
        return model.fit(rows, replace(ctx, rows=n))
    finally:
        rows.unpersist()
        merged.unpersist()


class Model:
    """A model before training. ``input`` is 'bow', 'text' or 'embedding'.

    A ``mergeable`` model gives the same fit on distinct (text, label) rows with
    a weight column as on the rows themselves.
    """
    input = "bow"
    mergeable = False

    def fit(self, train: DataFrame, ctx: Context) -> Fitted:
        raise NotImplementedError


def weighted(train: DataFrame, ctx: Context, balanced: bool = False) -> DataFrame:
    """A weight column, multiplied by n / (k * n_c) for balanced classes."""
    df = train if WEIGHT in train.columns else train.withColumn(WEIGHT, F.lit(1.0))
    if not balanced:
        return df
    factor = F
    for c, n in zip(ctx.classes, ctx.class_counts):
        factor = factor.when(F.col("label") == c, F.lit(ctx.n / (ctx.k * n)))
    return df.withColumn(WEIGHT, F.col(WEIGHT) * factor)


def binary_context(ctx: Context, c: int) -> Context:
    n1 = dict(zip(ctx.classes, ctx.class_counts))[c]
    return replace(ctx, classes=(0, 1), class_counts=(ctx.n - n1, n1))
