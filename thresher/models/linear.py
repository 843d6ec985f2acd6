"""Linear models, support vector machines and the multi-layer perceptron."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.ml.classification import (LinearSVC, LogisticRegression,
                                       MultilayerPerceptronClassifier)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from thresher.models.base import (Context, Fitted, Model, WEIGHT, binary_context, in_parallel,
                                  merge_rows, normalised, one_hot, argmax_class, settled, weighted)
from thresher.models.kernels import KernelMap
from thresher.models.linear_grid import LinearSpec, decision
from thresher.models.newton import (Problem, Solution, dealt, linear_scores, margins_of, minimise,
                                    parts_of)
from thresher.operators.folds import stratified_folds
from thresher.session import cut_lineage

# (train with 0/1 label and weight, context) -> (rows -> (rows with the new column, column))
Scorer = Callable[[DataFrame, str], DataFrame]


def each_class(train: DataFrame, ctx: Context,
               fit_one: Callable[[DataFrame, Context], Scorer]) -> list[Scorer]:
    """One scorer for class 1 of two classes, else one per class against the rest."""
    def job(c: int):
        rows = train.withColumn("label", (F.col("label") == c).cast("double"))
        return lambda: fit_one(rows, binary_context(ctx, c))
    wanted = ctx.classes[1:] if ctx.k == 2 else ctx.classes
    return in_parallel([job(c) for c in wanted], ctx.parallelism)


class FittedScores(Fitted):
    """Scores per class; ``probabilities`` says whether they lie in [0, 1]."""

    def __init__(self, scorers: list[Scorer], classes: Sequence[int], probabilities: bool):
        self.scorers, self.classes, self.probabilities = scorers, classes, probabilities

    def columns(self, df: DataFrame):
        names = []
        for i, score in enumerate(self.scorers):
            names.append(f"_score{i}")
            df = score(df, names[-1])
        cols = [F.col(n) for n in names]
        if len(self.classes) == 2:
            s = cols[0]
            decide = F.array(1 - s, s) if self.probabilities else F.array(-s, s)
        else:
            s, decide = None, F.array(*cols)
        if self.probabilities:
            proba = decide if s is not None else normalised(decide)
        else:
            proba = one_hot(argmax_class(decide, self.classes), self.classes)
        return df, proba, s, decide


def _probability_of_one(model, features: str = "features") -> Scorer:
    def score(df: DataFrame, out: str) -> DataFrame:
        scored = model.transform(df.select("*")).withColumn(
            out, vector_to_array("probability")[1])
        return scored.drop("rawPrediction", "probability", "prediction")
    return score


def _margin(model) -> Scorer:
    def score(df: DataFrame, out: str) -> DataFrame:
        return model.transform(df).withColumn(
            out, vector_to_array("rawPrediction")[1]).drop("rawPrediction", "prediction")
    return score


class Logistic(Model):
    """L2 logistic regression with inverse strength C; one against the rest beyond two classes."""
    mergeable = True

    def __init__(self, C: float = 1.0, max_iter: int = 1000, balanced: bool = False,
                 input: str = "bow"):
        self.C, self.max_iter, self.balanced, self.input = C, max_iter, balanced, input

    def fit(self, train, ctx):
        def one(rows, c):
            est = LogisticRegression(regParam=1.0 / (self.C * c.n), elasticNetParam=0.0,
                                     standardization=False, maxIter=self.max_iter, tol=1e-4,
                                     weightCol=WEIGHT)
            return _probability_of_one(est.fit(rows))
        return FittedScores(each_class(weighted(train, ctx, self.balanced), ctx, one),
                            ctx.classes, True)

    def spec(self) -> LinearSpec:
        return LinearSpec("logistic", 1.0 / self.C, balanced=self.balanced, probabilities=True)


class Ridge(Model):
    """Least squares on -1/+1 targets."""
    mergeable = True

    def fit(self, train, ctx):
        def one(rows, c):
            rows = rows.withColumn("_target", F.col("label") * 2 - 1)
            # Spark divides the penalty by the deviation of the target; here it must be 1
            share = c.class_counts[1] / c.n
            deviation = 2.0 * (share * (1.0 - share)) ** 0.5
            model = LinearRegression(labelCol="_target", regParam=deviation / c.n, elasticNetParam=0.0,
                                     standardization=False, weightCol=WEIGHT).fit(rows)
            return lambda df, out: model.transform(df).withColumnRenamed("prediction", out)
        return FittedScores(each_class(weighted(train, ctx), ctx, one), ctx.classes, False)

    def spec(self) -> LinearSpec:
        return LinearSpec("squares", 1.0)


def _svc(reg: float, max_iter: int, tol: float) -> LinearSVC:
    return LinearSVC(regParam=reg, maxIter=max_iter, tol=tol, standardization=False,
                     weightCol=WEIGHT)


class HingeLinear(Model):
    """Linear classifier under hinge loss, by regularisation ``alpha`` or by ``C``.

    An iteration is a pass over all rows; it ends when the objective changes by less than
    ``tol``, after ``max_iter`` at the latest.
    """
    mergeable = True

    def __init__(self, alpha: float | None = None, C: float = 1.0, max_iter: int = 2000,
                 tol: float = 1e-6):
        self.alpha, self.C, self.max_iter, self.tol = alpha, C, max_iter, tol

    def fit(self, train, ctx):
        def one(rows, c):
            reg = self.alpha if self.alpha is not None else 1.0 / (self.C * c.n)
            return _margin(_svc(reg, self.max_iter, self.tol).fit(rows))
        return FittedScores(each_class(weighted(train, ctx), ctx, one), ctx.classes, False)


class SquaredHinge(Model):
    """Linear classifier under squared hinge loss; the intercept is penalised like a weight.

    All classes are fitted against the rest together, by Newton steps until the gradient is
    ``tol`` of that at zero.
    """
    mergeable = True

    def __init__(self, C: float = 1.0, tol: float = 1e-8, input: str = "bow"):
        self.C, self.tol, self.input = C, tol, input

    def spec(self) -> LinearSpec:
        return LinearSpec("squared_hinge", 1.0 / self.C, 1.0 / self.C)

    def fit(self, train, ctx):
        rows = _engine_rows(weighted(train, ctx), ctx, "features").persist()
        problems = [Problem("squared_hinge", 1.0 / self.C, 1.0 / self.C, positive=c) for c in _against(ctx)]
        found = minimise(rows, problems, [max(1, ctx.n_features)], tol=self.tol)
        rows.unpersist()
        return FittedMargins(found, ctx.classes)


def _against(ctx: Context) -> list[int]:
    """The places of the classes that get a problem of their own."""
    return [1] if ctx.k == 2 else list(range(ctx.k))


def _class_place(ctx: Context, label: str = "label") -> Column:
    return F.array_position(F.array(*[F.lit(int(c)) for c in ctx.classes]), F.col(label).cast("int")).cast("int") - 1


def _engine_rows(rows: DataFrame, ctx: Context, features: str, fold: Column | None = None) -> DataFrame:
    """Training rows of one cell as ``minimise`` takes them."""
    index, values = parts_of(features)
    return dealt(rows.select(
        F.lit(0).alias("cell"), (F.lit(0) if fold is None else fold).cast("int").alias("fold"),
        _class_place(ctx).alias("label"), F.col(WEIGHT).cast("double").alias("weight"),
        index.alias("index"), values.alias("values")), ctx.held)


class FittedMargins(Fitted):
    """Scores against the rest from the coefficients of ``minimise``; no probabilities."""

    def __init__(self, found: Solution, classes: Sequence[int]):
        self.found, self.classes = found, classes

    def columns(self, df: DataFrame):
        scored = df.withColumn("_scores", linear_scores(self.found.weights, self.found.intercepts[:, 0]))
        proba, score, decide = decision(F.col("_scores"), self.classes, False)
        return scored, proba, score, decide


NARROW = 64                 # columns that are as good as coordinates
FEW = 1000                  # rows that need fewer coordinates than wide rows have columns


class SupportVector(Model):
    """Support vector machine with probabilities: a logistic curve on out-of-fold margins.

    All classes and calibration folds are problems of one fit, which ends when the gap between
    the primal and the dual objective is ``gap`` of the primal. The linear kernel of more than
    FEW rows, or of at most NARROW columns, is fitted on the columns themselves. Others run in the coordinates of a Nystroem approximation, whose rank
    grows until what it leaves of the rows' kernel values is at most ``error`` of them; the gap is
    that of the approximated kernel.
    """

    def __init__(self, kernel: str = "linear", C: float = 1.0, balanced: bool = False,
                 error: float = 1e-3, gap: float = 1e-3, input: str = "bow",
                 calibration_folds: int = 5):
        if kernel not in ("linear", "rbf"):
            raise ValueError(f"unknown kernel: {kernel}")
        self.kernel, self.C, self.balanced, self.input = kernel, C, balanced, input
        self.error, self.gap, self.calibration_folds = error, gap, calibration_folds

    def fit(self, train, ctx):
        rows = weighted(train, ctx, self.balanced)
        folded = settled(stratified_folds(rows, "id", "label", self.calibration_folds, ctx.seed), ctx.n)
        place, k = _against(ctx), self.calibration_folds
        problems = [Problem("hinge", 1.0 / self.C, fold=f, positive=c) for c in place for f in (*range(k), -1)]
        if ctx.n_features <= NARROW and "text" in folded.columns:      # few rows differ
            folded = cut_lineage(merge_rows(folded, "fold")).persist()
            ctx = replace(ctx, rows=folded.count())
        engine = _engine_rows(folded, ctx, "features", F.col("fold")).persist()
        kernel = None
        if self.kernel == "rbf" or (ctx.n_features > NARROW and ctx.n <= FEW):
            gamma = _scale_gamma(train, ctx) if self.kernel == "rbf" else None
            kernel = KernelMap.fit(engine, ctx.n_features, gamma, self.error, ctx.seed)
            coded = kernel.transform(engine).persist()
            found = minimise(coded, problems, [kernel.rank], dense=True, gap=self.gap)
        else:
            coded = engine
            found = minimise(coded, problems, [max(1, ctx.n_features)], gap=self.gap)
        curves = self._calibrated(coded, found, place, dense=kernel is not None)
        coded.unpersist()
        engine.unpersist()
        whole = slice(k, None, k + 1)       # the problems of all rows
        return FittedSupport(found, found.weights[whole], found.intercepts[whole, 0], curves, kernel, ctx.classes)

    def _calibrated(self, coded: DataFrame, found: Solution, place: Sequence[int], dense: bool) -> Solution:
        """Per class, the logistic curve of out-of-fold margins, on Platt's smoothed targets."""
        k, columns = self.calibration_folds, found.weights.shape[1]
        index = F.sequence(F.lit(0), F.lit(columns - 1)) if dense else F.col("index")
        own = margins_of(found.weights, found.intercepts[:, 0], index, F.col("values"))
        usable = F.array(*[F.lit(not found.dead[c * (k + 1) + f, 0]) for c in range(len(place)) for f in range(k)])
        per_class = F.transform(F.array(*[F.lit(c) for c in range(len(place))]), lambda c: F.struct(
            c.alias("cell"), F.get("_own", c * (k + 1) + F.col("fold")).alias("margin"),
            F.get(usable, c * k + F.col("fold")).alias("usable"),
            (F.get(F.array(*[F.lit(p) for p in place]), c) == F.col("label")).alias("hit")))
        rows = (coded.withColumn("_own", own).select("weight", F.inline(per_class)).where("usable")
                .drop("usable").persist())
        counts = {(r["cell"], r["hit"]): (r["n"], r["rows"]) for r in rows.groupBy("cell", "hit").agg(
            F.sum("weight").alias("n"), F.count("*").alias("rows")).collect()}
        total = [[counts.get((c, h), (0.0, 0))[0] for h in (False, True)] for c in range(len(place))]
        target = F.lit(0.5)
        for c, (no, yes) in enumerate(total):
            target = F.when(F.col("cell") == c, F.when(F.col("hit"), (yes + 1) / (yes + 2))
                            .otherwise(1 / (no + 2))).otherwise(target)
        both = F.array(F.struct(F.lit(1).alias("label"), (F.col("weight") * target).alias("weight")),
                       F.struct(F.lit(0).alias("label"), (F.col("weight") * (1 - target)).alias("weight")))
        soft = rows.select(F.col("cell"), F.lit(0).alias("fold"), F.array("cell").alias("index"),
                           F.array("margin").alias("values"), F.inline(both))
        soft = dealt(soft, 2 * sum(n for _, n in counts.values())).persist()
        curves = minimise(soft, [Problem("logistic", 1e-9, 1e-9)], [1] * len(place))
        soft.unpersist()
        rows.unpersist()
        return curves


class FittedSupport(Fitted):
    def __init__(self, found: Solution, weights, intercepts, curves: Solution, kernel, classes):
        self.found, self.weights, self.intercepts = found, weights, intercepts
        self.curves, self.kernel, self.classes = curves, kernel, classes

    def columns(self, df):
        index, values = parts_of("features")
        if self.kernel is None or self.kernel.gamma is None:
            weights = self.weights if self.kernel is None else self.kernel.linear_weights(self.weights)
            margins = margins_of(weights, self.intercepts, index, values)
        else:
            margins = self.kernel.margins(self.weights, self.intercepts, index, values)
        scored = df.withColumn("_margins", margins)
        curved = F.array(*[F.get("_margins", F.lit(i)) * F.lit(float(a)) + F.lit(float(b)) for i, (a, b) in enumerate(
            zip(self.curves.weights[0], self.curves.intercepts[0]))])
        proba, score, decide = decision(curved, self.classes, True)
        return scored, proba, score, decide


def _scale_gamma(train: DataFrame, ctx: Context) -> float:
    """1 / (features x variance of all entries), from column sums."""
    row = train.agg(F.count("*").alias("n"), Summarizer.mean(F.col("features")).alias("m"),
                    Summarizer.normL2(F.col("features")).alias("l2")).first()
    d = len(row["m"])
    mean = float(row["m"].toArray().mean())
    square = float((row["l2"].toArray() ** 2).sum()) / (row["n"] * d)
    variance = square - mean * mean
    return 1.0 / (d * variance) if variance > 0 else 1.0


class Perceptron(Model):
    def __init__(self, hidden: Sequence[int] = (100,), max_iter: int = 500,
                 solver: str = "l-bfgs"):
        self.hidden, self.max_iter, self.solver = tuple(hidden), max_iter, solver

    def fit(self, train, ctx):
        index = F
        for i, c in enumerate(ctx.classes):
            index = index.when(F.col("label") == c, F.lit(float(i)))
        est = MultilayerPerceptronClassifier(
            layers=[ctx.n_features, *self.hidden, ctx.k], maxIter=self.max_iter,
            solver=self.solver, seed=ctx.seed)
        return FittedProbabilities(est.fit(train.withColumn("label", index)), ctx.classes)


class FittedProbabilities(Fitted):
    """A Spark ML model whose probability vector is in class order."""

    def __init__(self, model, classes):
        self.model, self.classes = model, classes

    def columns(self, df):
        return self.model.transform(df), vector_to_array("probability"), None, None
