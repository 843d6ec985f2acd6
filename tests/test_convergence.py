"""Fits end by their tolerance, at the optimum, however rows are dealt out."""

import uuid

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import Window, functions as F

from thresher.evaluation import evaluate as E
from thresher.models import registry
from thresher.models.base import describe
from thresher.models.ensemble import AT_ONCE, Stacking
from thresher.models.kernels import KernelMap
from thresher.models.linear import HingeLinear, SquaredHinge, SupportVector, _engine_rows, _svc
from thresher.models.base import weighted
from thresher.models.linear_grid import LinearSpec, cross_validated_linear
from thresher.models.newton import LOSSES, Layout, Problem, _packed, minimise
from thresher.models.trees import Tree
from thresher.operators.folds import stratified_folds


def test_hinge_fits_converge(spark):
    model = HingeLinear()
    rng = np.random.default_rng(0)
    x = (rng.random((200, 40)) < 0.1) * rng.integers(1, 4, (200, 40))
    y = x @ rng.normal(size=40) + 1.5 * rng.normal(size=200) > 0
    rows = spark.createDataFrame([(Vectors.dense(a), float(b), 1.0) for a, b in zip(x, y)],
                                 ["features", "label", "weight"]).repartition(1).cache()
    fitted = _svc(1.0 / 200, model.max_iter, model.tol).fit(rows)
    assert fitted.summary().totalIterations < model.max_iter


def points(n=90, d=4, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    return x, (x @ np.arange(1, d + 1) + 2 * rng.normal(size=n) > 0).astype(int)


def frame(spark, x, y):
    return spark.createDataFrame([(i, int(b), Vectors.dense(a)) for i, (a, b) in enumerate(zip(x, y))],
                                 ["id", "label", "features"])


def gradient(loss, w, b, x, t, penalty, own):
    """Of the whole objective at (w, b), written out row by row."""
    gw, gb = penalty * w, own * b
    for a, y in zip(x, t):
        f = a @ w + b
        s = {"logistic": -y / (1 + np.exp(y * f)), "squared_hinge": -2 * y * max(0, 1 - y * f), "squares": f - y}[loss]
        gw, gb = gw + s * a, gb + s
    return np.append(gw, gb)


@pytest.mark.parametrize("parts", [1, 3])
def test_gradients_vanish(spark, parts):
    x, y = points()
    df = frame(spark, x, y)
    rows = _engine_rows(weighted(df, describe(df, 4)), describe(df, 4), "features",
                        F.col("id") % 3).repartition(parts).persist()
    problems = [Problem(loss, 0.5, own, fold) for loss, own in (("logistic", 0.0), ("squared_hinge", 0.5), ("squares", 0.0))
                for fold in (-1, 2)]
    found = minimise(rows, problems, [4])
    for q, p in enumerate(problems):
        keep = np.arange(90) % 3 != p.fold
        g = gradient(p.loss, found.weights[q], found.intercepts[q, 0], x[keep], 2.0 * y[keep] - 1, 0.5, p.intercept_penalty)
        at_zero = gradient(p.loss, np.zeros(4), 0.0, x[keep], 2.0 * y[keep] - 1, 0.5, p.intercept_penalty)
        assert np.linalg.norm(g) < 1e-7 * np.linalg.norm(at_zero)
    assert (found.gradient <= 1e-8).all()


def test_wide_problems_by_products_only(spark, monkeypatch):
    """Products with directions lead to the same optimum as whole Hessians."""
    x, y = points()
    df = frame(spark, x, y)
    rows = _engine_rows(weighted(df, describe(df, 4)), describe(df, 4), "features").persist()
    problems = [Problem(loss, 0.5, 0.1) for loss in LOSSES if loss != "hinge"]
    whole = minimise(rows, problems, [4])
    monkeypatch.setattr("thresher.models.newton.WHOLE", 0)
    by_steps = minimise(rows, problems, [4])
    assert np.abs(whole.weights - by_steps.weights).max() < 1e-6 and by_steps.passes > whole.passes


@pytest.mark.parametrize("kernel", ["linear", "rbf"])
def test_support_vectors_have_a_small_gap(spark, kernel):
    x, y = points()
    df = frame(spark, x, y)
    fitted = SupportVector(kernel, C=2.0).fit(df, describe(df, 4))
    assert (fitted.found.gap < 1e-3 * fitted.found.objective).all()
    rows = fitted.predict(df, ["label"]).collect()
    assert sum(r["pred"] == r["label"] for r in rows) > 70
    assert all(abs(sum(r["proba"]) - 1) < 1e-9 for r in rows)
    # the primal value by hand: no point near it is better
    if kernel == "linear":
        t, w, b = 2.0 * y - 1, fitted.weights[0], fitted.intercepts[0]
        value = lambda w, b: np.maximum(0, 1 - t * (x @ w + b)).sum() + w @ w / 4
        best = value(w, b)
        rng = np.random.default_rng(0)
        assert all(value(w + 0.05 * rng.normal(size=4), b + 0.05 * rng.normal()) > best * (1 - 1e-3) for _ in range(300))


def test_wide_linear_machines_need_no_coordinates(spark):
    """Fitted on the columns, however many: no rank that grows with the rows."""
    rng = np.random.default_rng(2)
    x = (rng.random((1100, 100)) < 0.1).astype(float)
    y = (x[:, :5].sum(1) > 0).astype(int)
    df = frame(spark, x, y)
    fitted = SupportVector("linear").fit(df, describe(df, 100))
    assert fitted.kernel is None and (fitted.found.gap < 1e-3 * fitted.found.objective).all()


def test_passes_read_packed_rows(spark):
    """A pass reads bytes of many rows at a time, in several tasks also for few rows."""
    x, y = points(n=9000, d=3)
    df = frame(spark, x, y)
    rows = _engine_rows(weighted(df, describe(df, 3)), describe(df, 3), "features")
    assert rows.rdd.getNumPartitions() == 3
    packed = _packed(rows, Layout([Problem("logistic")], [3])).collect()
    assert len(packed) <= 6 and sum(r["rows"] for r in packed) == 9000
    values = np.concatenate([np.frombuffer(r["values"]) for r in packed])
    assert np.allclose(np.sort(values), np.sort(x.ravel()))


def test_kernel_rank_follows_the_error(spark):
    x, y = points(n=100, d=3)
    df = frame(spark, x, y)
    rows = _engine_rows(weighted(df, describe(df, 3)), describe(df, 3), "features").persist()
    coarse, fine = (KernelMap.fit(rows, 3, 0.2, error=e, block=8) for e in (0.05, 1e-4))
    assert coarse.residual <= 0.05 and fine.residual <= 1e-4 and coarse.rank < fine.rank <= 100
    z = np.array([r["values"] for r in fine.transform(rows).collect()])
    kernel = np.exp(-0.2 * ((x[:, None] - x[None]) ** 2).sum(2))
    # rows come back in another order: compare the sorted spectra of both Gram matrices' diagonals and sums
    assert abs((z ** 2).sum() - 100) < 0.02
    assert abs(np.sort((z @ z.sum(0))) - np.sort(kernel.sum(0))).max() < 0.1


@pytest.fixture(scope="module")
def texts(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(160):
        label = i % 3 % 2
        words = rng.choice([f"t{j}" for j in range(25)], 8).tolist()
        words[rng.integers(0, 8)] = "mark" if label and i % 7 else "other"
        rows.append((i, " ".join(words), label))
    return spark.createDataFrame(rows, "id long, text string, label int").persist()


def test_grid_equals_separate_fits(spark, texts):
    """All folds and cells in one fit against one fit per fold by another solver."""
    folded = stratified_folds(texts, "id", "label").persist()
    both = folded.withColumn("cut", F.lit("a")).unionByName(
        folded.withColumn("cut", F.lit("b")).withColumn("text", F.substring("text", 1, 12)))
    models = {"LogisticRegression": LinearSpec("logistic", 1.0, probabilities=True),
              "balanced": LinearSpec("logistic", 1.0, balanced=True, probabilities=True),
              "RidgeClassifier": LinearSpec("squares")}
    together = cross_validated_linear(both, models, 5, ["cut"])
    found = {(r["cut"], r["model"], r["id"]): r for r in together.collect()}
    assert len(found) == 2 * 3 * 160
    for cut in ("a", "b"):
        rows = both.where(F.col("cut") == cut)
        for f in (0, 3):
            train = rows.where(F.col("fold") != f)
            bag = E.BagOfWords().fit(train)
            test = bag.transform(rows.where(F.col("fold") == f))
            for name, model, near in (("LogisticRegression", registry.Logistic(), 2e-3),
                                      ("balanced", registry.Logistic(balanced=True), 2e-3),
                                      ("RidgeClassifier", registry.Ridge(), 1e-4)):
                own = E.fit_model(model, train, bag, describe(train, len(bag.terms))).predict(test)
                for r in own.collect():
                    assert abs(r["score"] - found[cut, name, r["id"]]["score"]) < near
                    assert r["pred"] == found[cut, name, r["id"]]["pred"] or abs(r["score"] - 0.5) < near


def test_jobs_do_not_grow_with_cells(spark, texts):
    model = {"LogisticRegression": registry.Logistic()}

    def jobs(sizes, group):
        spark.sparkContext.setJobGroup(group, group)
        E.evaluate_extractions(texts, model, sizes, baseline=False, k=3).count()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    few, many = jobs({"word": (1, 2)}, "few"), jobs({"word": (1, 2, 3, 4, 5, 6)}, "many")
    spark.sparkContext.setJobGroup("rest", "rest")
    assert many < 1.5 * few


def test_three_classes_and_a_missing_one(spark, texts):
    three = texts.withColumn("label", (F.col("id") % 3).cast("int")).withColumn(
        "text", F.concat(F.lit("class"), F.col("label").cast("string")))
    folded = stratified_folds(three, "id", "label")
    # class 2 only stands in fold 0, whose training rows lack it
    folded = folded.withColumn("fold", F.when(F.col("label") == 2, 0).otherwise(F.col("fold")))
    rows = cross_validated_linear(folded, {"m": LinearSpec("squared_hinge", 1.0, 1.0),
                                           "p": LinearSpec("logistic", probabilities=True)}).collect()
    assert len(rows) == 320 and all(r["score"] is None for r in rows)
    assert all((r["pred"] == r["label"]) == (r["label"] != 2) for r in rows)


def test_squared_hinge_model(spark):
    x, y = points()
    df = frame(spark, x, y + (x[:, 0] > 1))
    fitted = SquaredHinge(C=0.7).fit(df, describe(df, 4))
    assert fitted.predict(df, ["label"]).where("pred = label").count() > 60


def jobs_of(spark, run):
    """What ``run`` returns and how many jobs it took."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    try:
        found = run()
        return found, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def cells(spark, n=60):
    """Rows of two cells of 3 and 2 columns, in three folds; cell 1 lacks a row in each ten."""
    rng = np.random.default_rng(4)
    rows = []
    for c, (start, width) in enumerate(((0, 3), (3, 2))):
        for i in range(n):
            x = rng.normal(size=width)
            if c == 0 or i % 10:
                rows.append((c, i % 3, int(x.sum() + rng.normal() > 0), 1.0 + i % 2, list(range(start, start + width)), x.tolist()))
    return spark.createDataFrame(rows, "cell int, fold int, label int, weight double, index array<int>, values array<double>")


def test_steps_of_held_rows_need_no_jobs(spark, monkeypatch):
    """Rows that a task can hold are fitted in a few jobs, at the same point as with a job per step."""
    rows = cells(spark).persist()
    problems = [Problem(loss, 0.5, 0.1, fold) for loss in ("logistic", "squared_hinge", "squares") for fold in (0, 1, -1)]
    mask = np.ones((len(problems), 5))
    mask[2, 1] = 0
    weights = np.random.default_rng(5).uniform(0.5, 2, (len(problems), 2, 2))

    def fit():
        return minimise(rows, problems, [3, 2], mask, weights)
    held, few = jobs_of(spark, fit)
    monkeypatch.setattr("thresher.models.newton.SHARED", 0)     # a task for each problem
    alone = fit()
    monkeypatch.setattr("thresher.models.newton.HELD", 0)
    by_passes, many = jobs_of(spark, fit)
    assert few <= 6 < many and held.passes > 6
    for other in (alone, by_passes):
        assert np.abs(held.weights - other.weights).max() < 1e-6 and np.abs(held.intercepts - other.intercepts).max() < 1e-6
        assert np.allclose(held.objective, other.objective) and (held.dead == other.dead).all()


@pytest.mark.parametrize("own", [0.0, 0.5])
def test_dual_ascent_certifies_hinge_problems(spark, monkeypatch, own):
    """Wide hinge problems of held rows end by their gap, in a few jobs; rows of no column and of a weight count."""
    rng = np.random.default_rng(6)
    x = (rng.random((240, 60)) < 0.15) * rng.integers(1, 3, (240, 60))
    x[:7] = 0
    y = (x[:, :8].sum(1) + rng.normal(size=240) > 2.5).astype(int)
    weight = rng.integers(1, 4, 240)
    rows = spark.createDataFrame(
        [(0, i % 3, int(b), float(w), np.flatnonzero(a).tolist(), a[a > 0].astype(float).tolist())
         for i, (a, b, w) in enumerate(zip(x, y, weight))],
        "cell int, fold int, label int, weight double, index array<int>, values array<double>").persist()
    monkeypatch.setattr("thresher.models.newton.WHOLE", 0)
    mask = np.ones((2, 60))
    mask[1, :4] = 0
    problems = [Problem("hinge", 0.5, own), Problem("hinge", 2.0, own, fold=1)]
    found, jobs = jobs_of(spark, lambda: minimise(rows, problems, [60], mask))
    again = minimise(rows.repartition(5), problems, [60], mask)
    assert jobs <= 6 and (found.weights == again.weights).all()         # however rows are dealt out
    assert (found.gap <= 1e-3 * found.objective).all() and (found.weights[1, :4] == 0).all()
    for q, p in enumerate(problems):
        used = np.arange(240) % 3 != p.fold
        a, t, c = x[used], 2.0 * y[used] - 1, weight[used]

        def value(w, b):
            return (c * np.maximum(0, 1 - t * (a @ w + b))).sum() + p.penalty / 2 * w @ w + own / 2 * b * b
        w, b = found.weights[q], found.intercepts[q, 0]
        assert abs(value(w, b) - found.objective[q, 0]) < 1e-6
        moves = mask[q] * rng.normal(size=(300, 60))
        assert all(value(w + s * m, b + s * m[-1]) > value(w, b) * (1 - 1e-3) for m in moves for s in (0.003, 0.05))


def test_one_class_has_no_dual(spark, monkeypatch):
    monkeypatch.setattr("thresher.models.newton.WHOLE", 0)
    rows = spark.createDataFrame([(0, i % 2, i % 2, 1.0, [0], [float(i)]) for i in range(6)],
                                 "cell int, fold int, label int, weight double, index array<int>, values array<double>")
    found = minimise(rows, [Problem("hinge", fold=0), Problem("hinge")], [1])
    assert found.dead.tolist() == [[True], [False]] and (found.weights[0] == 0).all()


def test_stacking_fits_from_short_plans(spark):
    """What made the training rows and their folds is in no member's plan, not even as what is cached."""
    plans, running = [], []

    class Recorder(Tree):
        def fit(self, train, ctx):
            running.append(1)
            plans.append((train._jdf.queryExecution().executedPlan().toString(), sum(running)))
            fitted = super().fit(train, ctx)
            running.append(-1)
            return fitted
    x, y = points()
    df = frame(spark, x, y).withColumn("at", F.row_number().over(Window.orderBy("id"))).where("at > 0").drop("at").persist()
    fitted = Stacking({"tree": Recorder(2)}, registry.Logistic(), 3).fit(df, describe(df, 4))
    assert len(plans) == 4 and not any("Window" in p for p, _ in plans)
    assert all(n <= AT_ONCE for _, n in plans)
    assert fitted.predict(df, ["label"]).where("pred = label").count() > 60
