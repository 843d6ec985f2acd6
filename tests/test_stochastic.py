"""Stochastic training against versions written out row by row."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from thresher.models.base import describe
from thresher.models.histograms import uniform
from thresher.models.stochastic import (AdamPerceptron, Network, StochasticHinge, hinge_pass, start_of_rates)


def frame(spark, x, y):
    return spark.createDataFrame([(i, int(b), Vectors.sparse(len(a), np.flatnonzero(a).tolist(), a[a != 0].tolist()))
                                  for i, (a, b) in enumerate(zip(x, y))], ["id", "label", "features"])


def points(n, d=4, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * (rng.random((n, d)) < 0.8)
    return x, (x @ np.arange(1, d + 1) + rng.normal(size=n) > 0).astype(int)


def test_one_pass_over_ten_rows(spark):
    x, y = points(10)
    df = frame(spark, x, y)
    fitted = StochasticHinge(alpha=1e-2, max_iter=1).fit(df, describe(df, 4))
    keys = {r["id"]: r["k"] for r in df.selectExpr("id", "xxhash64(id) AS k").collect()}
    order = sorted(range(10), key=lambda i: float(uniform(42, 0, np.array([keys[i]]))[0]))
    w, b, t = np.zeros(4), 0.0, 0
    for i in order:
        rate = 1 / (1e-2 * (start_of_rates(1e-2) + t))
        s = 2 * y[i] - 1
        margin = s * (w @ x[i] + b)
        w = w * (1 - rate * 1e-2)
        if margin < 1:
            w, b = w + rate * s * x[i], b + rate * s
        t += 1
    assert np.allclose(fitted.weights[0], np.append(w, b), atol=1e-12)


def test_shrinking_weights_stay_exact():
    rows = [(np.array([1.0]), 1.0, np.array([0]), np.array([0.5]))] * 50
    w, _ = hinge_pass(np.zeros((1, 2)), 0.0, rows, 0.5)
    v, b = 0.0, 0.0
    for t in range(50):
        rate = 1 / (0.5 * (start_of_rates(0.5) + t))
        margin = 0.5 * v + b
        v *= 1 - rate * 0.5
        if margin < 1:
            v, b = v + rate * 0.5, b + rate
    assert np.allclose(w[0], [v, b], atol=1e-12)


def test_passes_end_and_do_not_depend_on_partitions(spark):
    x, y = points(300)
    df = frame(spark, x, y + (x[:, 3] > 1.2))
    found = [StochasticHinge().fit(df.repartition(p), describe(df, 4)) for p in (1, 6)]
    assert np.array_equal(found[0].weights, found[1].weights) and found[0].passes < 1000
    assert found[0].predict(df, ["label"]).where("pred = label").count() > 200


@pytest.mark.parametrize("hidden", [(5,), (4, 3)])
def test_gradient_equals_finite_differences(hidden):
    x, y = points(12)
    net = Network([4, *hidden, 2])
    at = net.start(3)
    weight = np.linspace(0.5, 2, 12)
    sizes = (x != 0).sum(1)
    index, values = np.nonzero(x)[1], x[x != 0]
    _, grad = net.loss(at, y, weight, index, values, sizes)
    for j in range(net.total):
        step = np.zeros(net.total)
        step[j] = 1e-6
        up, down = (net.loss(at + s * step, y, weight, index, values, sizes)[0] for s in (1, -1))
        assert abs((up - down) / 2e-6 - grad[j]) < 1e-5


def test_perceptron_learns_alike_on_any_partitions(spark):
    x, y = points(400)
    df = frame(spark, x, y)
    model = AdamPerceptron((8,), max_iter=12, rate=0.02, batch=100)
    found = [model.fit(df.repartition(p), describe(df, 4)) for p in (1, 6)]
    assert np.abs(found[0].vector - found[1].vector).max() < 1e-9
    rows = found[0].predict(df, ["label"]).collect()
    assert sum(r["pred"] == r["label"] for r in rows) > 320
    assert all(abs(sum(r["proba"]) - 1) < 1e-9 for r in rows)


def test_early_stopping_keeps_the_best(spark):
    x, y = points(200)
    df = frame(spark, x, y)
    short = AdamPerceptron((4,), max_iter=300, rate=0.05, patience=3).fit(df, describe(df, 4))
    assert short.epochs < 300
    by_loss = AdamPerceptron((4,), max_iter=6, early_stopping=False).fit(df, describe(df, 4))
    assert by_loss.epochs == 6


def test_few_distinct_rows_are_counted_for_many_epochs_at_once(spark, monkeypatch):
    from thresher.models import stochastic
    x, y = points(12)
    x, y = np.tile(x, (40, 1)), np.tile(y, 40)
    y[::7] ^= 1
    df, calls = frame(spark, x, y), []

    def summed(*arguments, old=stochastic._summed):
        calls.append(1)
        return old(*arguments)
    monkeypatch.setattr(stochastic, "_summed", summed)
    for options in ({"max_iter": 8}, {"max_iter": 4, "early_stopping": False}, {"max_iter": 40, "rate": 0.05, "patience": 2}):
        model, found = AdamPerceptron(**{"hidden": (5,), "rate": 0.02, "batch": 100, **options}), []
        for few, passes in ((1024, 2), (0, 1000)):
            monkeypatch.setattr(stochastic, "FEW_ROWS", few)
            calls.clear()
            found.append(model.fit(df.repartition(3), describe(df, 4)))
            assert len(calls) <= passes
        assert found[0].epochs == found[1].epochs and np.abs(found[0].vector - found[1].vector).max() < 1e-9
