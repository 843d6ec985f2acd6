"""Models trained by stochastic steps: a linear hinge classifier and a multi-layer perceptron.

Both keep their few coefficients on the driver and send them to the tasks that hold the rows:
the linear one for a pass, in which every partition takes its own steps and the results are
averaged; the perceptron for a step, whose gradients are summed over all partitions. Where few rows
differ, the perceptron's minibatches are weights of distinct rows, counted for many epochs in one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, functions as F

from thresher.models.base import Context, Fitted, Model, WEIGHT, settled, softmax, weighted
from thresher.models.histograms import uniform
from thresher.models.linear_grid import decision
from thresher.models.newton import linear_scores, parts_of
from thresher.session import in_task


def _training_rows(train: DataFrame, ctx: Context) -> DataFrame:
    """(key, label, weight, index, values), the same rows in the same partitions however they came."""
    index, values = parts_of("features")
    place = F.array_position(F.array(*[F.lit(int(c)) for c in ctx.classes]), F.col("label").cast("int")) - 1
    return settled(weighted(train, ctx), ctx.n).select(
        F.xxhash64("id").alias("key"), place.cast("int").alias("label"),
        F.col(WEIGHT).cast("double").alias("weight"), index.alias("index"), values.alias("values"))


def _flat(batch: pa.RecordBatch):
    sizes = pa.compute.list_value_length(batch.column("values")).to_numpy(False).astype(np.int64)
    return (*(batch.column(c).to_numpy() for c in ("key", "label", "weight")),
            *(batch.column(c).flatten().to_numpy(False) for c in ("index", "values")), sizes)


def _summed(rows: DataFrame, several: bool, run: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> np.ndarray:
    """The sum over all partitions of the vectors that ``run`` makes of them."""
    def partial(batches):
        yield pa.RecordBatch.from_pydict({"sums": pa.array([run(batches).tobytes()], pa.binary())})

    def merge(batches):
        total = 0.0
        for batch in batches:
            for sums in batch.column("sums").to_pylist():
                total = total + np.frombuffer(sums)
        if not np.isscalar(total):
            yield pa.RecordBatch.from_pydict({"sums": pa.array([total.tobytes()], pa.binary())})
    sums = rows.mapInArrow(partial, "sums binary")
    if several:     # one vector a partition, added as they come
        sums = sums.repartition(1).mapInArrow(merge, "sums binary")
    return sum(np.frombuffer(r["sums"]) for r in sums.collect())


# ---- linear hinge ----

def start_of_rates(alpha: float) -> float:
    """t0 of the rate 1 / (alpha (t0 + t)): the first step moves a weight by its typical size."""
    typical = np.sqrt(1.0 / np.sqrt(alpha))
    return 1.0 / (typical * alpha)


def hinge_pass(weights: np.ndarray, t: float, rows: Sequence[tuple], alpha: float
               ) -> tuple[np.ndarray, float]:
    """Steps over ``rows`` (signs per class, weight, index, values); the intercept is the last
    column. Returns the weights and the loss met on the way."""
    weights, loss, shrink = weights.copy(), 0.0, 1.0
    for signs, weight, index, values in rows:
        rate = 1.0 / (alpha * (start_of_rates(alpha) + t))
        margin = signs * (shrink * (weights[:, index] @ values) + weights[:, -1])
        loss += weight * np.maximum(0, 1 - margin).sum()
        shrink *= 1 - rate * alpha
        if shrink < 1e-9:       # weights are kept divided by ``shrink``
            weights[:, :-1] *= shrink
            shrink = 1.0
        step = np.where(margin < 1, rate * weight * signs, 0.0)
        weights[:, index] += np.outer(step / shrink, values)
        weights[:, -1] += step
        t += 1
    weights[:, :-1] *= shrink
    return weights, loss


class StochasticHinge(Model):
    """Linear classifiers, one against the rest, by stochastic subgradient steps on hinge loss.

    A pass is one job: every partition (of a fixed number of rows, in the order of a hash)
    steps from the same weights, and their results are averaged by rows. Training ends when
    ``patience`` passes in a row lower the mean loss by less than ``tol``, after ``max_iter`` passes
    at the latest.
    """

    def __init__(self, alpha: float = 1e-4, max_iter: int = 1000, tol: float = 1e-3, patience: int = 5,
                 input: str = "bow"):
        self.alpha, self.max_iter, self.tol, self.patience, self.input = alpha, max_iter, tol, patience, input

    def fit(self, train: DataFrame, ctx: Context) -> "FittedStochastic":
        rows = _training_rows(train, ctx).persist()
        several = rows.rdd.getNumPartitions() > 1
        wanted = np.array([1] if ctx.k == 2 else list(range(ctx.k)))
        weights = np.zeros((len(wanted), ctx.n_features + 1))
        alpha, seed, best, waited, seen = self.alpha, ctx.seed, np.inf, 0, 0.0
        for number in range(self.max_iter):
            sent = rows.sparkSession.sparkContext.broadcast((weights, seen))

            def run(batches):
                held = []
                for batch in batches:
                    key, label, weight, index, values, sizes = _flat(batch)
                    ends = np.cumsum(sizes)
                    order = uniform(seed, number, key)
                    held += [(order[i], np.where(label[i] == wanted, 1.0, -1.0), weight[i],
                              index[e - s:e], values[e - s:e]) for i, (s, e) in enumerate(zip(sizes, ends))]
                held.sort(key=lambda row: row[0])
                start, t = sent.value
                after, loss = hinge_pass(start, t, [row[1:] for row in held], alpha)
                return np.concatenate([[len(held), loss], (len(held) * after).ravel()])
            n, loss, *total = _summed(rows, several, run)
            sent.unpersist()
            weights = np.array(total).reshape(weights.shape) / n
            seen += n / rows.rdd.getNumPartitions()     # steps that a partition has taken
            waited = waited + 1 if loss > best - self.tol * ctx.n else 0
            best = min(best, loss)
            if waited >= self.patience:
                break
        rows.unpersist()
        return FittedStochastic(weights, ctx.classes, number + 1)


class FittedStochastic(Fitted):
    def __init__(self, weights: np.ndarray, classes: Sequence[int], passes: int):
        self.weights, self.classes, self.passes = weights, classes, passes

    def columns(self, df: DataFrame):
        scored = df.withColumn("_scores", linear_scores(self.weights[:, :-1], self.weights[:, -1]))
        proba, score, decide = decision(F.col("_scores"), self.classes, False)
        return scored, proba, score, decide


# ---- multi-layer perceptron ----

class Network:
    """Layers of rectified units under a softmax; all parameters in one vector."""

    def __init__(self, sizes: Sequence[int]):
        self.sizes = list(sizes)
        self.shapes = [(a, b) for a, b in zip(self.sizes, self.sizes[1:])]
        self.total = sum(a * b + b for a, b in self.shapes)

    def start(self, seed: int) -> np.ndarray:
        rng = np.random.default_rng(seed)
        return np.concatenate([rng.uniform(-1, 1, a * b + b) * np.sqrt(6 / (a + b)) for a, b in self.shapes])

    def layers(self, vector: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        for a, b in self.shapes:
            out.append((vector[at:at + a * b].reshape(a, b), vector[at + a * b:at + a * b + b]))
            at += a * b + b
        return out

    def weights_only(self) -> np.ndarray:
        """1 where a parameter is a weight, which is penalised, 0 where it is an intercept."""
        return np.concatenate([np.append(np.ones(a * b), np.zeros(b)) for a, b in self.shapes])

    def forward(self, vector: np.ndarray, index, values, sizes) -> list[np.ndarray]:
        """Outputs of all layers for sparse rows; the last are log probabilities."""
        out = []
        for number, (w, b) in enumerate(self.layers(vector)):
            if number == 0:
                z = np.tile(b, (len(sizes), 1))
                filled = sizes > 0
                if filled.any():
                    begins = (np.cumsum(sizes) - sizes)[filled]
                    z[filled] += np.add.reduceat(w[index] * values[:, None], begins, axis=0)
            else:
                z = out[-1] @ w + b
            out.append(np.maximum(z, 0) if number < len(self.shapes) - 1 else
                       z - z.max(1, keepdims=True) - np.log(np.exp(z - z.max(1, keepdims=True)).sum(1, keepdims=True)))
        return out

    def loss(self, vector, label, weight, index, values, sizes) -> tuple[float, np.ndarray]:
        """Weighted log loss and its gradient."""
        out = self.forward(vector, index, values, sizes)
        n = np.arange(len(label))
        loss = -(weight * out[-1][n, label]).sum()
        back = np.exp(out[-1])
        back[n, label] -= 1
        back *= weight[:, None]
        layers, grads = self.layers(vector), []
        for number in range(len(layers) - 1, -1, -1):
            if number:
                gw = out[number - 1].T @ back
            else:
                gw = np.zeros(self.shapes[0])
                np.add.at(gw, index, values[:, None] * np.repeat(back, sizes, axis=0))
            grads.append(np.append(gw.ravel(), back.sum(0)))
            if number:
                back = (back @ layers[number][0].T) * (out[number - 1] > 0)
        return loss, np.concatenate(grads[::-1])


FEW_ROWS = 1024             # distinct rows whose weights in a minibatch stand for it
COUNTED = 1 << 18           # weights that a pass counts, of as many epochs as that makes
EPOCHS = 25                 # in a pass at most


@dataclass
class Course:
    """Where training stands."""
    vector: np.ndarray
    m: np.ndarray
    v: np.ndarray
    kept: np.ndarray
    t: int = 0
    best: float = -np.inf
    waited: int = 0
    met: float = 0.0
    epochs: int = 0

    def step(self, model: "AdamPerceptron", penalised: np.ndarray, loss: float, weight: float, grad: np.ndarray) -> None:
        if not weight:
            return
        self.t += 1
        grad = (grad + model.alpha * penalised * self.vector) / weight
        self.met += loss + model.alpha / 2 * (penalised * self.vector * self.vector).sum()
        self.m, self.v = 0.9 * self.m + 0.1 * grad, 0.999 * self.v + 0.001 * grad * grad
        self.vector = self.vector - (model.rate * np.sqrt(1 - 0.999 ** self.t) / (1 - 0.9 ** self.t)
                                     * self.m / (np.sqrt(self.v) + 1e-8))

    def ended(self, model: "AdamPerceptron", hits: float, held: float, n: float) -> bool:
        """After an epoch; ``hits`` of ``held`` are of the held out rows under the coefficients of the last step."""
        score = hits / max(held, 1e-300) if model.early_stopping else -self.met / n
        self.waited = 0 if score > self.best + model.tol else self.waited + 1
        if score > self.best:
            self.best, self.kept = score, self.vector
        self.met, self.epochs = 0.0, self.epochs + 1
        return self.waited >= model.patience or self.epochs >= model.max_iter


class AdamPerceptron(Model):
    """Multi-layer perceptron: rectified units, Adam on minibatches, an L2 penalty ``alpha``.

    An epoch deals rows into minibatches by a hash, of ``batch`` rows or as many as make STEPS
    of them; the gradient of a step is summed over all partitions. If at most FEW_ROWS rows differ, a pass
    counts what each of them weighs in every minibatch of many epochs, and one task takes their steps:
    the sums are the same. With ``early_stopping`` a share of the rows is held out, and training ends when
    their accuracy has not risen by ``tol`` for ``patience`` epochs; the best coefficients stay. Otherwise it is
    the training loss.
    """
    STEPS = 20

    def __init__(self, hidden: Sequence[int] = (100,), max_iter: int = 500, alpha: float = 1e-4,
                 early_stopping: bool = True, held_out: float = 0.1, rate: float = 1e-3, batch: int = 200,
                 tol: float = 1e-4, patience: int = 10, input: str = "bow"):
        self.hidden, self.max_iter, self.alpha, self.early_stopping = tuple(hidden), max_iter, alpha, early_stopping
        self.held_out, self.rate, self.batch, self.tol, self.patience = held_out, rate, batch, tol, patience
        self.input = input

    def fit(self, train: DataFrame, ctx: Context) -> "FittedNetwork":
        net = Network([ctx.n_features, *self.hidden, ctx.k])
        rows = _training_rows(train, ctx).withColumn("same", F.xxhash64("label", "index", "values")).persist()
        several = rows.rdd.getNumPartitions() > 1
        share = self.held_out if self.early_stopping else 0.0
        steps = int(max(1, min(self.STEPS, np.ceil((1 - share) * ctx.n / self.batch))))
        start, seed = net.start(ctx.seed), ctx.seed
        course = Course(start, np.zeros(net.total), np.zeros(net.total), start)
        few, done = _few_rows(rows), self.max_iter < 1
        if few is not None:
            same, *distinct = few
            together = max(1, min(EPOCHS, COUNTED // (steps * max(1, len(same)))))
            while not done:
                counts, held = _weights(rows, several, same, seed, share, course.epochs, together, steps)
                course, done = in_task(rows.sparkSession, _several_epochs, self, net, course, distinct, counts, held, ctx.n)
        while not done:
            penalised = net.weights_only()
            for step in range(steps):
                sums = self._sums(rows, several, net, course.vector, seed, share, course.epochs, step, steps)
                course.step(self, penalised, sums[0], sums[1], sums[4:])
            done = course.ended(self, sums[2], sums[3], ctx.n)
        rows.unpersist()
        return FittedNetwork(net, course.kept if self.early_stopping else course.vector, ctx.classes, course.epochs)

    @staticmethod
    def _sums(rows, several, net, vector, seed, share, epoch, step, steps) -> np.ndarray:
        """Loss and weight of a minibatch, hits and weight of the held out rows, the gradient."""
        sent = rows.sparkSession.sparkContext.broadcast(vector)

        def run(batches):
            total = np.zeros(4 + net.total)
            for batch in batches:
                key, label, weight, index, values, sizes = _flat(batch)
                out = uniform(seed, -1, key) < share
                mine = ~out & ((uniform(seed, epoch, key) * steps).astype(int) == step)
                for chosen, held in ((mine, False), (out if step == steps - 1 else out & False, True)):
                    if not chosen.any():
                        continue
                    inside = np.repeat(chosen, sizes)
                    part = index[inside], values[inside], sizes[chosen]
                    if held:
                        hit = net.forward(sent.value, *part)[-1].argmax(1) == label[chosen]
                        total[2:4] += (weight[chosen] * hit).sum(), weight[chosen].sum()
                    else:
                        loss, grad = net.loss(sent.value, label[chosen], weight[chosen], *part)
                        total[0] += loss
                        total[1] += weight[chosen].sum()
                        total[4:] += grad
            return total
        found = _summed(rows, several, run)
        sent.unpersist()
        return found


def _few_rows(rows: DataFrame) -> tuple | None:
    """Hashes of the distinct rows, ascending, with their labels, index, values and sizes; none if they are many."""
    if rows.agg(F.approx_count_distinct("same")).first()[0] > 2 * FEW_ROWS:
        return None
    found = rows.select("same", "label", "index", "values").distinct().limit(FEW_ROWS + 1).collect()
    found.sort(key=lambda r: r["same"])
    same = np.array([r["same"] for r in found], np.int64)
    if len(found) > FEW_ROWS or len(np.unique(same)) < len(found):
        return None
    return (same, np.array([r["label"] for r in found], np.int64),
            np.array([i for r in found for i in r["index"]], np.int64),
            np.array([v for r in found for v in r["values"]], float),
            np.array([len(r["index"]) for r in found], np.int64))


def _weights(rows: DataFrame, several: bool, same: np.ndarray, seed: int, share: float, first: int, epochs: int,
             steps: int) -> tuple[np.ndarray, np.ndarray]:
    """What each distinct row weighs in the minibatches (epoch, step) from ``first`` on, and among the rows held out."""
    def run(batches):
        counts, held = np.zeros((epochs, steps * len(same))), np.zeros(len(same))
        for batch in batches:
            key, weight, own = (batch.column(c).to_numpy() for c in ("key", "weight", "same"))
            place, out = np.searchsorted(same, own), uniform(seed, -1, key) < share
            held += np.bincount(place[out], weight[out], len(same))
            key, weight, place = key[~out], weight[~out], place[~out]
            for n in range(epochs):
                step = (uniform(seed, first + n, key) * steps).astype(int)
                counts[n] += np.bincount(step * len(same) + place, weight, counts.shape[1])
        return np.append(counts.ravel(), held)
    found = _summed(rows.select("key", "weight", "same"), several, run)
    return found[:-len(same)].reshape(epochs, steps, len(same)), found[-len(same):]


def _several_epochs(model: AdamPerceptron, net: Network, course: Course, distinct: Sequence[np.ndarray],
                    counts: np.ndarray, held: np.ndarray, n: float) -> tuple[Course, bool]:
    """The epochs that ``counts`` holds, or those up to the end of training."""
    label, index, values, sizes = distinct
    penalised, done = net.weights_only(), False
    for epoch in counts:
        for step, weight in enumerate(epoch):
            if step == len(epoch) - 1:
                hit = net.forward(course.vector, index, values, sizes)[-1].argmax(1) == label
            chosen = weight > 0
            if chosen.any():
                inside = np.repeat(chosen, sizes)
                loss, grad = net.loss(course.vector, label[chosen], weight[chosen], index[inside], values[inside],
                                      sizes[chosen])
                course.step(model, penalised, loss, weight.sum(), grad)
        done = course.ended(model, (held * hit).sum(), held.sum(), n)
        if done:
            break
    return course, done


class FittedNetwork(Fitted):
    def __init__(self, net: Network, vector: np.ndarray, classes: Sequence[int], epochs: int):
        self.net, self.vector, self.classes, self.epochs = net, vector, classes, epochs

    def columns(self, df: DataFrame):
        import pandas as pd
        net, vector = self.net, self.vector

        def score(index, values):
            if not len(values):
                return pd.Series([], dtype="object")
            sizes = values.map(len).to_numpy()
            i = np.concatenate(index.to_numpy()) if sizes.sum() else np.zeros(0, np.int64)
            x = np.concatenate(values.to_numpy()) if sizes.sum() else np.zeros(0)
            return pd.Series(list(net.forward(vector, i, x, sizes)[-1]))
        score.__annotations__ = {"index": pd.Series, "values": pd.Series, "return": pd.Series}
        scores: Column = F.pandas_udf(score, "array<double>")(*parts_of("features"))
        return df.withColumn("_logs", scores), softmax(F.col("_logs")), None, None
