"""Hinge problems by ascent of their dual, a row at a time (Hsieh, Chang, Lin, Keerthi and Sundararajan, 2008).

The rows of a problem are held by one task. An intercept without a penalty is found by the
method of multipliers: it is pulled to a centre that moves along with it. A problem ends by its gap: the best
primal value, of the last weights or of their mean, less the best dual value of multipliers that meet the
intercept's equation.
"""

from __future__ import annotations

import numpy as np

EPOCHS = 10_000             # passes over the rows that may still change
LOOK = 10                   # passes between two looks at the gap
AGAIN = 5                   # every so many passes take all rows
MARGIN = 0.3                # rows at a bound whose margin lies so far beyond it rest until then


def row_order(index: np.ndarray, values: np.ndarray | None, sizes: np.ndarray, *facts: np.ndarray) -> np.ndarray:
    """Rows by what they hold, however they arrived."""
    ends = np.cumsum(sizes)
    keys = [(index[e - n:e].tobytes(), b"" if values is None else values[e - n:e].tobytes(), *f) for e, n, f in zip(
        ends.tolist(), sizes.tolist(), zip(*(x.tolist() for x in facts)))]
    return np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)


class Rows:
    """Sparse rows, and sums over them."""

    def __init__(self, index: np.ndarray, values: np.ndarray | None, sizes: np.ndarray, width: int):
        """``values`` is None where all are 1."""
        self.index, self.values, self.sizes, self.width = index, values, sizes, width
        ends = np.cumsum(sizes)
        self.filled = sizes > 0
        self.begins = (ends - sizes)[self.filled]
        self.square = sizes.astype(float)
        if values is not None and len(self.begins):
            self.square[self.filled] = np.add.reduceat(values * values, self.begins)
        ones = np.ones(int(sizes.max(initial=0)))
        self.parts = [(index[e - n:e], ones[:n] if values is None else values[e - n:e])
                      for e, n in zip(ends.tolist(), sizes.tolist())]

    def scores(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.sizes))
        if len(self.begins):
            at = np.take(weights, self.index)
            if self.values is not None:
                at *= self.values
            out[self.filled] = np.add.reduceat(at, self.begins)
        return out

    def spread(self, per_row: np.ndarray) -> np.ndarray:
        at = np.repeat(per_row, self.sizes)
        if self.values is not None:
            at *= self.values
        return np.bincount(self.index, at, self.width)


def best_intercept(scores: np.ndarray, y: np.ndarray, cost: np.ndarray) -> float:
    """The least point of the sum of hinges, whose slope grows by a row's cost where its margin is 1."""
    at = y - scores
    order = np.argsort(at, kind="stable")
    sums = np.cumsum(cost[order])
    return float(at[order][min(len(at) - 1, int(np.searchsorted(sums, cost[y > 0].sum())))])


def balanced(alpha: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Multipliers whose sums over both classes are equal, the smaller one of them."""
    yes, no = alpha[y > 0].sum(), alpha[y < 0].sum()
    least = min(yes, no)
    return alpha * np.where(y > 0, least / yes if yes else 0.0, least / no if no else 0.0)


def ascend(rows: Rows, y: np.ndarray, cost: np.ndarray, penalty: float, own: float, gap: float,
           seed: int = 42) -> tuple[np.ndarray, float, float, float, int]:
    """Weights, intercept, primal value, gap and passes of ``sum cost hinge(y (x b + b0)) + penalty / 2 |b|^2 + own / 2 b0^2``.

    ``penalty`` is above 0; ``own`` may be 0. All rows have a cost above 0.
    """
    n, rng = len(y), np.random.default_rng(seed)
    pull = own or penalty               # of the intercept, to 0 or to a centre
    bend = (rows.square / penalty + 1 / pull).tolist()
    signs, most = y.tolist(), cost.tolist()
    alpha, weights, centre, total = [0.0] * n, np.zeros(rows.width), 0.0, 0.0
    active, held, count, fresh = np.arange(n), np.zeros(rows.width), 0, 2 * LOOK
    best, dual = (np.inf, weights, 0.0), -np.inf
    for epoch in range(1, EPOCHS + 1):
        for i in rng.permutation(active).tolist():
            index, values = rows.parts[i]
            before, sign = alpha[i], signs[i]
            after = before + (1 - sign * (float(weights[index] @ values) + centre + total / pull)) / bend[i]
            after = 0.0 if after < 0 else most[i] if after > most[i] else after
            if after != before:
                alpha[i] = after
                weights[index] += values * ((after - before) * sign / penalty)
                total += (after - before) * sign
        if not own:
            centre += total / pull
        held, count = held + weights, count + 1
        intercept = centre if not own else total / pull
        if epoch % AGAIN:
            margins, a = y * (rows.scores(weights) + intercept), np.array(alpha)
            active = np.flatnonzero(~((a <= 0) & (margins > 1 + MARGIN) | (a >= cost) & (margins < 1 - MARGIN)))
        else:
            active = np.arange(n)
        if epoch % LOOK and len(active):
            continue
        a = np.array(alpha)
        a = a if own else balanced(a, y)
        point = rows.spread(a * y)
        dual = max(dual, a.sum() - point @ point / (2 * penalty) - ((a * y).sum() ** 2 / (2 * own) if own else 0.0))
        for w, b in ((weights, intercept), (held / count, intercept), (point / penalty, intercept)):
            scores = rows.scores(w)
            b = b if own else best_intercept(scores, y, cost)
            primal = (cost * np.maximum(0, 1 - y * (scores + b))).sum() + penalty * (w @ w) / 2 + own * b * b / 2
            if primal < best[0]:
                best = float(primal), w.copy(), b
        if best[0] - dual <= 0.5 * gap * best[0]:
            break
        if epoch >= fresh:
            held, count, fresh = np.zeros(rows.width), 0, epoch * 3 // 2
    return best[1], best[2], best[0], float(best[0] - dual), epoch
