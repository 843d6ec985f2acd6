"""Coordinates in which a kernel is an inner product, of as high a rank as an error asks for.

Pivots are drawn by randomly pivoted Cholesky (Chen, Epperly, Tropp and Webber, 2023): rows in
proportion to what the pivots so far leave of their kernel value, a block at a time, until all
that is left is at most the error stated, as a share. Rows stay where they are; a round is one pass,
from which the driver gets a block of candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, functions as F

from thresher.session import in_task

BLOCK = 128                 # pivots drawn in a round
CELLS = 1 << 24             # numbers a task expands at a time
DEPENDENT = 1e-9            # residual of a candidate that adds nothing


@dataclass
class KernelMap:
    """``root`` maps kernel values at the ``pivots`` (dense rows) to coordinates.

    The kernel is exp(-gamma |x - p|^2), or x p where ``gamma`` is None.
    """
    gamma: float | None
    pivots: np.ndarray
    root: np.ndarray
    residual: float

    @property
    def rank(self) -> int:
        return len(self.pivots)

    def kernel(self, index: np.ndarray, values: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
        """Kernel values of sparse rows and all pivots, some rows at a time."""
        ends = np.cumsum(sizes)
        norms, columns = (self.pivots ** 2).sum(1), self.pivots.T
        start = 0
        while start < len(sizes):
            before = ends[start - 1] if start else 0
            limit = max(1, CELLS // max(1, self.rank))
            end = max(start + 1, min(int(np.searchsorted(ends, before + limit, side="right")), start + limit))
            part, i = sizes[start:end], index[before:ends[end - 1]]
            v, filled = values[before:ends[end - 1]], part > 0
            product, square = np.zeros((end - start, self.rank)), np.zeros(end - start)
            if filled.any():
                begins = (np.cumsum(part) - part)[filled]
                product[filled] = np.add.reduceat(columns[i] * v[:, None], begins, axis=0)
                square[filled] = np.add.reduceat(v * v, begins)
            yield product if self.gamma is None else np.exp(
                -self.gamma * np.maximum(square[:, None] + norms - 2 * product, 0))
            start = end

    @staticmethod
    def fit(rows: DataFrame, n_features: int, gamma: float | None, error: float = 1e-3, seed: int = 42,
            block: int = BLOCK) -> "KernelMap":
        """From rows (index, values). Equal rows count as often as they stand there."""
        found = KernelMap(gamma, np.zeros((0, n_features)), np.zeros((0, 0)), 1.0)
        lower = np.zeros((0, 0))
        seeds = F.xxhash64(F.lit(seed), "index", "values").alias("draw")
        parts, turn = rows.rdd.getNumPartitions(), 0
        while True:
            turn += 1
            picked = _candidates(rows.select("index", "values", seeds), found, block, turn)
            best = picked.orderBy("rank").limit(block + parts).collect()
            stats = [r for r in best if r["rank"] < 0]
            found.residual = sum(r["residual"] for r in stats) / (sum(r["whole"] for r in stats) or 1.0)
            fresh = [r for r in best if r["rank"] >= 0][:block]
            if found.residual <= error or not fresh:
                break
            new = np.zeros((len(fresh), n_features))
            for row, r in zip(new, fresh):
                row[r["index"]] = r["values"]
            lower, kept, root = in_task(rows.sparkSession, _extended, found, lower, new)
            if not kept:
                break
            found.pivots, found.root = np.vstack([found.pivots, new[kept]]), root
        if not found.rank:
            found.pivots, found.root = np.zeros((1, n_features)), np.eye(1)
        return found

    def transform(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the coordinates in ``values``; the other columns stay, ``index`` goes."""
        keep = [c for c in rows.columns if c not in ("index", "values")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = 0
                for k in self.kernel(*_flat(batch)):
                    z = k @ self.root.T
                    part = batch.slice(at, len(z))
                    at += len(z)
                    lists = pa.ListArray.from_arrays(
                        pa.array(np.arange(len(z) + 1, dtype=np.int32) * self.rank), pa.array(z.ravel()))
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), lists],
                                                     names=[*keep, "values"])
        schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
        return rows.mapInArrow(run, f"{schema}, values array<double>")

    def linear_weights(self, weights: np.ndarray) -> np.ndarray:
        """Of the columns themselves, for the linear kernel."""
        return np.einsum("qr,rp,pc->qc", weights, self.root, self.pivots, optimize=False)

    def margins(self, weights: np.ndarray, intercepts: np.ndarray, index: Column, values: Column) -> Column:
        """array<double> of z b + b0 per row of ``weights``, without forming z."""
        import pandas as pd
        at_pivots = weights @ self.root

        def score(index, values):
            if not len(values):
                return pd.Series([], dtype="object")
            sizes = values.map(len).to_numpy()
            i = np.concatenate(index.to_numpy()) if sizes.sum() else np.zeros(0, np.int64)
            v = np.concatenate(values.to_numpy()) if sizes.sum() else np.zeros(0)
            out = np.concatenate([k @ at_pivots.T for k in self.kernel(i, v, sizes)]) + intercepts
            return pd.Series(list(out))
        score.__annotations__ = {"index": pd.Series, "values": pd.Series, "return": pd.Series}
        return F.pandas_udf(score, "array<double>")(index, values)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = pa.compute.list_value_length(batch.column("values")).to_numpy(False).astype(np.int64)
    return (batch.column("index").flatten().to_numpy(False),
            batch.column("values").flatten().to_numpy(False), sizes)


def _candidates(rows: DataFrame, found: KernelMap, block: int, turn: int) -> DataFrame:
    """Per task: its ``block`` rows of least rank, drawn in proportion to their residual, and
    one row of rank -1 with the sums of residuals and of whole kernel values."""
    schema = "rank double, residual double, whole double, index array<int>, values array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, whole, held = 0.0, 0.0, []
        for batch in batches:
            _, values, sizes = _flat(batch)
            own = np.ones(len(sizes)) if found.gamma is not None else np.bincount(
                np.repeat(np.arange(len(sizes)), sizes), values * values, len(sizes))
            explained = (np.concatenate([((k @ found.root.T) ** 2).sum(1) for k in found.kernel(*_flat(batch))])
                         if found.rank and len(sizes) else 0.0)
            residual = np.maximum(own - explained, 0)
            total, whole = total + residual.sum(), whole + own.sum()
            draw = batch.column("draw").to_numpy().view(np.uint64) ^ np.uint64(turn * 0x9E3779B97F4A7C15 % 2 ** 64)
            draw = (draw ^ (draw >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            draw = (draw ^ (draw >> np.uint64(29))) >> np.uint64(11)
            with np.errstate(divide="ignore"):
                rank = -np.log((draw + 1.0) / 2.0 ** 53) / residual
            rank[residual <= DEPENDENT] = np.inf
            order = np.argsort(rank, kind="stable")[:block]
            order = order[np.isfinite(rank[order])]
            chosen = batch.take(pa.array(order))
            held += list(zip(rank[order].tolist(), chosen.column("index").to_pylist(),
                             chosen.column("values").to_pylist()))
            held = sorted(held, key=lambda h: h[0])[:block]
        yield pa.RecordBatch.from_arrays([
            pa.array([-1.0, *(h[0] for h in held)]), pa.array([total, *([0.0] * len(held))]),
            pa.array([whole, *([0.0] * len(held))]),
            pa.array([[], *(h[1] for h in held)], pa.list_(pa.int32())),
            pa.array([[], *(h[2] for h in held)], pa.list_(pa.float64()))],
            names=["rank", "residual", "whole", "index", "values"])
    return rows.mapInArrow(run, schema)


def _extended(found: KernelMap, lower: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, list[int], np.ndarray]:
    """The Cholesky factor with those of ``new`` that do not depend on earlier pivots; its inverse."""
    def kernel(a, b):
        if found.gamma is None:
            return a @ b.T
        square = (a ** 2).sum(1)[:, None] + (b ** 2).sum(1) - 2 * a @ b.T
        return np.exp(-found.gamma * np.maximum(square, 0))
    across = found.root @ kernel(found.pivots, new) if found.rank else np.zeros((0, len(new)))
    rest = kernel(new, new) - across.T @ across
    kept: list[int] = []
    factor = np.zeros((len(new), len(new)))
    for j in range(len(new)):
        row = np.zeros(len(kept))
        for i, other in enumerate(kept):
            row[i] = (rest[j, other] - factor[other, :i] @ row[:i]) / factor[other, i]
        left = rest[j, j] - row @ row
        if left > DEPENDENT:
            factor[j, :len(kept)], factor[j, len(kept)] = row, left ** 0.5
            kept.append(j)
    m, b = len(lower), len(kept)
    out = np.zeros((m + b, m + b))
    out[:m, :m] = lower
    out[m:, :m] = across[:, kept].T
    out[m:, m:] = factor[kept, :b]
    return out, kept, np.linalg.inv(out)
