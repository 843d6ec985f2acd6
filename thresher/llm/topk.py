"""Exact top-k search by inner product: tiles of a matrix product, then a tree of merges."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

EXACT = 2.0 ** 53           # doubles hold every integer up to here
LONG = (-(1 << 63), (1 << 63) - 1)


def quantised(column: str, factor: int) -> F.Column:
    """``floor(factor * x)`` of every component; null where the vector takes no part."""
    x = F.col(column).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return F.when(x.isNotNull() & ~bad, F.transform(x, lambda v: F.floor(v * F.lit(float(factor)))))


def top_k(vectors: DataFrame, k: int = 5, query_every: int = 50, id_col: str = "vec_id",
          vector_col: str = "embedding", factor: int = 256, shard_rows: int = 4096,
          block_queries: int = 2048, fan_in: int = 16) -> DataFrame:
    """The ``k`` rows of highest integer inner product for every query.

    Queries are the rows whose id is divisible by ``query_every``, candidates all rows but
    those of the query's own id; ties go to the smaller id. Returns ``query_id``, ``rank``
    (from 1), ``vec_id`` and ``score``.

    Rows are dealt by a hash into shards of about ``shard_rows`` and queries into blocks of
    about ``block_queries``. Each shard meets each block in one task, which multiplies the two
    matrices and keeps ``k`` per query; lists of ``fan_in`` shards are merged at a time.

    Vectors that are null or hold a null or non-finite component take no part, nor do rows
    without an id. Vectors of other lengths count as padded with zeros, empty ones as zero.
    Repeated rows: candidates of equal id and score each take a place; a query repeated
    under one id is answered once, for its components in ascending order the first. Scores
    beyond a long are held at its ends. An empty table gives no rows.
    """
    rows = (vectors.select(F.col(id_col).cast("long").alias("vec_id"),
                           quantised(vector_col, factor).alias("v"))
            .where("vec_id is not null and v is not null"))
    is_query = F.col("vec_id") % query_every == 0
    n, asked = rows.agg(F.count("*"), F.count_if(is_query)).first()
    shards, blocks = max(1, math.ceil(n / shard_rows)), max(1, math.ceil(asked / block_queries))
    deal = lambda m: F.pmod(F.xxhash64("vec_id", "v"), F.lit(m)).cast("int")
    tiles = shards * blocks

    queries = (rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
               .withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
               .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))))
    candidates = (rows.withColumn("shard", deal(shards))
                  .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    tile = (F.col("shard") * blocks + F.col("block")).alias("tile")
    both = (candidates.select(tile, F.lit(False).alias("asks"), "vec_id", "v")
            .unionByName(queries.select(tile, F.lit(True).alias("asks"), "vec_id", "v")))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bool], list[tuple[np.ndarray, list]]] = {}
        for batch in batches:
            tile_of, asks = batch.column("tile").to_numpy(), batch.column("asks").to_numpy(False)
            for key in {*zip(tile_of.tolist(), asks.tolist())}:
                here = pa.array((tile_of == key[0]) & (asks == key[1]))
                part = batch.filter(here)
                held.setdefault(key, []).append((part.column("vec_id").to_numpy(), part.column("v")))
        for tile_no in sorted({t for t, _ in held}):
            if (tile_no, True) not in held or (tile_no, False) not in held:
                continue
            asked_ids, asked_v = _matrix(held.pop((tile_no, True)))
            ids, v = _matrix(held.pop((tile_no, False)))
            order = np.argsort(ids, kind="stable")      # so that the first of equals is the smaller id
            ids, v = ids[order], v[order]
            for at in range(0, len(asked_ids), 256):
                part = slice(at, at + 256)
                yield _best(asked_ids[part], _product(asked_v[part], v), ids, k, tile_no // blocks)

    lists = (both.repartition(tiles, "tile")
             .mapInArrow(multiply, "query_id long, shard int, best array<struct<negative:long,vec_id:long>>"))
    while True:
        lists = (lists.groupBy("query_id", (F.col("shard") / fan_in).cast("int").alias("shard"))
                 .agg(F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, k).alias("best")))
        shards = math.ceil(shards / fan_in)
        if shards <= 1:
            break
    return (lists.select("query_id", F.posexplode("best").alias("pos", "found"))
            .select("query_id", (F.col("pos") + 1).alias("rank"), "found.vec_id",
                    (-1 - F.col("found.negative")).alias("score")))


def _matrix(parts: list) -> tuple[np.ndarray, np.ndarray]:
    ids = np.concatenate([ids for ids, _ in parts])
    width = max(int(pa.compute.max(pa.compute.list_value_length(v)).as_py() or 0) for _, v in parts)
    out, at = np.zeros((len(ids), width), np.int64), 0
    for _, v in parts:
        sizes = pa.compute.list_value_length(v).to_numpy(False)
        inside = np.arange(width) < sizes[:, None]
        out[at:at + len(sizes)][inside] = v.flatten().to_numpy(False)
        at += len(sizes)
    return ids, out


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integers: in doubles where those are exact, else in whole numbers."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    largest = [float(max(abs(int(x.min())), abs(int(x.max())))) if x.size else 0.0 for x in (a, b)]
    if largest[0] * largest[1] * max(1, width) < EXACT:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return np.clip(a.astype(object) @ b.T.astype(object), *LONG).astype(np.int64)


def _best(asked: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int, shard: int) -> pa.RecordBatch:
    lists = []
    for query, row in zip(asked.tolist(), scores):
        mine = ids == query
        n = int(mine.sum())
        # with its own rows and ties at the edge, the k best are among these
        if len(row) > k + n:
            edge = np.partition(row, len(row) - k - n)[len(row) - k - n]
            found = np.flatnonzero((row >= edge) & ~mine)
        else:
            found = np.flatnonzero(~mine)
        found = found[np.argsort(-1 - row[found], kind="stable")[:k]]
        lists.append([{"negative": -1 - s, "vec_id": i}
                      for s, i in zip(row[found].tolist(), ids[found].tolist())])
    return pa.RecordBatch.from_arrays(
        [pa.array(asked), pa.array([shard] * len(lists), pa.int32()),
         pa.array(lists, pa.list_(pa.struct([("negative", pa.int64()), ("vec_id", pa.int64())])))],
        names=["query_id", "shard", "best"])
