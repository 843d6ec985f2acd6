"""Connected groups of rows that share buckets, have close bitmaps and pass a check of pairs.

Used where a bucket may hold any share of the rows: no bucket is expanded into all its
pairs, and none is collected into one task.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from thresher.llm.staging import staged, swept, unstaged

TILE = 1024
NEAREST = 2
FEW_PAIRS = 1024            # possible ones a member: so many are compared at once, without the nearest first
SLICES = 4                  # buckets whose rows are dealt to tiles one after another, if there are many
SLICED_ROWS = 1 << 20
ASKED, ASKS, BOTH = 0, 1, 2  # what a row does in a tile


def connected_components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node reachable, for every node of a link ``a``, ``b``.

    Alternates two steps until every node hangs on one root: a node hands its larger
    neighbours to its least one, then its smaller neighbours. Hot nodes meet only in
    minimums, which are taken before the shuffle, and in joins that Spark can split.
    """
    edges = (links.where("a != b").select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u"))
             .distinct())
    while True:
        roots = staged(edges.select(F.col("u").alias("node"), "v")
                       .unionByName(edges.select(F.col("v").alias("node"), "v"))
                       .groupBy("node").agg(F.min("v").alias("root"), F.max("v").alias("last")), "roots")
        if roots.where("root != last").isEmpty():
            return roots.select("node", "root")
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u != v").distinct())
        # every edge now runs from a node to a smaller one
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        edges = staged(small.select("e.u", F.col("e.m").alias("v")).where("u != v").distinct(), "edges")


def differing_bits(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0),
                       lambda total, n: total + n)


def linked_groups(members: DataFrame, traits: DataFrame, confirm: Callable[[DataFrame], DataFrame],
                  most_bits: int, size_percent: int, extra_links: DataFrame | None = None,
                  closer: Callable[[DataFrame], DataFrame] | None = None,
                  most_fine_bits: int = 0, most_bits_percent: float | None = None) -> DataFrame:
    """``node`` and ``root`` over all true links between nodes that share a bucket.

    ``members`` has ``key`` and ``node``, ``traits`` has ``node``, ``size`` and ``bits`` (longs).
    A pair can only be linked if its bitmaps differ in at most ``most_bits`` places (and, if given,
    in at most ``most_bits_percent`` of the larger size) and what it has in common, the smaller size
    at most, is ``size_percent`` of all it has; ``confirm`` keeps the true links among such pairs ``a``, ``b``. Nodes without a link are left out. ``closer`` may look again at
    the few nodes ``node``, ``outside`` that are left at the end: ``shared``, how much of each outside
    node occurs in another of them, bounds what two nodes have in common, ``fine`` is a longer
    bitmap, of which at most ``most_fine_bits`` may differ, and ``keys`` are the node's buckets, one
    for each place, so that a pair is made once.

    Every bucket first links its rows to one hub, the row with most bucket mates in all its
    buckets. That joins most of a group of copies. Afterwards only rows outside a bucket's main
    component are compared with the rest of the bucket, by bitmap and in tiles: first each with
    its nearest few of each tile, which joins most rows that belong to a group, then those that
    are still outside with all close rows. So the groups are those of all pairs. Where few pairs
    are possible, all close ones are compared at once.
    """
    shared = members.groupBy("key").agg(F.count("*").alias("mates")).where("mates > 1")
    members = staged(members.join(shared, "key").join(traits, "node"), "members")
    weight = members.groupBy("node").agg(F.sum("mates").alias("weight"))
    hubs = (members.join(weight, "node").groupBy("key")
            .agg(F.max_by(F.struct(F.col("node").alias("hub"), F.col("size").alias("hub_size"),
                                   F.col("bits").alias("hub_bits")),
                          F.struct("weight", -F.col("node"))).alias("h")).select("key", "h.*"))
    fits = (F.lit(100) * F.least("size", "hub_size") >= F.lit(size_percent) * F.greatest("size", "hub_size"))
    differ = differing_bits("bits", "hub_bits")
    near = differ <= most_bits
    if most_bits_percent is not None:
        near &= F.lit(100) * differ <= F.lit(most_bits_percent) * F.greatest("size", "hub_size")
    stars = staged(members.join(hubs, "key").where(F.col("node") != F.col("hub"))
                   .where(fits & near)
                   .select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct(),
                   "stars")
    links = staged(confirm(stars), "links")
    if extra_links is not None:
        links = links.unionByName(extra_links)
    groups = connected_components(links)

    tested = stars
    swept(members.sparkSession)
    for nearest in (NEAREST, None):
        placed = staged(members.drop("mates").join(groups, "node", "left")
                        .withColumn("root", F.coalesce("root", "node")), "placed")
        main = (placed.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key")
                .agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("rows"),
                     (F.sum("n") - F.max("n")).alias("outside"), F.count("*").alias("roots"))
                .where("roots > 1").drop("roots"))
        slices = 1
        if closer is None:
            main = staged(main, "main")
            rows, possible = main.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(
                F.sum(F.col("outside").cast("double") * F.col("rows")), F.lit(0.0))).first()
            slices = SLICES if rows > SLICED_ROWS else 1
            if possible <= FEW_PAIRS * rows:
                nearest = None
        mixed = placed.join(main, "key").withColumn("shared", F.col("size"))
        if nearest is None and closer is not None:
            mixed = staged(mixed.drop("shared"), "mixed")
            outside = (F.col("root") != F.col("main")).alias("outside")
            traits = closer(mixed.select("node", outside).groupBy("node").agg(F.max("outside").alias("outside")))
            mixed = mixed.join(traits, "node")
        parts = []
        for number in range(slices):
            own = mixed if slices == 1 else mixed.where(F.pmod(F.xxhash64("key"), F.lit(slices)) == number)
            parts.append(staged(_tiled_pairs(own, most_bits, most_fine_bits, size_percent, nearest, most_bits_percent)
                                .distinct(), "close"))
            del own
            swept(members.sparkSession)
        del mixed
        pairs = staged(functools.reduce(DataFrame.unionByName, parts).distinct()
                       .join(tested, ["a", "b"], "left_anti"), "pairs")
        for part in parts:
            unstaged(part)
        more = staged(confirm(pairs), "links")
        unstaged(placed)
        if closer is None:
            unstaged(main)
        if not more.isEmpty():
            tested, links = tested.unionByName(pairs), links.unionByName(more)
            groups = connected_components(links)
        if nearest is None:         # all close pairs are compared
            break
    unstaged(members)
    return groups


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows by tile (``key``, ``p``, ``q``); ``asks`` says what a row does there."""
    blocks = lambda n: F.ceil(F.col(n) / TILE).cast("int")
    numbers = lambda n: F.sequence(F.lit(0), blocks(n) - 1)
    own = lambda n: F.pmod(F.xxhash64("node"), blocks(n)).cast("int")
    outside, one_tile = F.col("root") != F.col("main"), F.col("rows") <= TILE
    kept = [c for c in rows.columns if c not in ("main", "rows", "outside")]
    asked = rows.select(*kept, F.when(one_tile & outside, BOTH).otherwise(ASKED).alias("asks"),
                        F.explode(numbers("outside")).alias("p"), own("rows").alias("q"))
    asking = rows.where(outside & ~one_tile).select(*kept, F.lit(ASKS).alias("asks"), own("outside").alias("p"),
                                                    F.explode(numbers("rows")).alias("q"))
    return asked.unionByName(asking)


def _tiled_pairs(rows: DataFrame, most_bits: int, most_fine_bits: int, size_percent: int,
                 nearest: int | None, most_bits_percent: float | None) -> DataFrame:
    """Pairs of close rows of one key, one of them outside the main root, of different roots;
    with ``nearest``, each outside row only with that many of its closest in a tile.

    A key's rows are dealt into blocks of about ``TILE``; each block of outside rows meets
    each block of all rows in a tile of its own. Of a key that is one tile every row goes there once.
    """
    dealt = _dealt(rows)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by tile; the last tile of a batch may go on in the next one
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
            starts = _tile_starts(rows)
            yield from _close_pairs(rows.slice(0, starts[-1]), most_bits, most_fine_bits, size_percent, nearest,
                                    most_bits_percent)
            rest = rows.slice(starts[-1])
        if rest is not None:
            yield from _close_pairs(rest, most_bits, most_fine_bits, size_percent, nearest, most_bits_percent)

    return (dealt.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
            .mapInArrow(compare, "a long, b long"))


def _tile_starts(rows: pa.Table) -> np.ndarray:
    tile = np.stack([rows.column(c).to_numpy() for c in ("key", "p", "q")], 1)
    return np.append(0, np.flatnonzero((tile[1:] != tile[:-1]).any(1)) + 1)


def _bitmaps(rows: pa.Table, column: str) -> np.ndarray | None:
    if column not in rows.column_names:
        return None
    flat = rows.column(column).combine_chunks().flatten().to_numpy()
    return flat.view(np.uint64).reshape(rows.num_rows, -1)


def _close_pairs(rows: pa.Table, most_bits: int, most_fine_bits: int, size_percent: int,
                 nearest: int | None, most_bits_percent: float | None) -> Iterator[pa.RecordBatch]:
    """Pairs of whole tiles: all asking rows of a tile with all its other rows, many tiles at once."""
    if not rows.num_rows:
        return
    rows = rows.combine_chunks()
    asks = rows.column("asks").to_numpy()
    node, size, shared, root, key = (rows.column(c).to_numpy() for c in ("node", "size", "shared", "root", "key"))
    bits, fine, keys = (_bitmaps(rows, c) for c in ("bits", "fine", "keys"))
    starts = _tile_starts(rows)
    ends = np.append(starts[1:], rows.num_rows)
    tile = np.repeat(np.arange(len(starts)), ends - starts)
    # in each tile the rows asked come first
    order = np.lexsort((asks == ASKS, tile))
    others = np.bincount(tile, asks != ASKS, len(starts)).astype(np.int64)
    asking = order[asks[order] != ASKED]
    counts = others[tile[asking]]
    limit = np.cumsum(counts)
    at = 0
    while at < len(asking):             # about a quarter of a million pairs at a time
        to = max(at + 1, int(np.searchsorted(limit, (limit[at - 1] if at else 0) + (1 << 18), side="right")))
        own, n = asking[at:to], counts[at:to]
        at = to
        i = np.repeat(own, n)
        first = np.repeat(starts[tile[own]] - np.cumsum(n) + n, n)
        j = order[np.arange(len(i)) + first]
        common = np.minimum(shared[i], shared[j])
        fits = (root[i] != root[j]) & (100 * common >= size_percent * (size[i] + size[j] - common))
        i, j = i[fits], j[fits]
        differ = np.bitwise_count(bits[i] ^ bits[j]).sum(1, dtype=np.int64)
        close = differ <= most_bits
        if most_bits_percent is not None:
            close &= 100 * differ <= most_bits_percent * np.maximum(size[i], size[j])
        i, j, differ = i[close], j[close], differ[close]
        if nearest is not None and len(i):
            rank = np.lexsort((differ, i))
            new = np.append(True, i[rank][1:] != i[rank][:-1])
            place = np.arange(len(rank)) - np.maximum.accumulate(np.where(new, np.arange(len(rank)), 0))
            chosen = rank[place < nearest]
            i, j = i[chosen], j[chosen]
        if keys is not None and len(i):     # the first bucket that two rows share makes their pair
            place = (keys[i] == keys[j]).argmax(1)
            mine = keys[i, place].view(np.int64) == key[i]
            i, j = i[mine], j[mine]
        if fine is not None and len(i):
            close = np.bitwise_count(fine[i] ^ fine[j]).sum(1, dtype=np.int64) <= most_fine_bits
            i, j = i[close], j[close]
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])),
                                              pa.array(np.maximum(node[i], node[j]))], names=["a", "b"])
