"""A prefix trie of conversations, built as a table: a Z-fast trie filled in batches.

A prefix of d turns is known by a 128-bit hash, the exclusive or of the hashes of its (place,
turn) pairs, so prefix hashes are running sums. Conversations are cut at every CHUNK turns;
a piece starts at the node of its first turns, and equal pieces are one. No row, window or
task ever holds a whole conversation, however long it is.

Nodes that branch, or where a piece ends, are rows of a table keyed by the hash at their
handle: the depth in their edge that the most powers of two divide (the two-fattest). A fat
binary search (Belazzougui, Boldi, Pagh and Vigna, 2009) finds the node under which a piece
leaves the trie in one join per bit of its length. A batch splits the edges that pieces leave
and hangs one piece, the least by a hash, under every new turn; the others of that turn search
on from where they left in the next batch, in which those that still go the same way halve in
expectation. At the end edges are expanded into the nodes of all depths.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from thresher.llm.staging import staged, unstaged

CHUNK = 256                 # turns of a piece; bounds every array
SUPER = 4096                # pieces whose sums one window orders
WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 8192                # bytes of ids in a row on their way to the hasher
NO_ENDS = hashlib.sha256(b"").hexdigest()


# ---- turns ----

def numbered_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                   role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, pos, key, n_words): turns by ``turn``, null first, from 1; equal ones by ``key``.

    ``key`` is a hash of role and text (null: empty). Rows without a conversation are left out.
    Range partitions cut long conversations anywhere; a partition numbers its own rows, and
    only conversations that a border cuts, at most one a partition, get an offset.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.md5(F.concat(F.md5(role), F.md5(text))).alias("key"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "key"]
    ordered = (rows.repartitionByRange(*order).sortWithinPartitions(*order)
               .select("conv_id", "key", "n_words", F.spark_partition_id().alias("part")))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv_id").to_numpy()
            starts = np.flatnonzero(np.append(True, conv[1:] != conv[:-1]))
            place = np.arange(1, len(conv) + 1) - np.repeat(
                starts, np.diff(np.append(starts, len(conv))))
            if conv[0] == last:
                place[:starts[1] if len(starts) > 1 else None] += seen
            last, seen = conv[-1], int(place[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)],
                                             names=["conv_id", "key", "n_words", "part", "here"])

    # written, so that the borders are the same for all that reads it
    numbered = staged(ordered.mapInArrow(
        number, "conv_id long, key string, n_words long, part int, here long"), "trie-turns")
    sizes = numbered.groupBy("conv_id", "part").agg(F.max("here").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (sizes.withColumn("before", F.sum("n").over(before)).where("before is not null")
               .select("conv_id", "part", "before"))
    return (numbered.join(F.broadcast(offsets), ["conv_id", "part"], "left")
            .select("conv_id", (F.col("here") + F.coalesce("before", F.lit(0))).alias("pos"), "key", "n_words"))


def share_heads(turns: DataFrame, ids: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Turns of conversations that begin alike: the first h of c become those of c - c % every.

    h is the CRC-32 of c, in decimal, modulo ``most``. All turns of the base are taken if there
    are fewer, none if it is absent; the conversation's own turns follow after its first h.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    firsts = turns.where((F.col("pos") < most) & (F.col("conv_id") % every == 0)).select(
        F.col("conv_id").alias("base"), "pos", "key", "n_words")
    taken = (ids.select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
             .where("h > 0"))
    heads = taken.join(firsts, "base").where("pos <= h").select("conv_id", "pos", "key", "n_words")
    # what is missing at the front where the base has fewer than h turns
    short = (taken.join(firsts.groupBy("base").agg(F.max("pos").alias("has")), "base", "left")
             .select("conv_id", (F.col("h") - F.coalesce("has", F.lit(0))).alias("lack")).where("lack > 0"))
    own = (turns.where(F.col("pos") > h).join(short, "conv_id", "left")
           .select("conv_id", (F.col("pos") - F.coalesce("lack", F.lit(0))).alias("pos"), "key", "n_words"))
    return own.unionByName(heads)


# ---- pieces ----

def _xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def _pieces(turns: DataFrame) -> DataFrame:
    """(conv_id, chunk, at): ``at[i]`` holds the hash (a, b) and the words d of the prefix of
    CHUNK * chunk + i turns; ``at[0]`` is where the piece starts."""
    key = ["conv_id", "chunk"]
    rows = turns.select("conv_id", F.floor((F.col("pos") - 1) / CHUNK).alias("chunk"), "pos",
                        F.xxhash64("pos", "key").alias("a"),
                        F.xxhash64(F.lit(1), "key", "pos").alias("b"), F.col("n_words").alias("d"))
    running = Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.select(*key, "pos", *[f(c).over(running).alias(c) for c, f in
                                        (("a", F.bit_xor), ("b", F.bit_xor), ("d", F.sum))])
    pieces = inside.groupBy(*key).agg(F.transform(
        F.sort_array(F.collect_list(F.struct("pos", "a", "b", "d"))),
        lambda x: F.struct(x["a"], x["b"], x["d"])).alias("inner"))

    # full pieces are what others follow; their sums run in two levels
    full = pieces.where(F.size("inner") == CHUNK).select(
        *key, F.floor(F.col("chunk") / SUPER).alias("super"), F.element_at("inner", -1).alias("s"))
    level = Window.partitionBy("conv_id", "super").orderBy("chunk")
    over = Window.partitionBy("conv_id").orderBy("super").rowsBetween(Window.unboundedPreceding, -1)
    parts = (("a", F.bit_xor, _xor), ("b", F.bit_xor, _xor), ("d", F.sum, lambda x, y: x + y))
    supers = full.groupBy("conv_id", "super").agg(*[f(f"s.{c}").alias(c) for c, f, _ in parts])
    supers = supers.select("conv_id", "super", *[f(c).over(over).alias(f"o{c}") for c, f, _ in parts])
    starts = full.join(supers, ["conv_id", "super"]).select(
        "conv_id", (F.col("chunk") + 1).alias("chunk"),
        *[g(f(f"s.{c}").over(level), F.coalesce(f"o{c}", F.lit(0))).alias(c) for c, f, g in parts])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    joined = pieces.join(starts, key, "left").select(
        *key, F.struct(zero("a").alias("a"), zero("b").alias("b"), zero("d").alias("d")).alias("s"), "inner")
    return joined.select(*key, F.concat(F.array("s"), F.transform("inner", lambda x: F.struct(
        _xor(x["a"], F.col("s.a")).alias("a"), _xor(x["b"], F.col("s.b")).alias("b"),
        (x["d"] + F.col("s.d")).alias("d")))).alias("at"))


# ---- the trie ----

def _fattest(low: Column, high: Column) -> Column:
    """The number in (low, high] that the largest power of two divides."""
    bit = F.length(F.bin(_xor(low.cast("long"), high.cast("long")))) - 1
    return F.call_function("shiftleft", F.call_function("shiftright", high, bit), bit)


def _edges(rows: DataFrame) -> DataFrame:
    """(chunk, lo, at) as edges: ``at`` runs from the upper node, ``lo`` turns into the piece, to
    the lower one, ``hi`` turns in. p, n, f, x: hashes of the upper node, of one turn further,
    of the handle and of the lower node."""
    rows = rows.withColumn("hi", F.col("lo") + F.size("at") - 1)
    handle = F.get("at", _fattest(F.col("lo"), F.col("hi")) - F.col("lo"))
    return rows.select("chunk", "lo", "hi", "at", *[
        hash_of[c].alias(f"{name}{c}") for name, hash_of in (
            ("p", F.get("at", F.lit(0))), ("n", F.get("at", F.lit(1))), ("f", handle),
            ("x", F.element_at("at", -1))) for c in ("a", "b")])


def _search(pieces: DataFrame, edges: DataFrame, steps: int) -> DataFrame:
    """Pieces with ``low``, the depth where they leave the trie, and n of the edge left inside."""
    size = F.size("at") - 1
    state = pieces.withColumn("high", size)
    # rows that have ended look up a key that no node has, and are spread
    ended = (F.lit(-1) - F.col("xb")).alias("kb")
    handles = edges.select(F.col("fa").alias("ka"), F.col("fb").alias("kb"), F.col("hi").alias("to"),
                           F.col("xa").alias("ta"), F.col("xb").alias("tb"))
    for _ in range(steps):
        on = F.get("at", _fattest(F.col("low"), F.col("high")))
        going = F.col("low") < F.col("high")
        state = state.withColumn("ka", F.when(going, on["a"]).otherwise(F.col("xa"))).withColumn(
            "kb", F.when(going, on["b"]).otherwise(ended))
        there = F.get("at", F.col("to"))
        below = F.coalesce((there["a"] == F.col("ta")) & (there["b"] == F.col("tb")), F.lit(False))
        found = F.col("to").isNotNull()
        state = state.join(handles, ["ka", "kb"], "left").select(
            "chunk", "at", "xa", "xb",
            # a node whose handle fits but whose end does not is where the piece leaves
            F.when(found & below, F.col("to")).otherwise(F.col("low")).alias("low"),
            F.when(~going | (found & below), F.col("high")).when(found, F.col("low"))
            .otherwise(_fattest(F.col("low"), F.col("high")) - 1).alias("high"))
    name = F.get("at", F.col("low") + 1)
    state = state.select("chunk", "at", "xa", "xb", "low",
                         F.coalesce(name["a"], F.col("xa")).alias("na"),
                         F.when(F.col("low") < size, name["b"]).otherwise(ended).alias("nb"))
    exits = edges.select("na", "nb", "hi", F.col("at").alias("edge"))
    alike = F.size(F.filter("edge", lambda e, i: (i > 0) & (
        F.get("at", F.col("low") + i)["a"] == e["a"]) & (F.get("at", F.col("low") + i)["b"] == e["b"])))
    return (state.join(exits, ["na", "nb"], "left")
            .withColumn("shared", F.when(F.col("edge").isNotNull(), alike).otherwise(0))
            .select("chunk", "at", "xa", "xb", (F.col("low") + F.col("shared")).alias("low"),
                    "na", "nb", ((F.col("shared") > 0) & (F.col("low") + F.col("shared") < F.col("hi"))).alias("splits")))


def _inserted(edges: DataFrame | None, located: DataFrame) -> DataFrame:
    """The edges after a batch: those left inside are split, one new piece hangs under each turn."""
    name = F.get("at", F.col("low") + 1)
    new = (located.where(F.col("low") < F.size("at") - 1)
           .groupBy(name["a"].alias("na"), name["b"].alias("nb"))
           .agg(F.min_by(F.struct("chunk", "low", "at"), F.xxhash64("xa", "xb", F.lit(7))).alias("one"))
           .select("one.chunk", F.col("one.low").alias("lo"),
                   F.slice("one.at", F.col("one.low") + 1, F.size("one.at") - F.col("one.low")).alias("at")))
    if edges is None:
        return _edges(new)
    cuts = located.where("splits").groupBy("na", "nb").agg(
        F.sort_array(F.collect_set("low")).alias("cuts"))
    borders = F.concat(F.array("lo"), F.coalesce("cuts", F.array().cast("array<int>")), F.array("hi"))
    parts = (edges.join(cuts, ["na", "nb"], "left").withColumn("borders", borders)
             .select("chunk", "lo", "at", "borders",
                     F.explode(F.sequence(F.lit(0), F.size("borders") - 2)).alias("i"))
             .select("chunk", F.get("borders", "i").alias("low"), F.get("borders", F.col("i") + 1).alias("high"), "lo", "at")
             .select("chunk", F.col("low").alias("lo"),
                     F.slice("at", F.col("low") - F.col("lo") + 1, F.col("high") - F.col("low") + 1).alias("at")))
    return _edges(parts.unionByName(new))


def compacted_trie(pieces: DataFrame) -> DataFrame:
    """All edges of the Z-fast trie of ``pieces`` (chunk, at, xa, xb)."""
    located, edges = pieces.withColumn("low", F.lit(0)).withColumn("splits", F.lit(False)), None
    while True:
        grown = staged(_inserted(edges, located), "trie-edges")
        pending = located.where(F.col("low") < F.size("at") - 1).select("chunk", "at", "xa", "xb", "low")
        bits = F.length(F.bin(_xor(F.col("low").cast("long"), (F.size("at") - 1).cast("long"))))
        steps = pending.agg(F.max(bits)).first()[0]
        unstaged(edges)
        edges = grown
        if steps is None:
            return edges
        found = staged(_search(pending, edges, steps), "trie-located")
        unstaged(located)
        located = found


# ---- sums over subtrees ----

def _subtree_sums(nodes: DataFrame) -> DataFrame:
    """Sums (n, s, leaves, w) and the least id over every node's subtree.

    After k rounds a node holds the sums of its descendants less than 2^k below it, and knows
    its ancestor 2^k above: it takes on the sums of those whose ancestor it is. The number of
    rounds is the logarithm of the height.
    """
    sums = ("n", "s", "leaves", "w")
    while True:
        above = nodes.where("ua is not null")
        if above.isEmpty():
            return nodes
        gained = above.groupBy(F.col("ua").alias("xa"), F.col("ub").alias("xb")).agg(
            *[F.sum(c).alias(f"g_{c}") for c in sums], F.min("least").alias("g_least"))
        # the root has none above it: its many children need not ask
        asks = F.col("ua").isNotNull() & ((F.col("ua") != 0) | (F.col("ub") != 0))
        next_up = nodes.where("ua is not null").select(
            F.col("xa").alias("ja"), F.col("xb").alias("jb"), F.col("ua").alias("va"), F.col("ub").alias("vb"))
        grown = (nodes.join(gained, ["xa", "xb"], "left")
                 .withColumn("ja", F.when(asks, F.col("ua")).otherwise(F.col("xa")))
                 .withColumn("jb", F.when(asks, F.col("ub")).otherwise(F.lit(-1) - F.col("xb")))
                 .join(next_up, ["ja", "jb"], "left")
                 .select("xa", "xb", F.col("va").alias("ua"), F.col("vb").alias("ub"),
                         *[(F.col(c) + F.coalesce(f"g_{c}", F.lit(0))).alias(c) for c in sums],
                         F.least("least", "g_least").alias("least")))
        grown = staged(grown, "trie-sums")
        unstaged(nodes)
        nodes = grown


def _end_digests(ends: DataFrame) -> DataFrame:
    """(xa, xb, sha): SHA-256 of each node's ids, ascending, joined by commas.

    Range partitions pack ids into blocks, wherever a border falls; a node's blocks then pass
    through one hasher in order, a block at a time, as the digest demands.
    """
    order = ["xa", "xb", "conv_id"]
    packed_schema = "xa long, xb long, first long, ids string"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, ids = (batch.column(c).to_numpy() for c in order)
            if not len(ids):
                continue
            cut = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            bounds = [(at, min(at + BLOCK // 21, end)) for s, end in zip(cut, np.append(cut[1:], len(ids)))
                      for at in range(s, end, BLOCK // 21)]
            at = [s for s, _ in bounds]
            yield pa.RecordBatch.from_arrays(
                [pa.array(a[at]), pa.array(b[at]), pa.array(ids[at]),
                 pa.array([",".join(map(str, ids[s:e].tolist())) for s, e in bounds])],
                names=["xa", "xb", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, hasher = None, None

        def rows(found):
            return pa.RecordBatch.from_pylist(
                found, pa.schema([("xa", pa.int64()), ("xb", pa.int64()), ("sha", pa.string())]))
        for batch in batches:
            done = []
            for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("xa", "xb", "ids"))):
                if node != (a, b):
                    if hasher:
                        done.append({"xa": node[0], "xb": node[1], "sha": hasher.hexdigest()})
                    node, hasher = (a, b), hashlib.sha256(ids.encode())
                else:
                    hasher.update(b"," + ids.encode())
            yield rows(done)
        if hasher:
            yield rows([{"xa": node[0], "xb": node[1], "sha": hasher.hexdigest()}])

    packed = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pack, packed_schema)
    return (packed.repartition("xa", "xb").sortWithinPartitions("xa", "xb", "first")
            .mapInArrow(digest, "xa long, xb long, sha string"))


def prefix_trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """The trie of conversations: one row per distinct sequence of first turns, and its root.

    ``turns`` is (conv_id, pos, key, n_words) with places from 1 without gaps, as
    ``numbered_turns`` gives it; ``ids`` lists all conversations once, also those without turns.
    Returns, per node: ``conv_id`` (the smallest member), ``depth``, ``parent_conv_id`` (null for
    the root), ``n_convs`` (members: conversations that start so), ``n_children``, ``n_leaves``
    (childless nodes in its subtree, itself included), ``saved_tokens`` (over its subtree, a
    node's members but one times the words of its last turn), ``ends_sha256`` (of the members
    that end there).

    Turns are told apart by 128-bit hashes. Conversations without turns are members of the root
    only; without any conversation there is no node. Equal conversations share all nodes.
    """
    pieces = staged(_pieces(turns), "trie-pieces")
    last = F.element_at("at", -1)
    ends = pieces.groupBy("conv_id").agg(F.max_by(last, "chunk").alias("x"))
    zero = F.lit(0).cast("long")
    ends = staged(ids.select("conv_id").join(ends, "conv_id", "left").select(
        "conv_id", *[F.coalesce(F.col(f"x.{c}"), zero).alias(f"x{c}") for c in ("a", "b", "d")]), "trie-ends")
    distinct = staged(pieces.groupBy(last["a"].alias("xa"), last["b"].alias("xb")).agg(
        F.any_value("chunk").alias("chunk"), F.any_value("at").alias("at")), "trie-distinct")
    unstaged(pieces)
    edges = compacted_trie(distinct)

    ended = ends.groupBy("xa", "xb").agg(F.count("*").alias("n"), F.min("conv_id").alias("least"),
                                         F.sum("xd").alias("s"))
    kids = edges.groupBy(F.col("pa").alias("xa"), F.col("pb").alias("xb")).agg(F.count("*").alias("kids"))
    root = ids.sparkSession.range(1).select(
        zero.alias("xa"), zero.alias("xb"), F.lit(None).cast("long").alias("ua"),
        F.lit(None).cast("long").alias("ub"), zero.alias("w"))
    words = F.element_at("at", -1)["d"] - F.get("at", F.lit(0))["d"]
    nodes = (edges.select("xa", "xb", F.col("pa").alias("ua"), F.col("pb").alias("ub"), words.alias("w"))
             .unionByName(root)
             .join(ended, ["xa", "xb"], "left").join(kids, ["xa", "xb"], "left")
             .select("xa", "xb", "ua", "ub", F.coalesce("n", zero).alias("n"), F.coalesce("s", zero).alias("s"),
                     F.when(F.col("kids").isNull(), 1).otherwise(0).cast("long").alias("leaves"), "w", "least"))
    total = _subtree_sums(staged(nodes, "trie-nodes")).select("xa", "xb", "n", "s", "leaves", "w", "least")
    top = total.where("xa = 0 and xb = 0").first()      # one row
    facts = (total.join(kids, ["xa", "xb"], "left").join(_end_digests(ends), ["xa", "xb"], "left")
             .withColumn("kids", F.coalesce("kids", zero))
             .withColumn("sha", F.coalesce("sha", F.lit(NO_ENDS))))

    # parents: the root is known, so its many children need not look it up
    is_top = (F.col("pa") == 0) & (F.col("pb") == 0)
    parents = total.select(F.col("xa").alias("ja"), F.col("xb").alias("jb"), F.col("least").alias("upper"))
    wide = (edges.select("chunk", "lo", "at", "pa", "pb", "xa", "xb").join(facts, ["xa", "xb"])
            .withColumn("ja", F.when(is_top, F.col("xa")).otherwise(F.col("pa")))
            .withColumn("jb", F.when(is_top, F.lit(-1) - F.col("xb")).otherwise(F.col("pb")))
            .join(parents, ["ja", "jb"], "left")
            .withColumn("upper", F.when(is_top, F.lit(top["least"])).otherwise(F.col("upper"))))
    size = F.size("at")
    spread = wide.select("*", F.posexplode(F.slice("at", 1, size - 1)).alias("i", "before"))
    first, final = F.col("i") == 0, F.col("i") == size - 2
    start = F.get("at", F.lit(0))["d"]
    below = F.col("before.d")
    out = spread.select(
        F.col("least").alias("conv_id"),
        (F.col("chunk") * CHUNK + F.col("lo") + F.col("i") + 1).cast("long").alias("depth"),
        F.when(first, F.col("upper")).otherwise(F.col("least")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(final, F.col("kids")).otherwise(1).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        # members times words from here down, less one of each edge's words from here down
        (F.col("s") - F.col("n") * below - F.col("w") + (below - start)).alias("saved_tokens"),
        F.when(final, F.col("sha")).otherwise(NO_ENDS).alias("ends_sha256"))
    whole = facts.where("xa = 0 and xb = 0 and n > 0").select(
        F.col("least").alias("conv_id"), zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("s") - F.col("w")).alias("saved_tokens"), F.col("sha").alias("ends_sha256"))
    return out.unionByName(whole)
