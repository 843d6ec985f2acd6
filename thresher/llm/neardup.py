"""Near-duplicates: MinHash bands propose pairs, odd sketches sift them, full sets confirm."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from thresher.llm.linking import linked_groups
from thresher.llm.staging import staged
from thresher.llm.urls import blocked_bloom, might_hold
from thresher.llm.words import WordHashes, mix, rolling, slices, split_words

MISSING_ID = (1 << 63) - 1          # a null id comes after all others
BASE = 0x9E3779B97F4A7C15
BANDS, BAND_ROWS = 36, 5            # a pair at 0.8 shares no band with probability 6e-7
SKETCH_BITS = 1024
FINE_SAMPLES, FINE_BITS, FINE_SIFT = 1440, 4096, 0.747    # as rare, for a pair at 0.8
FILTER_BLOCKS = 1 << 15
SIFT = 0.66                         # the share of 180 samples is as low for a pair at 0.8 once in 10^6


def shingle_sets(texts: list[bytes], cache: WordHashes, n: int) -> list[np.ndarray]:
    """Distinct hashes of the ``n``-word shingles of each text, A-Z lower-cased; a text
    with fewer words is one shingle, one without words has none."""
    _, hashes, ends = split_words([text.lower() for text in texts], cache)
    runs = rolling(hashes, n, BASE)
    out, begin = [], 0
    for end in ends.tolist():
        if end - begin >= n:
            out.append(np.unique(runs[begin:end - n + 1]))
        elif end > begin:
            out.append(mix(rolling(hashes[begin:end], end - begin, BASE)
                           + np.uint64(end - begin)))
        else:
            out.append(np.empty(0, np.uint64))
        begin = end
    return out


class MinHash:
    """Least values of ``bands * rows`` hash functions, and their folds."""

    def __init__(self, bands: int, rows: int, bits: int, seed: int = 4) -> None:
        rng = np.random.default_rng(seed)
        self.bands, self.rows, self.bits = bands, rows, bits
        self.factors = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.salts = mix(np.arange(1, bands * rows + 1, dtype=np.uint64))

    def samples(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row per set that is not empty."""
        sets = [s for s in sets if len(s)]
        values = np.concatenate(sets or [np.empty(0, np.uint64)])
        begins = np.cumsum([0] + [len(s) for s in sets])
        out = np.empty((len(sets), len(self.factors)), np.uint64)
        at = 0
        while at < len(sets):       # a few thousand values at a time stay in the cache
            to = max(at + 1, int(np.searchsorted(begins, begins[at] + 8192, side="right")) - 1)
            own, cuts = values[begins[at]:begins[to]], begins[at:to] - begins[at]
            for j, factor in enumerate(self.factors):
                out[at:to, j] = np.minimum.reduceat(own * factor, cuts)
            at = to
        return out

    def band_keys(self, samples: np.ndarray) -> np.ndarray:
        keys = np.zeros((len(samples), self.bands), np.uint64) + self.salts[:self.bands]
        folded = samples.reshape(len(samples), self.bands, self.rows)
        for r in range(self.rows):
            keys = mix(keys ^ folded[:, :, r]) if r else mix(keys + folded[:, :, r])
        return keys

    def odd_sketches(self, samples: np.ndarray) -> np.ndarray:
        """Parity bitmaps of (function, sample) pairs, as 64-bit words."""
        spot = (mix(samples ^ self.salts) % np.uint64(self.bits)).astype(np.int64)
        spot += np.arange(len(samples))[:, None] * self.bits
        parity = np.bincount(spot.ravel(), minlength=len(samples) * self.bits) & 1
        return np.packbits(parity.astype(np.uint8).reshape(len(samples), self.bits),
                           axis=1, bitorder="little").view(np.uint64)


def most_differing(bits: int, samples: int, at_least: float) -> int:
    """The population count of the XOR of two sketches that a similarity allows."""
    elements = 2 * samples * (1 - at_least)         # those in one of the two sets only
    return math.ceil(bits / 2 * (1 - math.exp(-2 * elements / bits)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
                    threshold: int = 80, bands: int = BANDS, band_rows: int = BAND_ROWS,
                    bits: int = SKETCH_BITS) -> DataFrame:
    """Groups of documents whose word shingles have a Jaccard similarity of ``threshold`` percent.

    One row per input row: ``doc_id``, ``n_shingles``, ``component_id`` (the smallest id
    reachable over links) and ``kept`` (whether that is its own).

    Documents of equal sets are one class. Classes that share a MinHash band are candidates,
    odd sketches drop the hopeless ones, and every link is confirmed on the full sets. A true
    link is missed only if its pair shares no band.

    Null and empty texts have no shingles and link with nothing. Rows that repeat an id are
    one document of several texts. A null id comes after all others and stays null. An empty
    table gives no rows; other columns are ignored. Texts of any length count whole.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(MISSING_ID)).alias("doc"),
                       F.col(text_col).cast("string").alias("text")).withColumn("of_text", F.xxhash64("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, minhash = WordHashes(), MinHash(bands, band_rows, bits)
        for batch in slices(batches, most=2 << 20):
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            sets = shingle_sets(texts, cache, shingle)
            sizes = np.array([len(s) for s in sets], np.int64)
            samples = minhash.samples(sets)
            keys, sketches = minhash.band_keys(samples), minhash.odd_sketches(samples)
            full = iter(range(len(samples)))
            spot = [next(full) if n else None for n in sizes]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc"), batch.column("of_text"), pa.array(sizes),
                pa.array([int(mix(s).sum().view(np.int64)) for s in sets], pa.int64()),
                pa.array([int(mix(s ^ np.uint64(BASE)).sum().view(np.int64)) for s in sets], pa.int64()),
                pa.array([None if i is None else keys[i].view(np.int64) for i in spot], pa.list_(pa.int64())),
                pa.array([None if i is None else sketches[i].view(np.int64) for i in spot], pa.list_(pa.int64()))],
                names=["doc", "of_text", "size", "f", "g", "keys", "sketch"])

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in slices(slices(batches, "text_a", 2 << 20), "text_b", 2 << 20):
            known: dict[bytes, np.ndarray] = {}
            for side in ("text_a", "text_b"):
                new = list({*batch.column(side).cast(pa.binary()).to_pylist()} - known.keys())
                known.update(zip(new, shingle_sets(new, cache, shingle)))
            keep = []
            for x, y in zip(*(batch.column(side).cast(pa.binary()).to_pylist() for side in ("text_a", "text_b"))):
                common = len(np.intersect1d(known[x], known[y], assume_unique=True))
                keep.append(100 * common >= threshold * (len(known[x]) + len(known[y]) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    signed = staged(rows.mapInArrow(
        sign, "doc long, of_text long, size long, f long, g long, keys array<long>, sketch array<long>"), "signed")
    rows_signed, ids = signed.agg(F.count("*"), F.count_distinct("doc")).first()
    # a class goes by its least id; where ids repeat, two classes may have the same, so by its hashes
    node = F.col("first.doc") if ids == rows_signed else F.xxhash64("f", "g", "size")
    classes = (signed.where("size > 0").groupBy("f", "g", "size")
               .agg(F.min_by(F.struct("doc", "of_text", "keys", "sketch"), F.struct("doc", "of_text")).alias("first"))
               .select("f", "g", "size", node.alias("node"), "first.doc", "first.of_text", "first.keys",
                       "first.sketch"))
    classes = staged(classes, "classes")
    of_doc = signed.where("size > 0").select("doc", "f", "g", "size").join(
        classes.select("f", "g", "size", "node"), ["f", "g", "size"]).select("doc", "size", "node")
    same_id = None
    if ids < rows_signed:       # several texts under one id link their classes
        first = of_doc.groupBy("doc").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z")
        same_id = of_doc.join(first, "doc").select("a", F.col("node").alias("b")).where("a != b").distinct()

    def texts_of(nodes: DataFrame) -> DataFrame:
        # only texts that are needed are moved: the filter has a fixed size, the join is exact
        found = nodes.join(classes.select("node", "doc", "of_text"), "node")
        bloom = blocked_bloom(found.select(F.xxhash64("doc").alias("h")), "h", FILTER_BLOCKS).scalar()
        texts = rows.where(might_hold(bloom, F.xxhash64("doc"))).dropna().join(found, ["doc", "of_text"])
        return texts if same_id is None else texts.dropDuplicates(["node"])

    def confirmed(pairs: DataFrame) -> DataFrame:
        nodes = staged(pairs.select(F.col("a").alias("node")).unionByName(
            pairs.select(F.col("b").alias("node"))).distinct(), "wanted")
        texts = texts_of(nodes)
        pair_texts = (pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
                      .join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b"))
        return pair_texts.mapInArrow(confirm, "a long, b long").distinct()

    def list_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in slices(batches, most=1 << 20):
            sets = shingle_sets(batch.column("text").cast(pa.binary()).to_pylist(), cache, shingle)
            of = pa.array(np.repeat(np.arange(len(sets)), list(map(len, sets))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("node").take(of), batch.column("outside").take(of),
                 pa.array(np.concatenate(sets).view(np.int64))], names=["node", "outside", "h"])

    def sketch_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, minhash = WordHashes(), MinHash(FINE_SAMPLES, 1, FINE_BITS, seed=5)
        for batch in slices(batches, most=1 << 20):
            sets = shingle_sets(batch.column("text").cast(pa.binary()).to_pylist(), cache, shingle)
            sketches = minhash.odd_sketches(minhash.samples(sets)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(list(sketches), pa.list_(pa.int64()))],
                                             names=["node", "fine"])

    def closer(nodes: DataFrame) -> DataFrame:
        texts = staged(texts_of(staged(nodes, "wanted")), "texts")
        found = staged(texts.select("node", "outside", "text")
                       .mapInArrow(list_shingles, "node long, outside boolean, h long"), "shingles")
        several = found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
        own = found.where("outside").join(several, "h").groupBy("node").agg(F.count("*").alias("shared"))
        sketches = texts.select("node", "text").mapInArrow(sketch_again, "node long, fine array<long>")
        sizes = classes.select("node", "size", "keys")
        return (texts.select("node", "outside").join(own, "node", "left").join(sketches, "node").join(sizes, "node")
                .select("node", "fine", "keys", F.when(F.col("outside"), F.coalesce("shared", F.lit(0)))
                        .otherwise(F.col("size")).alias("shared")))

    members = classes.select(F.explode("keys").alias("key"), "node")
    traits = classes.select("node", "size", F.col("sketch").alias("bits"))
    groups = linked_groups(members, traits, confirmed, most_differing(bits, bands * band_rows, SIFT),
                           threshold, same_id, closer if same_id is None else None,
                           most_differing(FINE_BITS, FINE_SAMPLES, FINE_SIFT))
    found = of_doc.join(groups, "node", "left").select(
        "doc", "size", F.coalesce("root", "node").alias("root"))
    if same_id is not None:
        least = (classes.join(groups, "node", "left").groupBy(F.coalesce("root", "node").alias("root"))
                 .agg(F.min("doc").alias("least")))
        found = found.join(least, "root").select("doc", "size", F.col("least").alias("root"))
    alone = signed.where("size = 0").select("doc", "size", F.col("doc").alias("root"))
    return found.unionByName(alone).select(
        F.when(F.col("doc") != MISSING_ID, F.col("doc")).alias("doc_id"), F.col("size").alias("n_shingles"),
        F.when(F.col("root") != MISSING_ID, F.col("root")).alias("component_id"),
        (F.col("doc") == F.col("root")).alias("kept"))
